import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from sessionlens import cli
from sessionlens.detectors.base import EVENTS, Frames
from sessionlens.functions import code, text
from sessionlens.operators import predicates as pr
from sessionlens.plans import report
from sessionlens.sinks import render
from sessionlens.sources import lines, registry, repo

from . import logs


@pytest.fixture(scope="module")
def everything(spark, tmp_path_factory):
    path = logs.write(tmp_path_factory.mktemp("log") / "-w-app", logs.EVERYTHING)
    frames = registry.SOURCES["jsonl"].load(spark, path)
    frames.events.cache(), frames.sessions.cache()
    found = report.all_findings(frames).cache()
    return path, frames, found


def test_session_counts_and_usage(everything):
    _, frames, _ = everything
    s = frames.sessions.first()
    assert (s["session_id"], s["cwd"], s["git_branch"], s["versions"]) == ("all", "/w/app", "dev", ["2.1.9"])
    assert (s["malformed_lines"], s["sidechain_events"], s["compacted"]) == (1, 1, False)
    assert s["unrecognized"] == {"queue-note": 1, "enclosure": 1, "mystery": 1}
    assert s["usage"].asDict() == {"input": 21, "output": 34, "cache_creation": 47, "cache_read": 60}  # m1 once, no sidechain
    kinds = {r["kind"]: r["count"] for r in frames.events.groupBy("kind").count().collect()}
    assert kinds == {"prompt": 1, "assistant_text": 2, "tool_call": 7, "tool_result": 1}


def test_findings_of_everything(everything):
    _, _, found = everything
    rows = {r["detector"]: r for r in found.collect()}
    assert set(rows) == {"instruction-violation", "test-integrity", "rework-loop"}
    d1, d2, d3 = (rows[k] for k in ("instruction-violation", "test-integrity", "rework-loop"))
    assert (d1["severity"], d1["confidence"], d1["detail"]) == (2, 2, "Agent edited settings.yaml")
    assert d1["title"] == 'You said: "Do not modify settings.yaml"'
    assert d2["severity"] == 2 and d2["title"].startswith("cache_test.go: 1 assertion(s) removed, assertion weakened (Equal")
    assert d3["severity"] == 1 and d3["title"] == "cache.go rewritten 3× (10:05, 10:20, 10:30)"
    assert "edit at 10:30 reverses the edit at 10:20 (A→B→A)" in d3["detail"]
    assert d3["tokens_est"] == 60 + 6 + 6 + 6 + 15 + 3 + 6


def test_report_formats(everything):
    _, frames, found = everything
    s, rows = render.report_rows(report.reports(frames, found), found)
    out = json.loads(render.as_json(s, rows))
    assert out["tokens"]["fresh"] == 102 and len(out["findings"]) == 3 and out["diagnostics"]["malformed_lines"] == 1
    assert [f["severity"] for f in out["findings"]] == ["violation", "violation", "warning"]
    page = render.as_html(s, [*rows, rows[0] | {"title": "<script>"}])
    assert "<script>" not in page and "&lt;script&gt;" in page
    uuids = {u for r in rows for u in r["event_uuids"]}
    assert s["clean_events"] == len({"u1", "a1", "a2", "u2", "a3", "a4", "a5", "a6", "a7", "a8"} - uuids)
    trend = json.loads(render.trend_json(report.trend(frames.sessions, found)))
    assert trend["totals"] == {"instruction-violation": 1, "test-integrity": 1, "rework-loop": 1, "hallucinated-api": 0}


def test_commands(spark, everything, tmp_path, capsys):
    root = everything[0].rsplit("/", 2)[0]
    args = ["--cwd", "/w/app", "--root", f"jsonl={root}"]
    assert cli.main(["analyze", *args, "--explain", "--fail-on", "violation"], spark) == 1
    assert "REWORK LOOPS (1)" in capsys.readouterr().out
    assert cli.main(["trend", *args], spark) == 0 and cli.main(["sessions", *args], spark) == 0
    out = capsys.readouterr().out
    assert "TOTALS" in out and "Add a cache. Do not modify settings.yaml." in out
    assert cli.main(["analyze", *args, "--session", "nope"], spark) == 1


def events(spark, rows):
    shape = spark.createDataFrame([], EVENTS).schema
    full = [{f.name: None for f in shape} | {"session_id": "s", "seq": i, "uuid": str(i), "text": ""} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[f.name] for f in shape) for r in full], shape)


def at(minute):
    import datetime as dt

    return dt.datetime(2026, 1, 1, 12) + dt.timedelta(minutes=minute)


def prompt(m, t):
    return {"kind": "prompt", "ts": at(m), "text": t}


def edited(m, path, old="a", new="b", tool="Edit"):
    return {"kind": "tool_call", "ts": at(m), "tool": tool, "file_path": path, "old_string": old, "new_string": new}


def shell(m, command):
    return {"kind": "tool_call", "ts": at(m), "tool": "Bash", "command": command}


SQUEEZE = {"kind": "compaction", "ts": at(3)}


@pytest.mark.parametrize(
    ("rows", "n", "confidence"),
    [
        ([prompt(0, "don't touch a.yaml"), edited(1, "/r/a.yaml")], 1, 2),
        ([prompt(0, "don't touch a.yaml"), prompt(1, "ok go ahead"), edited(2, "/r/a.yaml")], 0, None),
        ([prompt(0, "don't touch a.yaml"), edited(1, "/r/a.yaml"), prompt(2, "never mind")], 1, 2),
        ([prompt(0, "please only edit src/x.go"), edited(1, "/r/src/y.go"), edited(2, "/r/src/x.go"), edited(3, "/r/new.go", tool="Write")], 1, 1),
        ([prompt(0, "Leave conf/ alone please"), shell(1, "rm -rf conf/old")], 1, 1),
        ([prompt(0, "do not edit a.yaml"), shell(1, "cat a.yaml")], 0, None),
        ([prompt(0, "do not edit a.yaml"), SQUEEZE, edited(4, "/r/a.yaml")], 1, 1),
        ([prompt(0, "do not edit a.go or b.go"), edited(1, "/r/b.go")], 0, None),
    ],
)
def test_directives(spark, rows, n, confidence):
    from sessionlens.detectors import Instructions

    found = Instructions().scan(Frames(events(spark, rows), None)).collect()
    assert len(found) == n and (not n or found[0]["confidence"] == confidence)


def test_rework_needs_other_files_between(spark):
    from sessionlens.detectors import Rework

    same = [edited(i, "/r/a.go", f"v{i}", f"w{i}") for i in range(5)]
    assert Rework().scan(Frames(events(spark, same), None)).count() == 0
    mixed = [edited(i, f"/r/{'ab'[i % 2]}.go", f"v{i}", f"w{i}") for i in range(6)]
    assert Rework().scan(Frames(events(spark, mixed), None)).count() == 2


def test_shell_deletion_and_lookback_window(spark):
    from sessionlens.detectors import TestIntegrity

    weak = ("self.assertEqual(a)", "pass")
    rows = [shell(0, "rm -f -v tests/test_a.py"), shell(0, "rm notes.txt"), prompt(1, "make the tests pass"), edited(5, "/r/a_test.py", *weak), edited(30, "/r/a_test.py", *weak)]
    found = TestIntegrity().scan(Frames(events(spark, rows), None)).orderBy("emit_key").collect()
    assert [(r["severity"], r["confidence"]) for r in found] == [(2, 1), (2, 2), (1, 2)]


def test_undefined_calls(spark, tmp_path):
    from sessionlens.detectors import HallucinatedApi

    files = {"a.py": "from lib import known as k2\ndef helper(x):\n    return x\n", "wild.py": "from m import *\n", "a.go": "package a\nfunc Helper() {}\ntype Widget struct{}\n", "a.ts": "export function helper() {}\n", "node_modules/z.py": "def nowhere(): pass\n"}
    for name, body in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text(body)
    rows = [
        edited(0, f"{tmp_path}/a.py", new="helper(k2(1)); nowhere(2); len('made_up(3)')  # other(4)"),
        edited(1, f"{tmp_path}/wild.py", new="anything(1)"),
        edited(2, f"{tmp_path}/a.go", new="func B() { Helper(); Missing(1); x.Member() }"),
        edited(3, f"{tmp_path}/a.ts", new="helper(); gone(1); new Promise((resolve) => resolve(1)); o.method(); `quoted(1)`"),
    ]
    sessions = spark.createDataFrame([("s", str(tmp_path))], "session_id string, cwd string")
    found = HallucinatedApi().scan(Frames(events(spark, rows), sessions, repo.read_sources(spark, str(tmp_path)))).orderBy("emit_key").collect()
    assert [(r["title"].split("(")[0], r["confidence"]) for r in found] == [("nowhere", 0), ("Missing", 1), ("gone", 0)]


def test_chat_store(spark, tmp_path):
    (tmp_path / "w1").mkdir()
    db = sqlite3.connect(tmp_path / "w1" / "state.vscdb")
    db.execute("CREATE TABLE ItemTable (key TEXT UNIQUE, value BLOB)")
    from sessionlens.functions.patterns import CHAT_KEY

    db.execute("INSERT INTO ItemTable VALUES (?, ?)", (CHAT_KEY, json.dumps({"tabs": [{"bubbles": [{"type": "user", "text": "hi"}, {"type": "ai", "text": "hello"}, {"type": "odd", "text": "?"}]}]})))
    db.execute("INSERT INTO ItemTable VALUES (?, ?)", ("composerData:1", json.dumps({"conversation": [{"type": 1, "text": "do it", "timingInfo": {"clientStartTime": 1700000000000}}, {"type": "2", "text": "done"}, {"type": "1", "text": " "}]})))
    db.commit(), db.close()
    (tmp_path / "w1" / "workspace.json").write_text(json.dumps({"folder": "file:///w/my%20app"}))
    listed = registry.SOURCES["kvdb"].list(spark, str(tmp_path), "/w/my app").collect()
    assert [r["id"] for r in listed] == ["w1"]
    frames = registry.SOURCES["kvdb"].load(spark, listed[0]["path"])
    assert [(r["kind"], r["text"]) for r in frames.events.orderBy("seq").collect()] == [("prompt", "hi"), ("assistant_text", "hello"), ("prompt", "do it"), ("assistant_text", "done")]
    assert frames.sessions.first()["unrecognized"] == {"bubble:odd": 1}


def test_line_decoding_is_strict():
    ok = '{"type":"user","message":{"content":"hi"}}'
    assert lines.decode_line(ok)["content_text"] == "hi"
    for bad in (ok + "x", '{"type":5}', '{"message":[]}', "[]", "NaN", '{"message":{"usage":{"input_tokens":1.5}}}', '{"isMeta":"yes"}'):
        assert lines.decode_line(bad) is None
    assert lines.decode_line('{"TYPE":"user"}')["type"] == "user"
    assert lines.decode_line('{"message":{}}')["content"] == "missing"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scalar_functions(spark):
    s = lambda x: F.lit(x)
    assert one(spark, text.truncate(s("aé"), 2)) == "a�…"
    assert one(spark, text.similarity(s("é"), s("e"))) == 0.0
    assert [one(spark, text.human_tokens(F.lit(n))) for n in (999, 42500, 43500)] == ["999", "42k", "44k"]
    assert [one(spark, text.human_duration(F.lit(n))) for n in (0, 120, 3700)] == ["unknown duration", "2 min", "1h 01m"]
    assert [one(spark, text.base_name(s(p))) for p in ("", "/", "a/b/", "c")] == [".", "/", "b", "c"]
    yes = [("a.go", "/r/a.go"), ("./src/a.go", "/r/src/a.go"), ("src/", "/r/src/x/y"), ("a.*", "/r/a.ts")]
    no = [("a.go", "/r/ba.go"), ("src/", "/r/mysrc/x"), ("rc/a.go", "/r/src/a.go"), ("", "/r/x")]
    for (p, t), want in [*((x, True) for x in yes), *((x, False) for x in no)]:
        assert one(spark, pr.path_matches(s(p), s(t))) is want, (p, t)
    for c, want in (("echo x>a.go", True), ("echo x > a.go", False), ("docker run --rm a.go", True), ("cat a.go", False)):
        assert one(spark, pr.shell_mutates(s(c), s("a.go"))) is want, c
    tests = {"a_test.go": True, "x/test_a.py": True, "a.spec.rb": True, "src/tests/x": True, "FooTest.java": True, "contest.go": False, "latest/x.go": False}
    for p, want in tests.items():
        assert one(spark, pr.is_test_file(s(p))) is want, p


def test_masking_keeps_places():
    assert code.mask('x = "a(b)" # c\ny', "python") == "x =            \ny".replace("=            ", "=" + " " * 11)
    assert code.mask("/* a\nb */ f()", "typescript") == "    \n     f()"
    assert code.bound("a, {b: c, d = 1}, ...rest, type E as F2") == ["a", "b", "c", "d", "rest", "F2"]

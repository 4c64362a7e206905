"""Sessions that cannot be read, quoting, and the walk over source folders."""

import io
import json
import sqlite3

from pyspark.sql import functions as F

from sessionlens import cli
from sessionlens.functions import text
from sessionlens.plans import report
from sessionlens.sinks import render
from sessionlens.sources import registry, repo


def store(folder, key=None, value=None):
    folder.mkdir(parents=True)
    db = sqlite3.connect(folder / "state.vscdb")
    db.execute("CREATE TABLE ItemTable (key TEXT UNIQUE, value BLOB)")
    if key:
        db.execute("INSERT INTO ItemTable VALUES (?, ?)", (key, value))
    db.commit(), db.close()
    (folder / "workspace.json").write_text(json.dumps({"folder": "file:///w/app"}))


def test_trend_goes_on_past_a_store_without_chats(spark, tmp_path, capsys):
    store(tmp_path / "full", "composerData:1", json.dumps({"conversation": [{"type": 1, "text": "do it"}]}))
    store(tmp_path / "empty")
    store(tmp_path / "broken")
    (tmp_path / "broken" / "state.vscdb").write_bytes(b"no database")
    frames = registry.SOURCES["kvdb"].load(spark, f"{tmp_path}/*/state.vscdb")
    errors = {r["session_id"].rsplit("/", 2)[1]: r["error"] for r in frames.sessions.collect()}
    assert errors["full"] is None and errors["empty"] and errors["broken"]
    rows = report.trend(frames.sessions, report.all_findings(frames))
    out = io.StringIO()
    render.write_trend(out, rows)
    assert "3 session(s)" in out.getvalue() and out.getvalue().count("unparseable") == 2 and "TOTALS" in out.getvalue()
    told = json.loads(render.trend_json(rows))["sessions"]
    assert len(told) == 3 and sum("parse_error" in s for s in told) == 2
    args = ["--root", f"kvdb={tmp_path}", "--cwd", "/w/app"]
    assert cli.main(["analyze", *args, "--session", "empty"], spark) == 1 and "no chat" in capsys.readouterr().err


def test_quoting(spark):
    cases = {'say "a\\b"': '"say \\"a\\\\b\\""', "tab\tnew\nbell\a": '"tab\\tnew\\nbell\\a"', "\x01\x7f": '"\\x01\\x7f"', "é 漢 😀": '"é 漢 😀"', "a b​﻿": '"a\\u00a0b\\u200b\\ufeff"', "\U000e0001": '"\\U000e0001"', "": '""'}
    rows = spark.createDataFrame([(k,) for k in cases], "s string").select("s", text.quoted(F.col("s")).alias("q")).collect()
    assert {r["s"]: r["q"] for r in rows} == cases


def test_pruned_folders_are_never_opened(spark, tmp_path, monkeypatch):
    for name in ("src/deep", "node_modules/x", ".git", "src/vendor/y", "we[i]rd{a}"):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "a.py").write_text(f"def f_{len(name)}(): pass")
    (tmp_path / "src" / "b.txt").write_text("no source")
    opened, list_folder = [], repo.list_folder

    def listed(spark, path):
        opened.append(path.split(tmp_path.name, 1)[1].strip("/"))
        if path.endswith("deep"):
            return [], False  # as one that cannot be read
        return list_folder(spark, path)

    monkeypatch.setattr(repo, "list_folder", listed)
    got = repo.read_sources(spark, str(tmp_path)).collect()
    assert sorted(opened) == ["", "src", "src/deep", "we[i]rd{a}"]
    assert [r["path"] for r in got] == [f"{tmp_path}/we[i]rd{{a}}/a.py"] and got[0]["cwd"] == str(tmp_path)
    assert repo.list_folder is listed and list_folder(spark, f"{tmp_path}/gone") == ([], False)
    assert repo.read_sources(spark, f"{tmp_path}/src/vendor").count() == 0

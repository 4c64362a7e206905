"""Directives in long sessions and logs out of order, against a loop over all pairs."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from sessionlens.detectors.base import EVENTS, Frames
from sessionlens.detectors.instructions import Instructions
from sessionlens.detectors.rework import Rework
from sessionlens.functions import patterns as P
from sessionlens.operators import directives

MINUTE = 60
COLUMNS = "session_id string, seq bigint, kind string, at bigint, uuid string, text string, tool string, file_path string, command string, new_string string, old_string string"


def events(spark, rows):
    shape = spark.createDataFrame([], EVENTS).schema
    df = spark.createDataFrame(rows, COLUMNS).withColumn("ts", F.timestamp_seconds("at"))
    return df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in shape])


def prompt(session, seq, at, text):
    return (session, seq, "prompt", at, f"u{seq}", text, None, None, None, None, None)


def edit(session, seq, at, path, tool="Edit", new="x", old="y"):
    return (session, seq, "tool_call", at, f"u{seq}", "", tool, path, None, new, old)


def later(a, b):
    """Whether time a is after time b; unknown ones are before all."""
    return a is not None and (b is None or a > b)


def test_supersession_equals_a_loop(spark):
    rng = random.Random(1)
    paths = ["a.go", "src/a.go", "data.go", "./x/y.py", "docs/", "a.b"]
    texts = ["Do not modify {}.", "Leave {} alone. Only edit {}!", "look at /repo/{}x", "see my{}, ok", "Actually, go on", "go", "NEVER touch {}", "don't edit {} or b.go"]
    rows = []
    for s in range(12):
        for i in range(40):
            t = rng.choice(texts)
            at = None if rng.random() < 0.1 else 1_700_000_000 + MINUTE * (i + (rng.randrange(-6, 7) if s % 2 else 0))
            rows.append(prompt(f"s{s}", i, at, "".join(x + (rng.choice(paths) if k < t.count("{}") else "") for k, x in enumerate(t.split("{}")))))
    found = directives.session_directives(events(spark, rows)).collect()
    assert len(found) > 200
    for d in found:
        own = [r for r in rows if r[0] == d["session_id"]]
        at = next(r[3] for r in own if r[1] == d["seq"])
        ends = [r for r in own if r[1] > d["seq"] and later(r[3], at) and (d["path"].lower() in r[5].lower() or re.search(P.REOPENING, r[5]))]
        assert d["superseded_by"] == (ends[0][5] if ends else None)
        assert (d["superseded_at"] and int(d["superseded_at"].timestamp())) == (ends[0][3] if ends else None)


@pytest.mark.parametrize("path, text, holds", [("a.go", "x data.go", True), ("a.go", "a. go", False), ("/", "a/b", True), ("a/", "za/", True), ("averylongname/file.go", "(averylongname/file.go)", True), ("file.x", "file.y file.", False), ("é.go", "é.go", True), ("x.go", "X.GO", True)])
def test_mentions(spark, path, text, holds):
    got = directives.path_mentions(spark.createDataFrame([("s", path.lower())], "session_id string, path string"), spark.createDataFrame([("s", 1, None, text)], "session_id string, seq long, ts timestamp, text string"))
    if path.isascii():  # a directive's path has ASCII signs only
        assert (got.count() == 1) is holds


def test_one_long_session(spark):
    """5,000 directives, 50,000 prompts and 100,000 calls of one session: no join meets them pair by pair, and several tasks share the calls."""
    rng = random.Random(2)
    rows, at = [], 1_700_000_000
    for i in range(150_000):
        at += 1
        kind = i % 30
        if kind == 0:
            rows.append(prompt("s", i, at, f"Do not modify src/f{rng.randrange(2000)}.go."))
        elif kind < 10:
            rows.append(prompt("s", i, at, rng.choice(["go on", "and then src/g.go", "thanks", f"look at f{rng.randrange(2000)}.go"])))
        else:
            rows.append(edit("s", i, at, f"/r/src/f{rng.randrange(2000)}.go"))
    ev = events(spark, rows).cache()
    began = time.time()
    got = [(r["seq"], r["path"], r["superseded_by"] is not None) for r in directives.session_directives(ev).collect()]
    assert len(got) == 5000 and sum(x[2] for x in got) > 500 and time.time() - began < 90
    held = directives.session_directives(ev).withColumnRenamed("kind", "directives_kind")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else small partitions are put together
    try:
        tasks = directives.violations(held, ev).select("session_id", "seq", "e_seq").groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert tasks >= 3
    last, want = {}, 0
    marks = [(i, r[5]) for i, r in enumerate(rows) if r[2] == "prompt"]
    until = dict((s, None) for s, _, _ in got)
    open_ = {}
    for i, text in marks:
        for f in re.findall(r"f\d+\.go", text):
            for seq, path in [x for x in open_.get(f, [])]:
                if path in text:
                    until[seq] = i
                    open_[f].remove((seq, path))
        if text.startswith("Do not"):
            open_.setdefault(f, []).append((i, f"src/{f}"))
    by_file = {}
    for i, r in enumerate(rows):
        if r[2] == "tool_call":
            by_file.setdefault(r[7], []).append(i)
    for seq, path, _ in got:
        want += sum(i > seq and (until[seq] is None or i <= until[seq]) for i in by_file.get(f"/r/{path}", []))
    assert directives.violations(held, ev).count() == want > 1000


def test_nothing_is_broadcast(spark):
    """Logs that repeat themselves are small files of many rows: whatever Spark takes their size for, no table goes to the driver."""
    rows = [r for i in range(0, 40, 4) for r in (prompt("s", i, i, "Do not modify a.go."), edit("s", i + 1, i + 1, "/r/a.go"), prompt("s", i + 2, i + 2, "go on"))]
    ev = events(spark, rows).localCheckpoint()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        for df in (directives.session_directives(ev), directives.broken_directives(ev).drop("edits"), Instructions().scan(Frames(ev, None))):
            assert df.count() and "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_evidence_is_bounded(spark):
    """Very many actions: all ids, five excerpts."""
    rows = [prompt("s", 0, 1_700_000_000, "Never touch a.go.")] + [edit("s", i, 1_700_000_000 + i, "/r/a.go" if i % 2 else f"/r/b{i % 4}.go", new=f"n{i}" + "x" * 300) for i in range(1, 20_001)]
    frames = Frames(events(spark, rows), None)
    found = Instructions().scan(frames).collect()
    assert [(len(r["event_uuids"]), len(r["evidence"])) for r in found] == [(10_000, 6)] and found[0]["evidence"][1]["content"].startswith("Edit /r/a.go: n1x")
    loops = {r["emit_key"]: r for r in Rework().scan(frames).collect()}
    assert {k: (len(r["event_uuids"]), len(r["evidence"])) for k, r in loops.items()} == {"/r/a.go": (10_000, 5), "/r/b0.go": (5_000, 5), "/r/b2.go": (5_000, 5)}
    assert [e["label"] for e in loops["/r/a.go"]["evidence"]] == [f"edit {i} (Edit)" for i in range(1, 6)]

"""Scan and decoding of session files: splits, numbers, and the two decoders against each other."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sessionlens.sources import lines, registry

from .logs import agent, edit, say, user

GOOD = '{"type":"user","message":{"content":"hi"}}'
ODD_LINES = [
    GOOD, GOOD + "x", GOOD + GOOD, GOOD + "}", GOOD + '} {"', '[' + GOOD + "]", "[]", "{}", "null", "5", '"s"', "NaN", "{", "{'type':'user'}", '{"type":5}', '{"type":null}', '{"a":NaN}', '{"a":01}', '{"a":1,}',
    '{"TYPE":"user"}', '{"Type":"a","type":"b"}', '{"type":"a","type":"b"}', '{"\\u0074ype":"user"}', '{"\\u0054ype":"user"}', '{"isMeta":"yes"}', '{"isMeta":true,"isSidechain":false,"isCompactSummary":null}',
    '{"message":[]}', '{"message":null}', '{"message":{}}', '{"message":{"content":null}}', '{"message":{"content":7}}', '{"message":{"content":{"a":1}}}', '{"message":{"content":[]}}', '{"message":{"content":[null]}}',
    '{"message":{"content":[5]}}', '{"message":{"content":[{"type":"text","text":"t"},{"type":5}]}}', '{"message":{"role":5,"content":"x"}}', '{"message":{"id":"m","content":[{"type":"tool_use","id":"i","name":"Edit","input":{"b":1,"a":"x"}}]}}',
    '{"message":{"content":[{"type":"tool_use","input":"text"},{"type":"tool_use","input":[1,2]},{"type":"tool_use","input":null}]}}', '{"message":{"content":[{"TEXT":"t"}]}}',
    '{"message":{"usage":{"input_tokens":1.5}}}', '{"message":{"usage":{"input_tokens":3,"output_tokens":null},"content":"x"}}', '{"message":{"usage":{"input_tokens":1e3}}}', '{"message":{"usage":[]}}', '{"message":{"usage":{"input_tokens":99999999999999999999}}}',
    '{"message":{"usage":{"input_tokens":-9223372036854775808}}}', '{"message":{"usage":{"input_tokens":true}}}', '{"type":"system","compactMetadata":null}', '{"type":"system","compactMetadata":{"a":[1]}}', '{"message":{"content":"\\ud800 \\ud83d\\ude00 é"}}',
    '{"type":"a","type":5}', '{"message":{"content":"say \\"Type\\": no"}}', '{"message":{"content":"tab\\tnew\\nline"}}', '{"x":' + "[" * 900 + "]" * 900 + "}", '{"type":"user","other":{"Type":5}}', '{"v":1,"type":"user"}', ' \t{"type":"user"} \r',
]


def as_plain(row):
    return None if row is None else json.loads(json.dumps(row.asDict(recursive=True)))


def test_both_decoders_agree(spark):
    rows = spark.createDataFrame(list(enumerate(ODD_LINES)), "line_no int, value string")
    got = {r["line_no"]: as_plain(r["line"]) for r in lines.decode(rows).collect()}
    expected = {r["line_no"]: as_plain(r["line"]) for r in lines.decode_odd(rows.withColumn("value", F.regexp_replace("value", r"^\s+|\s+$", ""))).collect()}
    for i, text in enumerate(ODD_LINES):
        for side in (got[i], expected[i]):
            for b in (side or {}).get("blocks") or []:
                b["input"] = b["input"] and json.loads(b["input"])
        assert got[i] == expected[i], text


def test_ordinary_lines_need_no_python(spark):
    odd, line = lines.decoded_natively(F.col("value"))
    rows = spark.createDataFrame([(user(1, "u", "hi there"),), (agent(2, "a", [say("x"), edit("/a", "1", "2")], "m", (1, 2, 3, 4)),)], "value string")
    assert [r["odd"] for r in rows.select(odd.alias("odd")).collect()] == [False, False]
    plan = rows.select(line.alias("line"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_long_file_is_read_in_splits(spark, tmp_path, small_splits):
    """Lines of 200 KB lie across the ends of splits; numbers equal a plain count; blank lines count; carriage returns end no line."""
    rng = random.Random(2)
    folder = tmp_path / "-w-app"
    folder.mkdir()
    for name in ("one", "two"):
        texts = []
        for i in range(120):
            size = 200_000 if i % 30 == 7 else rng.randrange(1, 9000)
            texts += [user(i % 60, f"{name}{i}", f"{i} " + "é" * (size // 2))] + ["", "  ", "{broken", "\r"][: rng.randrange(5)]
        (folder / f"{name}.jsonl").write_text("\n".join(texts) + ("\n" if name == "one" else ""))
    scanned = lines.scan_lines(spark, f"{folder}/*.jsonl")
    assert scanned.rdd.getNumPartitions() >= 8
    got = lines.number_lines(lines.decode(scanned))
    for name in ("one", "two"):
        texts = (folder / f"{name}.jsonl").read_text().split("\n")
        want = {i: json.loads(t)["uuid"] for i, t in enumerate(texts) if t.startswith('{"')}
        found = got.where(F.col("session_path").endswith(f"{name}.jsonl"))
        assert {r["line_no"]: r["line"]["uuid"] for r in found.where("line IS NOT NULL").collect()} == want
        assert {r["line_no"]: len(r["line"]["content_text"]) for r in found.where("line IS NOT NULL").collect()} == {i: len(json.loads(texts[i])["message"]["content"]) for i in want}
        assert found.where("blank").count() == sum(not t.strip() for t in texts) - (name == "one")
    frames = registry.SOURCES["jsonl"].load(spark, f"{folder}/*.jsonl")
    assert frames.events.count() == 240
    plan = frames.events._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "parse_json" not in plan


def test_files_without_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("")
    (tmp_path / "b.jsonl").write_text("\n\n")
    assert lines.read_decoded(spark, f"{tmp_path}/*.jsonl").where("NOT blank").count() == 0
    frames = registry.SOURCES["jsonl"].load(spark, f"{tmp_path}/*.jsonl")
    assert frames.events.count() == 0 and frames.sessions.count() == 0

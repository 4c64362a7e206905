"""Neighbouring documents and their similarity against plain loops."""

import random

from pyspark.sql import functions as F

from sessionlens.functions import text
from sessionlens.functions.distance import edit_distance
from sessionlens.plans import queries


def distance(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def alike(a: str, b: str) -> float:
    x, y = a.encode()[:4096], b.encode()[:4096]
    return 1.0 if a == b else 0.0 if not a or not b else 1 - distance(x, y) / max(len(x), len(y))


def test_every_pair_has_a_row(spark, tmp_path):
    rng = random.Random(5)
    sizes = [0, 5, 40, 1999, 2000, 2600, 5000]
    rows = [(i, rng.choice("abc"), "".join(rng.choice("xyzé ") for _ in range(sizes[i % 7] if i < 14 else 20))) for i in [*range(14), *range(40, 60), 900, 5000, 5001]]
    spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    last, expected = {}, {}
    for i, source, t in rows:
        if source in last:
            expected[i] = (t, last[source])
        last[source] = t
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for block in (1, 4, 512):
        got = queries.neighbours(docs, block).collect()
        assert len(got) == len(expected) and {r.doc_id: (r.text, r.before) for r in got} == expected
    got = {r.doc_id: r.similarity for r in queries.x13_similarity(spark, str(tmp_path)).collect()}
    assert got == {i: round(alike(*x), 9) for i, x in expected.items()}
    assert any(min(map(len, x)) >= 2000 for x in expected.values())


def test_bits_agree_with_the_table_of_distances():
    rng = random.Random(7)
    sizes = [0, 1, 2, 29, 30, 31, 63, 64, 65, 130, 200]
    for _ in range(600):
        a, b = (bytes(rng.choice(b"abc\0\xff") for _ in range(rng.choice(sizes))) for _ in range(2))
        assert edit_distance(a, b) == edit_distance(b, a) == distance(a, b)
    long = bytes(rng.randrange(256) for _ in range(4096))
    assert edit_distance(long, long[7:] + b"1234567") == 14


def test_band_decides_as_the_whole_distance(spark):
    rng = random.Random(9)
    rows = [("", "a"), ("a", ""), ("", ""), ("é" * 20, "é" * 19 + "e"), ("x" * 9000, "x" * 8000), (None, "a")]
    for size in (5, 10, 20, 30, 400, 4095, 4096, 5000):
        for part in (0.05, 0.095, 0.1, 0.105, 0.5):
            a = "".join(rng.choice("abcdefgh") for _ in range(size))
            b = list(a)
            for i in rng.sample(range(size), int(part * min(size, 4096))):
                b[i] = rng.choice(["", "Z", "YY"]) if size < 4000 else "Z"
            rows.append((a, "".join(b)))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", text.more_similar(F.col("a"), F.col("b"), 0.9).alias("near"), text.similarity(F.col("a"), F.col("b")).alias("s")).collect()
    for r in got:
        if r.a is None:
            assert r.near is None and r.s is None
        else:
            assert r.near == (r.s > 0.9)
            if len(r.a) < 500:
                assert r.s == alike(r.a, r.b)
    assert len({r.near for r in got}) == 3


def test_only_bytes_after_4096_are_left_out(spark):
    one = spark.createDataFrame([("a" * 4096 + "b", "a" * 4096 + "c")], "a string, b string").select(text.similarity(F.col("a"), F.col("b")).alias("s")).first()
    assert one.s == 1.0


def test_no_more_bytes_are_dealt_out_than_are_compared(spark, tmp_path, monkeypatch):
    rows = [(i, "a", t) for i, t in enumerate(["é" * 9000, "é" * 9000, "é" * 9001, "x" + "é" * 9000, "", "", "y", "x" * 4096, "x" * 4097])]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen, whole = [], queries.neighbours
    monkeypatch.setattr(queries, "neighbours", lambda docs: seen.append(docs) or whole(docs))
    got = {r.doc_id: r.similarity for r in queries.x13_similarity(spark, str(tmp_path)).collect()}
    assert seen[0].select(F.max(F.octet_length("text"))).first()[0] == 4096
    assert got == {i: round(alike(rows[i][2], rows[i - 1][2]), 9) for i in range(1, len(rows))}

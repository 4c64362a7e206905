"""The prefix trie against a plain one."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlens.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def label(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def plain(rows):
    """The contract, conversation by conversation."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, label(role or "", text or ""), role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
        ends[built[c]].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)

    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = sum(saved[x] for x in children[k]) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0)
    return sorted(
        (members[k][0], len(k), members[k[:-1]][0] if k else None, len(members[k]), len(children[k]), leaves[k], saved[k], hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest())
        for k in members
    )


def made(spark, rows, **how):
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(3), **how)
    return sorted(map(tuple, got.collect()), key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("light", [1, 3, 10, 10_000])
def test_equals_plain_trie(spark, light, monkeypatch):
    """Shared prefixes, copies of whole conversations, absent first ones, ties and nulls, in shards and upper parts of many sizes."""
    rng = random.Random(light)
    rows = []
    for c in [*range(0, 70), *range(130, 170), *range(200, 230), 905, 1000]:
        for turn in range(rng.randrange(1, 9)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "ccc é"])))
    rows += [(230, t, "user", "x") for t in range(300)] + [(231, t, "user", "x") for t in range(300)]  # long, and alike
    rows += [(5, 1, "user", "a"), (5, 1, None, None), (6, None, "user", None), (7, 2, None, ""), (None, 0, "user", "nobody"), (905, 0, "user", "a")]
    if light == 3:
        monkeypatch.setattr(prefix_trie, "SMALL", -1)  # salted joins
    if light == 10:
        monkeypatch.setattr(prefix_trie, "PIECE", 3)  # lists of ids in many pieces
    assert made(spark, rows, light=light) == plain(rows)


def test_common_conversation(spark):
    """Most rows are one conversation again and again, and its first turn begins all others."""
    rows = [(100 * i + 99, t, "user", f"same {t}") for i in range(400) for t in range(7)]
    rows += [(100 * i + 50, t, "user", "same 0" if t == 0 else f"own {i % 7} {t}") for i in range(100) for t in range(4)]
    assert made(spark, rows, light=20) == plain(rows)


def test_empty_and_other_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.conversation_trie(empty).count() == 0
    more = spark.createDataFrame([(3, 0, "user", "hi", 1, "x")], SCHEMA + ", depth long, node string")
    assert len(prefix_trie.conversation_trie(more).collect()) == (1 if zlib.crc32(b"3") % 6 else 2)


def test_level_order_bits():
    parent = np.array([-1, 0, 0, 1, -1, 4, 3])
    order, bits, starts = prefix_trie.louds(parent)
    assert order.tolist() == [0, 4, 1, 2, 5, 3, 6]
    assert "".join(map(str, bits)) == "110" + "110" + "10" + "10" + "0" + "0" + "10" + "0"
    sums = prefix_trie.rolled_up(bits, starts, np.ones((7, 1), np.int64))
    assert dict(zip(order.tolist(), sums[:, 0].tolist(), strict=True)) == {0: 5, 1: 3, 2: 1, 3: 2, 4: 2, 5: 1, 6: 1}


def test_shards_over_many_batches(spark):
    """A batch may end within a shard."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rng = random.Random(5)
        rows = [(c, t, "user", rng.choice("ab")) for c in range(300) for t in range(rng.randrange(1, 7))]
        assert made(spark, rows, light=30) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    got = prefix_trie.conversation_trie(table.withColumn("n", F.lit(1)), light=5)
    assert sorted(map(tuple, got.collect()), key=lambda r: tuple((x is not None, x) for x in r)) == plain(rows)

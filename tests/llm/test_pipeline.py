"""Every stage of the corpus pipeline against a plain version, each on what the stage before it kept."""

import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sessionlens.llm import quality, simhash
from sessionlens.llm.common import materialize, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input rows and output rows of each stage, by name."""
    docs = table(spark, SF, "documents").selectExpr("*", "1 AS score", "'y' AS node", "2 AS taken")
    some = docs.limit(1).selectExpr("1000000L AS doc_id", "CAST(NULL AS STRING) AS text", *[c for c in docs.columns if c not in ("doc_id", "text")])
    docs = docs.unionByName(some).unionByName(docs.where("doc_id % 17 = 0"))  # a null text, and rows that repeat
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, docs, SF), name)
        out[name] = (docs, docs.collect(), after, after.collect())
        docs = after
    return out


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_columns_stay(stages):
    for name, (before, _, after, rows) in stages.items():
        assert rows, name
        assert name == "pack" or after.columns == before.columns


def test_quality_drops_what_the_classifier_rejects(spark, stages):
    before, rows, _, kept = stages["quality"]
    good = [r["doc_id"] for r in quality.classify_quality(before, table(spark, SF, "labels")).where("predicted = 1").collect()]
    assert sorted(good) == sorted(r["doc_id"] for r in kept) and len(kept) < len(rows)
    texts = {r["doc_id"]: r["text"] for r in rows}
    assert all(r["text"] == texts[r["doc_id"]] for r in kept)


def test_exact_dedup_keeps_the_smallest_id(stages):
    _, rows, _, kept = stages["exact_dedup"]
    least = {}
    for r in rows:
        least[r["text"] or ""] = min(r["doc_id"], least.get(r["text"] or "", r["doc_id"]))
    assert sorted(least.values()) == sorted(r["doc_id"] for r in kept)


def test_near_dedup_follows_five_word_similarity(stages):
    _, rows, _, kept = stages["near_dedup"]
    sets = {r["doc_id"]: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for r in rows for w in [words(r["text"])]}
    near, ids = defaultdict(float), {r["doc_id"] for r in kept}
    for a, b in combinations(sets, 2):
        alike = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        near[a], near[b] = max(near[a], alike), max(near[b], alike)
        assert alike < 0.9 or not {a, b} <= ids  # bits may miss a pair, the rarer the more alike
    assert all(near[x] >= 0.75 for x in set(sets) - ids) and len(ids) == len(kept)  # sets decide, and sketches where very many meet


def test_near_dedup_recall(spark):
    """Of all pairs of distinct texts at 0.8 or more on sf0.1, nine in ten at least are joined by the stage."""
    from sessionlens.llm.set_join import shingle_set

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    sets = {r["doc_id"]: shingle_set(r["text"], 5) for r in docs.collect()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for h in s[s % np.uint64(16) == 0].tolist() if len(s) > 100 else s.tolist():  # a sixteenth of the shingles finds all near pairs of longer texts
            holders[h].append(i)
    pairs = {(a, b) for ids in holders.values() if len(ids) < 400 for a, b in combinations(sorted(ids), 2) if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b]))}
    alike = [(a, b) for a, b in pairs if 10 * (n := len(np.intersect1d(sets[a], sets[b], assume_unique=True))) >= 8 * (len(sets[a]) + len(sets[b]) - n)]
    part = {r["doc_id"]: r["component_id"] for r in simhash.simhash_components(docs, radius=7, similarity=0.8).collect()}
    found = sum(part[a] == part[b] for a, b in alike)
    assert len(alike) >= 30 and found >= 0.9 * len(alike), (found, len(alike))


def test_mix_takes_the_targets_words(stages):
    _, rows, _, mixed = stages["mix"]
    own = {r["doc_id"]: (words(r["text"]), r["source"]) for r in rows}
    size, taken, copies = defaultdict(int), defaultdict(int), defaultdict(int)
    for w, source in own.values():
        size[source] += len(w)
    for r in mixed:
        w = words(r["text"])
        assert w == own[r["doc_id"]][0][: len(w)]
        taken[r["source"]] += len(w)
        copies[r["doc_id"]] += 1
    assert max(copies.values()) <= 2
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(size))}
    target, rest, free = {}, 1.5 * sum(size.values()), set(size)
    while free:
        part = {s: rest * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if part[s] > 2 * size[s]}
        target.update({s: 2 * size[s] for s in over} if over else part)
        rest -= sum(2 * size[s] for s in over)
        free = free - over if over else set()
    assert all(abs(taken[s] - target[s]) <= 1 for s in size)


def test_pack_holds_every_row_once(stages):
    _, rows, _, pieces = stages["pack"]
    by_row, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_row[p["row"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert sorted(r["doc_id"] for r in rows) == sorted(ps[0]["doc_id"] for ps in by_row.values())
    for ps in by_row.values():
        ps.sort(key=lambda p: p["start"])
        assert [p["start"] for p in ps] == [sum(x["length"] for x in ps[:i]) for i in range(len(ps))]
        assert sum(p["length"] for p in ps) == ps[0]["doc_tokens"]
    for ps in by_sequence.values():
        ps.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in ps] == [sum(x["length"] for x in ps[:i]) for i in range(len(ps))]
        assert sum(p["length"] for p in ps) <= 2048
    assert sum(p["length"] for p in pieces) > 0.95 * 2048 * len(by_sequence)


def test_run_gives_the_stages_rows(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0

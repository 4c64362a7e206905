"""Held-out accuracy of the classifiers, and their edge cases."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from sessionlens.llm import quality, toxicity

SF = "/root/testdata/sf0.1"


def held_out(spark, got, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    return [(r["predicted"], r["y"]) for r in got.where("held_out").join(labels, "doc_id").collect()]


def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_quality(spark):
    docs, labels = tables(spark)
    rows = held_out(spark, quality.classify_quality(docs, labels, most=600), "quality")
    assert len(rows) > 300 and sum(p == y for p, y in rows) / len(rows) > 0.98


def test_toxicity(spark):
    docs, labels = tables(spark)
    rows = held_out(spark, toxicity.classify_toxicity(docs, labels, most=1500), "toxic")
    caught = [p for p, y in rows if y]
    # measured here: 804 of 825 right, 80 of 97 caught
    assert sum(p == y for p, y in rows) / len(rows) > 0.95 and sum(caught) / len(caught) > 0.8


def test_kernel_tolerates_gaps_and_insertions():
    assert toxicity.kernel(["moldy"], ["moldy"])[0, 0] == pytest.approx(1, abs=1e-4)  # repeated letters may give more than 1
    k = toxicity.kernel(["idiot", "id-iot", "iXdiot", "garden"], ["idiot"])[:, 0]
    assert k[0] >= 1 and min(k[1], k[2]) > 0.3 > 0.05 > k[3]
    assert "idiot" in toxicity.units_of("you i d i o t") and toxicity.units_of("") == set()


def occurrences(word):
    """Every four signs of `<word>` in order within a span, with the decayed weight, scaled to length 1; punctuation only makes gaps."""
    s = f"<{word}>"
    found = [(s[a] + s[b] + s[c] + s[d], toxicity.DECAY ** (d - a + 1)) for a, b, c, d in combinations(range(len(s)), 4) if d - a < toxicity.SPAN and "-" not in (s[a], s[b], s[c], s[d])]
    norm = sum(w * w for _, w in found) ** 0.5
    return [(x, w / norm) for x, w in found]


def test_kernel_equals_the_sum_over_all_subsequences():
    r = random.Random(5)
    units = ["".join(r.choice("abc1-") for _ in range(r.randrange(2, 12))) for _ in range(30)]
    got = toxicity.kernel(units, units[:8])
    for i, u in enumerate(units):
        for j, v in enumerate(units[:8]):
            assert got[i, j] == pytest.approx(sum(x * y for a, x in occurrences(u) for b, y in occurrences(v) if a == b), abs=1e-4)


def test_models_without_labels_and_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, "x"), (1, "", "y"), (None, "a\n\nb" * 5000, "z")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    a, b = quality.classify_quality(rows, none).collect(), toxicity.classify_toxicity(rows, none).collect()
    assert len(a) == len(b) == 3 and all(0 <= r["score"] <= 1 for r in [*a, *b])
    assert quality.keep_good(rows, none).columns == rows.columns


def test_forward_backward_matches_enumeration():
    import itertools

    import numpy as np

    r = np.random.default_rng(0)
    scores, trans, sizes = r.normal(size=(9, 2)), r.normal(size=(2, 2)), np.array([1, 3, 5])
    starts = np.array([0, 1, 4])
    marginal, pairs, z = quality.forward_backward(scores, starts, sizes, trans)
    for k, (s, n) in enumerate(zip(starts, sizes, strict=True)):
        paths = list(itertools.product((0, 1), repeat=int(n)))
        w = np.exp([sum(scores[s + i, c] for i, c in enumerate(p)) + sum(trans[x, y] for x, y in zip(p, p[1:], strict=False)) for p in paths])
        assert np.log(w.sum()) == pytest.approx(z[k])
        for i in range(n):
            assert marginal[s + i, 1] == pytest.approx(sum(x for x, p in zip(w, paths, strict=True) if p[i]) / w.sum())
        assert pairs[k].sum() == pytest.approx(n - 1)

"""Nearest neighbours against brute force: recall over several shards, extreme values, ties, repeats, odd rows."""

import math

import numpy as np
import pytest

from sessionlens.llm import ann

SCHEMA = "vec_id long, embedding array<double>, score double, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0.5, "x") for i, v in rows], SCHEMA).repartition(3)


def brute(rows, q, k=10):
    own = dict(rows)[q]
    far = [(math.dist(own, v), i) for i, v in rows if i != q and len(v) == len(own)]
    return [(i, d) for d, i in sorted(far)[:k]]


def answers(df, **kw):
    out = {}
    for r in sorted(ann.nearest(df, df.where("vec_id % 100 = 0"), **kw).collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("least", [400, 100_000])  # six shards, and one
def test_recall(spark, least):
    r = np.random.default_rng(0)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(2400, 32)))]
    got = answers(frame(spark, rows), spread=6, least=least)
    hits = [len({i for i, _ in brute(rows, q)} & {i for i, _ in got[q]}) / 10 for q in range(0, 2400, 100)]
    assert len(got) == 24 and np.mean(hits) >= 0.95
    assert all(s == pytest.approx(math.dist(rows[q][1], rows[i][1]), rel=1e-12) for q in got for i, s in got[q])


def test_extremes_ties_and_repeats(spark):
    r = np.random.default_rng(1)
    near = [(i, [*map(float, v), 0.0]) for i, v in enumerate(r.integers(-3, 4, (205, 3)))]
    rows = [(i, v) for i, v in near if any(v)]
    for scale in (2.0**83, 2.0**1000, 2.0**-500):  # every neighbour is found, ties go to the smaller id
        some = [(i, [x * scale for x in v]) for i, v in rows]
        got = answers(frame(spark, some), beam=300)
        for q in got:
            want = brute([(i, [x / scale for x in v]) for i, v in some], q)
            assert [i for i, _ in got[q]] == [i for i, _ in want]
            assert all(a == pytest.approx(b * scale, rel=1e-9) for (_, a), (_, b) in zip(got[q], want, strict=True))


def test_odd_rows(spark):
    same = [1.0, 2.0]
    rows = [(i, same) for i in range(30)] + [(100, [1.0, 3.0]), (100, [5.0, 5.0]), (200, [1.0, 2.0, 3.0]), (300, None), (400, [0.0, 0.0]), (500, [1.0, float("nan")]), (600, [1.0, None]), (700, []), (None, [1.0, 2.5])]
    got = answers(frame(spark, rows))
    assert got.keys() == {0, 100}  # the vector of width 3 has no candidates
    assert got[0] == [(i, 0.0) for i in range(1, 11)]
    assert got[100] == [(i, 1.0) for i in range(10)]  # the smaller of its two vectors asks
    assert ann.nearest(frame(spark, rows).limit(0), frame(spark, rows).limit(0)).count() == 0


def test_vectors_of_mixed_size(spark):
    """Huge and tiny vectors beside ordinary ones, in every shard, and as queries."""
    r = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(2400, 32)))]
    odd = {7: 1e170, 200: 1e170, 300: 1e-200, 411: 1e-200, 500: 1e60, 611: 1e61, 777: 1e300, 900: 1e-310, 1000: 1e30} | {i: 1e170 for i in range(1201, 1260)}
    rows = [(i, [x * odd.get(i, 1.0) for x in v]) for i, v in rows]
    got = answers(frame(spark, rows), spread=6, least=400)
    hits = {q: len({i for i, _ in brute(rows, q)} & {i for i, _ in got[q]}) / 10 for q in range(0, 2400, 100)}
    assert np.mean(list(hits.values())) >= 0.95
    assert all(hits[q] == 1.0 for q in (200, 300, 500, 900)), hits
    assert all(s == pytest.approx(math.dist(rows[q][1], rows[i][1]), rel=1e-12) for q in got for i, s in got[q])


def test_equal_distances_end():
    """One-hot vectors are all as far from each other: a search among more of them than its beam holds ends."""
    x = np.eye(300)
    edges, entry = ann.build_graph(x, degree=8, beam=16)
    ids, far = ann.beam_search(x, edges, entry, x[:50], 32)
    assert (ids[:, :11] >= 0).all() and np.all(np.isclose(far[ids >= 0], 2) | np.isclose(far[ids >= 0], 0))

"""The set join against all pairs."""

import random
import re

import numpy as np
import pytest

from sessionlens.llm import set_join

SCHEMA = "doc_id long, text string"


def plain(rows, percent=90):
    sets = []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((i, {" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))} if words else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, (_, a) in enumerate(sets):
        for y, (_, b) in enumerate(sets[:x]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(x)] = find(y)
    least = {}
    for x, (i, s) in enumerate(sets):
        if s and i is not None:
            least[find(x)] = min(least.get(find(x), i), i)
    return sorted((repr(i), len(s), least.get(find(x)) if s else i) for x, (i, s) in enumerate(sets))


def made(spark, rows, percent=90):
    got = set_join.shingle_join(spark.createDataFrame(rows, SCHEMA).repartition(4), percent=percent).collect()
    return sorted((repr(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in got)


def near_texts(rng):
    """Chains of texts, each a few words from the last, of many lengths; some pairs lie just at the threshold."""
    rows = []
    for length in (3, 4, 9, 11, 12, 19, 21, 22, 30, 41, 60, 100, 200, 381, 500):
        words = [f"w{rng.randrange(10_000)}" for _ in range(length)]
        for _ in range(14):
            rows.append(" ".join(words))
            edit = rng.randrange(4)
            if edit == 0:
                words = words[:-1] if len(words) > 3 else words
            elif edit == 1:
                words = [*words, f"w{rng.randrange(10_000)}"]
            elif edit == 2:
                words = [*words[: len(words) // 2], "New", *words[len(words) // 2 :]]
            else:
                words = [x if rng.random() > 0.02 else f"w{rng.randrange(10_000)}" for x in words]
    return rows


@pytest.mark.parametrize("seed, percent", [(0, 90), (1, 90), (2, 70)])
def test_equals_all_pairs(spark, seed, percent, monkeypatch):
    rng = random.Random(seed)
    texts = near_texts(rng)
    texts += [texts[5]] * 30 + [t.upper() for t in texts[:9]] + ["", " \n", None, "one", "One", "one two", "two one", "é É", "x " * 50_000, "a b c a b c a b c"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [*zip(ids, texts, strict=True), (None, texts[3]), (None, None), (7, texts[20]), (ids[0], texts[0])]
    if seed == 1:  # every signature goes the way of crowded ones, joins are salted, and no round comes first
        for name, value in (("CROWD", 1), ("BLOCK", 3), ("SMALL", -1)):
            monkeypatch.setattr(set_join, name, value)
    assert made(spark, rows, percent) == plain(rows, percent)


def test_similar_sets_share_a_signature():
    """The guarantee: no pair of the similarity is without a common signature, at any size."""
    rng = np.random.default_rng(4)
    for percent in (60, 90, 95):
        classes = set_join.SizeClasses(percent)
        for _ in range(1500):
            size = int(rng.integers(1, 900))
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            gone = int(rng.integers(0, len(a) * (100 - percent) // 100 + 1))
            new = 0 if rng.random() < 0.5 else int(((100 * (len(a) - gone)) // percent - len(a)))
            b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 1 << 63, max(new, 0), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= percent * (len(a) + len(b) - both):
                assert np.intersect1d(classes.signatures(a), classes.signatures(b)).size, (percent, len(a), len(b))
                assert np.bitwise_count((set_join.sketch(a) ^ set_join.sketch(b)).view(np.uint64)).sum() <= len(a) + len(b) - 2 * both


def test_common_passages_do_not_link(spark):
    """Many short texts that share most of their words, below the threshold; a signature of theirs may be crowded."""
    rng = random.Random(9)
    line = " ".join(f"c{i}" for i in range(30))
    rows = [(i, f"{line} {' '.join(f'u{rng.randrange(10**6)}' for _ in range(4))}") for i in range(400)]
    assert {r["component_id"] for r in set_join.shingle_join(spark.createDataFrame(rows, SCHEMA)).collect()} == set(range(400))


def test_empty_and_other_columns(spark):
    assert set_join.shingle_join(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "a b c d", 5, "x", 3), (2, "A b c d", 6, "y", 4)]
    got = set_join.shingle_join(spark.createDataFrame(rows, SCHEMA + ", node long, sig string, n long")).collect()
    assert sorted(map(tuple, got)) == [(1, 2, 1), (2, 2, 1)]

"""Components against union-find, and what a round carries."""

import random
from itertools import combinations

import pytest

from sessionlens.llm import graph


def roots_of(edges):
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    return {x: top(x) for x in up}


def found(spark, edges):
    return {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}


@pytest.mark.parametrize("small", [0, 100_000])
def test_chains_hubs_and_odd_edges(spark, monkeypatch, small):
    monkeypatch.setattr(graph, "SMALL", small)
    draw = random.Random(3)
    mixed = draw.sample(range(1000, 1200), 200)
    edges = [(i, i + 1) for i in range(90)] + list(zip(mixed, mixed[1:])) + [(2000 + i, 2099 - i) for i in range(100)] + [(2000 + i, 2098 - i) for i in range(99)]
    edges += [(3500, 3000 + i) for i in range(300)] + [(5000, 5000), (None, 1), (4, None), (1, 0)] + [(draw.randrange(6000, 6300), draw.randrange(6000, 6300)) for _ in range(170)]
    draw.shuffle(edges)
    assert found(spark, edges) == roots_of(edges)
    assert found(spark, []) == {}


def test_a_group_is_carried_once(spark, monkeypatch):
    """Links within a part go, so those of a large group are not met again in every round."""
    carried = []
    for name in ("materialize", "counted"):
        real = getattr(graph, name)

        def seen(df, of, *a, real=real, name=name):
            out = real(df, of, *a)
            if of == "links":
                carried.append((out if name == "materialize" else out[0]).count())
            return out

        monkeypatch.setattr(graph, name, seen)
    group = list(combinations(range(100, 160), 2))
    edges = group + [(b, a) for a, b in group] + [(i, i + 1) for i in range(159, 180)]
    assert found(spark, edges) == {x: 100 for x in range(100, 181)}
    assert carried[0] == len(group) + 21 and sum(carried[1:]) < 100

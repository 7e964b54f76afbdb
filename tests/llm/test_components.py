"""Components against union-find, and in how few steps they are found."""

import numpy as np
import pytest

from babelgauge.llm import components as C


def least_reached(edges):
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return {x: top(x) for x in up}


def graph():
    """A long chain in no order, a star, dense clusters with repeated edges, negative nodes and a loop."""
    rng = np.random.default_rng(2)
    chain = rng.permutation(np.arange(1000, 1150)).tolist()
    edges = list(zip(chain, chain[1:])) + [(5, 2000 + i) for i in range(60)]
    for g in range(8):
        edges += [tuple(x) for x in (3000 + 100 * g + rng.integers(0, 12, (40, 2))).tolist()]
    edges += [(-7, 40), (40, -9), (2**62, -(2**62)), (5, 2000)]
    return [edges[i] for i in rng.permutation(len(edges))]


@pytest.mark.parametrize("held", [1 << 20, 5])
def test_components(spark, monkeypatch, held):
    monkeypatch.setattr(C, "HELD", held)
    edges = graph()
    df = spark.createDataFrame([*edges, (77, 77)], "a long, b long").repartition(5)
    got = [tuple(r) for r in C.components(df).select("node", "root").collect()]
    assert len(got) == len(dict(got)) and dict(got) == least_reached([e for e in edges if e[0] != e[1]])


def test_stars_need_no_step(spark, monkeypatch):
    """What tasks have joined is not gone over again: no step to settle it, and none to see that nothing changes."""
    labels, write = [], C.settle
    monkeypatch.setattr(C, "settle", lambda df, label, **options: labels.append(label) or write(df, label, **options))
    edges = [(i % 10, 10 + i) for i in range(300)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    assert {tuple(r) for r in C.components(df).collect()} == set(least_reached(edges).items())
    assert "stars" not in labels


def test_no_edges(spark):
    found = C.components(spark.createDataFrame([(3, 3)], "a long, b long"))
    assert found.columns == ["node", "root"] and found.count() == 0

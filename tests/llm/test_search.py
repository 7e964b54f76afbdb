"""Exact top-k search against brute force."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from babelgauge.llm import voronoi_knn
from babelgauge.llm.voronoi_knn import top_products


def brute(rows, k):
    kept = {(i, tuple(math.floor(1024 * float(x)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q, v in kept:
        if q % 100 == 0:
            scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), i) for i, w in kept if i != q and len(v) == len(w))
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)}
    return out


def vectors():
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.1, 6).round(3).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)]  # ties
    rows += [(300, rows[300][1]), (None, rows[1][1]), (2000, None), (2100, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2200, [float("nan")] * 6), (2300, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0])]
    rows += [(2400, [0.5, 0.25]), (2401, [0.5, -1.0]), (2500, []), (2501, []), (2600, [0.0] * 6), (-100, [0.1] * 6)]
    return rows


@pytest.mark.parametrize("bounds", [(48, 4096, 8192), (5, 3, 50), (1, 2, 10**6)])
def test_top_products(spark, monkeypatch, bounds):
    pivots, queries, block = bounds
    monkeypatch.setattr(voronoi_knn, "GROUP_QUERIES", queries)
    monkeypatch.setattr(voronoi_knn, "BLOCK_ROWS", block)
    rows = vectors()
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cell string")
    got = {tuple(r) for r in top_products(table, F.col("vec_id") % 100 == 0, 10, pivots).collect()}
    assert got == brute(rows, 10)


def test_huge_components(spark):
    rows = [(0, [1e15, -1e3]), (1, [1e15, 7.0]), (2, [3e9, 1.0]), (3, [3e9, 2.0]), (100, [2.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in top_products(table, F.col("vec_id") % 100 == 0).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    want = defaultdict(list)
    for q, rank, i, s in brute(rows, 10):
        want[q].append((rank, i, s))
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items()}


def test_empty_table(spark):
    assert top_products(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).collect() == []


def test_only_queries_missing(spark):
    assert top_products(spark.createDataFrame([(7, [0.1, 0.2])], "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).collect() == []

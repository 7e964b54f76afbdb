"""Connected components of a large graph by local forests and alternating large-star and small-star steps.

Each step is one grouping of the edges; every node keeps pointing to smaller nodes until all point to the smallest of
their component. The number of steps grows with the logarithm of the largest component. Between the steps every task
replaces the edges it reads, some of them at a time, by a forest that connects the same nodes: this shuffles nothing,
takes repeated edges away and saves steps. Every step is written to the shared folder, so the plan stays short and lost
executors cost one step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from babelgauge.llm.work import share_package, tidy
from babelgauge.session import settle

HELD = 1 << 20  # edges that a task joins to a forest at a time


def least_linked(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes that these edges link with a smaller one, and the smallest node each of them reaches."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = code[: len(a)], code[len(a) :]
    least = np.arange(len(nodes))
    while len(a):
        low = np.minimum(least[a], least[b])
        np.minimum.at(least, least[a], low)
        np.minimum.at(least, least[b], low)
        while (least[least] != least).any():
            least = least[least]
        apart = least[a] != least[b]
        a, b = a[apart], b[apart]
    moved = np.flatnonzero(least < np.arange(len(nodes)))
    return nodes[moved], nodes[least[moved]]


def _forests(edges: DataFrame) -> DataFrame:
    """Edges ``a, b`` (a > b) that connect the same nodes: every ``HELD`` edges of a task become a forest of stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def forest() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            nodes, least = least_linked(table.column("a").to_numpy(), table.column("b").to_numpy())
            return pa.RecordBatch.from_pydict({"a": pa.array(nodes), "b": pa.array(least)})

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= HELD:
                yield forest()
                held, rows = [], 0
        if held:
            yield forest()

    return edges.mapInArrow(tidy(run), "a long, b long")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: larger neighbours of each node go to its minimum. Small star: the others and the node itself.

    ``edges`` have a > b, and so have those that come back. There are never more of them.
    """
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    linked = both.join(least, "a")
    moved = linked.where("b > a" if large else "b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved if large else moved.union(least.select("a", F.col("m").alias("b")))


def _settled(edges: DataFrame) -> bool:
    """Whether all edges lead to the smallest node of a component: no node has two ends, or is one and has one."""
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("end")).union(edges.select("b", "b"))
    seen = ends.groupBy("node").agg((F.min("end") != F.max("end")).alias("open")).agg(F.max("open")).first()
    return not seen[0]


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``edges (a, b)``; the root is the smallest node of its component."""
    share_package(edges.sparkSession)
    ordered = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # written first: edges often come from a Python step, and two such steps in a task are two workers that hold memory
    edges = settle(_forests(settle(ordered, "edges")), "forests")
    while not _settled(edges):
        edges = settle(_forests(settle(_star(_star(edges, large=True), large=False), "stars")), "forests")
    edges = edges.distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())

"""A Merkle manifest of a table by time-forward processing.

Rows are leaves; the leaves of a source form a tree of fan-out 16, and the roots of the sources' trees form one more. A
tree's nodes carry labels in the order of their making: level by level, left to right. In the forward sweep a priority
queue ordered by label delivers the digests of children to their parents; in the reversed sweep, labels descending, it
delivers to every child what its parent got (the siblings on the way to the root) and the child's own siblings before it.

The queue is external where trees are large: a shuffle sorted by (tree, unit, position) cuts every tree into units of
``16 ** HEIGHT`` neighbouring nodes and delivers their rows in label order; inside a unit a heap takes over. A unit's top
is a node of the next sweep, so the number of sweeps is the height over ``HEIGHT``: three for 16 million leaves. Positions
come from ranks over range partitions, so no source, however large, meets in one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce
from hashlib import sha256
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from babelgauge.llm.work import settle, share_package, tidy

FAN = 16
HEIGHT = 2  # levels of a unit: 256 nodes at most
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
UNIT_SCHEMA = "tree string, unit long, size long, levels int, top string, ids array<long>, digests array<string>, changed array<string>"
PATH_SCHEMA = "tree string, unit long, subroot string, root string, before array<string>, after array<string>"
LEAF_SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def field(value: Column) -> Column:
    """A field as hashed: ``-`` for null, else its UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def ranked(nodes: DataFrame, tree: str, order: list[Column]) -> DataFrame:
    """``nodes`` (a written result) with ``pos`` (from 0, within the tree) and ``size`` (nodes of the tree).

    Rows are dealt to ranges of (tree, order), with a last key that spreads equal rows; a range counts its rows of each
    tree, and the counts of the ranges before give the offset.
    """
    tie = F.xxhash64(F.monotonically_increasing_id())
    tied = nodes.withColumn("__tie", tie)
    keys = [F.col(tree).asc_nulls_first(), *order, F.col("__tie")]
    dealt = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie")
    share_package(nodes.sparkSession)
    at = dealt.columns.index(tree)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            code = batch.column(at).dictionary_encode()
            code = code.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            edges = np.concatenate([[0], np.flatnonzero(code[1:] != code[:-1]) + 1, [len(code)]]) if len(code) else np.zeros(1, np.int64)
            places = np.arange(len(code))
            for start, stop in zip(edges[:-1].tolist(), edges[1:].tolist()):
                name = (batch.column(at)[start].as_py(),)
                seen = seen if name == last else 0
                places[start:stop] += seen - start
                last, seen = name, seen + stop - start
            yield batch.append_column("place", pa.array(places, pa.int64()))

    placed = dealt.mapInArrow(tidy(number), StructType([*dealt.schema.fields, StructField("place", LongType())])).withColumn("range", F.spark_partition_id())
    placed = settle(placed, "ranges")
    counts = placed.groupBy(tree, "range").agg(F.count("*").alias("n"))  # one row for each tree and range it lies in
    whole = Window.partitionBy(tree).orderBy("range")
    offsets = counts.select(F.col(tree).alias("__tree"), F.col("range").alias("__range"),
                            (F.sum("n").over(whole) - F.col("n")).alias("__before"), F.sum("n").over(Window.partitionBy(tree)).alias("size"))
    same = (F.col("range") == F.col("__range")) & F.col(tree).eqNullSafe(F.col("__tree"))
    return placed.join(offsets, same).withColumn("pos", F.col("place") + F.col("__before")).drop("__tree", "__range", "__before", "place", "range")


def height(size: int) -> int:
    """Levels above the leaves of a tree."""
    levels = 0
    while size > 1:
        size, levels = -(-size // FAN), levels + 1
    return levels


def forward(digests: list[str], levels: int) -> list[list[str]]:
    """The digests of every level of a unit, leaves first. The queue's messages are (level, node, child, digest)."""
    queue = [(0, i, 0, d) for i, d in enumerate(digests)]  # ordered by label already, so a heap
    nodes: list[list[str]] = [[] for _ in range(levels + 1)]
    while queue:
        level, node, _, _ = queue[0]
        inputs = []
        while queue and queue[0][:2] == (level, node):
            inputs.append(heapq.heappop(queue)[3])
        own = sha256("".join(inputs).encode()).hexdigest() if level else inputs[0]
        nodes[level].append(own)
        if level < levels:
            heapq.heappush(queue, (level + 1, node // FAN, node % FAN, own))
    return nodes


def backward(nodes: list[list[str]], before: list[str], after: list[str]) -> Iterator[tuple[int, list[str], list[str]]]:
    """For every leaf its siblings before and after it, level by level up to the root, from those of the unit's top."""
    queue: list[tuple[int, int, list[str], list[str]]] = [(1 - len(nodes), 0, before, after)]
    while queue:
        level, node, left, right = heapq.heappop(queue)  # labels descend: the level counts down, then the node
        level, node = -level, -node
        if not level:
            yield node, left, right
            continue
        children = nodes[level - 1][node * FAN : (node + 1) * FAN]
        for i in range(len(children)):
            heapq.heappush(queue, (1 - level, -(node * FAN + i), ["".join(children[:i]), *left], ["".join(children[i + 1 :]), *right]))


def fold(digest_: str, before: list[str], after: list[str]) -> str:
    for left, right in zip(before, after):
        digest_ = sha256(f"{left}{digest_}{right}".encode()).hexdigest()
    return digest_


def units(nodes: DataFrame) -> DataFrame:
    """The forward sweep over ``tree, pos, size, left (levels), id, digest, changed``: one row for each unit, written.

    ``levels`` is how many levels the unit climbs; the top is the digest it hands on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def closed() -> pa.RecordBatch:
            first = held[0]
            levels = min(HEIGHT, first["left"])
            top = forward([r["digest"] for r in held], levels)[-1]
            row = {"tree": first["tree"], "unit": first["unit"], "size": first["size"], "levels": levels, "top": top[0], "ids": [r["id"] for r in held],
                   "digests": [r["digest"] for r in held], "changed": [r["changed"] for r in held]}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["tree"], row["unit"]) != (held[0]["tree"], held[0]["unit"]):
                    yield closed()
                    held = []
                held.append(row)
        if held:
            yield closed()

    schema = to_arrow_schema(StructType.fromDDL(UNIT_SCHEMA))
    unit = F.floor(F.col("pos") / FAN**HEIGHT).cast("long").alias("unit")
    told = nodes.select("tree", unit, "pos", "size", "left", "id", "digest", "changed")
    return settle(told.repartition("tree", "unit").sortWithinPartitions("tree", "unit", "pos").mapInArrow(tidy(run), UNIT_SCHEMA), "units")


def climb(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """All sweeps over the trees of ``leaves``; the unit tables from the leaves up, and ``tree, top`` of every tree."""
    sweeps = [units(leaves)]
    while True:
        last = sweeps[-1]
        rest = last.where(F.col("size") > FAN**HEIGHT)
        if rest.isEmpty():
            break
        size = F.floor((F.col("size") + FAN**HEIGHT - 1) / FAN**HEIGHT).cast("long")
        upper = rest.select("tree", F.col("unit").alias("pos"), size.alias("size"), F.col("unit").alias("id"), F.col("top").alias("digest"), F.col("top").alias("changed"))
        sweeps.append(units(upper.withColumn("left", _height(F.col("size")))))
    tops = [s.where(F.col("size") <= FAN**HEIGHT).select("tree", "top") for s in sweeps]
    out = tops[0]
    for t in tops[1:]:
        out = out.union(t)
    return sweeps, out


def _height(size: Column) -> Column:
    """``height`` as an expression: how many powers of the fan-out lie below the size."""
    return reduce(add, [(size > F.lit(FAN**i)).cast("int") for i in range(15)])


def descend(sweeps: list[DataFrame], paths: DataFrame) -> DataFrame:
    """``tree, unit, subroot, root, before, after`` of every unit of the lowest sweep: the siblings from its top up.

    ``paths`` holds the siblings above each tree's root, and the two roots. The reversed sweep goes through the unit tables from the top.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = [{"tree": row["tree"], "unit": row["ids"][i], "subroot": row["subroot"], "root": row["root"], "before": b, "after": a}
                        for i, b, a in backward(forward(row["digests"], row["levels"]), row["before"], row["after"])]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = to_arrow_schema(StructType.fromDDL(PATH_SCHEMA))
    known = None
    for depth in range(len(sweeps) - 1, -1, -1):
        level = sweeps[depth]
        above = level.where(F.col("size") <= FAN**HEIGHT).select("tree", "unit").join(paths, "tree").select("tree", "unit", "subroot", "root", "before", "after")
        if known is not None:
            above = above.unionByName(known)
        if not depth:
            return above
        known = settle(level.select("tree", "unit", "levels", "ids", "digests").join(above, ["tree", "unit"]).mapInArrow(tidy(run), PATH_SCHEMA), "paths")


def merkle_manifest(docs: DataFrame, tampers: Column, tampered_text: Column) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every document.

    ``docs`` needs ``doc_id, source, lang, n_chars, text``; other columns are ignored. A leaf is the SHA-256 of these five
    fields, a null one written ``-``, so a null differs from every value and from an empty text. Within a source (null is
    one as well, the first) leaves ascend by ``doc_id``, null last; rows with equal ids by their digest, so that equal
    rows are neighbours and any order of them gives the same tree. A source with one leaf has it as its root, and a table
    with one source the source's root. Where ``tampers`` holds (null: it does not) the proof is checked for the row with
    ``tampered_text`` in place of its text, else for the row itself; ``proof_sha256`` is the digest of all siblings on the
    way to the root. Texts of any length are hashed whole. An empty table gives no rows.
    """
    spark = docs.sparkSession
    names = ["doc_id", "source", "lang", "n_chars"]
    plain = [F.col(c) for c in names]
    leaf = digest(*plain, F.col("text"))
    changed = F.when(F.coalesce(tampers, F.lit(False)), digest(*plain, tampered_text)).otherwise(leaf)
    # names of trees: '-' for the null source, so that no key of a shuffle is null and '' stays itself
    named = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    leaves = settle(docs.select(F.col("doc_id").cast("long").alias("id"), named.alias("tree"), leaf.alias("digest"), changed.alias("changed")), "leaves")
    placed = ranked(leaves, "tree", [F.col("id").asc_nulls_last(), F.col("digest"), F.col("changed")])
    sweeps, tops = climb(placed.withColumn("left", _height(F.col("size"))))
    tops = settle(tops, "subroots")
    # '-' sorts before '=', as null before every source
    sources = ranked(tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("top").alias("digest")), "tree", [F.col("name")])
    sources = settle(sources.withColumn("left", _height(F.col("size"))), "sources")
    upper, root = climb(sources.select("tree", "pos", "size", "left", F.col("pos").alias("id"), "digest", F.col("digest").alias("changed")))
    none = F.array().cast("array<string>")
    top_units = descend(upper, root.select("tree", F.col("top").alias("subroot"), F.col("top").alias("root"), none.alias("before"), none.alias("after")))
    share_package(spark)

    def to_children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = list(backward(forward(row["digests"], row["levels"]), row["before"], row["after"]))
                yield pa.RecordBatch.from_arrays([pa.array([row["ids"][i] for i, _, _ in found], pa.int64()), pa.array([row["digests"][i] for i, _, _ in found], pa.string()),
                                                  pa.array([row["root"]] * len(found), pa.string()), pa.array([b for _, b, _ in found], pa.list_(pa.string())),
                                                  pa.array([a for _, _, a in found], pa.list_(pa.string()))], names=["pos", "subroot", "root", "before", "after"])

    told = upper[0].select("tree", "unit", "levels", "ids", "digests").join(top_units, ["tree", "unit"])
    by_source = told.mapInArrow(tidy(to_children), "pos long, subroot string, root string, before array<string>, after array<string>")
    paths = settle(by_source.join(sources.select("pos", F.col("name").alias("tree")), "pos").drop("pos"), "source-paths")
    unit_paths = descend(sweeps, paths)

    def to_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                nodes = forward(row["digests"], row["levels"])
                out: list[tuple] = []
                for i, before, after in backward(nodes, row["before"], row["after"]):
                    proof = sha256()
                    for left, right in zip(before, after):
                        proof.update(f"{left}{right}".encode())
                    out.append((row["ids"][i], row["digests"][i], row["subroot"], row["root"], proof.hexdigest(), fold(row["changed"][i], before, after)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), *[pa.string()] * 5))],
                                                 names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"])

    found = sweeps[0].select("tree", "unit", "levels", "ids", "digests", "changed").join(unit_paths, ["tree", "unit"]).mapInArrow(tidy(to_leaves), LEAF_SCHEMA)
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))

"""Exact top-k inner-product search as a Voronoi kNN join.

Inner products become distances by one more component: data x gets sqrt(M^2 - |x|^2), where M bounds all lengths, and
queries get 0; then |q - x|^2 = |q|^2 + M^2 - 2 q.x, and the largest products are the smallest distances.

Every vector belongs to the cell of its nearest pivot. Cells have summaries: for queries their radius, for data the
smallest k distances to the pivot, and the span of distances. From these alone follows, for each cell of queries, a bound
that the k-th neighbour of any of its queries keeps; and with the triangle inequality, which data rows can be nearer than
that. Queries are grouped by cells, and a data row is sent to the groups that need it, only to those. Within a group,
data meets queries in blocks of bounded size (a hot cell is many blocks), each block keeps the k best for each query, and
these are merged. Scores are computed as whole numbers; distances only decide what need not be sent, with a margin for
rounding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from babelgauge.llm.work import settle, share_package, tidy

PIVOTS = 48
GROUP_QUERIES = 4096  # queries of a group, at most twice that
BLOCK_ROWS = 8192  # data rows of a block, about
EXACT = float(1 << 53)  # sums of products below are exact as doubles
LONG = (1 << 63) - 1


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """``vec_id, v``: components as floor(1024 x). Rows without identifier, null or with null or non-finite components go."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    kept = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~F.coalesce(odd, F.lit(True)))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * 1024)).alias("v")).distinct()


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def lifted(x: np.ndarray, limit: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(limit**2 - (x * x).sum(axis=1), 0))[:, None]], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(squares, 0))


def products(queries: list, data: list, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products; as doubles where no sum can lose a digit, else as Python integers."""
    top = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1])
    if top < EXACT:
        return (q @ x.T).astype(np.int64)
    exact = np.array(queries, object) @ np.array(data, object).T
    return np.array([[max(-LONG - 1, min(LONG, int(s))) for s in row] for row in exact], np.int64).reshape(len(queries), len(data))


def top_products(embeddings: DataFrame, queries, k: int = 10, pivots: int = PIVOTS) -> DataFrame:
    """The k highest inner products of every query vector with all others: ``query_id, rank, vec_id, score``.

    ``embeddings`` needs ``vec_id`` and ``embedding``; other columns are ignored. ``queries`` is a condition on
    ``vec_id``. Candidates are all rows but those with the query's own ``vec_id``, ties go to the smaller ``vec_id``, and
    fewer than k candidates are all returned. Vectors meet only vectors of their own length. Rows without ``vec_id`` and
    vectors that are null or hold a null or non-finite component take no part; repeated rows count once (rows with one
    ``vec_id`` but different vectors are separate candidates); empty vectors have product 0; an empty table gives no rows. Products beyond the range of a long stop at its ends.

    To the driver: the pivots, at most ``pivots`` vectors of each length, and summaries of at most pivots x k numbers.
    """
    share_package(embeddings.sparkSession)
    rows = settle(whole_vectors(embeddings).withColumn("dim", F.size("v")).withColumn("query", queries), "vectors")
    parts = [_search(rows.where(F.col("dim") == r["dim"]), k, pivots, r["dim"]) for r in rows.select("dim").distinct().orderBy("dim").collect()]
    if not parts:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _search(rows: DataFrame, k: int, n_pivots: int, dim: int) -> DataFrame:
    spark = rows.sparkSession
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    limit = float(np.sqrt(rows.agg(F.max(square)).first()[0] or 0.0)) * (1 + 1e-12) + 1e-9
    picked = rows.orderBy(F.xxhash64(F.lit(1), "vec_id"), "vec_id").limit(n_pivots).collect()
    centre = lifted(np.array([r["v"] for r in picked], np.float64).reshape(len(picked), dim), limit)
    margin = 1e-6 * (limit + 1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1)) if dim else np.zeros((batch.num_rows, 0))
            data, query = distances(lifted(x, limit), centre), distances(np.concatenate([x, np.zeros((len(x), 1))], axis=1), centre)
            of, q_of, at = data.argmin(axis=1), query.argmin(axis=1), np.arange(len(x))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), *map(pa.array, (of.astype(np.int32), data[at, of], q_of.astype(np.int32), query[at, q_of]))],
                names=["vec_id", "v", "query", "cell", "far", "q_cell", "q_far"],
            )

    found = settle(rows.select("vec_id", "v", "query").mapInArrow(tidy(assign), "vec_id long, v array<long>, query boolean, cell int, far double, q_cell int, q_far double"), "voronoi")

    # summaries: at most pivots x (k + 1) rows
    nearest = Window.partitionBy("cell").orderBy("far", "vec_id")
    heads = found.select("cell", "far", "vec_id").withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= k + 1).collect()
    cells = {r["cell"]: (r["n"], r["low"], r["high"]) for r in found.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).collect()}
    asked = {r["q_cell"]: (r["n"], r["radius"]) for r in found.where("query").groupBy("q_cell").agg(F.count("*").alias("n"), F.max("q_far").alias("radius")).collect()}
    if not asked:
        return _named(found.limit(0).select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0).cast("long").alias("score")), k)

    between = distances(centre, centre)
    bound = {}
    for i, (_, radius) in asked.items():  # radius + pivot to pivot + pivot to row, of the (k + 1)-th identifier (one may be the query's own)
        reach, ids = np.inf, set()
        for far, vec_id in sorted((radius + between[i, r["cell"]] + r["far"], r["vec_id"]) for r in heads):
            ids.add(vec_id)
            if len(ids) > k:
                reach = far + margin
                break
        bound[i] = reach

    groups: list[list[int]] = []  # cells of queries, neighbours together; a hot cell is several groups
    group_of, held = {}, GROUP_QUERIES
    for i in sorted(asked, key=lambda i: (between[0, i], i)):
        n = asked[i][0]
        if held + n > GROUP_QUERIES:
            group_of[i] = len(groups)
            groups += [[i]] * -(-n // GROUP_QUERIES)
            held = n
        else:
            group_of[i] = len(groups) - 1
            groups[-1] = [*groups[-1], i]
            held += n
    splits = {i: sum(members == [i] for members in groups) or 1 for i in asked}
    # a row of cell j is needed if it can be within the bound of some cell of the group: far >= |p_i p_j| - radius - bound
    least = {(g, j): min(between[i, j] - asked[i][1] - bound[i] for i in members) - margin for g, members in enumerate(groups) for j in cells}
    most = {(g, j): max(between[i, j] + asked[i][1] + bound[i] for i in members) + margin for g, members in enumerate(groups) for j in cells}
    blocks = {j: -(-n // BLOCK_ROWS) for j, (n, _, _) in cells.items()}
    first = dict(zip(sorted(blocks), np.cumsum([0, *[blocks[j] for j in sorted(blocks)]]).tolist()))

    def lookup(pairs: dict) -> Column:
        return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])

    needs = [(g, j, float(least[g, j]), float(most[g, j]), int(first[j]), int(blocks[j])) for g in range(len(groups)) for j in cells if cells[j][2] >= least[g, j] and cells[j][1] <= most[g, j]]
    needed = spark.createDataFrame(needs, "grp int, j int, least double, most double, first int, blocks int")
    within = (F.col("cell") == F.col("j")) & (F.col("far") >= F.col("least")) & (F.col("far") <= F.col("most"))
    block = F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    data = found.join(F.broadcast(needed), within).select("grp", block.alias("block"), F.col("vec_id").alias("data_id"), F.col("v").alias("x"))  # groups x pivots rows
    split = F.pmod(F.xxhash64(F.lit(2), "vec_id"), lookup(splits)[F.col("q_cell")]).cast("int")
    asks = found.where("query").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), (lookup(group_of)[F.col("q_cell")] + split).alias("grp"))
    meets = needed.select("grp", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("blocks") - 1)).alias("block"))
    asks = asks.join(meets, "grp").select("grp", "block", "query_id", "q")

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [])
        if left.num_rows and right.num_rows:
            right = right.sort_by("data_id")
            x, ids = matrix(right.column("x").combine_chunks()) if dim else np.zeros((right.num_rows, 0)), right.column("data_id").to_numpy()
            data = right.column("x").to_pylist() if np.abs(x).max(initial=0) ** 2 * max(1, dim) >= EXACT else []
            for at in range(0, left.num_rows, 512):
                part = left.slice(at, 512)
                q, own = matrix(part.column("q").combine_chunks()) if dim else np.zeros((part.num_rows, 0)), part.column("query_id").to_numpy()
                big = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, dim) >= EXACT
                scores = products(part.column("q").to_pylist() if big else [], data or (right.column("x").to_pylist() if big else []), q, x)
                for i in range(len(own)):
                    others = np.flatnonzero(ids != own[i])
                    s = scores[i, others]
                    if len(s) > k:
                        edge = np.partition(s, len(s) - k)[len(s) - k]
                        others, s = others[s >= edge], s[s >= edge]
                    best = np.lexsort((ids[others], ~s))[:k]
                    out[0].append(np.full(len(best), own[i]))
                    out[1].append(ids[others][best])
                    out[2].append(s[best])
        arrays = [pa.array(np.concatenate(o) if o else np.zeros(0, np.int64), pa.int64()) for o in out]
        return pa.Table.from_arrays(arrays, names=["query_id", "vec_id", "score"])

    solved = asks.groupBy("grp", "block").cogroup(data.groupBy("grp", "block")).applyInArrow(solve, "query_id long, vec_id long, score long")
    return _named(solved, k)


def _named(solved: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return solved.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

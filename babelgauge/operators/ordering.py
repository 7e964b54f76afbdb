"""Running sums and exact quantiles that never put a whole group into one task.

``sum() over (partition by g order by x)`` sorts all of ``g`` in one task, which fails when one group holds a
third of the table. Here rows are cut into blocks along the order column, totals per block give every block
its offset, and only rows of one block share a window. The result is the same number, exactly.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from babelgauge.session import settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_WIDTH = 1 << 20  # order positions per block, for integer sequence columns


def running_sum(df: DataFrame, keys: Sequence[str], order: str, value: Column, name: str,
                block: Column | None = None) -> DataFrame:
    """Add ``name``: the inclusive running sum of ``value`` within ``keys`` in order of ``order``.

    ``order`` must be unique within the keys. ``block`` must grow with it; by default it is a range of
    ``BLOCK_WIDTH`` consecutive numbers, so a window never sees more rows than that.
    """
    block = F.floor(F.col(order) / BLOCK_WIDTH) if block is None else block
    cut = df.withColumn("_block", block).withColumn("_value", value)
    on = [*keys, "_block"]
    totals = cut.groupBy(*on).agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*on, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*on).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = cut.withColumn("_sum", F.sum("_value").over(within))
    return null_safe_join(summed, offsets, on) \
        .select(*df.columns, (F.col("_offset") + F.col("_sum")).alias(name))


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; keeps the left copy of the keys."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    condition = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return left.join(renamed, condition, how).drop(*[f"_r_{c}" for c in on])


def _running_totals(keys: Sequence[str]):
    """An Arrow function over sorted rows: adds the running sum of ``n`` within equal keys, from the partition's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            for key in keys:
                code = batch.column(key).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            new[0] = last != [batch.column(k)[0].as_py() for k in keys]
            n = batch.column("n").to_numpy()
            total = np.cumsum(n)
            starts = np.flatnonzero(new)
            before = np.concatenate(([-carried], (total - n)[starts]))  # what ran before each group began
            out = total - before[np.searchsorted(starts, np.arange(len(n)), side="right")]
            last, carried = [batch.column(k)[-1].as_py() for k in keys], int(out[-1])
            yield batch.append_column("cum", pa.array(out, pa.int64()))

    return run


def ranked_counts(counts: DataFrame, keys: Sequence[str], order: Sequence[str] = ("value",)) -> DataFrame:
    """``counts`` with ``cum``, the running sum of ``n`` within the keys along ``order``, and ``total``.

    Rows are dealt to ranges of (keys, order) and summed as a sorted stream; the sums of the ranges before, one row for
    each range and key, are the offsets. No group meets in one task and nothing is brought to the driver. ``counts`` must
    be a written table (ranges are drawn from a sample of it) without repeated (keys, order).
    """
    dealt = counts.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    schema = StructType([*dealt.schema.fields, StructField("cum", LongType())])
    ranged = settle(dealt.mapInArrow(_running_totals(keys), schema).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(*keys, "_range").agg(F.sum("n").alias("_n"))
    along = Window.partitionBy(*keys).orderBy("_range")
    offsets = sums.select(*keys, "_range", (F.sum("_n").over(along) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(*keys)).alias("total"))
    joined = null_safe_join(ranged, offsets, [*keys, "_range"])
    return joined.withColumn("cum", F.col("cum") + F.col("_before")).drop("_range", "_before")


def cumulative_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by``, ``column``, ``value``, ``n``, ``cum``, ``total``: every distinct value with its running count.

    Equal values are counted before anything is sorted, so a hot value is one row. Nulls are left out. The counts
    are written out once: the source is read a single time.
    """
    long = df.select(*by, *[F.col(c).cast("double") for c in columns]) \
        .unpivot([F.col(c) for c in by], [F.col(c) for c in columns], "column", "value").where("value IS NOT NULL")
    keys = [*by, "column"]
    return ranked_counts(settle(long.groupBy(*keys, "value").agg(F.count("*").alias("n")), "value-counts"), keys)


def quantiles(cumulative: DataFrame, probabilities: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolation quantiles from ``cumulative_counts``: one ``q_<percent>`` column each.

    The two neighbours of a quantile are picked out by their rank, so nothing is sorted again.
    """
    aggregates = []
    for p in probabilities:
        place = (F.col("total") - 1) * F.lit(p)
        low, high = F.floor(place), F.ceil(place)

        def at(rank: Column) -> Column:
            before = F.col("cum") - F.col("n")
            picked = F.col("value")
            if "between" in cumulative.columns:  # of values that are one row only the first and the last are known
                unknown = F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")
                picked = F.when(rank == before, F.col("first")).when(rank == F.col("cum") - 1, F.col("last")).when(F.col("between"), unknown).otherwise(picked)
            return F.max(F.when((F.col("cum") > rank) & (before <= rank), picked))

        fraction = F.max(place - low)
        aggregates.append((at(low) + (at(high) - at(low)) * fraction).alias(f"q_{round(p * 100)}"))
    return cumulative.groupBy(*by, "column").agg(*aggregates)


def bracketed_counts(values: DataFrame, keys: Sequence[str], brackets: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """The counts that exact quantiles need, as ``cumulative_counts``: single values only near the quantiles.

    ``brackets`` holds, a row for each key, ``low`` and ``high`` (arrays, one entry for each probability) between which the
    quantile must lie, give or take one rank. All values between two brackets are one row (``between``) that stands after
    the bracket before; ``first`` and ``last`` are its least and greatest.
    """
    # the highest bracket that begins at or below the value; a value beyond its end is between brackets
    low, high = ([f"{side}[{i}]" for i in range(len(probabilities))] for side in ("low", "high"))
    inside = " OR ".join(f"value BETWEEN {a} AND {b}" for a, b in zip(low, high))
    after = "greatest(" + ", ".join(f"if(value >= {a}, {b}, -double('inf'))" for a, b in zip(low, high)) + ", -double('inf'))"
    placed = null_safe_join(values, brackets, keys).select(*keys, F.expr(f"if({inside}, value, {after})").alias("place"), F.expr(f"NOT ({inside})").alias("between"), "value")
    counts = settle(placed.groupBy(*keys, "place", "between").agg(F.count("*").alias("n"), F.min("value").alias("first"), F.max("value").alias("last")), "value-counts")
    return ranked_counts(counts, keys, ["place", "between"]).withColumn("value", F.col("place"))


def dense_ids(df: DataFrame, column: str, name: str = "id", first: int = 0) -> DataFrame:
    """Distinct values of a string column with ids ``first``, ``first + 1``, ...: no global sort.

    Values are dealt into 4096 equal blocks by the head of their digest; ids follow (digest head, value).
    """
    distinct = df.select(column).where(F.col(column).isNotNull()).distinct() \
        .withColumn("_block", F.substring(F.md5(F.col(column).cast("binary")), 1, 3))
    sizes = distinct.groupBy("_block").agg(F.count("*").alias("_n"))  # at most 4096 rows
    before = Window.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_block").orderBy(column)
    return distinct.withColumn("_rank", F.row_number().over(within)).join(F.broadcast(offsets), "_block") \
        .select(column, (F.col("_offset") + F.col("_rank") - 1 + first).cast("long").alias(name))

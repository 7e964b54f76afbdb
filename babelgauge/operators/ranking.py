"""Best rows per group, leaderboards and top-k.

"Best" is ``max_by`` over a struct: it combines on the map side, so a group of any size reaches the shuffle as
one row per task. Ties are settled by the remaining run parameters, so results do not depend on row order.

Spark aggregates structs, and ranks rows, by sorting them. An Arrow pass therefore goes first where rows count once for
each metric: of every batch it keeps the rows that can be among the best, so that only few are copied and sorted.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _leaders(df: DataFrame, values: Sequence[tuple[Column, int]], by: Sequence[str] = ()) -> DataFrame:
    """The rows of ``df`` that can be among the k highest of their group by one of ``values (value, k)``: of every Arrow
    batch those not below its k-th highest, ties included. Null is no value; NaN is the lowest. Rows keep their columns."""
    width = len(df.columns)
    keys = [df.columns.index(c) for c in by]
    ks = [k for _, k in values]
    marked = df.select("*", *[value.cast("double").alias(f"_value_{i}") for i, (value, _) in enumerate(values)])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = np.zeros(batch.num_rows, np.int64)
            for key in keys:
                if pa.types.is_nested(batch.column(key).type):  # no codes: every row is its own group
                    group = np.arange(batch.num_rows)
                    break
                code = batch.column(key).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                group = np.unique(group * (batch.num_rows + 1) + code, return_inverse=True)[1].astype(np.int64)
            kept = np.zeros(batch.num_rows, bool)
            for i, k in enumerate(ks):
                column = batch.column(width + i)
                there = np.flatnonzero(pc.is_valid(column).to_numpy(zero_copy_only=False))
                loss = -column.to_numpy(zero_copy_only=False)[there]  # ascending, so that NaN is last
                order = np.lexsort((loss, group[there]))
                ordered, loss = group[there][order], loss[order]
                first = np.searchsorted(ordered, ordered)
                last = np.searchsorted(ordered, ordered, side="right") - 1
                bound = loss[np.minimum(first + k - 1, last)]
                kept[there[order[(loss <= bound) | np.isnan(bound)]]] = True
            if kept.any():
                yield pa.RecordBatch.from_arrays(batch.columns[:width], schema=pa.schema(list(batch.schema)[:width])).filter(pa.array(kept))

    return marked.mapInArrow(keep, df.schema)


def best_rows(df: DataFrame, by: Sequence[str | Column], order: Column, descending: bool = True,
              columns: Sequence[str] | None = None) -> DataFrame:
    """The row with the highest (lowest) ``order`` per group; rows with equal order go by lowest other columns."""
    columns = list(columns or df.columns)
    row = F.struct(*columns)
    if descending:  # max of order, then min of the row
        picked = F.min_by(row, F.struct((-order).alias("order"), row))
    else:
        picked = F.min_by(row, F.struct(order.alias("order"), row))
    return df.where(order.isNotNull()).groupBy(*by).agg(picked.alias("_row")).select("_row.*")


def best_per_metric(runs: DataFrame, metrics: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The best row per group for every metric: one scan for all metrics."""
    highest = [(F.col(m), 1) for m in metrics]
    nan = [(F.when(F.isnan(m), 1), 1) for m in metrics]  # the highest value is NaN where there is one, the best row another
    runs = _leaders(runs, highest + nan, by)
    row = F.struct(*[c for c in runs.columns])
    long = runs.select(*by, row.alias("_row"), F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("_m"))
    best = long.where("_m.value IS NOT NULL").groupBy(*by, F.col("_m.metric").alias("metric")).agg(
        F.min_by("_row", F.struct(-F.col("_m.value"), F.col("_row"))).alias("_row"),
        F.max("_m.value").alias("value"))
    return best.select("metric", "value", "_row.*")


def best_values(runs: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("dataset_name", "model_name")) -> DataFrame:
    """Best value per model and metric, with the model's rank inside its dataset."""
    from pyspark.sql import Window

    best = runs.groupBy(*by).agg(*[F.max(m).alias(m) for m in metrics]) \
        .unpivot([F.col(c) for c in by], [F.col(m) for m in metrics], "metric", "value")
    order = Window.partitionBy("dataset_name", "metric").orderBy(F.desc("value"), "model_name")  # one row per model
    return best.withColumn("place", F.row_number().over(order))


def top_k(df: DataFrame, order: Column, k: int, descending: bool = True) -> DataFrame:
    """The k best rows, ties by the other columns: a per-task top-k and one small merge."""
    first = order.desc_nulls_last() if descending else order.asc_nulls_last()
    return df.orderBy(first, *[F.col(c) for c in df.columns]).limit(k)


def top_k_per_metric(df: DataFrame, orders: dict[str, tuple[Column, Column, int]]) -> DataFrame:
    """The best rows for several measures from one scan: ``metric`` and the row.

    ``orders`` names, per metric, the condition its rows must meet, the value (higher is better) and k. Rows without
    a value are left out. A row is one candidate per metric; tasks keep few of a batch before anything is sorted.
    """
    from pyspark.sql import Window

    # NaN is the highest value here
    df = _leaders(df, [(F.when(kept, F.nanvl(value.cast("double"), F.lit(float("inf")))), k) for kept, value, k in orders.values()])
    row = F.struct(*df.columns)
    entries = [F.struct(F.lit(m).alias("metric"), F.when(kept, value.cast("double")).alias("value"), F.lit(k).alias("k"))
               for m, (kept, value, k) in orders.items()]
    long = df.select(row.alias("_row"), F.explode(F.array(*entries)).alias("_m")).where("_m.value IS NOT NULL") \
        .select("_m.metric", "_m.value", "_m.k", "_row")
    place = F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("value"), "_row"))
    most = max(k for _, _, k in orders.values())
    return long.withColumn("place", place).where((F.col("place") <= most)).where("place <= k") \
        .select("metric", "place", "_row.*")


def extremes(df: DataFrame, higher_is_better: dict[str, bool], best: int = 1, worst: int = 2) -> DataFrame:
    """The best and worst rows by every measure, as ``measure, kind, place`` and the row. Rows without a value of the
    measure are neither."""
    orders = {}
    for measure, higher in higher_is_better.items():
        for kind, k in (("best", best), ("worst", worst)):
            value = F.col(measure) if higher == (kind == "best") else -F.col(measure)
            orders[f"{measure}|{kind}"] = (F.lit(True), value, k)
    found = top_k_per_metric(df, orders)
    parts = F.split("metric", r"\|")
    return found.select(parts[0].alias("measure"), parts[1].alias("kind"), "place", *df.columns)

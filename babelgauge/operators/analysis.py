"""Descriptive statistics: describe, spread per metric, grouped means with intervals, histograms, ECDFs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from babelgauge.operators.ordering import bracketed_counts, cumulative_counts, null_safe_join, quantiles
from babelgauge.session import settle

SKETCH = 1000  # the sketch's ranks are off by at most 1 / SKETCH of the rows
BRACKET = 2.5 / SKETCH


def describe(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """count, mean, std, min, quartiles and max of every column, one row per column.

    One pass gives the moments and a quantile sketch. For exact quartiles a second pass counts single values only in
    the narrow brackets that the sketch leaves (``BRACKET`` of all rows around each quartile) and everything between
    them as one; ranks come from range partitions, so no task holds a column. ``exact=False`` ends with the sketch.
    """
    keys, wanted = [*by, "column"], [0.25, 0.5, 0.75]
    values = unpivot(df, columns, by)
    asked = wanted if not exact else [max(0.0, p - BRACKET) for p in wanted] + [min(1.0, p + BRACKET) for p in wanted]
    summed = values.groupBy(*keys).agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.percentile_approx("value", asked, SKETCH).alias("q"))
    basic = [*keys, "count", "mean", "std", "min"]
    if not exact:
        return summed.selectExpr(*basic, "q[0] AS q_25", "q[1] AS q_50", "q[2] AS q_75", "max")
    summed = settle(summed, "summary")
    brackets = summed.where("count > 0").select(*keys, F.slice("q", 1, 3).alias("low"), F.slice("q", 4, 3).alias("high"))
    counted = bracketed_counts(values.where("value IS NOT NULL"), keys, brackets, wanted)
    found = null_safe_join(summed.drop("q"), quantiles(counted, wanted, by), keys)
    return found.select(*basic, "q_25", "q_50", "q_75", "max")


def unpivot(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` and one (column, value) row per measure: one scan for any number of measures."""
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns]) \
        .unpivot([F.col(c) for c in keep], [F.col(c) for c in columns], "column", "value")


def spread_by_metric(df: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and sample standard deviation of every metric."""
    return unpivot(df, metrics, by).groupBy(*by, "column") \
        .agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def filtered_sizes(runs: DataFrame) -> DataFrame:
    """Corpus size left by every input-length limit, over multi-sentence runs.

    All runs of a dataset and limit should agree; where they do not, the first in key order is taken. Files too
    old to record the size are left out.
    """
    key = F.struct("model_name", "batch_size", "beam_size", "max_gen_length", "tokenizer_padding_setting",
                   "dataset_size_after_filter_wrt_input_len")
    recorded = F.col("dataset_size_after_filter_wrt_input_len").isNotNull()
    return runs.where((F.col("dataset_size") != 1) & recorded).groupBy("dataset_name", "max_input_seq_length").agg(
        F.min_by("dataset_size_after_filter_wrt_input_len", key).alias("size_after_filter"),
        F.max("dataset_size").alias("dataset_size"))


def grouped_interval(df: DataFrame, measures: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Mean per group with a normal 95 % interval: what an error-bar plot shows."""
    half = F.lit(1.96) * F.col("std") / F.sqrt(F.col("n"))
    return unpivot(df, measures, by).groupBy(*by, "column") \
        .agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")) \
        .select(*by, "column", "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


PRIME = 268435399  # below 2^28, so that products of two residues are exact
POISSON = [0.367879441, 0.735758882, 0.919698603, 0.981011843, 0.996340153, 0.999405815]  # shares of 0, 0 to 1, ...


def resample_mixers(samples: int) -> list[tuple[int, int]]:
    """Multiplier and addend of every resample: a row's draw is ``(row * multiplier + addend) % PRIME / PRIME``."""
    return [((s * 1103515245 + 12345) % PRIME, (s * 214013 + 2531011) % PRIME) for s in range(1, samples + 1)]


def bootstrap_interval(df: DataFrame, measure: str, by: Sequence[str], row_key: Sequence[str],
                       samples: int = 200) -> DataFrame:
    """Mean per group with a Poisson-bootstrap 95 % interval.

    Every row draws a Poisson(1) weight per resample from a digest of its key (columns that read the same as text
    everywhere: integers and strings). An Arrow batch adds up its resamples at once and emits one row per group and
    resample; these are summed on the map side again. A recomputed task draws the same weights.
    """
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in row_key])
    row = F.conv(F.substring(F.md5(key.cast("binary")), 1, 7), 16, 10).cast("long")
    keys = [f"_by{i}" for i in range(len(by))]
    rows = df.where(F.col(measure).isNotNull()).select(
        *[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(measure).cast("double").alias("_value"), row.alias("_row"))
    mixers = resample_mixers(samples)

    def resample(batches):
        import numpy as np
        import pandas as pd

        factor, addend = (np.array(x, np.int64) for x in zip(*mixers))
        for batch in batches:
            group = batch.groupby(keys, dropna=False, sort=False).ngroup().to_numpy() if keys else np.zeros(len(batch), int)
            if not len(batch):
                continue
            draw = (batch["_row"].to_numpy()[:, None] * factor + addend) % PRIME / PRIME
            weight = np.searchsorted(POISSON, draw, side="left").astype(np.float64)
            sums = np.zeros((2, group.max() + 1, samples))
            np.add.at(sums[0], group, weight)
            np.add.at(sums[1], group, weight * batch["_value"].to_numpy()[:, None])
            heads = batch[keys].iloc[pd.Series(group).drop_duplicates().index] if keys else pd.DataFrame(index=[0])
            out = heads.loc[heads.index.repeat(samples)].reset_index(drop=True)
            yield out.assign(_sample=np.tile(np.arange(samples), len(heads)), _weight=sums[0].ravel(), _sum=sums[1].ravel())

    types = {f.name: f.dataType for f in rows.schema.fields}
    schema = StructType([StructField(k, types[k]) for k in keys]).add("_sample", "long").add("_weight", "double").add("_sum", "double")
    means = rows.mapInPandas(resample, schema).groupBy(*keys, "_sample").agg(
        (F.sum("_sum") / F.nullif(F.sum("_weight"), F.lit(0.0))).alias("_mean"))
    sorted_means = means.groupBy(*keys).agg(F.sort_array(F.collect_list("_mean")).alias("_b"))  # ``samples`` numbers
    plain = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_value").alias("mean"))

    def at(share: float) -> Column:
        return F.get("_b", F.floor((F.size("_b") - 1) * F.lit(share)).cast("int"))

    joined = null_safe_join(plain, sorted_means, keys) if keys else plain.crossJoin(sorted_means)  # one row each
    return joined.select(*[F.col(k).alias(c) for k, c in zip(keys, by)], "n", "mean", at(0.025).alias("low"), at(0.975).alias("high"))


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 100, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins over the range of every column, with plain and cumulative counts.

    The ranges are one row per group, made by a first pass; the second pass bins on the map side, so at most ``bins``
    rows per group and task are shuffled. Empty bins have no row.
    """
    from pyspark.sql import Window

    keys = [*by, "column"]
    values = unpivot(df, columns, by).where("value IS NOT NULL")
    edges = values.groupBy(*keys).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    width = (F.col("high") - F.col("low")) / F.lit(bins)
    number = F.when(F.col("high") == F.col("low"), F.lit(0)) \
        .otherwise(F.least(F.floor((F.col("value") - F.col("low")) / width), F.lit(bins - 1)))
    binned = null_safe_join(values, edges, keys).withColumn("bin", number.cast("long")) \
        .groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    running = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return binned.select(*keys, "bin", "n", F.sum("n").over(running).alias("cumulative"))


def ecdf(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Share of rows at or below every distinct value."""
    return cumulative_counts(df, columns, by).select(
        *by, "column", "value", "n", (F.col("cum") / F.col("total")).alias("ecdf"))


def shares_at_most(df: DataFrame, columns: Sequence[str], marks: Sequence[int]) -> DataFrame:
    """Share of rows at or below every mark, per column."""
    return unpivot(df, columns).groupBy("column").agg(
        *[F.avg((F.col("value") <= m).cast("int")).alias(f"at_most_{m}") for m in marks])

"""Cleaning and slicing of the experiment table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from babelgauge.functions.models import short_name
from babelgauge.operators.ordering import null_safe_join

MAX_BEAM, MAX_GEN = 32, 128  # fixed values: the outlier caps of the studies


def fill_missing(runs: DataFrame) -> DataFrame:
    """A missing offload flag means it was off; a missing ratio stays missing (it is not a number)."""
    return runs.na.fill(False, ["use_archer"])


def cap_outliers(runs: DataFrame, beam: int | None = MAX_BEAM, gen: int | None = MAX_GEN) -> DataFrame:
    """Runs within the caps; ``None`` is no cap."""
    for column, cap in (("beam_size", beam), ("max_gen_length", gen)):
        if cap is not None:
            runs = runs.where(F.col(column) <= cap)
    return runs


def clean_runs(runs: DataFrame, beam: int | None = MAX_BEAM, gen: int | None = MAX_GEN) -> DataFrame:
    """Fill, cap and deduplicate. The caps come first so that they reach the scan."""
    return fill_missing(cap_outliers(runs, beam, gen)).dropDuplicates()


def short_names(runs: DataFrame) -> DataFrame:
    return runs.withColumn("model_name", short_name(F.col("model_name")))


def without(runs: DataFrame, **values) -> DataFrame:
    """Chained inequality filters; a list excludes each of its values. Rows without a value stay."""
    for column, value in values.items():
        for v in value if isinstance(value, list) else [value]:
            runs = runs.where(~F.col(column).eqNullSafe(v))
    return runs


def only(runs: DataFrame, **values) -> DataFrame:
    """Equality filters, all of which must hold; a list means membership."""
    for column, value in values.items():
        runs = runs.where(F.col(column).isin(value) if isinstance(value, list) else F.col(column) == value)
    return runs


def ratio_set_or_resident() -> Column:
    """Runs with an explicit memory ratio, or that did not offload at all."""
    ratio = F.col("device_memory_ratio")
    return (ratio.isNotNull() & (ratio != 0)) | ~F.coalesce("use_archer", F.lit(False))


def split_check(runs: DataFrame, by: list[str]) -> DataFrame:
    """Single- and multi-sentence runs, their shares, and whether the parts add up to the whole."""
    counted = runs.groupBy(*by).agg(F.count_if(F.col("dataset_size") == 1).alias("single"),
                                    F.count_if(~F.col("dataset_size").eqNullSafe(1)).alias("multi"),
                                    F.count("*").alias("runs"))
    return counted.select(*by, "single", "multi", "runs", (F.col("single") / F.col("runs")).alias("single_share"),
                          (F.col("single") + F.col("multi") == F.col("runs")).alias("adds_up"))


def with_parameter_count(runs: DataFrame, models: DataFrame) -> DataFrame:
    """``runs`` with ``total_params`` of their model from the model dimension ``models (model_name, total_params)``.

    A model that is listed more than once counts as its largest; one that is not listed has none, and its runs stay.
    """
    largest = models.groupBy("model_name").agg(F.max("total_params").alias("total_params"))
    return null_safe_join(runs, largest, ["model_name"], "left")

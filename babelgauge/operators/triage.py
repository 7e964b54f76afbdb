"""Failure triage. Input: ``failures(sweep_id, seq, batch_size, dataset_size, message)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from babelgauge.operators.ordering import running_sum

ERROR_BUDGET = 20  # fixed value: other errors a sweep survives


def is_memory_failure(message: Column) -> Column:
    return F.contains(F.lower(message), F.lit("out of memory"))


def next_batch_size(batch_size: Column, message: Column) -> Column:
    """Batch size to retry a memory failure with: a quarter, but one for two; null when there is no retry."""
    retry = is_memory_failure(message) & (batch_size != 1)
    return F.when(retry & (batch_size > 2), F.floor(batch_size / 4)).when(retry, F.lit(1)).cast("long")


def spend_budget(failures: DataFrame) -> DataFrame:
    """Add ``other_errors``: how many errors that cannot be retried the sweep has seen so far.

    One sweep may hold most of the failures, so the count is the blocked running sum.
    """
    other = F.when(next_batch_size(F.col("batch_size"), F.col("message")).isNull(), 1).otherwise(0)
    return running_sum(failures, ["sweep_id"], "seq", other, "other_errors")


def triage(failures: DataFrame, budget: int = ERROR_BUDGET) -> DataFrame:
    """Add ``next_batch_size`` and ``action``: reduce, continue while the budget lasts, then abort."""
    spent = spend_budget(failures) \
        .withColumn("next_batch_size", next_batch_size(F.col("batch_size"), F.col("message")))
    return spent.withColumn("action", F.when(F.col("next_batch_size").isNotNull(), "reduce")
                            .when(F.col("other_errors") <= budget, "continue").otherwise("abort"))

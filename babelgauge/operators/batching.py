"""Token-id batches: padding, masks, lengths and counts. Input: ``(idx long, ids array<int>)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from babelgauge.operators.ordering import running_sum

PAD, LABEL_MASK = 0, -100  # fixed values
BLOCK = 1 << 13  # places in the order that are numbered together: the rows hold texts


def with_batches(df: DataFrame, batch_size: int, idx: str = "idx") -> DataFrame:
    """Fixed-size batches in order of ``idx`` (0, 1, 2, ...); the last one may be short."""
    return df.withColumn("batch_id", F.floor(F.col(idx) / batch_size).cast("long"))


def renumbered(df: DataFrame, idx: str = "idx", keys: Sequence[str] = ()) -> DataFrame:
    """The rows left after a filter numbered 0, 1, 2, ... in order of ``idx`` (within ``keys``), so that batches are full
    again."""
    counted = running_sum(df, list(keys), idx, F.lit(1), "_number", F.floor(F.col(idx) / BLOCK))
    return counted.withColumn(idx, (F.col("_number") - 1).cast("long")).drop("_number")


def unmask(ids: Column, pad: int = PAD) -> Column:
    """Label ids with the loss mask replaced by the pad id."""
    return F.transform(ids, lambda x: F.when(x == LABEL_MASK, F.lit(pad)).otherwise(x))


def pad_batches(batched: DataFrame, pad: int = PAD) -> DataFrame:
    """Pad every row to the longest one of its batch.

    The longest length is a grouped maximum joined back; ids themselves are not shuffled for it, and
    batches are of fixed size, so no key is hot.
    """
    longest = batched.groupBy("batch_id").agg(F.max(F.size("ids")).alias("width"))
    return batched.join(longest, "batch_id") \
        .withColumn("ids", F.concat("ids", F.array_repeat(F.lit(pad), F.col("width") - F.size("ids"))))


def token_length(ids: Column, pad: int = PAD) -> Column:
    """Ids that are not padding."""
    return F.size(F.filter(ids, lambda x: x != pad)).cast("long")


def attention_mask(ids: Column, pad: int = PAD) -> Column:
    return F.transform(ids, lambda x: (x != pad).cast("int"))


def batch_token_counts(batched: DataFrame, pad: int = PAD, keys: Sequence[str] = ()) -> DataFrame:
    return batched.groupBy(*keys, "batch_id").agg(F.sum(token_length(F.col("ids"), pad)).alias("n_tokens"))


def truncate(tokens: Column, padding: str | None = None, cap: int = 512) -> Column:
    """Apply the length cap; ``do_not_pad`` runs without it, every other padding setting with it."""
    return tokens if padding == "do_not_pad" else F.slice(tokens, 1, cap)

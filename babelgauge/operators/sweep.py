"""Sweep planning: grids, resolved sizes, and which planned runs are already recorded."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from babelgauge.functions.models import SPLIT_SIZES, canonical_dataset
from babelgauge.operators.ordering import null_safe_join
from babelgauge.schemas import EXPERIMENT_KEYS

# The axes of the quality sweep. ``None`` as a size means the whole corpus.
QUALITY_AXES = {
    "dataset_size": [1, None],
    "max_input_seq_length": [-1, 15, 30],
    "tokenizer_padding_setting": ["pad_to_max_length", "do_not_pad"],
    "max_gen_length": [128, 256, 512],
    "beam_size": [1, 2, 4],
}
SETTING_TYPES = {"use_archer": "boolean", "device_memory_ratio": "double", "model_name": "string",
                 "dataset_name": "string", "tokenizer_padding_setting": "string"}


def derive(config: Mapping, **changes) -> dict:
    """A copy of a sweep with some axes replaced."""
    unknown = set(changes) - set(config)
    if unknown:
        raise KeyError(f"not an axis of this sweep: {sorted(unknown)}")
    return {**config, **changes}


def _typed(name: str, value) -> Column:
    kind = SETTING_TYPES.get(name, "bigint")
    if isinstance(value, list):
        return F.array(*[F.lit(v) for v in value]).cast(f"array<{kind}>")
    return F.lit(value).cast(kind)


def expand(base: DataFrame, axes: Mapping) -> DataFrame:
    """Every combination of the axes for every row of ``base``: lists are exploded, scalars are settings."""
    for name, value in axes.items():
        column = _typed(name, value)
        base = base.withColumn(name, F.explode(column) if isinstance(value, list) else column)
    return base


def sweep_grid(spark: SparkSession, config: Mapping) -> DataFrame:
    """The grid of one configuration, starting from a single row."""
    return expand(spark.range(1).select(), config)


def resolve_sizes(planned: DataFrame) -> DataFrame:
    """Sizes as numbers of sentences: a missing size is the whole split, a larger one is clamped to it."""
    split = F.create_map(*[F.lit(x) for item in SPLIT_SIZES.items() for x in item])
    limit = F.try_element_at(split, F.col("dataset_name")).cast("long")
    return planned.withColumn("dataset_name", canonical_dataset(F.col("dataset_name"))) \
        .withColumn("dataset_size", F.least(F.coalesce("dataset_size", limit), limit))


def recorded_keys(runs: DataFrame) -> DataFrame:
    """Distinct experiment keys of finished runs; deduplicated before the join so that repeats cost nothing."""
    return runs.select(
        "model_name", canonical_dataset(F.col("dataset_name")).alias("dataset_name"), "dataset_size", "max_gen_length",
        "beam_size", "max_input_seq_length", "tokenizer_padding_setting",
        F.coalesce("use_archer", F.lit(False)).alias("use_archer"), "device_memory_ratio").distinct()


def unrecorded(planned: DataFrame, recorded: DataFrame, keys: Sequence[str] = EXPERIMENT_KEYS) -> DataFrame:
    """Planned runs with no finished twin; a missing ratio equals a missing ratio."""
    return null_safe_join(planned, recorded.select(*keys), list(keys), "left_anti")


def already_recorded(planned: DataFrame, recorded: DataFrame, keys: Sequence[str] = EXPERIMENT_KEYS) -> DataFrame:
    return null_safe_join(planned, recorded.select(*keys), list(keys), "left_semi")


def filtered_corpus_sizes(corpus: DataFrame, limits: Sequence[int], text: str = "en") -> DataFrame:
    """``max_input_seq_length, n`` for every limit in one pass: one conditional count per limit, no join."""
    from babelgauge.functions.text import word_count

    words = corpus.select(word_count(F.col(text)).alias("words"))
    counted = words.agg(*[F.count_if((F.lit(m) == -1) | (F.col("words") <= m)).alias(f"n{i}")
                          for i, m in enumerate(limits)])
    return counted.select(F.explode(F.array(*[
        F.struct(F.lit(m).cast("long").alias("max_input_seq_length"), F.col(f"n{i}").alias("n"))
        for i, m in enumerate(limits)])).alias("e")).select("e.*")


def skip_empty(planned: DataFrame, sizes: DataFrame) -> DataFrame:
    """Drop planned runs whose input limit leaves no sentence. ``sizes`` has one row per limit; a run with a limit
    that is not among them stays, with a null ``n``."""
    return planned.join(sizes, "max_input_seq_length", "left").where("n IS NULL OR n > 0")

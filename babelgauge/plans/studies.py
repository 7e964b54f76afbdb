"""The analysis studies over the cleaned experiment table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from babelgauge.operators.analysis import describe, grouped_interval, histogram, shares_at_most
from babelgauge.operators.ranking import best_rows, extremes, top_k
from babelgauge.operators.runs import clean_runs, only, short_names, without
from babelgauge.schemas import QUALITY_COLUMNS, SPEED_COLUMNS
from babelgauge.sources.corpora import with_word_counts
from babelgauge.sources.results import union_versions

BETTER = {"encoder_latency_s": False, "decoder_latency_s": False, "encoder_throughput": True,
          "decoder_throughput": True}
LENGTH_MARKS = [15, 30, 82]  # fixed values: the marks of the length study


def merged_runs(fragments: Sequence[DataFrame]) -> DataFrame:
    """All result files as one clean table."""
    return clean_runs(union_versions(fragments))


def full_corpus_runs(runs: DataFrame) -> DataFrame:
    """Runs on unlimited input over more than one sentence: the basis of the leaderboards."""
    return without(only(runs, max_input_seq_length=-1), dataset_size=1)


def leaderboard(runs: DataFrame, metric: str = "meteor") -> DataFrame:
    """The best configuration of every model per dataset, with its quality and speed.

    The ranking metric is explicit. The default is the one the published tables were ranked by.
    """
    return best_rows(full_corpus_runs(runs), ["dataset_name", "model_name"], F.col(metric)) \
        .select("dataset_name", "model_name", *QUALITY_COLUMNS, *SPEED_COLUMNS)


def beam_study(runs: DataFrame) -> DataFrame:
    """Effect of the beam size on decoder speed and quality, by model."""
    kept = without(short_names(runs), model_name="switch-base-128", beam_size=8)
    return grouped_interval(kept, ["decoder_latency_s", "decoder_throughput", "sacrebleu"], ["beam_size", "model_name"])


def input_length_study(runs: DataFrame) -> DataFrame:
    """Effect of the input limit on encoder and decoder speed, by dense model."""
    kept = without(short_names(runs), model_name=["switch-base-128", "switch_16_finetuned", "nllb-moe-54b"],
                   beam_size=8, max_input_seq_length=10, dataset_size=1)
    return grouped_interval(kept, SPEED_COLUMNS, ["max_input_seq_length", "model_name"])


def fastest(runs: DataFrame, model: str = "t5-large", measure: str = "decoder_latency_s") -> DataFrame:
    """The fastest multi-sentence row of one model."""
    kept = without(short_names(runs), beam_size=8, max_input_seq_length=10, dataset_size=1)
    return top_k(only(kept, model_name=model), F.col(measure), 1, descending=False)


def ratio_study(runs: DataFrame, model: str = "switch_16_finetuned", ceiling: float = 1000) -> DataFrame:
    """One row per memory ratio (a missing ratio is its own group): the first by the remaining columns.

    Restricted to runs with a plausible encoder throughput.
    """
    kept = only(without(short_names(runs), beam_size=8), model_name=model, dataset_name="wmt14") \
        .where(F.col("encoder_throughput") < ceiling)
    return best_rows(kept, ["device_memory_ratio"], F.lit(0)) \
        .select("device_memory_ratio", *SPEED_COLUMNS, "beam_size", "max_gen_length")


def sparse_model_study(runs: DataFrame, model: str = "nllb-moe-54b") -> DataFrame:
    """The best row and the two worst of a sparse model by every speed measure."""
    kept = only(without(short_names(runs), beam_size=8), model_name=model, dataset_name="wmt14")
    return extremes(kept, BETTER)


def length_profile(corpus: DataFrame, part: str) -> DataFrame:
    """Word counts of a corpus: its ``summary``, ``histogram`` or ``shares`` under the usual marks."""
    counted = with_word_counts(corpus)
    columns = ["word_count_en", "word_count_fr"]
    if part == "summary":
        return describe(counted, columns)
    if part == "histogram":
        return histogram(counted, columns)
    if part == "shares":
        return shares_at_most(counted, columns, LENGTH_MARKS)
    raise ValueError(f"unknown part {part!r}")

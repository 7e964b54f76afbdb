"""Finished runs, end to end: pairs, token counts and the forward log become 24-column result rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from babelgauge.operators.latency import LAYERS, of_layer
from babelgauge.operators.quality import Metric, evaluate
from babelgauge.schemas import RUN_COLUMNS


def assemble_results(config: DataFrame, corpus_sizes: DataFrame, pairs: DataFrame, tokens: DataFrame,
                     forward_log: DataFrame, metrics: Sequence[Metric]) -> DataFrame:
    """All result rows in one job, whatever the number of runs.

    ``config(run_id, ...)`` holds the settings, ``corpus_sizes(run_id, dataset_size,
    dataset_size_after_filter_wrt_input_len)``, ``pairs(run_id, prediction, reference, gen_len)``,
    ``tokens(run_id, encoder_tokens, decoder_tokens)``. Everything is aggregated to one row per run before the
    joins, so the joins are small. Every run of ``config`` has a row; what was not recorded for it is null.
    """
    quality = evaluate(pairs, metrics, ["run_id"], gen_len=F.col("gen_len"))
    latency = forward_log.groupBy("run_id").agg(
        *[F.avg(of_layer(layer, F.col("latency_s"))).alias(f"{layer}_latency_s") for layer in LAYERS])
    joined = config
    for part in (corpus_sizes, quality, tokens, latency):
        joined = joined.join(part, "run_id", "left")
    for layer in LAYERS:
        joined = joined.withColumn(f"{layer}_throughput", F.col(f"{layer}_tokens") / F.col(f"{layer}_latency_s"))
    return joined.select("run_id", *RUN_COLUMNS)

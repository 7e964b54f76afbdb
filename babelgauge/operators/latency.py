"""Forward-pass logs to latency and throughput.

Inputs: ``forward_log(run_id, call_seq, layer_type, latency_s)`` and ``batch_tokens(run_id, batch_idx, n_tokens)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from babelgauge.operators.ordering import running_sum

LAYERS = ["encoder", "decoder"]


def of_layer(layer: str, value: Column) -> Column:
    return F.when(F.col("layer_type") == layer, value)


def mean_latency(forward_log: DataFrame) -> DataFrame:
    """Mean latency per run, one column per layer type, in one pass without a pivot shuffle."""
    return forward_log.groupBy("run_id").agg(
        *[F.avg(of_layer(layer, F.col("latency_s"))).alias(f"{layer}_latency_s") for layer in LAYERS])


def number_encoder_calls(forward_log: DataFrame) -> DataFrame:
    """Encoder calls with their position in the run, from 0: the batch they served.

    A run may hold any share of the log, so positions come from the blocked running count.
    """
    calls = forward_log.where(F.col("layer_type") == "encoder").select("run_id", "call_seq", "latency_s")
    return running_sum(calls, ["run_id"], "call_seq", F.lit(1), "_n") \
        .select("run_id", "call_seq", "latency_s", (F.col("_n") - 1).cast("long").alias("batch_idx"))


def zip_batches(forward_log: DataFrame, batch_tokens: DataFrame) -> DataFrame:
    """Every encoder call with the token count of its batch; null where no batch was recorded."""
    return number_encoder_calls(forward_log).join(batch_tokens, ["run_id", "batch_idx"], "left")


def per_token_latency(zipped: DataFrame) -> DataFrame:
    """Encoder latency per run: per call (as recorded) and per token (as documented)."""
    return zipped.groupBy("run_id").agg(
        F.avg("latency_s").alias("per_call"),
        F.avg(F.col("latency_s") / F.nullif(F.col("n_tokens"), F.lit(0))).alias("per_token"),
        F.count("n_tokens").alias("matched_calls"))


def throughput(forward_log: DataFrame, tokens: DataFrame) -> DataFrame:
    """Tokens per second and layer. ``tokens(run_id, encoder_tokens, decoder_tokens)``.

    ``mean_based`` divides the token total by the mean call (the recorded definition, which grows with the
    number of calls); ``sum_based`` divides by the total time and is a rate. A run without a log has nulls.
    """
    latency = forward_log.groupBy("run_id").agg(*[
        f(of_layer(layer, F.col("latency_s"))).alias(f"{layer}_{kind}")
        for layer in LAYERS for kind, f in (("mean", F.avg), ("sum", F.sum))])
    return tokens.join(latency, "run_id", "left").select("run_id", *[
        (F.col(f"{layer}_tokens") / F.col(f"{layer}_{kind}")).alias(f"{layer}_{kind}_based")
        for layer in LAYERS for kind in ("mean", "sum")])


def batch_check(forward_log: DataFrame, batch_tokens: DataFrame) -> DataFrame:
    """Encoder calls against recorded batches per run; ``mismatch`` flags runs where they differ."""
    calls = forward_log.groupBy("run_id").agg(F.count_if(F.col("layer_type") == "encoder").alias("encoder_calls"))
    batches = batch_tokens.groupBy("run_id").agg(F.count("*").alias("batches"))
    return calls.join(batches, "run_id", "full").select(
        "run_id", F.coalesce("encoder_calls", F.lit(0)).alias("encoder_calls"),
        F.coalesce("batches", F.lit(0)).alias("batches")) \
        .withColumn("mismatch", F.col("encoder_calls") != F.col("batches"))


def end_to_end(forward_log: DataFrame, rows: DataFrame) -> DataFrame:
    """Whole-run latency and rows per second. ``rows(run_id, n_rows)``. A run without a log has nulls."""
    spent = forward_log.groupBy("run_id").agg(F.sum("latency_s").alias("latency_s"))
    return rows.join(spent, "run_id", "left").select("run_id", "n_rows", "latency_s",
                                             (F.col("n_rows") / F.col("latency_s")).alias("rows_per_s"))

"""Incremental forms: metric statistics batch by batch, and tailing the forward log."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from babelgauge.operators.quality import Metric, row_statistics, scores, sum_statistics
from babelgauge.session import work_path
from babelgauge.sources.tables import Table


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def running_statistics(pairs: DataFrame, metrics: Sequence[Metric], by: Sequence[str]) -> DataFrame:
    """Streaming sums of the metric statistics per group: constant state per group, exactly-once sums."""
    return sum_statistics(row_statistics(pairs, metrics, list(by)), by)


def run_to_table(stream: DataFrame, path: str, mode: str = "complete") -> StreamingQuery:
    """Process what is available and keep the current result as a table below ``path``.

    A complete result is a new version of a manifest table (``sources.tables``): readers see the version before or this
    one, never a part; a micro-batch that is run again changes nothing, and older versions are removed. Appended results
    go through the transactional file sink.
    """
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/_state")
    if mode == "append":
        return writer.outputMode("append").format("parquet").option("path", f"{path}/table").start()

    def add_version(batch: DataFrame, number: int) -> None:
        Table(batch.sparkSession, f"{path}/table").replace(batch, ("stream", number))

    return writer.outputMode("complete").foreachBatch(add_version).start()


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The newest complete result below ``path``."""
    return Table(spark, f"{path}/table").read(schema)


def stream_scores(spark: SparkSession, pairs: DataFrame, metrics: Sequence[Metric], by: Sequence[str]) -> DataFrame:
    """Scores after all available micro-batches; equal to the batch result."""
    path = work_path(spark, "stream-scores")
    sums = running_statistics(pairs, metrics, by)
    run_to_table(sums, path).awaitTermination()
    return scores(read_table(spark, path, sums.schema), metrics, by)


def tail_latency(log: DataFrame) -> DataFrame:
    """Mean latency per layer over everything read so far."""
    return log.groupBy("layer_type").agg(F.avg("latency_s").alias("mean_latency_s"), F.count("*").alias("calls"))


def zip_online(calls: DataFrame, batches: DataFrame, lateness: str = "1 hour", patience: str = "1 day") -> DataFrame:
    """Encoder calls with the token counts of their batches, as both come: ``run_id, batch_idx, call_seq, latency_s,
    n_tokens, matched``.

    ``calls (run_id, call_seq, layer_type, latency_s, ts)`` and ``batches (run_id, batch_idx, n_tokens, ts)`` are streams.
    A call's place in its run is known once the watermark (``lateness`` behind the newest row) has passed it; calls are
    numbered by (ts, call_seq) then. A call whose count comes later waits for it, ``patience`` at most by event time; then
    it is told without (``matched`` false: what a batch check flags). The state of a run holds the calls of that stretch,
    the counts that no call has asked for yet, and the next number.
    """
    told = calls.where("layer_type = 'encoder'").selectExpr("CAST(run_id AS BIGINT) AS run_id", "'call' AS kind", "CAST(call_seq AS BIGINT) AS seq", "CAST(latency_s AS DOUBLE) AS number", "CAST(ts AS TIMESTAMP) AS ts")
    counted = batches.selectExpr("CAST(run_id AS BIGINT) AS run_id", "'batch' AS kind", "CAST(batch_idx AS BIGINT) AS seq", "CAST(n_tokens AS DOUBLE) AS number", "CAST(ts AS TIMESTAMP) AS ts")
    wait = int(pd.Timedelta(patience) / pd.Timedelta("1ms"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"next": 0, "calls": [], "open": [], "tokens": {}}
        for frame in frames:
            for kind, seq, number, ts in zip(frame["kind"], frame["seq"].tolist(), frame["number"].tolist(), frame["millis"].tolist()):
                if kind == "call":
                    held["calls"].append((ts, seq, number))
                else:
                    held["tokens"][str(seq)] = None if pd.isna(number) else int(number)
        mark = state.getCurrentWatermarkMs()
        passed = sorted(c for c in map(tuple, held["calls"]) if c[0] < mark)
        held["calls"] = [c for c in held["calls"] if c[0] >= mark]
        held["open"] += [(held["next"] + i, *call) for i, call in enumerate(passed)]
        held["next"] += len(passed)
        out, still = [], []
        for number, ts, seq, latency in held["open"]:
            known = str(number) in held["tokens"]
            if known or ts + wait < mark:
                out.append((key[0], number, seq, latency, held["tokens"].pop(str(number), None), known))
            else:
                still.append((number, ts, seq, latency))
        held["open"] = still
        due = [c[0] for c in held["calls"]] + [ts + wait for _, ts, *_ in still]
        state.update((json.dumps(held),))
        if due:
            state.setTimeoutTimestamp(max(min(due), mark) + 1)
        frame = pd.DataFrame(out, columns=["run_id", "batch_idx", "call_seq", "latency_s", "n_tokens", "matched"])
        yield frame.astype({"n_tokens": "Int64"})

    both = told.unionByName(counted).withColumn("millis", F.unix_millis("ts")).withWatermark("ts", lateness)
    return both.groupBy("run_id").applyInPandasWithState(
        step, "run_id long, batch_idx long, call_seq long, latency_s double, n_tokens long, matched boolean", "held string",
        "append", GroupStateTimeout.EventTimeTimeout)


def _per_window(log: DataFrame, width: str, time: str) -> DataFrame:
    return log.groupBy(F.window(time, width), "layer_type") \
        .agg(F.avg("latency_s").alias("mean_latency_s"), F.count("*").alias("calls")) \
        .select(F.col("window.start").alias("window_start"), "layer_type", "mean_latency_s", "calls")


def windowed_latency(log: DataFrame, width: str = "1 day", lateness: str = "1 hour", time: str = "ts") -> DataFrame:
    """Mean latency per layer and time window; windows close ``lateness`` behind the newest call."""
    timed = log.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
    return _per_window(timed, width, time)


def open_windows(log: DataFrame, width: str = "1 day", lateness: str = "1 hour", time: str = "ts") -> DataFrame:
    """The windows that are not closed yet, from the stored calls: those that end less than ``lateness`` behind the
    newest call. Only calls that can lie in one are read on."""
    timed = log.withColumn(time, F.col(time).cast("timestamp"))
    newest = timed.agg(F.max(time)).first()[0]
    if newest is None:
        return _per_window(timed, width, time)
    mark = F.lit(newest) - F.expr(f"INTERVAL {lateness}")
    return _per_window(timed.where(F.window(time, width)["end"] > mark), width, time)

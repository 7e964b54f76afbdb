"""Forward-pass logs and token totals: J2, E1 to E6, E14, U1, ST2."""

from __future__ import annotations

from pyspark.sql import functions as F

from babelgauge import streaming
from babelgauge.operators import latency as L
from babelgauge.operators.batching import token_length, unmask
from babelgauge.catalog.standin import BATCH, stand_in, tries_sql
from babelgauge.operators import inference
from babelgauge.operators.triage import triage
from babelgauge.session import settle, work_path


def rounded(df, **digits):
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


def events_stream(t):
    """The events table as a file stream, in the role of the growing forward log."""
    schema = t.events.schema
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    kind = F.when(F.col("event_type").isin("signup", "purchase"), "encoder").otherwise("decoder")
    return stream.where("event_type <> 'error'").select("ts", kind.alias("layer_type"),
                                                        (F.col("value") / 1000).alias("latency_s"))


def register(add) -> None:
    zipped = """zipped AS (SELECT c.run_id, c.call_seq, c.batch_idx, c.latency_s, b.n_tokens FROM (
            SELECT run_id, call_seq, latency_s,
                row_number() OVER (PARTITION BY run_id ORDER BY call_seq) - 1 AS batch_idx
            FROM forward_log WHERE layer_type = 'encoder') c LEFT JOIN batch_tokens b USING (run_id, batch_idx))"""
    add("j2_batch_zip", lambda t: L.zip_batches(t.forward_log, t.batch_tokens),
        f"WITH {zipped} SELECT run_id, batch_idx, call_seq, latency_s, n_tokens FROM zipped")
    add("e1_mean_latency", lambda t: rounded(L.mean_latency(t.forward_log), encoder_latency_s=12, decoder_latency_s=12),
        """SELECT run_id, round(avg(latency_s) FILTER (WHERE layer_type = 'encoder'), 12) AS encoder_latency_s,
            round(avg(latency_s) FILTER (WHERE layer_type = 'decoder'), 12) AS decoder_latency_s
        FROM forward_log GROUP BY run_id""")
    add("e2_per_token_latency", lambda t: rounded(L.per_token_latency(L.zip_batches(t.forward_log, t.batch_tokens)),
                                                  per_call=12, per_token=12),
        f"""WITH {zipped} SELECT run_id, round(avg(latency_s), 12) AS per_call,
            round(avg(latency_s / nullif(n_tokens, 0)), 12) AS per_token, count(n_tokens) AS matched_calls
        FROM zipped GROUP BY run_id""")
    add("e3_throughput", lambda t: rounded(L.throughput(t.forward_log, t.run_tokens), encoder_mean_based=5,
        encoder_sum_based=8, decoder_mean_based=5, decoder_sum_based=8),
        """SELECT run_id, round(max(encoder_tokens) / avg(e), 5) AS encoder_mean_based,
            round(max(encoder_tokens) / sum(e), 8) AS encoder_sum_based,
            round(max(decoder_tokens) / avg(d), 5) AS decoder_mean_based,
            round(max(decoder_tokens) / sum(d), 8) AS decoder_sum_based
        FROM (SELECT run_id, CASE WHEN layer_type = 'encoder' THEN latency_s END AS e,
            CASE WHEN layer_type = 'decoder' THEN latency_s END AS d FROM forward_log) l JOIN run_tokens USING (run_id)
        GROUP BY run_id""")
    lengths = "len(list_filter(ids, lambda x: x <> 0 AND x <> -100))"

    def gen_len():
        return token_length(unmask(F.col("ids")))

    add("e4_decoded_tokens", lambda t: t.token_ids.agg(F.sum(gen_len()).alias("decoded_tokens")),
        f"SELECT CAST(sum({lengths}) AS BIGINT) AS decoded_tokens FROM token_ids")
    add("e5_mean_length", lambda t: t.token_ids.agg(F.round(F.avg(gen_len()), 9).alias("gen_len")),
        f"SELECT round(avg({lengths}), 9) AS gen_len FROM token_ids")
    add("e6_batch_check", lambda t: L.batch_check(t.forward_log, t.batch_tokens),
        """SELECT run_id, encoder_calls, batches, encoder_calls <> batches AS mismatch
        FROM (SELECT run_id, count(*) FILTER (WHERE layer_type = 'encoder') AS encoder_calls FROM forward_log GROUP BY 1) c
        JOIN (SELECT run_id, count(*) AS batches FROM batch_tokens GROUP BY 1) b USING (run_id)""")
    add("e14_end_to_end", lambda t: rounded(L.end_to_end(t.forward_log, t.run_tokens.select("run_id", "n_rows")),
                                            latency_s=9, rows_per_s=9),
        """SELECT run_id, n_rows, round(s, 9) AS latency_s, round(n_rows / s, 9) AS rows_per_s
        FROM run_tokens LEFT JOIN (SELECT run_id, sum(latency_s) AS s FROM forward_log GROUP BY run_id) l USING (run_id)""")

    def translated(t):
        """Run 7: all documents through the stand-in model, failures and all."""
        source = t.documents.select(F.col("doc_id").alias("idx"), F.col("text").alias("source"))
        return settle(inference.translate_batches(source, stand_in, BATCH, run_id=7), "events")

    given = "given AS (SELECT CAST(7 AS BIGINT) AS run_id, doc_id AS n, text FROM documents)"
    add("u1_batched_map", lambda t: inference.predictions(translated(t)).select(
        "idx", "run_id", "batch_id", F.md5("prediction").alias("digest")),
        f"""WITH {given}, {tries_sql('given')} SELECT n AS idx, run_id, batch_id, md5(p) AS digest FROM said""")
    spent = """spent AS (SELECT *, CAST(sum(CASE WHEN next_batch_size IS NULL THEN 1 ELSE 0 END)
            OVER (PARTITION BY run_id ORDER BY idx, batch_size DESC) AS BIGINT) AS other_errors
        FROM (SELECT *, CASE WHEN message LIKE '%out of memory%' AND batch_size > 1
            THEN CASE WHEN batch_size > 2 THEN batch_size // 4 ELSE 1 END END AS next_batch_size FROM failed) f)"""
    action = "CASE WHEN next_batch_size IS NOT NULL THEN 'reduce' WHEN other_errors <= 20 THEN 'continue' ELSE 'abort' END"
    add("u1_failures", lambda t: triage(inference.failures(translated(t))).select(
        F.col("sweep_id").alias("run_id"), "batch_id", "idx", "batch_size", "message", "next_batch_size", "action"),
        f"""WITH {given}, {tries_sql('given')}, {spent}
        SELECT run_id, batch_id, idx, batch_size, message, next_batch_size, {action} AS action FROM spent""")
    add("u1_calls", lambda t: rounded(inference.forward_log(translated(t)).groupBy("run_id", "layer_type").agg(
        F.count("*").alias("calls"), F.sum("latency_s").alias("latency_s")), latency_s=6),
        f"""WITH {given}, {tries_sql('given')} SELECT run_id, layer_type, count(*) AS calls, round(sum(s), 6) AS latency_s FROM (
            SELECT run_id, 'encoder' AS layer_type, e AS s FROM calls UNION ALL SELECT run_id, 'decoder', d FROM calls) l GROUP BY ALL""")
    add("u1_within_budget", lambda t: inference.predictions(inference.within_budget(translated(t), budget=3)).select("run_id", "idx"),
        f"""WITH {given}, {tries_sql('given')}, {spent},
            ended AS (SELECT run_id, min(idx) AS e FROM spent WHERE next_batch_size IS NULL AND other_errors > 3 GROUP BY run_id)
        SELECT run_id, n AS idx FROM said LEFT JOIN ended USING (run_id) WHERE e IS NULL OR n < e""")

    def st2(t):
        path = work_path(t.spark, "tail-latency")
        tail = streaming.tail_latency(events_stream(t))
        streaming.run_to_table(tail, path).awaitTermination()
        return rounded(streaming.read_table(t.spark, path, tail.schema), mean_latency_s=12)

    add("st2_tail_latency", st2, """SELECT layer_type, round(avg(latency_s), 12) AS mean_latency_s, count(*) AS calls
        FROM forward_log GROUP BY layer_type""")

    def j2_online(t):
        """The log and the batch counts as two file streams of several micro-batches, which come in any order."""
        calls, counts, path = (work_path(t.spark, n) for n in ("call-stream", "count-stream", "zipped"))
        log = t.forward_log.select("run_id", "call_seq", "layer_type", "latency_s", F.col("ts").cast("timestamp").alias("ts"))
        first = log.agg(F.min("ts")).first()[0]
        late = t.batch_tokens.select("run_id", "batch_idx", "n_tokens", (F.lit(first) + F.expr("INTERVAL 1 HOUR") * F.col("batch_idx")).alias("ts"))
        end = t.spark.sql("SELECT -1L AS run_id, 0L AS call_seq, 'encoder' AS layer_type, 0D AS latency_s, TIMESTAMP '2100-01-01' AS ts")
        log.repartition(3, "call_seq").write.parquet(calls)
        end.write.mode("append").parquet(calls)
        late.repartition(3, "batch_idx").write.parquet(counts)
        read = t.spark.readStream.option("maxFilesPerTrigger", 2)
        zipped = streaming.zip_online(read.schema(log.schema).parquet(calls), read.schema(late.schema).parquet(counts), "3650 days", "1 day")
        streaming.run_to_table(zipped, path, "append").awaitTermination()
        return t.spark.read.schema(zipped.schema).parquet(f"{path}/table").where("run_id >= 0")

    add("j2_online_zip", j2_online, """SELECT c.run_id, c.call_seq, c.batch_idx, c.latency_s, b.n_tokens, b.run_id IS NOT NULL AS matched FROM (
            SELECT run_id, call_seq, latency_s, row_number() OVER (PARTITION BY run_id ORDER BY ts, call_seq) - 1 AS batch_idx
            FROM forward_log WHERE layer_type = 'encoder') c LEFT JOIN batch_tokens b USING (run_id, batch_idx)""")

    def st2_windows(t):
        path = work_path(t.spark, "window-latency")
        closed = streaming.windowed_latency(events_stream(t))
        streaming.run_to_table(closed, path, "append").awaitTermination()
        done = t.spark.read.parquet(f"{path}/table").withColumn("closed", F.lit(True)) \
            .unionByName(streaming.open_windows(t.forward_log).withColumn("closed", F.lit(False)))
        return rounded(done.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd")), mean_latency_s=12)

    add("st2_windowed_latency", st2_windows, """
        SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, layer_type,
            round(avg(latency_s), 12) AS mean_latency_s, count(*) AS calls,
            date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM forward_log) - INTERVAL 1 HOUR AS closed
        FROM forward_log GROUP BY ALL""")

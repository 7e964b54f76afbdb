"""Sweep planning, triage, end-to-end rows and streaming scores: J3 to J7, W8, X1 to X3, ST1."""

from __future__ import annotations

from pyspark.sql import functions as F

from babelgauge.catalog.quality import (ALL_JOINS, ALL_SCORES, DIGITS, NAMES, OPTIONS, all_metrics_sql, bleu_sql,
                                        meteor_sql, rounded, tokens_13a_sql)
from babelgauge.catalog.standin import BATCH, stand_in, tries_sql
from babelgauge.functions.text import as_references, word_count
from babelgauge.operators import sweep as S
from babelgauge.operators.batching import PAD, batch_token_counts, renumbered
from babelgauge.operators.inference import forward_log, predictions, run_batches
from babelgauge.operators.quality import metrics
from babelgauge.operators.triage import next_batch_size, spend_budget, triage
from babelgauge.plans.experiment import assemble_results
from babelgauge.schemas import EXPERIMENT_KEYS, RUN_COLUMNS
from babelgauge.session import settle
from babelgauge.streaming import stream_scores

KEYS = ", ".join(EXPERIMENT_KEYS)
TASK_ROWS = 8192  # texts of a task; merged shuffle partitions make little more than one task for each core, and those are uneven
PRIOR = """prior AS (SELECT DISTINCT model_name, replace(dataset_name, 'facebook/flores', 'flores200') AS dataset_name,
        dataset_size, max_gen_length, beam_size, max_input_seq_length, tokenizer_padding_setting,
        coalesce(use_archer, false) AS use_archer, device_memory_ratio
    FROM runs WHERE total_params <> 320000000 OR sacrebleu > 40)"""


def planned_sql(name: str = "planned", gen: str = "[128, 256, 512]") -> str:
    return f"""{name} AS (
    SELECT model_name, dataset_name, CAST(CASE size WHEN 1 THEN 1 ELSE CASE dataset_name WHEN 'wmt14' THEN 3000 ELSE 997 END
            END AS BIGINT) AS dataset_size, CAST(gen AS BIGINT) AS max_gen_length, CAST(beam AS BIGINT) AS beam_size,
        CAST(lim AS BIGINT) AS max_input_seq_length, pad AS tokenizer_padding_setting, false AS use_archer,
        CAST(NULL AS DOUBLE) AS device_memory_ratio
    FROM (SELECT DISTINCT model_name, replace(dataset_name, 'facebook/flores', 'flores200') AS dataset_name FROM runs) m,
        (SELECT unnest([1, 2]) AS size), (SELECT unnest([-1, 15, 30]) AS lim),
        (SELECT unnest(['pad_to_max_length', 'do_not_pad']) AS pad), (SELECT unnest({gen}) AS gen),
        (SELECT unnest([1, 2, 4]) AS beam))"""


def planned(t, **changes):
    """The quality sweep over every model and dataset on record."""
    base = t.runs.select("model_name", "dataset_name").distinct()
    axes = S.derive({**S.QUALITY_AXES, "use_archer": False, "device_memory_ratio": None}, **changes)
    return S.resolve_sizes(S.expand(base, axes)).select(*EXPERIMENT_KEYS)


def prior(t):
    return S.recorded_keys(t.runs.where("total_params <> 320000000 OR sacrebleu > 40"))


def pairs_stream(t):
    """The documents as a file stream of prediction/reference pairs."""
    stored = t.spark.read.parquet(f"{t.folder}/documents.parquet")
    stream = t.spark.readStream.schema(stored.schema).option("pathGlobFilter", "documents.parquet").parquet(t.folder)
    tasks = t.spark.conf.get("spark.babelgauge.textTasks", None)
    stream = stream.repartition(int(tasks)) if tasks else stream
    predicted = """array_join(transform(filter(split(text, ' ', -1), w -> length(w) <> 2),
        w -> CASE WHEN length(w) = 3 THEN concat(w, 's') ELSE w END), ' ') AS prediction"""
    return stream.selectExpr("lang", "text AS reference", predicted)


def register(add) -> None:
    add("j3_unrecorded_runs", lambda t: S.unrecorded(planned(t), prior(t)),
        f"""WITH {PRIOR}, {planned_sql()} SELECT {KEYS} FROM planned EXCEPT SELECT {KEYS} FROM prior""")
    add("j4_recorded_runs", lambda t: S.already_recorded(planned(t), prior(t)),
        f"""WITH {PRIOR}, {planned_sql()} SELECT {KEYS} FROM planned INTERSECT SELECT {KEYS} FROM prior""")
    add("j5_sweep_grid", planned, f"WITH {planned_sql()} SELECT {KEYS} FROM planned")
    add("j6_derived_sweep", lambda t: planned(t, max_gen_length=[20, 32, 64]),
        f"WITH {planned_sql(gen='[20, 32, 64]')} SELECT {KEYS} FROM planned")

    def j7(t):
        predictions = t.pairs.select("id", "prediction")
        references = t.pairs.select("id", as_references(F.col("reference")).alias("references"))
        return predictions.join(references, "id").select("id", F.md5("prediction").alias("prediction"), F.md5(
            F.get("references", 0)).alias("reference"), F.size("references").cast("long").alias("n_references"))

    add("j7_pairing", j7, r"""SELECT id, md5(prediction) AS prediction,
        md5(regexp_replace(reference, '^\s+|\s+$', '', 'g')) AS reference, CAST(1 AS BIGINT) AS n_references FROM pairs""")

    next_size = """CASE WHEN lower(message) LIKE '%out of memory%' AND batch_size <> 1
        THEN CASE WHEN batch_size > 2 THEN batch_size // 4 ELSE 1 END END"""
    spent = f"""spent AS (SELECT *, CAST(sum(CASE WHEN next_batch_size IS NULL THEN 1 ELSE 0 END)
            OVER (PARTITION BY sweep_id ORDER BY seq) AS BIGINT) AS other_errors
        FROM (SELECT *, {next_size} AS next_batch_size FROM failures) f)"""
    add("w8_error_budget", lambda t: spend_budget(t.failures).select("sweep_id", "seq", "other_errors"),
        f"WITH {spent} SELECT sweep_id, seq, other_errors FROM spent")
    add("x2_next_batch_size", lambda t: t.failures.select(
        "sweep_id", "seq", "batch_size", next_batch_size(F.col("batch_size"), F.col("message")).alias("next_batch_size")),
        f"SELECT sweep_id, seq, batch_size, {next_size} AS next_batch_size FROM failures")
    add("x3_actions", lambda t: triage(t.failures).select("sweep_id", "seq", "next_batch_size", "action"),
        f"""WITH {spent} SELECT sweep_id, seq, next_batch_size, CASE WHEN next_batch_size IS NOT NULL THEN 'reduce'
            WHEN other_errors <= 20 THEN 'continue' ELSE 'abort' END AS action FROM spent""")

    def x1(t):
        """Length filter, full batches, the model with its failures, both layers' log, token counts, result rows."""
        limit = F.col("max_input_seq_length")
        config = settle(t.run_config, "config")  # its size is then known, and while it is small texts are not dealt to runs
        limited = t.pairs.select("id", "run_id", "reference").join(config.select("run_id", "max_input_seq_length"), "run_id") \
            .withColumn("kept", (limit == -1) | (word_count(F.col("reference")) <= limit))
        sizes = limited.groupBy("run_id").agg(
            F.count("*").alias("dataset_size"), F.count_if("kept").alias("dataset_size_after_filter_wrt_input_len"))
        kept = settle(renumbered(limited.where("kept").select("run_id", F.col("id").alias("idx"), "reference"), keys=["run_id"]), "kept")
        tasks = kept.count() // TASK_ROWS
        many = tasks > t.spark.sparkContext.defaultParallelism  # else the session's merging of partitions does
        events = settle(run_batches(kept, stand_in, BATCH, text="reference", tasks=tasks if many else None), "events")
        said = predictions(events)
        if many:
            said, kept = (side.repartition(tasks, "run_id", "idx") for side in (said, kept))
        done = said.join(kept, ["run_id", "idx"])
        ids = F.transform(F.split("reference", " ", -1), lambda w: F.when(F.length(w) <= 2, F.lit(PAD)).otherwise(F.length(w)))
        gen_len = word_count(F.col("prediction"))
        read = batch_token_counts(done.withColumn("ids", ids), keys=["run_id"]).groupBy("run_id").agg(F.sum("n_tokens").alias("encoder_tokens"))
        tokens = read.join(done.groupBy("run_id").agg(F.sum(gen_len).alias("decoder_tokens")), "run_id")
        rows = assemble_results(config, sizes, done.withColumn("gen_len", gen_len), tokens, forward_log(events), metrics(NAMES, **OPTIONS))
        exact = rounded(rows, [*NAMES, "gen_len"])
        return exact.select("run_id", *[F.round(c, 9 if "latency" in c else 4).alias(c) if c.startswith(
            ("encoder", "decoder")) else F.col(c) for c in RUN_COLUMNS])

    add("x1_result_rows", x1, f"""WITH
        limited AS (SELECT p.*, max_input_seq_length = -1
                OR len(string_split(reference, ' ')) <= max_input_seq_length AS kept
            FROM pairs p JOIN run_config USING (run_id)),
        given AS (SELECT id, run_id, row_number() OVER (PARTITION BY run_id ORDER BY id) - 1 AS n, reference AS text FROM limited WHERE kept),
        {tries_sql('given')},
        kept AS (SELECT id, run_id, text AS reference, p AS prediction FROM said), {all_metrics_sql('kept', 'run_id')},
        sizes AS (SELECT run_id, count(*) AS dataset_size, count(*) FILTER (WHERE kept)
            AS dataset_size_after_filter_wrt_input_len FROM limited GROUP BY run_id),
        gen AS (SELECT run_id, round(avg(len(string_split(prediction, ' '))), {DIGITS}) AS gen_len,
            sum(len(string_split(prediction, ' '))) AS decoder_tokens,
            sum(len(list_filter(string_split(reference, ' '), lambda w: length(w) > 2))) AS encoder_tokens FROM kept GROUP BY run_id),
        scored AS (SELECT grp AS run_id, {ALL_SCORES} FROM {ALL_JOINS}),
        lat AS (SELECT run_id, avg(e) AS e, avg(d) AS d FROM calls GROUP BY run_id)
        SELECT c.*, s.* EXCLUDE (run_id), q.* EXCLUDE (run_id), gen_len, round(e, 9) AS encoder_latency_s,
            round(d, 9) AS decoder_latency_s, round(encoder_tokens / e, 4) AS encoder_throughput,
            round(decoder_tokens / d, 4) AS decoder_throughput
        FROM run_config c LEFT JOIN sizes s USING (run_id) LEFT JOIN scored q USING (run_id) LEFT JOIN gen USING (run_id)
            LEFT JOIN lat USING (run_id)""")
    add("st1_streamed_scores", lambda t: rounded(stream_scores(
        t.spark, pairs_stream(t), metrics(["sacrebleu", "meteor"]), ["lang"])),
        f"""WITH {bleu_sql("b", "pairs", "lang", tokens_13a_sql)}, {meteor_sql("m", "pairs", "lang")}
        SELECT grp AS lang, round(b.score, {DIGITS}) AS sacrebleu, round(m.score, {DIGITS}) AS meteor
        FROM b_score b JOIN m_score m USING (grp)""")

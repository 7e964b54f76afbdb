"""Sources, sinks and set operations: A1 to A16, J1, H1 to H3."""

from __future__ import annotations

from pyspark.sql import functions as F

from babelgauge.functions.models import canonical_dataset, pair_configuration, task_prefix
from babelgauge.catalog.standin import BATCH, stand_in, tries_sql
from babelgauge.operators.inference import failure_records, forward_log, translate_batches
from babelgauge.operators.ranking import best_rows
from babelgauge.operators.runs import cap_outliers, fill_missing
from babelgauge.schemas import RUN_COLUMNS
from babelgauge.session import work_path
from babelgauge.sources import corpora, logs, results

REQUESTS = [1, 100, 1000, 5000, "all"]
PROFILE = """model_name, count(*) AS n, count(use_archer) AS flags, count(device_memory_ratio) AS ratios,
    CAST(sum(dataset_size) AS BIGINT) AS sizes, CAST(sum(beam_size) AS BIGINT) AS beams, max(chrf) AS chrf,
    min(encoder_latency_s) AS latency"""


def profile(runs):
    return runs.groupBy("model_name").agg(
        F.count("*").alias("n"), F.count("use_archer").alias("flags"), F.count("device_memory_ratio").alias("ratios"),
        F.sum("dataset_size").alias("sizes"), F.sum("beam_size").alias("beams"), F.max("chrf").alias("chrf"),
        F.min("encoder_latency_s").alias("latency"))


def stored_corpus(t, name: str):
    """The corpus written out once, as a loader finds it."""
    path = work_path(t.spark, name)
    t.corpus.write.parquet(path)
    return path


def log_totals(log):
    return log.groupBy("run_id", "layer_type").agg(F.count("*").alias("calls"), F.max("call_seq").alias("last_call"),
                                                   F.round(F.sum("latency_s"), 9).alias("latency_s"))


LOG_TOTALS = """SELECT run_id, layer_type, count(*) AS calls, max(call_seq) AS last_call,
    round(sum(latency_s), 9) AS latency_s FROM {log} GROUP BY run_id, layer_type"""


def register(add) -> None:
    add("a1_load_corpus", lambda t: corpora.flat(corpora.load_corpus(t.spark, stored_corpus(t, "wmt14"), "wmt14")),
        "SELECT id, en, fr FROM corpus")
    add("a2_first_sentences", lambda t: corpora.flat(corpora.load_corpus(
        t.spark, stored_corpus(t, "wmt14"), "wmt14", 100)), "SELECT id, en, fr FROM corpus ORDER BY id LIMIT 100")
    add("a3_granted_sizes", lambda t: corpora.granted_sizes(t.corpus, REQUESTS),
        """SELECT requested, CASE WHEN size IS NULL OR size > n THEN n ELSE size END AS granted,
            size IS NOT NULL AND size > n AS clamped
        FROM (SELECT count(*) AS n FROM corpus) c,
            (SELECT unnest(['1', '100', '1000', '5000', 'all']) AS requested,
                unnest([1, 100, 1000, 5000, NULL]) AS size) q""")
    add("a5_dataset_alias", lambda t: t.runs.groupBy(canonical_dataset(F.col("dataset_name")).alias("dataset"))
        .agg(F.count("*").alias("n")),
        """SELECT CASE dataset_name WHEN 'facebook/flores' THEN 'flores200' ELSE dataset_name END AS dataset,
            count(*) AS n FROM runs GROUP BY 1""")
    add("a6_pair_configuration", lambda t: t.runs.groupBy("dataset_name", pair_configuration(
        F.col("dataset_name"), F.col("src_lang"), F.col("tgt_lang")).alias("configuration"))
        .agg(F.count("*").alias("n")),
        """SELECT dataset_name, configuration, count(*) AS n FROM runs LEFT JOIN (
            SELECT 'wmt14' AS d, 'en' AS s, 'fr' AS t, 'fr-en' AS configuration
            UNION ALL SELECT 'opus100', 'en', 'fr', 'en-fr') i ON d = dataset_name AND s = src_lang AND t = tgt_lang
        GROUP BY ALL""")

    def a7(t):
        path = work_path(t.spark, "result-csv")
        t.runs.select(*RUN_COLUMNS).write.option("header", True).csv(path)
        return profile(results.read_results(t.spark, path))

    add("a7_result_csv", a7, f"SELECT {PROFILE} FROM runs GROUP BY model_name")

    def a8(t):
        path = work_path(t.spark, "latency-csv")
        t.forward_log.where("call_seq % 2 = 0").select("layer_type", "latency_s").write.csv(path)
        t.forward_log.where("call_seq % 2 = 1").select(F.lit(0), "layer_type", "latency_s").write.mode("append").csv(path)
        return logs.read_forward_files(t.spark, path).groupBy("layer_type").agg(
            F.count("*").alias("calls"), F.min("latency_s").alias("low"), F.max("latency_s").alias("high"))

    add("a8_latency_csv", a8, """SELECT layer_type, count(*) AS calls, min(latency_s) AS low, max(latency_s) AS high
        FROM forward_log GROUP BY layer_type""")

    def a9(t):
        """Four schema versions in folders of their own, and files beside them that are no result files."""
        path = work_path(t.spark, "files")
        for i, fragment in enumerate(t.fragments):
            fragment.write.option("header", True).csv(f"{path}/{i}")
        t.forward_log.select("layer_type", "latency_s").write.json(f"{path}/latencies")
        return profile(results.read_result_folder(t.spark, path, pattern="part-*.csv"))

    add("a9_result_folder", a9, f"SELECT {PROFILE} FROM runs_all GROUP BY model_name")

    def a10(t):
        path = work_path(t.spark, "result-table")
        results.write_results(t.frag_24, path, mode="overwrite")
        results.write_results(results.union_versions([t.frag_22]), path)
        return results.read_result_table(t.spark, path).groupBy("dataset", "model").agg(
            F.count("*").alias("n"), F.count("use_archer").alias("flags"), F.max("meteor").alias("meteor"))

    add("a10_result_sink", a10, """SELECT replace(dataset_name, 'facebook/flores', 'flores200') AS dataset,
            replace(replace(model_name, 'facebook/', ''), 'google/', '') AS model, count(*) AS n,
            count(use_archer) AS flags, max(meteor) AS meteor
        FROM (SELECT * FROM frag_24 UNION ALL BY NAME SELECT * FROM frag_22) u GROUP BY ALL""")

    def a11(t):
        path = work_path(t.spark, "call-log")
        source = t.documents.select(F.col("doc_id").alias("idx"), F.col("text").alias("source"))
        logs.append_forward_log(forward_log(translate_batches(source, stand_in, BATCH, run_id=3)), path)
        return logs.read_forward_log(t.spark, path).select("run_id", "layer_type", F.round("latency_s", 9).alias("latency_s"))

    add("a11_log_append", a11, f"""WITH given AS (SELECT CAST(3 AS BIGINT) AS run_id, doc_id AS n, text FROM documents), {tries_sql('given')}
        SELECT run_id, 'encoder' AS layer_type, round(e, 9) AS latency_s FROM calls UNION ALL SELECT run_id, 'decoder', round(d, 9) FROM calls""")

    def a12(t):
        path = work_path(t.spark, "reset-log")
        logs.append_forward_log(t.forward_log, path)
        again = t.forward_log.where((F.col("run_id") == 0) & (F.col("layer_type") == "encoder"))
        logs.reset_forward_log(again, path)
        return log_totals(logs.read_forward_log(t.spark, path))

    add("a12_log_reset", a12, LOG_TOTALS.format(
        log="(SELECT * FROM forward_log WHERE run_id <> 0 OR layer_type = 'encoder') l"))

    def a13(t):
        path = work_path(t.spark, "failure-csv")
        logs.append_failures(t.failure_records, path)
        logs.append_failures(t.failure_records.where("dataset_size = 'all'"), path)
        return logs.read_failures(t.spark, path).groupBy("model_name", "dataset_size", "batch_size", "dataset_name") \
            .agg(F.count("*").alias("n"), F.sum("max_gen_length").alias("gen"))

    def a13_records(t):
        """The failures of the batched map, with the settings of their run, through the failure log."""
        path = work_path(t.spark, "batch-failures")
        source = t.documents.select(F.col("doc_id").alias("idx"), F.col("text").alias("source"))
        config = t.run_config.where("run_id = 3").withColumn("dataset_size", F.lit("all"))
        records = failure_records(translate_batches(source, stand_in, BATCH, run_id=3), config)
        logs.append_failures(records, path)
        return logs.read_failures(t.spark, path).groupBy("model_name", "dataset_size", "batch_size", "max_input_seq_length") \
            .agg(F.count("*").alias("n"))

    add("a13_batch_failures", a13_records, f"""WITH given AS (SELECT CAST(3 AS BIGINT) AS run_id, doc_id AS n, text FROM documents), {tries_sql('given')}
        SELECT model_name, 'all' AS dataset_size, f.batch_size, max_input_seq_length, count(*) AS n
        FROM failed f LEFT JOIN run_config USING (run_id) GROUP BY ALL""")
    add("a13_failure_sink", a13, """SELECT model_name, dataset_size, batch_size, dataset_name, count(*) AS n,
            CAST(sum(max_gen_length) AS BIGINT) AS gen
        FROM (SELECT * FROM failure_records UNION ALL SELECT * FROM failure_records WHERE dataset_size = 'all') u
        GROUP BY ALL""")

    def a14(t):
        path = work_path(t.spark, "failure-text")
        logs.write_failure_texts(t.failure_records, path)
        logs.write_warning_texts(t.failure_records.where("batch_size > 8"), path)
        back = logs.read_failure_texts(t.spark, path)
        return back.groupBy(*back.columns).agg(F.count("*").alias("n"))

    add("a14_failure_text", a14, """SELECT *, count(*) AS n FROM (SELECT 'error' AS kind, * FROM failure_records UNION ALL
            SELECT 'warning', * REPLACE (NULL AS message) FROM failure_records WHERE batch_size > 8) u GROUP BY ALL""")
    add("a15_tuning_corpus", lambda t: corpora.train_test(corpora.flat(corpora.load_corpus(
        t.spark, stored_corpus(t, "opus_books"), "opus_books"))).select(
        "id", "part", F.concat(task_prefix(F.lit("google/switch-base-16"), F.lit("en"), F.lit("fr")), "en")
        .alias("source"), F.col("fr").alias("target")),
        """SELECT id, CASE WHEN ('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 7))::BIGINT % 100 < 20 THEN 'test'
                ELSE 'train' END AS part, 'translate English to French: ' || en AS source, fr AS target
        FROM corpus""")
    add("a16_sample_counts", lambda t: results.write_sample_counts(
        corpora.train_test(t.corpus), work_path(t.spark, "samples")),
        """SELECT part, count(*) AS samples FROM (SELECT CASE WHEN
            ('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 7))::BIGINT % 100 < 20 THEN 'test' ELSE 'train' END AS part
            FROM corpus) s GROUP BY part""")

    def j1(t):
        said = t.conversations.withColumn("idx", F.expr("conv_id * 1000 + turn div 2")).withColumnRenamed("text", "sentence")
        return corpora.flat(corpora.zip_monolingual(said.where("role = 'user'"), said.where("role <> 'user'")))

    add("j1_monolingual_zip", j1, """WITH said AS (SELECT conv_id * 1000 + turn // 2 AS id, role, text FROM conversations)
        SELECT id, a.text AS en, b.text AS fr FROM (SELECT * FROM said WHERE role = 'user') a
        FULL JOIN (SELECT * FROM said WHERE role <> 'user') b USING (id)""")
    add("h1_union_versions", lambda t: profile(results.union_versions(t.fragments)),
        f"SELECT {PROFILE} FROM runs_all GROUP BY model_name")
    add("h2_distinct", lambda t: profile(fill_missing(results.union_versions(t.fragments)).dropDuplicates()),
        f"""SELECT {PROFILE} FROM (SELECT DISTINCT * REPLACE (coalesce(use_archer, false) AS use_archer) FROM runs_all) d
        GROUP BY model_name""")
    add("h3_first_per_key", lambda t: best_rows(cap_outliers(t.runs), ["model_name", "beam_size"], F.col("meteor")),
        f"""SELECT {', '.join(RUN_COLUMNS)} FROM (SELECT *, row_number() OVER (PARTITION BY model_name, beam_size
            ORDER BY meteor DESC, {', '.join(c + ' NULLS FIRST' for c in RUN_COLUMNS)}) AS place FROM runs
            WHERE beam_size <= 32 AND max_gen_length <= 128) r WHERE place = 1""")

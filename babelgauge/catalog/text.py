"""Projections, predicates, text and token operators: B1 to B24, C1 to C12, S4, S5, X11."""

from __future__ import annotations

from pyspark.sql import functions as F

from babelgauge.catalog.quality import tokens_13a_sql, words_sql
from babelgauge.functions import models
from babelgauge.functions.text import as_references, pieces, strip, text_length, tokens_13a, word_count
from babelgauge.operators import runs as R
from babelgauge.operators.analysis import ecdf
from babelgauge.operators.batching import (attention_mask, batch_token_counts, pad_batches, renumbered, token_length,
                                           truncate, unmask, with_batches)
from babelgauge.operators.quality import evaluate, metric
from babelgauge.operators.sweep import filtered_corpus_sizes, resolve_sizes, skip_empty, expand, QUALITY_AXES
from babelgauge.operators.triage import is_memory_failure
from babelgauge.operators.vocabulary import build_vocabulary, decode, encode
from babelgauge.sources import corpora

N_RUNS = "count(*) AS n, CAST(sum(beam_size) AS BIGINT) AS beams, max(sacrebleu) AS best"
PREFIX = "translate English to French: "


def counted(df, *by):
    """Enough of a filtered run table to notice a wrong row."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum("beam_size").alias("beams"),
                               F.max("sacrebleu").alias("best"))


def digest(ids):
    """An array as one comparable string."""
    return F.md5(F.array_join(F.transform(ids, lambda x: x.cast("string")), " "))


DIGEST = "md5(array_to_string(list_transform({ids}, lambda x: CAST(x AS VARCHAR)), ' '))"


def register(add) -> None:
    def runs(key, change, where, view="clean", by=("model_name", "dataset_name")):
        add(key, lambda t: counted(change(t.clean), *by),
            f"SELECT {', '.join(by)}, {N_RUNS} FROM {view} WHERE {where} GROUP BY {', '.join(by)}")

    model = "CASE WHEN turns < 3 THEN 't5-base' WHEN turns < 6 THEN 'facebook/nllb-moe-54b' ELSE 'google/switch' END"
    add("b1_task_prefix", lambda t: t.corpus.withColumn("model", F.expr(model.replace("turns", "id % 1000"))).select(
        "id", F.concat(models.task_prefix(F.col("model"), F.lit("en"), F.lit("fr")), "en").alias("source")),
        f"""SELECT id, CASE WHEN model LIKE '%nllb%' THEN '' ELSE '{PREFIX}' END || en AS source
        FROM (SELECT *, {model.replace('turns', '(id % 1000)')} AS model FROM corpus) c""")
    add("b2_nested_field", lambda t: corpora.parallel(t.corpus).select("id", F.col("translation.en").alias("en")),
        "SELECT id, en FROM corpus")
    add("b3_flat_table", lambda t: corpora.flat(corpora.parallel(t.corpus)), "SELECT id, en, fr FROM corpus")
    add("b4_word_counts", lambda t: corpora.with_word_counts(t.corpus).select("id", "word_count_en", "word_count_fr"),
        "SELECT id, len(string_split(en, ' ')) AS word_count_en, len(string_split(fr, ' ')) AS word_count_fr FROM corpus")
    add("b5_length_filter", lambda t: t.corpus.where(corpora.within_length(F.col("en"), 15)).select("id", "en"),
        "SELECT id, en FROM corpus WHERE len(string_split(en, ' ')) <= 15")

    def b6(t):
        limits = [-1, 0, 15, 30]
        planned = expand(t.runs.select("model_name", "dataset_name").distinct(),
                         {**QUALITY_AXES, "max_input_seq_length": limits})
        kept = skip_empty(resolve_sizes(planned), filtered_corpus_sizes(t.corpus, limits))
        return kept.groupBy("max_input_seq_length").agg(F.max("n").alias("sentences"), F.count("*").alias("planned"))

    add("b6_skip_empty", b6, """SELECT CAST(m AS BIGINT) AS max_input_seq_length, sentences, planned FROM (
            SELECT m, (SELECT count(*) FROM corpus WHERE m = -1 OR len(string_split(en, ' ')) <= m) AS sentences,
                (SELECT count(*) * 36 FROM (SELECT DISTINCT model_name, dataset_name FROM runs) d) AS planned
            FROM (SELECT unnest([-1, 0, 15, 30]) AS m) l) s WHERE sentences > 0""")
    quality = ["sacrebleu", "spBleu", "chrf", "chrfpp", "meteor"]
    add("b7_drop_columns", lambda t: t.clean.where("dataset_size = 1").drop(*quality).groupBy("model_name").agg(
        F.count("*").alias("n"), F.max("encoder_latency_s").alias("slowest")),
        """SELECT model_name, count(*) AS n, max(encoder_latency_s) AS slowest
        FROM (SELECT * EXCLUDE (sacrebleu, "spBleu", chrf, chrfpp, meteor) FROM clean WHERE dataset_size = 1) c
        GROUP BY model_name""")
    add("b8_short_names", lambda t: counted(R.short_names(t.clean), "model_name"),
        f"SELECT model_name, {N_RUNS} FROM short_clean GROUP BY model_name")
    add("b9_result_file", lambda t: t.runs.groupBy(models.result_file(
        F.col("model_name"), F.col("dataset_name"), F.col("use_archer"), F.col("device_memory_ratio")).alias("file"))
        .agg(F.count("*").alias("n")),
        """SELECT replace(replace(model_name || '_' || dataset_name, 'facebook/', ''), 'google/', '')
            || CASE WHEN use_archer THEN '_archer_' || CAST(device_memory_ratio AS VARCHAR) ELSE '' END
            || '_metrics.csv' AS file, count(*) AS n FROM runs GROUP BY 1""")
    add("b10_fill_missing", lambda t: R.fill_missing(t.runs).groupBy("use_archer").agg(
        F.count("*").alias("n"), F.count("device_memory_ratio").alias("ratios")),
        """SELECT coalesce(use_archer, false) AS use_archer, count(*) AS n, count(device_memory_ratio) AS ratios
        FROM runs GROUP BY 1""")
    add("b11_outlier_caps", lambda t: counted(R.cap_outliers(t.runs), "beam_size", "max_gen_length"),
        f"""SELECT beam_size, max_gen_length, {N_RUNS} FROM runs WHERE beam_size <= 32 AND max_gen_length <= 128
        GROUP BY ALL""")
    runs("b12_equality", lambda d: R.only(d, dataset_name="wmt14"), "dataset_name = 'wmt14'")
    add("b13_inequalities", lambda t: counted(R.without(
        R.short_names(t.clean), model_name=["switch-base-128", "switch_16_finetuned", "nllb-moe-54b"], beam_size=8,
        max_input_seq_length=10, dataset_size=1), "model_name", "dataset_name"),
        f"""SELECT model_name, dataset_name, {N_RUNS} FROM short_clean
        WHERE model_name NOT IN ('switch-base-128', 'switch_16_finetuned', 'nllb-moe-54b') AND beam_size <> 8
            AND max_input_seq_length <> 10 AND dataset_size <> 1 GROUP BY ALL""")
    runs("b14_conjunction", lambda d: R.only(d, batch_size=32, beam_size=4, max_gen_length=128, max_input_seq_length=15),
         "batch_size = 32 AND beam_size = 4 AND max_gen_length = 128 AND max_input_seq_length = 15")
    add("b15_membership", lambda t: counted(R.only(R.short_names(t.clean), model_name=[
        "t5-large", "t5-base", "nllb-200-distilled-600M"]), "model_name"),
        f"""SELECT model_name, {N_RUNS} FROM short_clean
        WHERE model_name IN ('t5-large', 't5-base', 'nllb-200-distilled-600M') GROUP BY model_name""")
    runs("b16_nullable_disjunction", lambda d: d.where(R.ratio_set_or_resident()),
         "(device_memory_ratio IS NOT NULL AND device_memory_ratio <> 0) OR use_archer = false")
    runs("b17_threshold", lambda d: d.where(F.col("encoder_throughput") < 1000), "encoder_throughput < 1000")
    add("b18_split_check", lambda t: R.split_check(t.clean, ["dataset_name"]),
        """SELECT dataset_name, count(*) FILTER (WHERE dataset_size = 1) AS single,
            count(*) FILTER (WHERE dataset_size IS DISTINCT FROM 1) AS multi, count(*) AS runs,
            count(*) FILTER (WHERE dataset_size = 1) / CAST(count(*) AS DOUBLE) AS single_share, true AS adds_up
        FROM clean GROUP BY dataset_name""")
    add("b19_model_routing", lambda t: t.runs.groupBy(
        "model_name", models.family(F.col("model_name")).alias("family"),
        models.forward_log_file(F.col("model_name"), strict=True).alias("log")).agg(F.count("*").alias("n")),
        """SELECT model_name, family, log, count(*) AS n FROM runs JOIN (VALUES
            ('t5-base', 't5', 't5_latencies.csv'), ('t5-large', 't5', 't5_latencies.csv'),
            ('facebook/nllb-200-distilled-600M', 'nllb', 'nllb_latencies.csv'),
            ('facebook/nllb-moe-54b', 'nllb-moe', 'nllb-moe_latencies.csv'),
            ('google/switch-base-128', 'switch', 'switch_latencies.csv'),
            ('google/switch_16_finetuned', 'switch', 'switch_latencies.csv')) m(name, family, log) ON name = model_name
        GROUP BY ALL""")
    flag = "CASE event_type WHEN 'signup' THEN value > 30 WHEN 'view' THEN value <= 30 END AS is_decoder"
    kind = """CASE event_type WHEN 'click' THEN 'M2M100Encoder' WHEN 'purchase' THEN 'M2M100Decoder' ELSE 'T5Stack' END
        AS class"""
    add("b20_layer_type", lambda t: t.events.selectExpr("event_type", flag, kind).groupBy(
        "event_type", models.layer_type(F.col("is_decoder"), F.col("class")).alias("layer_type"))
        .agg(F.count("*").alias("n")),
        f"""SELECT event_type, CASE WHEN is_decoder THEN 'decoder' WHEN NOT is_decoder THEN 'encoder'
                WHEN class = 'M2M100Encoder' THEN 'encoder' ELSE 'decoder' END AS layer_type, count(*) AS n
        FROM (SELECT event_type, {flag}, {kind} FROM events) e GROUP BY ALL""")

    def b21(t):
        scored = evaluate(t.pairs, [metric("sacrebleu")], ["run_id"], gen_len=F.size(F.split("prediction", " ", -1)))
        return scored.select("run_id", F.round("sacrebleu", 4).alias("bleu"), F.round("gen_len", 4).alias("gen_len"))

    from babelgauge.catalog.quality import bleu_sql

    add("b21_round_metrics", b21, f"""WITH {bleu_sql('b', 'pairs', 'run_id', tokens_13a_sql)},
        g AS (SELECT run_id, avg(len(string_split(prediction, ' '))) AS gen_len FROM pairs GROUP BY run_id)
        SELECT run_id, round(score, 4) AS bleu, round(gen_len, 4) AS gen_len FROM b_score JOIN g ON grp = run_id""")
    add("b22_casts", lambda t: t.failure_records.groupBy(
        F.col("dataset_size").try_cast("bigint").alias("dataset_size"), F.col("beam_size").cast("int").alias("beam_size"))
        .agg(F.count("*").alias("n")),
        """SELECT TRY_CAST(dataset_size AS BIGINT) AS dataset_size, CAST(beam_size AS INTEGER) AS beam_size, count(*) AS n
        FROM failure_records GROUP BY ALL""")
    add("b23_parameter_count", lambda t: R.with_parameter_count(
        t.runs.drop("total_params"), t.run_config.select("model_name", "total_params"))
        .groupBy("model_name", "total_params").agg(F.count("*").alias("n")),
        """SELECT model_name, m.total_params, count(*) AS n FROM runs r LEFT JOIN (SELECT model_name, max(total_params) AS total_params
            FROM run_config GROUP BY model_name) m USING (model_name) GROUP BY ALL""")
    add("b24_loss_history", lambda t: t.events.withColumn("loss", F.get_json_object("props", "$.k"))
        .where(F.col("loss").isNotNull()).select("event_id", F.col("loss").cast("double").alias("loss")),
        """SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS loss FROM events
        WHERE json_extract_string(props, '$.k') IS NOT NULL""")

    add("c1_strip", lambda t: t.pairs.select("id", strip(F.col("prediction")).alias("prediction"),
                                             F.get(as_references(F.col("reference")), 0).alias("reference")),
        r"""SELECT id, regexp_replace(prediction, '^\s+|\s+$', '', 'g') AS prediction,
            regexp_replace(reference, '^\s+|\s+$', '', 'g') AS reference FROM pairs""")
    padding = "CASE WHEN lang = 'en' THEN 'do_not_pad' ELSE 'pad_to_max_length' END"
    add("c2_tokenise", lambda t: t.pairs.withColumn("tokens", tokens_13a(F.concat(F.lit(PREFIX), "reference"))).select(
        "id", F.when(F.col("lang") == "en", truncate(F.col("tokens"), "do_not_pad"))
        .otherwise(truncate(F.col("tokens"), "pad_to_max_length")).alias("tokens"))
        .select("id", F.size("tokens").cast("long").alias("n"), F.md5(F.array_join("tokens", " ")).alias("digest")),
        f"""SELECT id, len(tokens) AS n, md5(array_to_string(tokens, ' ')) AS digest FROM (
            SELECT id, CASE WHEN {padding} = 'do_not_pad' THEN all_tokens ELSE all_tokens[1:512] END AS tokens
            FROM (SELECT *, {tokens_13a_sql(f"('{PREFIX}' || reference)")} AS all_tokens FROM pairs) p) t""")
    vocabulary = f"""words AS (SELECT id AS doc, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS token
            FROM (SELECT id, {words_sql('reference')} AS w FROM pairs) p),
        vocab AS (SELECT token, row_number() OVER (ORDER BY substr(md5(token), 1, 3), token) + 2 AS id
            FROM (SELECT DISTINCT token FROM words) d
            UNION ALL SELECT unnest(['<pad>', '</s>', '<unk>']), unnest([0, 1, 2]))"""
    add("c3_vocabulary", lambda t: build_vocabulary(t.pairs, pieces(F.col("reference"))),
        f"""WITH {vocabulary} SELECT token, id, coalesce(n, 0) AS n FROM vocab
        LEFT JOIN (SELECT token, count(*) AS n FROM words GROUP BY token) w USING (token)""")

    def encoded(t):
        vocab = build_vocabulary(t.pairs, pieces(F.col("reference")))
        return encode(t.pairs, "id", pieces(F.col("reference")), vocab), vocab

    add("c3_encode", lambda t: encoded(t)[0].select("id", F.size("ids").cast("long").alias("n"),
                                                    digest(F.col("ids")).alias("digest")),
        f"""WITH {vocabulary} SELECT doc AS id, count(*) AS n, md5(string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos)) AS digest
        FROM words JOIN vocab USING (token) GROUP BY doc""")

    def c7(t):
        ids, vocab = encoded(t)
        return decode(ids.withColumn("ids", F.concat("ids", F.array(F.lit(1), F.lit(0)).cast("array<bigint>"))),
                      "id", F.col("ids"), vocab)

    add("c7_decode", c7, f"SELECT id, array_to_string({words_sql('reference')}, ' ') AS text FROM pairs")
    ids = "SELECT idx, idx // 32 AS batch_id, ids FROM token_ids"
    add("c4_batches", lambda t: with_batches(t.token_ids, 32).groupBy("batch_id").agg(
        F.count("*").alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx")),
        f"""SELECT batch_id, count(*) AS n, min(idx) AS first_idx, max(idx) AS last_idx FROM ({ids}) b GROUP BY batch_id""")
    add("c4_filtered_batches", lambda t: with_batches(renumbered(
        t.documents.where(corpora.within_length(F.col("text"), 300)).select(F.col("doc_id").alias("idx"), F.col("doc_id").alias("doc"))),
        32).groupBy("batch_id").agg(F.count("*").alias("n"), F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc")),
        """SELECT n // 32 AS batch_id, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM (SELECT doc_id,
            row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents WHERE len(string_split(text, ' ')) <= 300) k GROUP BY 1""")
    add("c5_padding", lambda t: pad_batches(with_batches(t.token_ids, 32)).select(
        "idx", "batch_id", F.size("ids").cast("long").alias("width"), digest(F.col("ids")).alias("digest")),
        f"""SELECT idx, batch_id, w AS width, md5(array_to_string(list_transform(ids, lambda x: CAST(x AS VARCHAR)), ' ')
            || repeat(' 0', CAST(w - len(ids) AS INTEGER))) AS digest
        FROM (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS w FROM ({ids}) b) p""")
    add("c6_unmask", lambda t: t.token_ids.select("idx", digest(unmask(F.col("ids"))).alias("digest")),
        "SELECT idx, " + DIGEST.format(ids="list_transform(ids, lambda y: CASE WHEN y = -100 THEN 0 ELSE y END)")
        + " AS digest FROM token_ids")
    add("c8_token_length", lambda t: t.token_ids.select("idx", token_length(unmask(F.col("ids"))).alias("gen_len")),
        "SELECT idx, len(list_filter(ids, lambda x: x <> 0 AND x <> -100)) AS gen_len FROM token_ids")
    add("c9_attention_mask", lambda t: t.token_ids.select("idx", digest(attention_mask(F.col("ids"))).alias("digest")),
        "SELECT idx, " + DIGEST.format(ids="list_transform(ids, lambda y: CASE WHEN y <> 0 THEN 1 ELSE 0 END)")
        + " AS digest FROM token_ids")
    add("c10_batch_tokens", lambda t: batch_token_counts(with_batches(
        t.token_ids.withColumn("ids", unmask(F.col("ids"))), 32)),
        f"""SELECT batch_id, CAST(sum(len(list_filter(ids, lambda x: x <> 0 AND x <> -100))) AS BIGINT) AS n_tokens
        FROM ({ids}) b GROUP BY batch_id""")
    add("c11_token_lengths", lambda t: t.corpus.select("id", text_length(F.col("en")).alias("length"),
                                                       text_length(F.col("en"), cut=256).alias("cut_length")),
        f"SELECT id, len({tokens_13a_sql('en')}) AS length, least(len({tokens_13a_sql('en')}), 256) AS cut_length FROM corpus")
    add("c12_memory_failures", lambda t: t.failures.groupBy(
        "sweep_id", is_memory_failure(F.col("message")).alias("memory")).agg(F.count("*").alias("n")),
        """SELECT sweep_id, lower(message) LIKE '%out of memory%' AS memory, count(*) AS n FROM failures GROUP BY ALL""")
    add("s4_first_rows", lambda t: corpora.with_word_counts(corpora.first_sentences(t.corpus, 10)),
        """SELECT *, len(string_split(en, ' ')) AS word_count_en, len(string_split(fr, ' ')) AS word_count_fr
        FROM (SELECT * FROM corpus ORDER BY id LIMIT 10) c""")
    add("s5_random_split", lambda t: corpora.train_test(t.corpus).select("id", "part"),
        """SELECT id, CASE WHEN ('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 7))::BIGINT % 100 < 20 THEN 'test'
            ELSE 'train' END AS part FROM corpus""")

    def w6(t):
        one = t.corpus.select(F.lit("corpus").alias("dataset"), F.col("en").alias("text"))
        two = t.documents.select(F.lit("documents").alias("dataset"), "text")
        sized = one.union(two).select("dataset", text_length(F.col("text")).alias("length"),
                                      text_length(F.col("text"), cut=256).alias("cut_length"))
        return ecdf(sized, ["length", "cut_length"], ["dataset"]).select(
            "dataset", "column", "value", "n", F.round("ecdf", 12).alias("ecdf"))

    add("w6_ecdf_two_corpora", w6, f"""WITH sized AS (
            SELECT 'corpus' AS dataset, len({tokens_13a_sql('en')}) AS value FROM corpus UNION ALL
            SELECT 'documents', len({tokens_13a_sql('text')}) FROM documents),
        lengths AS (SELECT dataset, 'length' AS "column", value FROM sized UNION ALL
            SELECT dataset, 'cut_length', least(value, 256) FROM sized)
        SELECT DISTINCT dataset, "column", CAST(value AS DOUBLE) AS value,
            count(*) OVER (PARTITION BY dataset, "column", value) AS n,
            round(cume_dist() OVER (PARTITION BY dataset, "column" ORDER BY value), 12) AS ecdf FROM lengths""")
    add("u2_row_predicate", lambda t: t.corpus.where(word_count(F.col("en")) <= 30).select("id"),
        "SELECT id FROM corpus WHERE len(string_split(en, ' ')) <= 30")
    add("u3_per_value", lambda t: t.documents.select("doc_id", word_count(F.col("text")).alias("words")),
        "SELECT doc_id, len(string_split(text, ' ')) AS words FROM documents")

"""Aggregations, rankings and studies over runs and corpora: E7 to E16, W1 to W7, S1 to S3, X4 to X11."""

from __future__ import annotations

from pyspark.sql import functions as F

from babelgauge.operators import analysis as A
from babelgauge.operators import ranking as K
from babelgauge.operators.runs import only, ratio_set_or_resident, short_names, split_check, without
from babelgauge.plans import studies
from babelgauge.schemas import QUALITY_COLUMNS, RUN_COLUMNS, SPEED_COLUMNS
from babelgauge.sources.corpora import with_word_counts

COLUMNS = ", ".join(f'"{c}"' for c in RUN_COLUMNS)
TIES = ", ".join(f'"{c}" NULLS FIRST' for c in RUN_COLUMNS)
FULL = "max_input_seq_length = -1 AND dataset_size <> 1"
WORDS = """(SELECT len(string_split(en, ' ')) AS word_count_en, len(string_split(fr, ' ')) AS word_count_fr
    FROM corpus) w"""


def long_sql(source: str, columns, keep: str = "") -> str:
    """One (column, value) row per measure."""
    prefix = keep + ", " if keep else ""
    return "(" + " UNION ALL ".join(
        f"SELECT {prefix}'{c}' AS \"column\", CAST(\"{c}\" AS DOUBLE) AS value FROM {source}" for c in columns) + ") l"


def describe_sql(source: str, columns, by: str = "") -> str:
    keys = (by + ", " if by else "") + '"column"'
    return f"""SELECT {keys}, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
        min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.25), 9) AS q_25,
        round(quantile_cont(value, 0.5), 9) AS q_50, round(quantile_cont(value, 0.75), 9) AS q_75
        FROM {long_sql(source, columns, by)} GROUP BY {keys}"""


def rounded(df, **digits):
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


SUMMARY = dict(mean=6, std=6, q_25=9, q_50=9, q_75=9)


def register(add) -> None:
    columns = [*QUALITY_COLUMNS, *SPEED_COLUMNS]
    add("e7_describe_runs", lambda t: rounded(A.describe(t.clean, columns, ["dataset_name"]), **SUMMARY),
        describe_sql("clean", columns, "dataset_name"))
    words = ["word_count_en", "word_count_fr"]
    add("e7_describe_corpus", lambda t: rounded(A.describe(with_word_counts(t.corpus), words), **SUMMARY),
        describe_sql(WORDS.replace(") w", ")"), words))
    add("e8_metric_spread", lambda t: rounded(A.spread_by_metric(t.clean, QUALITY_COLUMNS, ["model_name"]), mean=6, std=6),
        f"""SELECT model_name, "column", round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std
        FROM {long_sql('clean', QUALITY_COLUMNS, 'model_name')} GROUP BY ALL""")
    add("e9_maximum", lambda t: t.runs.agg(*[F.max(c).alias(c) for c in columns]),
        "SELECT " + ", ".join(f'max("{c}") AS "{c}"' for c in columns) + " FROM runs")
    add("e10_row_counts", lambda t: t.clean.groupBy("dataset_name").agg(F.count("*").alias("n")),
        "SELECT dataset_name, count(*) AS n FROM clean GROUP BY dataset_name")
    add("e11_filtered_sizes", lambda t: A.filtered_sizes(t.clean),
        """SELECT dataset_name, max_input_seq_length, min_by(size, ROW(model_name, batch_size, beam_size,
            max_gen_length, tokenizer_padding_setting, size)) AS size_after_filter, max(dataset_size) AS dataset_size
        FROM (SELECT *, dataset_size_after_filter_wrt_input_len AS size FROM clean WHERE dataset_size <> 1
            AND dataset_size_after_filter_wrt_input_len IS NOT NULL) c
        GROUP BY ALL""")

    def interval_sql(source, measures, by):
        return f"""SELECT {by}, "column", n,
            CASE WHEN contains("column", 'latency') THEN round(mean, 12) ELSE round(mean, 9) END AS mean,
            round(mean - 1.96 * std / sqrt(n), 6) AS low,
            round(mean + 1.96 * std / sqrt(n), 6) AS high FROM (
                SELECT {by}, "column", count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std
                FROM {long_sql(source, measures, by)} GROUP BY ALL) g"""

    def interval(df):
        """Means of small numbers keep more digits, so that a mean over 2^k rows is not cut at a tie."""
        mean = F.when(F.contains("column", F.lit("latency")), F.round("mean", 12)).otherwise(F.round("mean", 9))
        return rounded(df.withColumn("mean", mean), low=6, high=6)

    add("e12_grouped_interval", lambda t: interval(A.grouped_interval(
        t.clean, ["sacrebleu", "decoder_latency_s"], ["beam_size", "model_name"])),
        interval_sql("clean", ["sacrebleu", "decoder_latency_s"], "beam_size, model_name"))
    drawn_by = ["model_name", "dataset_name", "dataset_size", "batch_size", "beam_size", "max_gen_length",
                "max_input_seq_length", "encoder_calls", "decoder_calls"]
    mixed = "(r * ((s * 1103515245 + 12345) % 268435399) + (s * 214013 + 2531011) % 268435399) % 268435399 / 268435399e0"
    add("e12_bootstrap_interval", lambda t: rounded(A.bootstrap_interval(
        t.clean.withColumn("encoder_calls", F.col("encoder_throughput").cast("long"))
        .withColumn("decoder_calls", F.col("decoder_throughput").cast("long")),
        "sacrebleu", ["beam_size", "model_name"], drawn_by), mean=6, low=6, high=6),
        f"""WITH d AS (SELECT beam_size, model_name, sacrebleu AS v, ('0x' || substr(md5(concat_ws('|', model_name,
                dataset_name, dataset_size, batch_size, beam_size, max_gen_length, max_input_seq_length,
                CAST(encoder_throughput AS BIGINT), CAST(decoder_throughput AS BIGINT))), 1, 7))::BIGINT AS r
            FROM clean WHERE sacrebleu IS NOT NULL),
        w AS (SELECT beam_size, model_name, s, v, {mixed} AS u FROM d, (SELECT unnest(range(1, 201)) AS s) q),
        c AS (SELECT *, {" + ".join(f"(u > {t})::INT" for t in A.POISSON)} AS k FROM w),
        m AS (SELECT beam_size, model_name, s, sum(k * v) / nullif(sum(k), 0) AS mean FROM c GROUP BY ALL),
        b AS (SELECT beam_size, model_name, list_sort(list(mean)) AS b FROM m WHERE mean IS NOT NULL GROUP BY ALL)
        SELECT beam_size, model_name, n, round(mean, 6) AS mean,
            round(b[CAST(floor((len(b) - 1) * 0.025e0) AS BIGINT) + 1], 6) AS low,
            round(b[CAST(floor((len(b) - 1) * 0.975e0) AS BIGINT) + 1], 6) AS high
        FROM (SELECT beam_size, model_name, count(*) AS n, avg(v) AS mean FROM d GROUP BY ALL) p
        JOIN b USING (beam_size, model_name)""")

    def histogram_sql(source, names):
        return f"""SELECT "column", bin, n, CAST(sum(n) OVER (PARTITION BY "column" ORDER BY bin) AS BIGINT) AS cumulative
        FROM (SELECT "column", CAST(CASE WHEN high = low THEN 0 ELSE least(floor((value - low) / ((high - low) / 100e0)), 99)
                END AS BIGINT) AS bin, count(*) AS n
            FROM {long_sql(source, names)} JOIN (SELECT "column", min(value) AS low, max(value) AS high
                FROM {long_sql(source, names)} GROUP BY 1) e USING ("column") GROUP BY ALL) b"""

    add("e13_histogram", lambda t: A.histogram(with_word_counts(t.corpus), words),
        histogram_sql(WORDS.replace(") w", ")"), words))
    add("e15_distinct_values", lambda t: t.clean.select("model_name").distinct(), "SELECT DISTINCT model_name FROM clean")
    add("e16_single_share", lambda t: split_check(t.clean, ["model_name"]),
        """SELECT model_name, count(*) FILTER (WHERE dataset_size = 1) AS single,
            count(*) FILTER (WHERE dataset_size IS DISTINCT FROM 1) AS multi, count(*) AS runs,
            count(*) FILTER (WHERE dataset_size = 1) / CAST(count(*) AS DOUBLE) AS single_share, true AS adds_up
        FROM clean GROUP BY model_name""")

    def first_sql(source, by, order, where="true", cols=COLUMNS):
        return f"""SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}, {TIES}) AS place
            FROM {source} WHERE {where}) r WHERE place = 1"""

    metrics = ", ".join(f"'{m}'" for m in QUALITY_COLUMNS)
    case = "CASE metric " + " ".join(f"WHEN '{m}' THEN \"{m}\"" for m in QUALITY_COLUMNS) + " END"
    add("w1_best_per_metric", lambda t: K.best_per_metric(studies.full_corpus_runs(t.clean), QUALITY_COLUMNS,
                                                          ["dataset_name", "model_name"]),
        f"""SELECT metric, value, {COLUMNS} FROM (
            SELECT *, row_number() OVER (PARTITION BY dataset_name, model_name, metric ORDER BY value DESC, {TIES}) AS place
            FROM (SELECT c.*, metric, {case} AS value FROM clean c, (SELECT unnest([{metrics}]) AS metric) m
                WHERE {FULL}) v) r WHERE place = 1""")
    add("w2_best_values", lambda t: K.best_values(studies.full_corpus_runs(t.clean), QUALITY_COLUMNS)
        .withColumn("place", F.col("place").cast("long")),
        f"""SELECT dataset_name, model_name, "column" AS metric, value,
            row_number() OVER (PARTITION BY dataset_name, "column" ORDER BY value DESC, model_name) AS place
        FROM (SELECT dataset_name, model_name, "column", max(value) AS value
            FROM {long_sql(f'(SELECT * FROM clean WHERE {FULL}) f', QUALITY_COLUMNS, 'dataset_name, model_name')}
            GROUP BY ALL) b""")
    board = ", ".join(["dataset_name", "model_name", *[f'"{c}"' for c in columns]])
    add("w3_best_configuration", lambda t: K.best_rows(studies.full_corpus_runs(t.clean), ["dataset_name", "model_name"],
                                                       F.col("sacrebleu")),
        first_sql("clean", "dataset_name, model_name", "sacrebleu DESC", FULL))
    add("w4_first_per_ratio", lambda t: K.best_rows(t.clean, ["device_memory_ratio"], F.col("encoder_latency_s")),
        first_sql("clean", "device_memory_ratio", "encoder_latency_s DESC"))
    add("w5_ecdf", lambda t: rounded(A.ecdf(t.clean.where("dataset_size = 1"), ["encoder_throughput", "encoder_latency_s"]),
                                     ecdf=12),
        f"""SELECT DISTINCT "column", value, count(*) OVER (PARTITION BY "column", value) AS n,
            round(cume_dist() OVER (PARTITION BY "column" ORDER BY value), 12) AS ecdf
        FROM {long_sql('(SELECT * FROM clean WHERE dataset_size = 1) s', ['encoder_throughput', 'encoder_latency_s'])}""")
    add("w7_best_overall", lambda t: K.best_per_metric(t.clean, QUALITY_COLUMNS, []),
        f"""SELECT metric, value, {COLUMNS} FROM (
            SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, {TIES}) AS place
            FROM (SELECT c.*, metric, {case} AS value FROM clean c, (SELECT unnest([{metrics}]) AS metric) m) v) r
        WHERE place = 1""")
    add("s1_sorted_runs", lambda t: only(t.clean, dataset_name="wmt14").orderBy(
        F.desc("sacrebleu"), *RUN_COLUMNS).select("model_name", "beam_size", "max_gen_length", "sacrebleu"),
        "SELECT model_name, beam_size, max_gen_length, sacrebleu FROM clean WHERE dataset_name = 'wmt14'")

    def s2(t):
        counts = {m: 10 if m == "meteor" else 3 for m in QUALITY_COLUMNS}
        orders = {m: (F.col("beam_size") == 1 if m == "meteor" else F.lit(True), F.col(m), k) for m, k in counts.items()}
        return K.top_k_per_metric(studies.full_corpus_runs(t.clean), orders).withColumn("place", F.col("place").cast("long"))

    def places(source, name, where, order, k):
        return f"""(SELECT {name}, row_number() OVER (ORDER BY {order}, {TIES}) AS place, {COLUMNS}
            FROM {source} WHERE {where} QUALIFY place <= {k})"""

    add("s2_top_k", s2, " UNION ALL ".join(places(
        "clean", f"'{m}' AS metric", FULL + (" AND beam_size = 1" if m == "meteor" else ""), f'"{m}" DESC',
        10 if m == "meteor" else 3) for m in QUALITY_COLUMNS))

    def extremes_sql(source, where):
        return " UNION ALL ".join(places(
            source, f"'{measure}' AS measure, '{kind}' AS kind", f"{where} AND {measure} IS NOT NULL",
            f"{measure} {'DESC' if higher == (kind == 'best') else 'ASC'}", 1 if kind == "best" else 2)
            for measure, higher in studies.BETTER.items() for kind in ("best", "worst"))

    def extremes(df):
        return df.withColumn("place", F.col("place").cast("long"))

    add("s3_extremes", lambda t: extremes(K.extremes(only(t.clean, model_name="t5-large"), studies.BETTER)),
        extremes_sql("clean", "model_name = 't5-large'"))

    kept = "model_name <> 'switch-base-128' AND beam_size <> 8"
    add("x4_beam_study", lambda t: interval(studies.beam_study(t.clean)), interval_sql(
        f"(SELECT * FROM short_clean WHERE {kept}) k", ["decoder_latency_s", "decoder_throughput", "sacrebleu"],
        "beam_size, model_name"))
    dense = """model_name NOT IN ('switch-base-128', 'switch_16_finetuned', 'nllb-moe-54b') AND beam_size <> 8
        AND max_input_seq_length <> 10 AND dataset_size <> 1"""
    add("x5_input_length_study", lambda t: interval(studies.input_length_study(t.clean)),
        interval_sql(f"(SELECT * FROM short_clean WHERE {dense}) k", SPEED_COLUMNS, "max_input_seq_length, model_name"))
    add("x6_fastest", lambda t: studies.fastest(t.clean), f"""SELECT * FROM short_clean
        WHERE model_name = 't5-large' AND beam_size <> 8 AND max_input_seq_length <> 10 AND dataset_size <> 1
        ORDER BY decoder_latency_s, {TIES} LIMIT 1""")
    add("x7_ratio_study", lambda t: studies.ratio_study(t.clean), first_sql(
        "short_clean", "device_memory_ratio", "1", """model_name = 'switch_16_finetuned' AND beam_size <> 8
        AND dataset_name = 'wmt14' AND encoder_throughput < 1000""",
        ", ".join(["device_memory_ratio", *SPEED_COLUMNS, "beam_size", "max_gen_length"])))
    add("x8_sparse_model_study", lambda t: extremes(studies.sparse_model_study(t.clean)), extremes_sql(
        "short_clean", "model_name = 'nllb-moe-54b' AND beam_size <> 8 AND dataset_name = 'wmt14'"))
    add("x9_merged_runs", lambda t: t.clean, f"SELECT {COLUMNS} FROM clean")
    add("x9_resident_or_set", lambda t: only(t.clean, model_name="google/switch_16_finetuned")
        .where(ratio_set_or_resident()).dropDuplicates().groupBy("device_memory_ratio", "use_archer")
        .agg(F.count("*").alias("n")),
        """SELECT device_memory_ratio, use_archer, count(*) AS n FROM clean WHERE model_name = 'google/switch_16_finetuned'
            AND ((device_memory_ratio IS NOT NULL AND device_memory_ratio <> 0) OR NOT use_archer) GROUP BY ALL""")
    add("x10_leaderboard", lambda t: studies.leaderboard(t.clean),
        first_sql("clean", "dataset_name, model_name", "meteor DESC", FULL, board))
    add("x11_length_summary", lambda t: rounded(studies.length_profile(t.corpus, "summary"), **SUMMARY),
        describe_sql(WORDS.replace(") w", ")"), words))
    add("x11_length_histogram", lambda t: studies.length_profile(t.corpus, "histogram"),
        histogram_sql(WORDS.replace(") w", ")"), words))
    add("x11_length_shares", lambda t: rounded(studies.length_profile(t.corpus, "shares"), at_most_15=12, at_most_30=12,
                                               at_most_82=12),
        f"""SELECT "column", """ + ", ".join(f"round(avg(CASE WHEN value <= {m} THEN 1 ELSE 0 END), 12) AS at_most_{m}"
                                             for m in studies.LENGTH_MARKS)
        + f""" FROM {long_sql(WORDS.replace(") w", ")"), words)} GROUP BY 1""")

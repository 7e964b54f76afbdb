"""Streams against batches, and the shape of the physical plans."""

import re

import pytest
from pyspark.sql import functions as F

from babelgauge import streaming
from babelgauge.catalog import queries
from babelgauge.catalog.views import Inputs
from babelgauge.operators.quality import evaluate, metrics
from babelgauge.operators.runs import cap_outliers, only
from babelgauge.session import work_path

FOLDER = "/root/testdata/sf0.001"


def test_streamed_scores_over_many_files_equal_the_batch(spark):
    path = work_path(spark, "pairs")
    spark.range(300).select(F.concat(F.lit("a b c d e "), F.col("id") % 7).alias("prediction"),
                            F.concat(F.lit("a b c d f "), F.col("id") % 5).alias("reference"),
                            (F.col("id") % 2).alias("g")).repartition(6).write.parquet(path)
    chosen = metrics(["sacrebleu", "chrf", "meteor"])
    batch = spark.read.parquet(path)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 2).parquet(path)
    got = {r.g: r for r in streaming.stream_scores(spark, stream, chosen, ["g"]).collect()}
    for row in evaluate(batch, chosen, ["g"]).collect():
        assert got[row.g].sacrebleu == row.sacrebleu and got[row.g].chrf == row.chrf
        assert got[row.g].meteor == pytest.approx(row.meteor)


def plan(spark, key):
    return queries()[key](spark, FOLDER)._jdf.queryExecution().toString()


@pytest.mark.parametrize("key", ["m7_report", "m9_grouped", "x1_result_rows", "j2_batch_zip", "j3_unrecorded_runs",
                                 "w8_error_budget", "x10_leaderboard", "c3_encode", "x4_beam_study"])
def test_no_cross_joins(spark, key):
    text = plan(spark, key)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_metrics_shuffle_counts_not_grams(spark):
    """One exchange spreads the small input, one carries the sums; all metrics share one Python pass."""
    physical = plan(spark, "m7_report").split("== Physical Plan ==")[1]
    assert physical.count("ArrowEvalPython") == 1
    assert physical.count("Exchange ") == 2


def test_texts_are_not_dealt_to_runs(spark, monkeypatch):
    """The settings of the runs are a small table beside the texts, and many even tasks give the rows of few."""
    from babelgauge.catalog import control

    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "50000")  # below the size of the texts
    try:
        few = queries()["x1_result_rows"](spark, FOLDER)
        physical = few._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert re.search(r"BroadcastHashJoin \[run_id#\d+L?\], \[run_id#\d+L?\], Inner", physical)
    want = sorted(map(str, few.collect()))
    monkeypatch.setattr(control, "TASK_ROWS", 10)
    assert sorted(map(str, queries()["x1_result_rows"](spark, FOLDER).collect())) == want


def test_filters_reach_the_scan(spark):
    path = work_path(spark, "runs")
    Inputs(spark, FOLDER).runs.write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = only(cap_outliers(spark.read.parquet(path)), dataset_name="wmt14").select("meteor") \
        ._jdf.queryExecution().toString()
    pushed = [line for line in text.splitlines() if "PushedFilters" in line][0]
    for condition in ("LessThanOrEqual(beam_size,32)", "LessThanOrEqual(max_gen_length,128)", "EqualTo(dataset_name,wmt14)"):
        assert condition in pushed
    assert "sacrebleu" not in pushed.split("ReadSchema")[1]


def test_windows_stay_inside_blocks(spark):
    for key in ("j2_batch_zip", "w8_error_budget"):
        windows = [line for line in plan(spark, key).split("== Physical Plan ==")[1].splitlines() if "Window [" in line]
        assert windows and all("_block" in line for line in windows)


def test_calls_and_counts_in_any_order_zip_as_the_batch_does(spark):
    """Later calls come first, counts before and after their calls, one count never; a run of decoder calls only."""
    from babelgauge.operators import latency

    calls, counts, out = (work_path(spark, name) for name in ("calls", "counts", "zipped"))
    schema = "run_id long, call_seq long, layer_type string, latency_s double, ts timestamp"
    log = spark.sql(f"""SELECT id % 3 AS run_id, id AS call_seq, CASE WHEN id % 3 = 2 OR id % 5 = 1 THEN 'decoder' ELSE 'encoder' END AS layer_type,
        id / 8 AS latency_s, TIMESTAMP '2024-01-01' + make_interval(0, 0, 0, 0, 0, id) AS ts FROM range(60)""")
    numbered = latency.number_encoder_calls(log)
    told = numbered.where("batch_idx <> 4").selectExpr("run_id", "batch_idx", "batch_idx * 7 AS n_tokens")
    timed = told.join(log.selectExpr("run_id", "call_seq", "ts").join(numbered, ["run_id", "call_seq"]).select("run_id", "batch_idx", "ts"), ["run_id", "batch_idx"])
    end = spark.sql("SELECT -1L AS run_id, 0L AS call_seq, 'encoder' AS layer_type, 0D AS latency_s, TIMESTAMP '2024-03-01' AS ts")
    for where in ("call_seq >= 30", "call_seq < 30"):
        log.where(where).coalesce(1).write.mode("append").parquet(calls)
    end.coalesce(1).write.mode("append").parquet(calls)
    for where in ("batch_idx % 2 = 1", "batch_idx % 2 = 0"):
        timed.select("run_id", "batch_idx", "n_tokens", "ts").where(where).coalesce(1).write.mode("append").parquet(counts)
    read = spark.readStream.option("maxFilesPerTrigger", 1)
    zipped = streaming.zip_online(read.schema(schema).parquet(calls), read.schema("run_id long, batch_idx long, n_tokens long, ts timestamp").parquet(counts), "1 day", "1 hour")
    streaming.run_to_table(zipped, out, "append").awaitTermination()
    got = {(r.run_id, r.batch_idx, r.call_seq, r.latency_s, r.n_tokens, r.matched) for r in spark.read.parquet(f"{out}/table").where("run_id >= 0").collect()}
    want = {(r.run_id, r.batch_idx, r.call_seq, r.latency_s, r.n_tokens, r.n_tokens is not None) for r in latency.zip_batches(log, told).collect()}
    assert got == want and sum(not w[-1] for w in want) == 2

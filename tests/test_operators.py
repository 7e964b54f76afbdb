"""Operators on small hand-written tables."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from babelgauge.functions import models
from babelgauge.operators import analysis, batching, inference, latency, ordering, ranking, runs, sweep, triage, vocabulary
from babelgauge.schemas import EXPERIMENT_KEYS, RUN_COLUMNS, run_schema
from babelgauge.session import work_path
from babelgauge.sources import corpora, logs, results


def test_running_sum_crosses_blocks_and_groups(spark, monkeypatch):
    monkeypatch.setattr(ordering, "BLOCK_WIDTH", 4)
    rows = [(g, i, (i * 7 + (g or 0)) % 5) for g in (0, 1, None) for i in range(0, 41, 1 + (g or 0))]
    df = spark.createDataFrame(rows, "g int, i long, v long")
    got = {(r.g, r.i): r.s for r in ordering.running_sum(df, ["g"], "i", F.col("v"), "s").collect()}
    expected = {}
    for g in (0, 1, None):
        total = 0
        for _, i, v in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            total += v
            expected[g, i] = total
    assert got == expected


def test_quantiles_and_ecdf_are_exact(spark):
    rng = np.random.default_rng(1)
    values = np.round(rng.lognormal(size=2001), 2)
    df = spark.createDataFrame([(float(v), i % 3) for i, v in enumerate(values)], "x double, y int")
    row = {r["column"]: r for r in analysis.describe(df, ["x", "y"]).collect()}["x"]
    assert [row["q_25"], row["q_50"], row["q_75"]] == pytest.approx(list(np.quantile(values, [.25, .5, .75])))
    assert (row["mean"], row["std"], row["count"]) == (pytest.approx(values.mean()), pytest.approx(values.std(ddof=1)), 2001)
    approx = {r["column"]: r for r in analysis.describe(df, ["x"], exact=False).collect()}["x"]
    assert approx["q_50"] == pytest.approx(row["q_50"], rel=0.01)
    for r in analysis.ecdf(df, ["x"]).collect():
        assert r["ecdf"] == pytest.approx((values <= r["value"]).mean())


def test_bootstrap_interval_covers_the_mean_and_repeats(spark):
    df = spark.range(3000).select("id", (F.col("id") % 2).alias("g"), F.sin(F.col("id")).alias("x"))
    first = analysis.bootstrap_interval(df, "x", ["g"], ["id"]).orderBy("g").collect()
    again = analysis.bootstrap_interval(df.repartition(5), "x", ["g"], ["id"]).orderBy("g").collect()
    normal = {r["g"]: r for r in analysis.grouped_interval(df, ["x"], ["g"]).collect()}
    for a, b in zip(first, again):
        assert a["low"] < a["mean"] < a["high"]
        assert a["low"] == pytest.approx(b["low"]) and a["high"] == pytest.approx(b["high"])
        assert a["high"] - a["low"] == pytest.approx(normal[a["g"]]["high"] - normal[a["g"]]["low"], rel=0.25)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 0, 1, 50, 99, 100)], "x double")
    got = [(r.bin, r.n, r.cumulative) for r in analysis.histogram(df, ["x"]).orderBy("bin").collect()]
    assert got == [(0, 2, 2), (1, 1, 3), (50, 1, 4), (99, 2, 6)]


def test_dense_ids_have_no_gaps(spark):
    df = spark.range(5000).select(F.concat(F.lit("t"), F.col("id") % 777).alias("t"))
    got = ordering.dense_ids(df, "t", first=3).collect()
    assert sorted(r.id for r in got) == list(range(3, 780)) and len({r.t for r in got}) == 777


def test_vocabulary_round_trip(spark):
    df = spark.createDataFrame([(1, "a b a c"), (2, ""), (3, "z")], "id long, text string")
    words = F.filter(F.split("text", " "), lambda w: w != "")
    vocab = vocabulary.build_vocabulary(df.where("id < 3"), words)
    ids = vocabulary.encode(df, "id", words, vocab)
    assert {r.id: len(r.ids) for r in ids.collect()} == {1: 4, 2: 0, 3: 1}
    back = {r.id: r.text for r in vocabulary.decode(ids, "id", F.col("ids"), vocab).collect()}
    assert back == {1: "a b a c", 2: "", 3: ""}  # z is unknown, and unknowns are skipped


def test_padding_and_masks(spark):
    df = spark.createDataFrame([(0, [5, -100, 7]), (1, [1]), (2, [])], "idx long, ids array<int>")
    ids = df.withColumn("ids", batching.unmask(F.col("ids")))
    padded = {r.idx: r.ids for r in batching.pad_batches(batching.with_batches(ids, 2)).collect()}
    assert padded == {0: [5, 0, 7], 1: [1, 0, 0], 2: []}
    assert [r[0] for r in ids.orderBy("idx").select(batching.token_length(F.col("ids"))).collect()] == [2, 1, 0]
    assert ids.orderBy("idx").select(batching.attention_mask(F.col("ids"))).first()[0] == [1, 0, 1]


@pytest.mark.parametrize("size, expected", [(1, None), (2, 1), (4, 1), (32, 8)])
def test_next_batch_size(spark, size, expected):
    df = spark.createDataFrame([(size, "CUDA Out Of Memory")], "b long, m string")
    assert df.select(triage.next_batch_size(F.col("b"), F.col("m"))).first()[0] == expected


def test_budget_lets_twenty_errors_pass(spark):
    rows = [(7, i, 8, "1", "CUDA out of memory" if i % 2 else "TypeError") for i in range(60)]
    df = spark.createDataFrame(rows, "sweep_id long, seq long, batch_size long, dataset_size string, message string")
    actions = [r.action for r in triage.triage(df).orderBy("seq").collect()]
    assert actions.count("reduce") == 30 and actions.count("continue") == 20 and actions.count("abort") == 10
    assert "continue" not in actions[actions.index("abort"):]


SMALL_SWEEP = {"dataset_size": [1, None], "max_gen_length": [32, 64], "max_input_seq_length": [-1], "beam_size": [1],
               "model_name": ["t5-base"], "dataset_name": ["wmt14", "flores200"],
               "tokenizer_padding_setting": ["do_not_pad"], "use_archer": False, "device_memory_ratio": None}


def test_sweep_sizes(spark):
    assert sweep.sweep_grid(spark, SMALL_SWEEP).count() == 8
    assert sweep.sweep_grid(spark, sweep.QUALITY_AXES).count() == 108
    moe = sweep.derive(SMALL_SWEEP, model_name=["facebook/nllb-moe-54b"], device_memory_ratio=0.9, dataset_name=["wmt14"])
    row = sweep.resolve_sizes(sweep.sweep_grid(spark, moe)).where("dataset_size > 1").first()
    assert (row.model_name, row.dataset_size, row.device_memory_ratio) == ("facebook/nllb-moe-54b", 3000, 0.9)
    with pytest.raises(KeyError):
        sweep.derive(SMALL_SWEEP, beams=[1])


def test_recorded_runs_compare_missing_ratios_as_equal(spark):
    planned = sweep.resolve_sizes(sweep.sweep_grid(spark, SMALL_SWEEP)).select(*EXPERIMENT_KEYS)
    done = planned.where("dataset_name = 'wmt14'")
    assert {r.dataset_name for r in sweep.unrecorded(planned, done).collect()} == {"flores200"}
    assert {r.dataset_name for r in sweep.already_recorded(planned, done).collect()} == {"wmt14"}


def test_runs_with_unknown_limits_stay(spark):
    planned = spark.createDataFrame([(15,), (30,), (7,)], "max_input_seq_length long")
    sizes = spark.createDataFrame([(15, 0), (30, 4)], "max_input_seq_length long, n long")
    got = {(r.max_input_seq_length, r.n) for r in sweep.skip_empty(planned, sizes).collect()}
    assert got == {(30, 4), (7, None)}


def test_corpus_sizes_are_numbers_or_all(spark):
    corpus = spark.range(5)
    got = {r.requested: (r.granted, r.clamped) for r in corpora.granted_sizes(corpus, [3, "all", "10000000000000"]).collect()}
    assert got == {"3": (3, False), "all": (5, False), "10000000000000": (5, True)}
    for bad in ("al", "-5", -5, "12.5", 1.5):
        with pytest.raises(ValueError):
            corpora.granted_sizes(corpus, [bad])


def test_zip_keeps_positions_without_a_partner(spark):
    en = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "idx long, sentence string")
    got = {(r.id, r.en, r.fr) for r in corpora.flat(corpora.zip_monolingual(en, en.where("idx > 0"))).collect()}
    assert got == {(0, "a", None), (1, "b", "b"), (2, "c", "c")}


def test_missing_values_are_not_dropped(spark):
    runs_ = spark.createDataFrame([(None, None), (0.9, 1), (0.3, 7)], "device_memory_ratio double, dataset_size long")
    assert {r[0] for r in runs.without(runs_, device_memory_ratio=0.9).collect()} == {None, 0.3}
    row = runs.split_check(runs_, []).first()
    assert (row.single, row.multi, row.adds_up) == (1, 2, True)
    capped = spark.createDataFrame([(64, 512), (4, 128)], "beam_size long, max_gen_length long")
    assert runs.cap_outliers(capped, beam=None, gen=None).count() == 2 and runs.cap_outliers(capped).count() == 1


def test_null_groups_and_single_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 3.0), ("a", None)], "g string, x double").withColumn("id", F.monotonically_increasing_id())
    assert {r.g for r in analysis.bootstrap_interval(df, "x", ["g"], ["id"]).collect()} == {None, "a"}
    assert analysis.bootstrap_interval(df, "x", [], ["id"]).first().n == 3
    assert {(r.g, r.bin, r.n) for r in analysis.histogram(df, ["x"], 2, ["g"]).collect()} == {(None, 0, 1), (None, 1, 1), ("a", 0, 1)}


def test_missing_measures_are_neither_best_nor_worst(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", None), ("c", 0.1), ("d", 0.3)], "m string, s double")
    got = {(r.kind, r.place, r.m) for r in ranking.extremes(df, {"s": True}).collect()}
    assert got == {("best", 1, "a"), ("worst", 1, "c"), ("worst", 2, "d")}


def test_result_files_go_by_name(spark, tmp_path):
    names = RUN_COLUMNS
    row = {n: "1" for n in names} | {"use_archer": "true"}
    layouts = {"a_metrics.csv": names, "b_metrics.csv": names[::-1], "c_metrics.csv": names[:20]}
    for file, columns in layouts.items():
        (tmp_path / file).write_text(",".join(columns) + "\n" + ",".join(row[c] for c in columns) + "\n")
    (tmp_path / "d_metrics.csv").write_text(", ".join(f'"{c}"' for c in names) + "\n" + ",".join(row[c] for c in names) + "\n")
    (tmp_path / "notes.csv").write_text("something else\n1\n")
    merged = results.read_result_folder(spark, str(tmp_path)).collect()
    assert len(merged) == 4 and all(r.model_name == "1" and r.use_archer and r.chrf == 1.0 for r in merged)
    assert sum(r.decoder_throughput is None for r in merged) == 1
    (tmp_path / "e_metrics.csv").write_text(",".join([*names, "comet"]) + "\n")
    with pytest.raises(ValueError, match="comet"):
        results.read_result_folder(spark, str(tmp_path))


def test_runs_without_a_log_stay(spark):
    log = spark.createDataFrame([(1, 0, "encoder", 0.5)], "run_id long, call_seq long, layer_type string, latency_s double")
    tokens = spark.createDataFrame([(1, 40, 60, 3), (2, 1, 1, 1)], "run_id long, encoder_tokens long, decoder_tokens long, n_rows long")
    assert {r.run_id: r.encoder_sum_based for r in latency.throughput(log, tokens).collect()} == {1: 80.0, 2: None}
    assert {r.run_id: r.rows_per_s for r in latency.end_to_end(log, tokens).collect()} == {1: 6.0, 2: None}


def test_batches_are_full_after_a_filter(spark):
    kept = spark.range(500).where("id % 3 = 1").select(F.col("id").alias("idx"))
    sizes = [r["count"] for r in batching.with_batches(batching.renumbered(kept), 32).groupBy("batch_id").count().orderBy("batch_id").collect()]
    assert sizes == [32] * 5 + [7]


def test_rows_are_numbered_in_bounded_blocks(spark):
    """A run of more places than a block is several groups, numbered on from each other; repeated places are all numbered."""
    rows = spark.range(200_000).select(F.lit(1).alias("run_id"), F.expr("id div 2 * 2 AS idx"), "id")
    numbered = batching.renumbered(rows, keys=["run_id"])
    last = numbered.agg(F.min("idx"), F.max("idx"), F.count_distinct("idx"), F.count("*")).first()
    assert tuple(last) == (0, 199_999, 200_000, 200_000)
    assert numbered.where("idx <> id AND idx <> bigint(id) + 1 AND idx <> id - 1").isEmpty()
    windows = numbered._jdf.queryExecution().toString()
    assert f"/ {float(batching.BLOCK)}" in windows or f"/ cast({batching.BLOCK}" in windows


@pytest.mark.parametrize("heavy", [0, 3, 1 << 16])
def test_lookups_with_and_without_a_map(spark, monkeypatch, heavy):
    """Repeated keys, unknown and null tokens, null and empty arrays; whatever share of the tokens the tasks know."""
    monkeypatch.setattr(vocabulary, "HEAVY", heavy)
    rows = [(1, "a b a c"), (1, "c d"), (2, ""), (3, None), (4, "z a z"), (5, " ".join("abcdefgh" * 50)), (None, "b")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    words = F.filter(F.split("text", " "), lambda w: w != "")
    vocab = vocabulary.build_vocabulary(df.where("id <> 4 OR id IS NULL"), words)
    id_of = {r.token: r.id for r in vocab.collect()}
    assert {r.token: r.n for r in vocab.collect()}["a"] == 52
    got = sorted((r.id or 0, r.ids) for r in vocabulary.encode(df, "id", words, vocab).collect())
    assert got == sorted((i or 0, [id_of.get(w, 2) for w in (t or "").split()]) for i, t in rows)
    back = vocabulary.decode(vocabulary.encode(df, "id", words, vocab), "id", F.col("ids"), vocab).collect()
    assert sorted((r.id or 0, r.text) for r in back) == sorted((i or 0, " ".join(w for w in (t or "").split() if w in id_of)) for i, t in rows)


def test_names_and_routing(spark):
    df = spark.createDataFrame([("google/switch_16_finetuned", "wmt14", True, 0.9), ("t5-base", "flores200", None, None)],
                               "m string, d string, a boolean, r double")
    c = [F.col(x) for x in "mdar"]
    assert [r[0] for r in df.select(models.result_file(*c)).collect()] == [
        "switch_16_finetuned_wmt14_archer_0.9_metrics.csv", "t5-base_flores200_metrics.csv"]
    assert [r[0] for r in df.select(models.task_prefix(c[0], F.lit("en"), F.lit("fr"))).collect()] == [models.TASK_PREFIX] * 2
    with pytest.raises(PySparkException):
        df.select(models.forward_log_file(F.lit("gpt"), strict=True)).collect()
    with pytest.raises(PySparkException):
        df.select(models.pair_configuration(c[1], F.lit("en"), F.lit("de"), strict=True)).collect()


def test_corpus_names_and_sizes():
    with pytest.raises(ValueError):
        corpora.check_name("wmt99")
    assert corpora.check_name("facebook/flores") == "flores200"
    assert corpora.split_size("wmt14", 5000) == (3000, True)
    assert corpora.split_size("flores200", "all") == (997, False)


def test_word_count_of_nothing(spark):
    df = spark.createDataFrame([("",), (" a  b ",), (None,)], "en string").withColumn("fr", F.lit("x"))
    assert [r.word_count_en for r in corpora.with_word_counts(df).collect()] == [1, 5, 1]


def test_result_folder_mixes_versions(spark):
    path = work_path(spark, "versions")
    for version in (21, 22, 23, 24):
        schema = run_schema(version)
        row = [str(version) if f.dataType.simpleString() == "string" else True if f.name == "use_archer" else
               float(version) if f.dataType.simpleString() == "double" else version for f in schema]
        spark.createDataFrame([tuple(row)], schema).write.option("header", True).csv(f"{path}/{version}")
    merged = results.read_result_folder(spark, path, "part-*.csv")
    assert merged.columns == RUN_COLUMNS
    got = {int(r.model_name): (r.use_archer, r.device_memory_ratio, r.dataset_size_after_filter_wrt_input_len)
           for r in merged.collect()}
    assert got == {21: (None, None, None), 22: (None, None, 22), 23: (True, None, 23), 24: (True, 24.0, 24)}


def test_failure_texts_round_trip(spark):
    rows = [("facebook/nllb-moe-54b", 32, "all", 128, 4, -1, "do_not_pad", "wmt14", "Traceback:\n  a line\nCUDA out of memory"),
            ("t5, large", 1, None, 20, 1, 15, "no_pad_fill", "flores200", "TypeError")]
    df = spark.createDataFrame(rows, "model_name string, batch_size long, dataset_size string, max_gen_length long, beam_size long, "
                               "max_input_seq_length long, tokenizer_padding_setting string, dataset_name string, message string")
    path = work_path(spark, "texts")
    logs.write_failure_texts(df, path)
    lines = {r[0] for r in spark.read.text(path).collect()}
    assert ("Hyperparameters: model_name: facebook/nllb-moe-54b, Batch_size: 32, dataset_size: all, max_gen_length: 128, "
            "beam_size: 4, max_input_seq_length: -1, tokenizer_padding_setting: do_not_pad, dataset_name= wmt14") in lines
    logs.write_warning_texts(df, path)
    back = {tuple(r) for r in logs.read_failure_texts(spark, path).collect()}
    assert back == {("error", *r) for r in rows} | {("warning", *r[:-1], None) for r in rows}


def test_warning_without_line_break_and_filtered_size(spark, tmp_path):
    line = ("WARNING! Something.Hyperparameters: model_name: t5-base, Batch_size: 8, dataset_size: 3000, "
            "dataset_size_after_filter_wrt_input_len: 1370 max_gen_length: 128, beam_size: 4, max_input_seq_length: 15, "
            "tokenizer_padding_setting: do_not_pad, dataset_name= wmt14 \n")
    (tmp_path / "t5.txt").write_text(line + "ERROR: Exception occured during runtime!\nother text\n")
    assert [tuple(r) for r in logs.read_failure_texts(spark, str(tmp_path)).collect()] == [
        ("warning", "t5-base", 8, "3000", 128, 4, 15, "do_not_pad", "wmt14", None)]


def test_rows_without_position_are_batched_too(spark):
    df = spark.createDataFrame([(None, f"s{i}") for i in range(7)] + [(i, "the x") for i in range(5)], "idx long, source string")
    done = inference.translate_batches(df, lambda s: [f"{len(s)}"] * len(s), 3).collect()
    loose = [r.prediction for r in done if r.kind == "prediction" and r.idx is None]
    assert len(loose) == 7 and set(loose) <= {"1", "2", "3"} and all(r.batch_id is None for r in done if r.kind == "prediction" and r.idx is None)
    assert sorted((r.idx, r.batch_id, r.prediction) for r in done if r.kind == "prediction" and r.idx is not None) == [
        (0, 0, "3"), (1, 0, "3"), (2, 0, "3"), (3, 1, "2"), (4, 1, "2")]


def test_throughput_definitions(spark):
    log = spark.createDataFrame([(1, i, k, s) for i, (k, s) in enumerate(
        [("encoder", 0.1), ("decoder", 0.2), ("encoder", 0.3), ("decoder", 0.4)])], "run_id long, call_seq long, layer_type string, latency_s double")
    tokens = spark.createDataFrame([(1, 40, 60)], "run_id long, encoder_tokens long, decoder_tokens long")
    row = latency.throughput(log, tokens).first()
    assert row.encoder_mean_based == pytest.approx(200) and row.encoder_sum_based == pytest.approx(100)
    # throughput times mean latency gives the token total back
    mean = latency.mean_latency(log).first()
    assert row.decoder_mean_based * mean.decoder_latency_s == pytest.approx(60)


def test_ranking_breaks_ties_by_the_row(spark):
    df = spark.createDataFrame([("m", 1, 5.0), ("m", 0, 5.0), ("n", 2, None), ("n", 3, 1.0)], "g string, k int, v double")
    assert {r.g: r.k for r in ranking.best_rows(df, ["g"], F.col("v")).collect()} == {"m": 0, "n": 3}
    assert [r.k for r in ranking.top_k(df, F.col("v"), 2).collect()] == [0, 1]


def test_batched_map(spark):
    df = spark.range(70).select(F.col("id").alias("idx"), F.concat(F.lit("the "), F.col("id")).alias("source"))
    done = inference.translate_batches(df, inference.word_map({"the": "le"}), 32, run_id=5).cache()
    assert {r.idx: r.prediction for r in inference.predictions(done).collect()} == {i: f"le {i}" for i in range(70)}
    log = inference.forward_log(done).orderBy("call_seq").collect()
    assert [(r.run_id, r.call_seq >> inference.CALL_BITS, r.layer_type) for r in log] == [(5, i, "encoder") for i in range(3)]
    short = inference.translate_batches(df, lambda sentences: [], 32)
    assert inference.predictions(short).count() == 0  # a function that loses rows fails for each of them
    assert {r.message for r in inference.failures(short).collect()} == {"ValueError: 0 predictions for 1 sentences"}


def test_failing_calls(spark):
    """A function that fails on long batches and on one poison row: every other row is predicted, once."""
    from babelgauge.operators.triage import next_batch_size

    def moody(texts, timer):
        if len(texts) > 3:
            raise RuntimeError("CUDA out of memory")
        if "poison" in texts:
            raise ValueError("bad input")
        if "huge" in texts:
            raise MemoryError("out of memory")
        with timer("encoder"):
            out = [t.upper() for t in texts]
        timer.record("decoder", 0.5)
        timer.record("decoder", 0.25)
        return out

    texts = [(r, i, f"t{i}") for r in (1, 2) for i in range(40)] + [(1, 40, "poison"), (2, 40, "huge"), (None, 0, "no run")]
    df = spark.createDataFrame(texts, "run_id long, idx long, source string").repartition(5)
    events = inference.run_batches(df, moody, 16).cache()
    got = sorted((r.run_id or 0, r.idx, r.prediction) for r in inference.predictions(events).collect())
    assert got == sorted((r or 0, i, t.upper()) for r, i, t in texts if t not in ("poison", "huge"))
    failed = inference.failures(events)
    told = failed.select("*", next_batch_size(F.col("batch_size"), F.col("message")).alias("next")).orderBy("sweep_id", "seq").collect()
    memory = [(r.sweep_id, r.idx, r.batch_size, r.next) for r in told if "memory" in r.message]
    assert memory[:5] == [(1, 0, 16, 4), (1, 0, 4, 1), (1, 4, 4, 1), (1, 8, 4, 1), (1, 12, 4, 1)]
    assert [(r.sweep_id, r.idx, r.next) for r in told if r.message == "ValueError: bad input"] == [(1, 40, None)]
    assert (2, 40, 1, None) in memory
    calls = inference.forward_log(events).where("run_id = 1").orderBy("call_seq").collect()
    assert [c.layer_type for c in calls[:3]] == ["encoder", "decoder", "decoder"] and len({c.call_seq for c in calls}) == len(calls)
    again = inference.run_batches(df.repartition(2), moody, 16)
    assert sorted(map(str, inference.failures(again).collect())) == sorted(map(str, failed.collect()))  # repeatable
    dealt = inference.run_batches(df, moody, 16, tasks=13)
    assert dealt.rdd.getNumPartitions() == 13
    parts = lambda e: sorted(map(str, e.where("kind <> 'call'").collect()))
    assert parts(dealt) == parts(events)
    kept = inference.predictions(inference.within_budget(events, budget=0))
    assert {(r.run_id, r.n) for r in kept.groupBy("run_id").agg(F.count("*").alias("n")).collect()} == {(1, 40), (2, 40), (None, 1)}


def test_best_rows_by_metric_sort_few_rows(spark):
    """Only rows that can be among the best of their batch are copied for every metric; ties, nulls and NaN stand as they did."""
    from babelgauge.operators.ranking import _leaders, best_per_metric, extremes, top_k_per_metric

    nan = float("nan")
    odd = [(None, 1, nan, 1.0), (None, 2, 7.0, None), (None, 3, 7.0, nan), ("z", 4, None, nan), ("y", 5, nan, None)]
    rows = [("ab"[i % 2], i, float(i * 37 % 101), float(i * 53 % 89) if i % 3 else None) for i in range(2000)] + odd
    df = spark.createDataFrame(rows, "g string, id long, p double, q double")
    assert _leaders(df, [(F.col("p"), 1), (F.col("q"), 2)], ["g"]).count() < 400

    def down(v):  # as Spark sorts: NaN first
        return (0, 0) if v != v else (1, -v)

    def low(v):  # by the negative value NaN comes last
        return (1, 0) if v != v else (0, -v)

    for by in ([], ["g"]):
        want = set()
        for group in {r[0] for r in rows} if by else {"all"}:
            for m, at in (("p", 2), ("q", 3)):
                there = [r for r in rows if r[at] is not None and (not by or r[0] == group)]
                if there:
                    best = min(there, key=lambda r: (low(r[at]), r[0] is not None, r[0] or "", r[1]))
                    want.add((m, repr(min((r[at] for r in there), key=down)), best[1]))
        assert {(r.metric, repr(r.value), r.id) for r in best_per_metric(df, ["p", "q"], by).collect()} == want
    found = top_k_per_metric(df, {"p": (F.col("id") > 1, F.col("p"), 3), "q": (F.lit(True), -F.col("q"), 2)}).collect()
    for m, at, sign, k, least in (("p", 2, 1, 3, 2), ("q", 3, -1, 2, 0)):
        there = sorted((r for r in rows if r[at] is not None and r[1] >= least),
                       key=lambda r: (down(sign * r[at]), r[0] is not None, r[0] or "", r[1]))[:k]
        assert sorted((r.place, r.id) for r in found if r.metric == m) == [(i + 1, r[1]) for i, r in enumerate(there)]
    for result in (best_per_metric(df, ["p", "q"], ["g"]), extremes(df, {"p": True, "q": False})):
        assert "MapInArrow" in result._jdf.queryExecution().optimizedPlan().toString().split("Generate")[1]


def test_look_up_carries_places(spark, monkeypatch):
    """Entries are places in the map or among the row's questions until they are answered, in parts of bounded size."""
    monkeypatch.setattr(vocabulary, "HEAVY", 3)
    monkeypatch.setattr(vocabulary, "SLICE", 4)
    table = spark.createDataFrame([(w, w.upper() if w != "d" else None, 9 - i) for i, w in enumerate("abcdefg")], "token string, canonical string, n long")
    lists = [["a", "g", "a", "x"], [], None, [None, "d", "e", "e", "f", "x", "y"], ["a", "b", "c"], ["x"]]
    rows = [(i // 2 if i else None, w, i) for i, w in enumerate(lists)] * 2
    df = spark.createDataFrame(rows, "id long, w array<string>, i long").coalesce(1)
    known = {w: w.upper() for w in "abcefg"}

    def values(other):
        return sorted([(i, None if w is None else [known.get(x) or other(x) for x in w]) for _, w, i in rows], key=repr)

    plain = vocabulary.look_up(df, F.col("w"), table, "token", "canonical", "out")
    assert plain.columns == ["id", "w", "i", "out"]
    assert sorted([(r.i, r.out) for r in plain.collect()], key=repr) == values(lambda x: None)
    found = vocabulary.canonical_tokens(df, "id", ["w"], table, keep=False)
    assert found.columns == ["id", "i", "w_canonical"]
    assert sorted([(r.i, r.w_canonical) for r in found.collect()], key=repr) == values(lambda x: x)


def test_lookups_shuffle_no_tokens(spark):
    """Rows are joined to their answers without the token arrays; only questions and answers carry strings."""
    table = spark.createDataFrame([("a", "A", 1)], "token string, canonical string, n long")
    df = spark.createDataFrame([(1, ["a", "b"], ["c"])], "id long, h array<string>, r array<string>")
    out = vocabulary.canonical_tokens(df, "id", ["h", "r"], table, keep=False)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    rows = [line for line in plan.splitlines() if "_place" in line and "Relation" in line]
    assert rows and all(not any(f"{c}#" in line.replace("_asked#", "").replace("_place#", "") for c in ("h", "r", "_lowered", "_known")) for line in rows)

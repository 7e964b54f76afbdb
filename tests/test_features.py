"""Stems, ROUGE-L, subword pieces, own metrics, order statistics over ranges, tables with manifests, failure texts."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from babelgauge.functions import stems, subwords
from babelgauge.operators import analysis, ordering
from babelgauge.operators.quality import Meteor, evaluate, metric, metrics, register_metric, unregister_metric
from babelgauge.session import work_path
from babelgauge.sources import logs, results
from babelgauge.sources.tables import Manifest, Table

# --- stems -------------------------------------------------------------------------------------------------------------

PUBLISHED = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled
motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss
fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc
digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam
predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal
sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical
electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop
adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt
homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler
probate probat rate rate cease ceas controll control roll roll is is as as be be""".split()


def test_published_stems():
    assert {w: stems.porter(w) for w in PUBLISHED[::2]} == dict(zip(PUBLISHED[::2], PUBLISHED[1::2]))


def test_meteor_with_stems(spark):
    """Stems match only what surface forms left free, in any case."""
    df = spark.createDataFrame([("the Ponies jumped", "The pony jumping")], "prediction string, reference string")
    plain, stemmed = (evaluate(df, [Meteor(stem=s)]).first()[0] for s in (False, True))
    assert plain == pytest.approx((1 - 0.5 * 1) * (1 / 3)) and stemmed == pytest.approx(1 - 0.5 * (1 / 3) ** 3)


# --- ROUGE-L -----------------------------------------------------------------------------------------------------------


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_rouge_l(spark):
    rng = np.random.default_rng(2)
    words = [" ".join(f"W{x}" for x in rng.integers(0, 12, int(n))) for n in rng.integers(0, 300, 40)]
    rows = [*zip(words[::2], words[1::2]), ("", "a"), ("", ""), (None, "a b"), ("x - y!", "x, y"), ("a " * 2000, "b a " * 1500)]
    df = spark.createDataFrame(rows, "prediction string, reference string").repartition(3)
    scores = []
    for h, r in rows:
        h, r = ([w for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()] for t in (h, r))
        common = longest_common(h, r)
        scores.append(2 * common / (len(h) + len(r)) if common else 0.0)
    assert evaluate(df, [metric("rouge")]).first()[0] == pytest.approx(np.mean(scores))


# --- subword pieces ----------------------------------------------------------------------------------------------------


def test_pieces_equal_the_published_encoder(spark):
    tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    judge = tiktoken.Encoding("judge", pat_str=r" ?\S+", mergeable_ranks=subwords.read_ranks(path), special_tokens={})
    texts = ["The quick brown fox", "Überraschung élève 漢字 🙂🙂", "", None, "x" * 3000, "aaaaaaaaab" * 40, "  spaced \t out\n", "a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(3)
    got = {r.id: r.p for r in df.select("id", subwords.subword_tokenizer(path)(F.col("text")).alias("p")).collect()}
    for i, text in enumerate(texts):
        want = [str(t) for word in (text or "").split() for t in judge.encode_ordinary(" " + word)]
        assert (got[i] or []) == want
    same = spark.createDataFrame([("the same words here", "the same words here")], "prediction string, reference string")
    assert evaluate(same, [metric("spBleu", tokenize=f"ranks:{path}")]).first()[0] == pytest.approx(100)


# --- own metrics -------------------------------------------------------------------------------------------------------


def lengths(predictions, references):
    return [(len(p), len(r)) for p, r in zip(predictions, references)]


def test_own_metric(spark):
    register_metric("length_ratio", ["hyp", "ref"], lengths, "{hyp} / nullif({ref}, 0D)", [("a", "bb"), ("ccc", "d"), ("", "")])
    try:
        df = spark.createDataFrame([("aa", "b", 1), ("c", "dddd", 1), (None, "xyz", 2)], "prediction string, reference string, g int")
        got = {r.g: r for r in evaluate(df, metrics(["length_ratio", "chrf"]), ["g"]).collect()}
        assert got[1].length_ratio == pytest.approx(3 / 5) and got[2].length_ratio == 0
        with pytest.raises(ValueError, match="already"):
            register_metric("length_ratio", ["hyp", "ref"], lengths, "{hyp}", [("a", "b"), ("c", "d")])
    finally:
        unregister_metric("length_ratio")
    with pytest.raises(ValueError):
        metric("length_ratio")
    with pytest.raises(ValueError):
        unregister_metric("chrf")


@pytest.mark.parametrize("row", [
    lambda p, r: [(len(p), 1)] * len(p),  # depends on the rows beside it
    lambda p, r: [(1, 1)],  # not one row each
    lambda p, r: [(float("nan"), 1)] * len(p)])
def test_own_metrics_that_do_not_add_up_are_refused(row):
    with pytest.raises(ValueError):
        register_metric("odd", ["a", "b"], row, "{a}", [("a", "b"), ("c", "d"), ("e", "f")])


# --- order statistics --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 10, 999, 5000])
def test_quartiles_at_any_size(spark, n):
    """Ties, a value that is a third of the rows, nulls, groups, a null group."""
    rng = np.random.default_rng(n)
    spread = np.where(rng.random(n) < 0.34, 7.0, np.round(rng.normal(5, 40, n), int(n % 3)))
    rows = [(float(v), int(i % 2) if i % 3 else None) for i, v in enumerate(spread)] + [(None, 1), (None, 5)]
    df = spark.createDataFrame(rows, "x double, g int").repartition(4)
    for r in analysis.describe(df, ["x"], ["g"]).collect():
        mine = np.array([v for v, g in rows if g == r["g"] and v is not None])
        if not len(mine):
            assert (r["g"], r["count"], r["q_50"]) == (5, 0, None)
            continue
        assert [r["q_25"], r["q_50"], r["q_75"]] == pytest.approx(list(np.quantile(mine, [0.25, 0.5, 0.75])))
        assert (r["count"], r["min"], r["max"]) == (len(mine), mine.min(), mine.max())
        assert r["std"] == (pytest.approx(mine.std(ddof=1)) if len(mine) > 1 else None)


def test_ranks_over_ranges(spark):
    """Running counts cross ranges and groups; no range bound is brought into the plan."""
    rng = np.random.default_rng(3)
    rows = [(g, float(v)) for g in ("a", None, "b") for v in rng.integers(0, 400, 900)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    found = ordering.cumulative_counts(df, ["x"], ["g"])
    assert "array(" not in found._jdf.queryExecution().optimizedPlan().toString()
    for r in found.collect():
        mine = [v for g, v in rows if g == r["g"]]
        assert (r["n"], r["cum"], r["total"]) == (mine.count(r["value"]), sum(v <= r["value"] for v in mine), len(mine))


# --- tables with manifests ---------------------------------------------------------------------------------------------


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "n long")


def test_readers_see_whole_versions(spark):
    table = Table(spark, work_path(spark, "table"))
    assert table.read("n long").collect() == []
    table.append(numbers(spark, 1, 2))
    made = table.write_data(numbers(spark, 3))  # data is there, its manifest is not
    assert sorted(r.n for r in table.read("n long").collect()) == [1, 2]
    now = table.manifest()
    table.commit(Manifest(now.number + 1, now.folders + made, now.batches))
    assert sorted(r.n for r in table.read("n long").collect()) == [1, 2, 3]
    with pytest.raises(RuntimeError):  # two writers made the same version
        table.commit(Manifest(now.number + 1, now.folders, now.batches))
    assert sorted(r.n for r in table.read("n long").collect()) == [1, 2, 3]


def test_a_batch_is_added_once(spark):
    table = Table(spark, work_path(spark, "table"))
    assert table.append(numbers(spark, 1), ("job", 0)) and table.append(numbers(spark, 2), ("job", 1))
    assert not table.append(numbers(spark, 2), ("job", 1)) and not table.append(numbers(spark, 1), ("job", 0))
    assert table.append(numbers(spark, 5), ("other", 0)) and table.append(numbers(spark, 9))
    assert sorted(r.n for r in table.read("n long").collect()) == [1, 2, 5, 9]


def test_old_versions_go(spark):
    path = work_path(spark, "table")
    table = Table(spark, path)
    for i in range(5):
        table.replace(numbers(spark, i))
    assert [r.n for r in table.read("n long").collect()] == [4]
    assert len(os.listdir(f"{path}/data")) == 2 and table.versions() == [4, 5]
    with open(f"{path}/manifests/v-5.json") as file:
        assert len(json.load(file)["folders"]) == 1


def test_parts_are_replaced(spark):
    path = work_path(spark, "log")
    schema = "call_seq long, layer_type string, latency_s double, run_id long"
    log = spark.createDataFrame([(i, "encoder", 0.5, r) for r in (1, 2, None) for i in range(3)], schema)
    logs.append_forward_log(log, path, ("job", 1))
    logs.append_forward_log(log, path, ("job", 1))
    logs.reset_forward_log(log.where("run_id = 2 AND call_seq = 0"), path)
    got = logs.read_forward_log(spark, path).groupBy("run_id").count().collect()
    assert {r.run_id: r["count"] for r in got} == {1: 3, 2: 1, None: 3}


def test_result_tables_read_one_part(spark):
    from babelgauge.schemas import run_schema

    path = work_path(spark, "results")
    names = ["facebook/nllb-200", "t5-base", "odd|name/with=signs %"]
    rows = spark.createDataFrame([(n, "wmt14") for n in names] * 2, "model_name string, dataset_name string")
    runs = spark.createDataFrame([], run_schema()).unionByName(rows, allowMissingColumns=True)
    results.write_results(runs, path)
    assert results.read_result_table(spark, path).count() == 6
    one = results.read_result_table(spark, path, "wmt14", "odd|name/with=signs %")
    assert one.count() == 2 and len(one.inputFiles()) < len(results.read_result_table(spark, path).inputFiles())


def test_work_folder_is_empty_after_a_scope(spark):
    from babelgauge.catalog import queries
    from babelgauge.session import shared_folder, work_scope

    before = set(os.listdir(shared_folder(spark)))
    with work_scope(spark):
        assert queries()["e7_describe_runs"](spark, "/root/testdata/sf0.001").count() > 0
        assert set(os.listdir(shared_folder(spark))) > before
    assert set(os.listdir(shared_folder(spark))) == before


def test_large_files_are_read_in_parts(spark, tmp_path):
    """Rows of later parts of a file get the header that another task reads."""
    for i in range(3):
        columns = ["chrf", "model_name", "beam_size"][:: 1 if i else -1]
        body = "\n".join(",".join({"chrf": f"{k}.5", "model_name": f'"m, {i}"', "beam_size": str(k)}[c] for c in columns) for k in range(400))
        (tmp_path / f"{i}_metrics.csv").write_text(",".join(columns) + "\n" + body + "\n\n")
    (tmp_path / "other.txt").write_text("x,y\n1,2\n")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "1500")
    try:
        got = results.read_result_folder(spark, str(tmp_path)).groupBy("model_name").agg(F.count("*").alias("n"), F.sum("beam_size").alias("b"), F.sum("chrf").alias("c")).collect()
    finally:
        spark.conf.set(key, before)
    assert {tuple(r) for r in got} == {(f"m, {i}", 400, 79800, 80000.0) for i in range(3)}


# --- failure texts -----------------------------------------------------------------------------------------------------


def test_messages_cannot_be_taken_for_the_log(spark):
    path = work_path(spark, "texts")
    messages = ["first\n********** stars\nlast", "a\nERROR: Exception occured during runtime!\nHyperparameters: model_name: zz, Batch_size: 1", "", None,
                '{"message": 1}', "End of traceback message\n**********", "WARNING! Hyperparameters: model_name: no", "plain \n text"]
    rows = [("t5-base", i, "all", 128, 4, 15, "do_not_pad", "wmt14", m) for i, m in enumerate(messages)]
    df = spark.createDataFrame(rows, "model_name string, batch_size long, dataset_size string, max_gen_length long, beam_size long, "
                                     "max_input_seq_length long, tokenizer_padding_setting string, dataset_name string, message string")
    logs.write_failure_texts(df, path)
    logs.write_warning_texts(df.limit(2), path)
    back = logs.read_failure_texts(spark, path).collect()
    assert sorted((r.batch_size, r.message or "") for r in back if r.kind == "error") == [(i, m or "") for i, m in enumerate(messages)]
    assert sum(r.kind == "warning" for r in back) == 2 and {r.model_name for r in back} == {"t5-base"}


def test_failure_texts_search_a_record_once(spark, monkeypatch):
    """Many warnings between two record lines: the record is searched below the explode, and files of warnings are short."""
    monkeypatch.setattr(logs, "WARNINGS", 100)
    path = work_path(spark, "many-warnings")
    df = spark.range(350).selectExpr("concat('m', id) AS model_name", "id AS batch_size", "'all' AS dataset_size", "1L AS max_gen_length",
                                     "2L AS beam_size", "-1L AS max_input_seq_length", "'x, y' AS tokenizer_padding_setting", "'d' AS dataset_name",
                                     "CASE WHEN id % 2 = 0 THEN 'why' END AS message").coalesce(1)
    logs.write_failure_texts(df.limit(5), path)
    logs.write_warning_texts(df, path)
    assert spark.read.option("lineSep", logs.RECORD + "\n").text(path).where(F.col("value").startswith("WARNING")).count() == 4
    back = logs.read_failure_texts(spark, path)
    assert sorted((r.kind, r.model_name, r.message) for r in back.collect()) == sorted(
        [("warning", f"m{i}", None) for i in range(350)] + [("error", f"m{i}", None if i % 2 else "why") for i in range(5)])
    above = back._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    assert "(?s)" not in above, "the search for the traceback runs for every line"


def test_result_lines_are_parsed_as_columns():
    """Whole batches of lines give what the CSV reader gives line by line, quotes, blanks and short lines included."""
    import pyarrow as pa

    lines = ["a,b,c", ' a , "b, c" ,d', "a", "", ",,", "a,,c,d", '"x ""y""",z', " a\t,　,b ", '"",b', "a,'b',c", 'a"b,c,d"e']
    lines = lines * 3 + ["plain,line,only"]
    for places in ([0, 1, 2], [2, -1, 0], [3]):
        want = [results._picked(line, places) for line in lines]
        got = results._columns(pa.array(["skipped", *lines]).slice(1), places)
        assert [list(row) for row in zip(*(column.to_pylist() for column in got))] == want
    names = ["a", "b"]
    batch = pa.RecordBatch.from_pydict({"value": ["b,a", "1,2", " ", '"3",4', "5,6", "a", "7"], "file": ["f"] * 4 + ["g"] + ["h"] * 2, "start": [0] * 4 + [9] + [0] * 2})
    out = [tuple(row.values()) for found in results._parsed(names)(iter([batch.slice(0, 3), batch.slice(3)])) for row in found.to_pylist()]
    assert out == [("f", "b,a", None, None, None), ("f", None, None, "2", "1"), ("f", None, None, "4", "3"), ("g", None, "5,6", None, None),
                   ("h", "a", None, None, None), ("h", None, None, "7", None)]

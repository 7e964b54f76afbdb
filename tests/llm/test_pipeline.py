"""The stages of the pipeline, each on the output of the one before; and the registered queries with SQL."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from babelgauge.llm import catalog
from tests.compare import ROOT, check, database

FOLDER = f"{ROOT}/sf0.001"


@pytest.mark.parametrize("key", catalog.queries())
def test_queries(spark, key):
    sql = catalog.oracle_sql().get(key)
    problem, _, _, n = check(spark, database(FOLDER), FOLDER, key, catalog.queries()[key], sql)
    assert problem is None and n > 0


@pytest.mark.parametrize("which", ["given", "odd", "empty"])
def test_stages(spark, docs, nothing, tmp_path, which):
    frame = {"given": spark.read.parquet(f"{FOLDER}/documents.parquet"), "odd": docs, "empty": nothing}[which]
    counts = [frame.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = frame
        stage(spark, frame, FOLDER).write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        counts.append(frame.count())
        if name != "packing":
            assert frame.columns == before.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "mixing", "packing"]
    assert counts[1] <= counts[0] and counts[2] == counts[1] and counts[3] <= counts[2]
    if which == "given":
        assert counts[1] == counts[0] and counts[3] > 0.8 * counts[2]  # clean documents stay
        ids = Counter(r.doc_id for r in before.select("doc_id").collect())
        assert max(ids.values()) <= 2
        words = frame.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
        assert all(r.n == ids[r.doc_id] * r.t for r in words)


def test_stages_against_brute_force(spark, docs, rows, tmp_path):
    """Language, lines and near-duplicates decide row by row as their plain versions do, each on what the last one kept;
    mixing takes whole copies near the targets, and packing loses no id of them."""
    from babelgauge.llm.kernel_language import UNKNOWN, fit, identify
    from tests.llm.test_documents import LAST, expected_groups, expected_lines, fingerprint

    folder = tmp_path / "in"
    docs.write.parquet(str(folder / "documents.parquet"))
    kept, frame = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, frame, str(folder)).write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        kept[name] = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in frame.collect()]
    told = identify(docs, fit(docs, F.lit(True)))  # row by row as the plain kernels of test_documents
    stays = Counter((r.doc_id, r.score) for r in told.collect() if r.lang_pred != UNKNOWN and r.score >= 0.05)
    assert Counter(d for d, *_ in kept["language"]) == Counter(d for d, _ in stays.elements())
    assert Counter(kept["language"]) <= Counter((d, t, lang, s, None if t is None else len(t)) for d, t, lang, s in rows)

    lined = expected_lines([r[:4] for r in kept["language"]], min_docs=2, support=3)
    assert Counter((r[0], r[1], r[4]) for r in kept["lines"]) == Counter((d, t, len(t)) for d, t, *_ in lined)

    prints = [fingerprint(t, 3) for _, t, *_ in kept["lines"]]
    group = expected_groups(set(prints), 3)
    best = {}
    for r, p in zip(kept["lines"], prints):
        name = min(group[p])
        best[name] = min(best.get(name, LAST), LAST if r[0] is None else r[0])
    assert Counter(LAST if r[0] is None else r[0] for r in kept["near_duplicates"]) == Counter(best.values())
    assert set(kept["near_duplicates"]) <= set(kept["lines"])

    times = Counter(kept["mixing"])
    assert set(times) <= set(kept["near_duplicates"]) and max(times.values()) <= 2
    packed = corpus_pipeline.run(spark, str(folder))
    pieces = packed.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n"), F.count_if(F.col("start") == 0).alias("copies")).collect()
    copies = Counter()
    for r in pieces:  # two texts may have one id
        copies[r.doc_id] += r.copies
        assert r.n == r.copies * r.doc_tokens
    assert copies == Counter(r[0] for r in kept["mixing"])  # reruns agree
    full = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r.n == r.end <= 2048 for r in full)

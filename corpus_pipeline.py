"""The corpus pipeline: five stages over ``documents``, each written and read again before the next.

Each stage takes (spark, docs, sf_dir), works on all documents its predecessor kept and returns the columns of
``documents``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from babelgauge.llm.catalog import tokenizer_path
from babelgauge.llm.kernel_language import fit, keep_identified
from babelgauge.llm.kk_packing import pack_documents
from babelgauge.llm.line_templates import drop_recurring_lines
from babelgauge.llm.pigeonring_simhash import keep_one_of_each
from babelgauge.llm.pivotal_mix import take_mix
from babelgauge.session import work_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told. Those without a letter, without text, or unlike any language go.

    Null ids, languages and sources stay as they are, and so do repeated rows and texts of any length (judged whole). If no
    document has a language, nothing is unlike: every text with a letter stays.
    """
    return keep_identified(docs, fit(docs, F.lit(True)), least=0.05)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines whose template recurs; ``n_chars`` is that of the text left (null for a null text).

    A line stays in the smallest ``doc_id`` that holds it (null counts as the largest; rows with equal ids keep theirs).
    Empty texts stay empty, and a text may lose all its lines. Repeated rows are treated alike.
    """
    return drop_recurring_lines(docs, min_docs=2, support=3, similarity=0.8).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest ``doc_id``, null last.

    Null, empty and blank texts have the same fingerprint and are one group; of repeated rows one stays.
    """
    return keep_one_of_each(docs, shingle=3, distance=3)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, each at most twice.

    The null source is one of its own, the last. Null and empty texts have no words and add none to their source. Repeated
    rows are drawn one by one. Reruns take the same rows.
    """
    return take_mix(docs, weights=(3, 1, 2), share=1.5, most=2.0)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids in sequences of at most 2048, every copy of a document with its end id.

    A null or empty text is its end id alone; texts of any length are cut freely, and no id is lost.
    """
    return pack_documents(docs, tokenizer_path(), capacity=2048, end_id=1)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]
ORACLE_SQL = None  # model fitting, XXH64, random rounding and tokenizing are not SQL; the tests compare the stages with plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        out = work_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return STAGES[-1][1](spark, docs, sf_dir)

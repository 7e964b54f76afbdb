"""Parallel and monolingual corpora. Rows carry an explicit position, because Spark tables have no order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from babelgauge.functions.models import DATASET_ALIASES, SPLIT_SIZES
from babelgauge.functions.text import word_count

KNOWN = {"wmt14", "flores200", "opus_books"}


def check_name(name: str) -> str:
    """The canonical name of a known corpus."""
    name = DATASET_ALIASES.get(name, name)
    if name not in KNOWN:
        raise ValueError(f"unknown corpus {name!r}; known: {sorted(KNOWN)}")
    return name


def parallel(df: DataFrame, key: str = "id") -> DataFrame:
    """Flat ``key, en, fr`` as ``id, translation<en, fr>``."""
    return df.select(F.col(key).cast("long").alias("id"), F.struct("en", "fr").alias("translation"))


def flat(corpus: DataFrame) -> DataFrame:
    """``id, en, fr`` of a nested corpus; reads only the nested fields that are used."""
    return corpus.select("id", "translation.en", "translation.fr")


def load_corpus(spark: SparkSession, path: str, name: str, size: int | None = None) -> DataFrame:
    """A parallel corpus stored as Parquet ``id, en, fr``; at most ``size`` sentences, all by default."""
    corpus = parallel(spark.read.parquet(path))
    check_name(name)
    return corpus if size is None else first_sentences(corpus, size)


def first_sentences(corpus: DataFrame, size: int, key: str = "id") -> DataFrame:
    """The first sentences by key: a per-task top-n and one merge, never a full sort."""
    return corpus.orderBy(key).limit(size)


def granted_sizes(corpus: DataFrame, requested: list[int | str]) -> DataFrame:
    """``requested, granted, clamped`` for wanted corpus sizes; ``"all"`` asks for everything.

    A request beyond the corpus is clamped and flagged (rather than only warned about). Anything but ``"all"`` and
    whole numbers from 0 on is an error.
    """
    sizes = [None if r == "all" else int(r) if isinstance(r, str) else r for r in requested]
    if any(size is not None and (not isinstance(size, int) or size < 0) for size in sizes):
        raise ValueError(f"corpus sizes are whole numbers or 'all': {requested}")
    total = corpus.agg(F.count("*").alias("n"))
    wanted = [F.struct(F.lit(str(r)).alias("requested"), F.lit(size).cast("decimal(38,0)").alias("size"))
              for r, size in zip(requested, sizes)]
    return total.select("n", F.explode(F.array(*wanted)).alias("w")).select(
        "w.requested", F.least(F.coalesce("w.size", "n"), "n").cast("long").alias("granted"),
        F.coalesce(F.col("w.size") > F.col("n"), F.lit(False)).alias("clamped"))


def split_size(name: str, requested: int | str) -> tuple[int, bool]:
    """Sentences a request gets from an evaluation split of known size, and whether it was clamped."""
    limit = SPLIT_SIZES[check_name(name)]
    if requested == "all":
        return limit, False
    return min(int(requested), limit), int(requested) > limit


def zip_monolingual(en: DataFrame, fr: DataFrame, key: str = "idx", text: str = "sentence") -> DataFrame:
    """Two corpora aligned by position, as one parallel corpus. A position that one side lacks has a null there."""
    left = en.select(F.col(key).alias("id"), F.col(text).alias("en"))
    right = fr.select(F.col(key).alias("id"), F.col(text).alias("fr"))
    return parallel(left.join(right, "id", "full"))


def with_word_counts(table: DataFrame) -> DataFrame:
    return table.withColumn("word_count_en", word_count(F.col("en"))) \
        .withColumn("word_count_fr", word_count(F.col("fr")))


def within_length(text: Column, limit: int | None) -> Column:
    """Whether a text has at most ``limit`` words; -1 or none keeps all."""
    return F.lit(True) if limit is None or limit == -1 else word_count(text) <= limit


def train_test(df: DataFrame, key: str = "id", test_share: int = 20) -> DataFrame:
    """Add ``part``: a repeatable random split by the digest of the key, independent of row order."""
    draw = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 7), 16, 10).cast("long") % 100
    return df.withColumn("part", F.when(draw < test_share, "test").otherwise("train"))

"""Language identification with string kernels.

Two texts are as alike as the byte n-grams (1 to 3 bytes, blended) that both contain: the presence kernel, normalised by
the square roots of their own counts. The Nystroem method maps a text to its kernel values with a bounded number of
landmark texts, whitened by the landmarks' own kernel matrix, and one-versus-rest kernel ridge regression learns a score
for each language there. As all steps after presence are linear, landmarks and weights fold into one matrix, and a batch
of documents is scored by one matrix product.

The model is fitted on a bounded sample (``Settings``: so many training documents of each language, of long ones so many
characters); all documents are then scored in one pass over their whole texts, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from babelgauge.llm.blocks import text_bytes
from babelgauge.llm.work import give_back, settle, share_package, tidy

UNKNOWN = "und"
_SECOND, _THIRD = 1 << 8, (1 << 8) + (1 << 16)
_CODES = _THIRD + (1 << 24)
ROWS = 256  # documents scored together
PIECE = 1 << 20  # bytes of a text looked up together


@dataclass(frozen=True)
class Settings:
    per_language: int = 256  # training documents of each language
    landmarks: int = 48  # of these, landmarks
    longest: int = 20_000  # characters of a training document
    most_texts: int = 8192  # training documents of all languages
    most_landmarks: int = 768
    ridge: float = 1e-2


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    grams: bytes  # sorted codes of all n-grams of the landmarks, 32-bit
    weights: np.ndarray  # n-grams x languages


def gram_codes(data: np.ndarray) -> Iterator[np.ndarray]:
    """Codes of all n-grams of a text, in pieces of bounded size."""
    for at in range(0, len(data), PIECE):
        d = data[at : at + PIECE + 2].astype(np.int32)
        yield d[:PIECE]
        yield ((d[:-1] << 8) | d[1:])[:PIECE] + _SECOND
        yield ((d[:-2] << 16) | (d[1:-1] << 8) | d[2:])[:PIECE] + _THIRD


@lru_cache(maxsize=1)
def column_of(grams: bytes) -> np.ndarray:
    """The column of every code; codes without one share the last column."""
    codes = np.frombuffer(grams, np.int32)
    table = np.full(_CODES, len(codes), np.int32)
    table[codes] = np.arange(len(codes), dtype=np.int32)
    return table


def presence(texts: list[np.ndarray], grams: bytes) -> np.ndarray:
    """Which n-grams of the vocabulary each text contains, rows scaled to unit length."""
    table, n = column_of(grams), len(grams) // 4
    out = np.zeros((len(texts), n + 1), np.float32)
    for row, data in zip(out, texts):
        for codes in gram_codes(data):
            row[table[codes]] = 1
    out = out[:, :n]
    norm = np.sqrt(out.sum(axis=1, keepdims=True))
    return out / np.maximum(norm, 1)


def sample(docs: DataFrame, trains: Column, settings: Settings) -> list[Row]:
    """The rows that the model is fitted on: ``lang, rank, text``, ranked from 1 within each language.

    Of each language the distinct (``doc_id``, text) with the smallest hashes, those no longer than ``longest`` first; a
    longer text is cut to that, for the fit only. Only hashes small enough to hold four times the sample (by an estimate of
    how many there are) are ranked, so no task ranks a language.
    """
    usable = trains & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    told = docs.where(usable).select(F.col("lang").cast("string").alias("lang"), F.xxhash64(F.lit(9), F.col("doc_id"), F.col("text")).alias("draw"), F.col("text").cast("string").alias("text"))
    long = F.length("text") > settings.longest
    narrow = told.select("lang", "draw", long.alias("long"))
    many = narrow.groupBy("lang", "long").agg(F.approx_count_distinct("draw").alias("n"))  # two rows a language
    share = F.shiftrightunsigned("draw", 11) / F.lit(float(1 << 53))
    small = narrow.join(many, ["lang", "long"]).where(share * F.col("n") < 4.0 * settings.per_language + 64)
    drawn = small.groupBy("lang", "draw").agg(F.min("long").alias("long"))
    place = Window.partitionBy("lang").orderBy("long", "draw")
    chosen = settle(drawn.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= settings.per_language).select("lang", "draw", "rank"), "drawn")
    languages = chosen.select("lang").distinct().count()
    each = max(2, min(settings.per_language, settings.most_texts // max(languages, 1)))
    few = chosen.where(F.col("rank") <= each)  # at most most_texts rows
    start = F.regexp_extract("text", r"(?s)^.*?(\p{L}.*)$", 1)  # a cut text keeps its letters
    cut = F.when(long, F.substring(start, 1, settings.longest)).otherwise(F.col("text"))
    picked = told.join(F.broadcast(few), ["lang", "draw"]).groupBy("lang", "rank").agg(F.min(cut).alias("text"))
    return picked.orderBy("lang", "rank").collect()


def fit(docs: DataFrame, trains: Column, settings: Settings = Settings()) -> Model:
    """A model from ``text`` and ``lang`` of the documents for which ``trains`` holds.

    The sample does not depend on the table's order. Every language that has a text with a letter is learned, whatever its
    texts' lengths and however often their ids repeat or are null. To the driver: at most ``most_texts`` texts of at most
    ``longest`` characters (two for each language, if there are more languages), of which ``most_landmarks`` are landmarks.
    """
    rows = sample(docs, trains, settings)
    if not rows:
        return Model((), b"", np.zeros((0, 0)))
    languages = tuple(sorted({r["lang"] for r in rows}))
    texts = [np.frombuffer(r["text"].encode(), np.uint8) for r in rows]
    marked = max(1, min(settings.landmarks, settings.most_landmarks // len(languages)))
    marks = [t for t, r in zip(texts, rows) if r["rank"] <= marked]
    seen = np.zeros(_CODES, bool)
    for text in marks:
        for codes in gram_codes(text):
            seen[codes] = True
    grams = np.flatnonzero(seen).astype(np.int32).tobytes()
    landmark = presence(marks, grams)
    values, vectors = np.linalg.eigh((landmark @ landmark.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    mapped = np.concatenate([presence(texts[i : i + ROWS], grams) @ landmark.T for i in range(0, len(texts), ROWS)]).astype(np.float64) @ whiten
    target = np.array([[r["lang"] == name for name in languages] for r in rows], np.float64)
    share = target.mean(axis=0)
    ridge = settings.ridge * len(texts) * np.eye(mapped.shape[1])
    weight = np.sqrt(1 / (len(languages) * share))[target.argmax(axis=1)][:, None]  # languages count alike
    beta = np.linalg.solve((mapped * weight).T @ (mapped * weight) + ridge, (mapped * weight).T @ (target * weight))
    return Model(languages, grams, (landmark.T @ (whiten @ beta)).astype(np.float32))


def predict(column: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    """The language of every text and its score, clipped to 0 to 1. Null texts and texts without a letter (Unicode class L):
    ``und``, 0."""
    data, offsets = text_bytes(column)
    names, scores = [UNKNOWN] * len(column), np.zeros(len(column))
    texts = [data[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
    known = [i for i, t in enumerate(texts) if len(t) and model.languages and any(map(str.isalpha, t.tobytes().decode()))]
    for at in range(0, len(known), ROWS):
        rows = known[at : at + ROWS]
        score = presence([texts[i] for i in rows], model.grams) @ model.weights
        best = score.argmax(axis=1)
        for i, b, s in zip(rows, best, score[np.arange(len(rows)), best]):
            names[i], scores[i] = model.languages[b], min(max(float(s), 0.0), 1.0)
    return names, scores


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` of every document.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored, ``lang`` and ``source`` among them. Predictions
    are languages of the model, ``und`` (score 0) for null texts, texts without a letter, and if nothing was learnt.
    Repeated rows and null ``doc_id`` come back as they are; an empty table gives no rows.
    """

    share_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = predict(batch.column(1), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])
        column_of.cache_clear()  # workers go on to other tasks

    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return told.mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.05) -> DataFrame:
    """The documents, all columns, whose language is told with at least this score. ``und`` goes.

    Null texts and texts without a letter go; so do texts unlike every language. With a model that learnt no language (no
    labels) nothing is unlike: every text with a letter stays. Repeated rows, null ``doc_id`` and other columns stay as
    they are; only the texts go through Python.
    """
    share_package(docs.sparkSession)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))

    def stays(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for column in texts:
                names, scores = predict(column, model)
                yield pa.array((np.array(names, object) != UNKNOWN) & (scores >= least), pa.bool_())
        finally:
            column_of.cache_clear()  # workers go on to other tasks
            give_back()

    judged = F.arrow_udf(stays, "boolean")
    return docs.where(judged(F.col("text").cast("string")))

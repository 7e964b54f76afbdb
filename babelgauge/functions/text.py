"""Text expressions: strip, word counts and the tokenisers, all as column expressions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F

# The characters that count as white space in result files written by Python tools.
SPACE_POINTS = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACE_CHARACTERS = "".join(map(chr, SPACE_POINTS))
# The same set as a regex class. Latin characters are listed one by one (a bit set in the matcher, where ranges
# would be a chain of comparisons) and the rare ones sit behind one range test: this halves tokenising time.
SPACE = (r"[ \t\n\x0B\f\r\x1C\x1D\x1E\x1F\x85\xA0"
         r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]]")
# ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Mteval 13a rules, in order (BLEU needs exactly these).
CLEAN_13A = [
    ("<skipped>", ""),
    ("-\n", ""),
    ("\n", " "),
    ("&quot;", '"'),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
]
SPLIT_13A = [
    (r"([!\"#$%&()*+/:;<=>?@\[\\\]^_`{|}~])", r" $1 "),
    (r"([^0123456789])([.,])", r"$1 $2 "),
    (r"([.,])([^0123456789])", r" $1 $2"),
    (r"([0123456789])(-)", r"$1 $2 "),
]


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of any kind (``trim`` removes spaces only)."""
    return F.btrim(text, F.lit(SPACE_CHARACTERS))


def as_references(label: Column) -> Column:
    """A label as the one-element reference list that metrics expect."""
    return F.array(strip(label))


def word_count(text: Column) -> Column:
    """Pieces between single spaces; empty pieces count, and a null is the four-letter text ``None``."""
    return F.size(F.split(F.coalesce(text, F.lit("None")), " ", -1)).cast("long")


def pieces(text: Column) -> Column:
    """Split on runs of white space, without empty pieces."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda piece: piece != "")


def tokens_13a(text: Column) -> Column:
    text = F.rtrim(text, F.lit(SPACE_CHARACTERS))
    for old, new in CLEAN_13A:
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.concat(F.lit(" "), text, F.lit(" "))
    for pattern, replacement in SPLIT_13A:
        text = F.regexp_replace(text, pattern, replacement)
    return pieces(text)


def text_length(text: Column, cut: int | None = None) -> Column:
    """Number of 13a tokens, at most ``cut`` if that is given."""
    length = F.size(tokens_13a(text)).cast("long")
    return length if cut is None else F.least(length, F.lit(cut).cast("long"))


def characters(text: Column) -> Column:
    """Single characters, without white space."""
    return F.filter(F.split(F.regexp_replace(text, SPACE, ""), ""), lambda c: c != "")


def chrf_words(text: Column) -> Column:
    """Words with one trailing, else one leading, punctuation mark split off. Case is kept."""
    marks = F.lit(PUNCTUATION)

    def split_off(word: Column) -> Column:
        first, last, size = F.substr(word, F.lit(1), F.lit(1)), F.right(word, F.lit(1)), F.length(word)
        return F.when(size == 1, F.array(word)) \
            .when(F.contains(marks, last), F.array(F.substr(word, F.lit(1), size - 1), last)) \
            .when(F.contains(marks, first), F.array(first, F.substr(word, F.lit(2)))) \
            .otherwise(F.array(word))

    return F.flatten(F.transform(pieces(text), split_off))


def rouge_words(text: Column) -> Column:
    """Runs of letters a-z and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def sentencepiece_tokenizer(model_path: str) -> Callable[[Column], Column]:
    """A tokeniser backed by a SentencePiece model that every executor can read.

    Ship the model with ``spark.sparkContext.addFile(path)`` and pass its base name, or give a shared path.
    """
    @F.pandas_udf("array<string>")
    def encode(texts: pd.Series) -> pd.Series:
        import os

        import sentencepiece
        from pyspark import SparkFiles

        path = model_path if os.path.exists(model_path) else SparkFiles.get(model_path)
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return pd.Series(model.encode(texts.fillna("").tolist(), out_type=str))

    return encode


TOKENIZERS: dict[str, Callable[[Column], Column]] = {
    "none": pieces,
    "13a": tokens_13a,
    "char": characters,
}


def tokenizer(name: str | Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Look a tokeniser up by name; ``ranks:<path>`` cuts words by a file of byte-pair ranks, ``spm:<path>`` loads a
    SentencePiece model; a function is used as it is."""
    if callable(name):
        return name
    if name.startswith("ranks:"):
        from babelgauge.functions.subwords import subword_tokenizer

        return subword_tokenizer(name[6:])
    if name.startswith("spm:"):
        return sentencepiece_tokenizer(name[4:])
    if name not in TOKENIZERS:
        raise ValueError(f"unknown tokenizer {name!r}; known: {sorted(TOKENIZERS)}, ranks:<path> or spm:<path>")
    return TOKENIZERS[name]

"""Byte-pair pieces from a published rank file, for the dictionary of a batch: a word is cut once, however often it occurs."""

from __future__ import annotations

import base64
import heapq
import sys
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

from babelgauge.functions.text import pieces

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def load_ranks(path: str) -> dict[bytes, int]:
    """Pieces and their ranks from lines of base64 and number."""
    import os

    from pyspark import SparkFiles

    with open(path if os.path.exists(path) else SparkFiles.get(path), "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}


@lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    """The same, read once per worker."""
    return load_ranks(path)


SHORT = 48  # bytes


def cut(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word's pieces: of all neighbours the pair with the lowest rank is joined, the leftmost first."""
    return _cut_short(word, ranks) if len(word) <= SHORT else _cut_long(word, ranks)


def _cut_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Few pieces are looked through for every join, which is quicker than to keep them in order."""
    none = 1 << 62
    parts = [word[i:i + 1] for i in range(len(word))]
    joins = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while joins and (least := min(joins)) < none:
        i = joins.index(least)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del joins[i]
        if i:
            joins[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        if i < len(joins):
            joins[i] = ranks.get(parts[i] + parts[i + 1], none)
    return [ranks[part] for part in parts]


def _cut_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Neighbours wait in a heap and know each other by links, so a long word takes n log n steps."""
    ends = list(range(1, len(word) + 1))  # of the piece that begins here; 0 for a piece that was joined
    left = list(range(-1, len(word) - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(at: int) -> None:
        if at >= 0 and ends[at] < len(word):
            stop = ends[ends[at]]
            rank = ranks.get(word[at:stop])
            if rank is not None:
                heapq.heappush(heap, (rank, at, stop))

    for i in range(len(word) - 1):
        offer(i)
    while heap:
        _, at, stop = heapq.heappop(heap)
        middle = ends[at]
        if not middle or middle >= len(word) or ends[middle] != stop:
            continue  # one of the two has been joined meanwhile
        ends[at], ends[middle] = stop, 0
        if stop < len(word):
            left[stop] = at
        offer(at)
        offer(left[at])
    out, at = [], 0
    while at < len(word):
        out.append(ranks[word[at:ends[at]]])
        at = ends[at]
    return out


def subword_tokenizer(path: str) -> Callable[[Column], Column]:
    """A tokeniser over a rank file (base64 of the piece, blank, rank; every byte is a piece) that executors can read.

    Words are runs between white space, each with the blank before it as byte-level vocabularies expect; its tokens are
    the ids as text. Ship the file with ``spark.sparkContext.addFile(path)`` and pass its base name, or give a shared path.
    """

    @F.arrow_udf("array<string>")
    def subwords(words: pa.Array) -> pa.Array:
        ranks = read_ranks(path)
        encoded = words.flatten().dictionary_encode()
        found = [cut(b" " + word.encode(), ranks) for word in encoded.dictionary.to_pylist()]
        sizes = np.array([len(f) for f in found], np.int64)
        ids = np.array([i for f in found for i in f], np.int64)
        codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        each = sizes[codes]
        place = np.cumsum(each) - each
        flat = ids[np.arange(each.sum()) - np.repeat(place - starts[codes], each)] if len(codes) else ids
        word_ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy().astype(np.int64)))
        offsets = np.append(0, np.cumsum(each))[word_ends]
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat).cast(pa.string()))

    return lambda text: subwords(pieces(text))

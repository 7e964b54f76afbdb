"""Substring deduplication by level-wise doubling of repeated word windows.

Windows of a short length are tested for repetition over the whole corpus; only where they repeat are windows of twice
the length tested, up to the asked length, or until no candidate survives. The first level keeps one window of every
run of neighbours (the one with the smallest hash), which equal passages choose alike, so a quarter of all positions
is enough to find every repeat of the next level.

Levels run over blocks (see ``blocks``): each block asks once for each distinct window, so a passage that many
documents share costs one entry per block, and no list of its holders is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from babelgauge.llm import blocks as B
from babelgauge.llm.work import settle

KEPT_SCHEMA = "doc_id long, n_words long, n_removed long, kept string"
_CHECK_BASE = 0xD1342543DE82EF95


def ladder(window: int, seed: int) -> list[int]:
    """Window lengths, each at most twice the one before, up to ``window``."""
    if window < 2:
        raise ValueError("window must be at least 2 words")
    seed = max(min(seed, window - 1), 1)
    lengths = [seed]
    while lengths[-1] < window:
        lengths.append(min(2 * lengths[-1], window))
    return lengths


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:]) if len(values) > reach else values[:0]
        reach *= 2
    rest = width - reach
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest and len(values) > rest else values[:0] if rest else values


class Passage:
    """The words of one block, its documents in ascending order of their identifiers."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        ids, _ = B.signed(batch.column(0))
        self.order = np.argsort(ids, kind="stable")
        self.batch = batch.take(pa.array(self.order))
        self.ids = ids[self.order]
        self.data, self.offsets = B.text_bytes(self.batch.column(1))
        self.starts, self.ends, self.at = B.word_spans(self.data, self.offsets)
        self.words = B.word_hashes(self.data, self.starts, self.ends)
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(self.at))

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows, and which of them lie in one document."""
        hashes = B.window_hashes(self.words, length)
        return hashes, B.inside(self.at, length, len(hashes))

    def owners(self, positions: np.ndarray) -> np.ndarray:
        return self.ids[self.doc[positions]]


def known(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    at = np.searchsorted(sorted_set, values)
    at[at == len(sorted_set)] = 0
    return sorted_set[at] == values


def grouped(hashes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, the position of each in its smallest owner, smallest and largest owner (owners ascend)."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(ranked)) - 1 if len(first) else first
    return ranked[first], order[first], owners[order[first]], owners[order[last]]


def gathered(replies: list[dict[str, np.ndarray]]) -> np.ndarray:
    return np.sort(np.concatenate([r["key"] for r in replies])) if replies else np.zeros(0, np.uint64)


def repeats_of(bucket: int, asked: list[int], arrays: list[dict[str, np.ndarray]]) -> Iterator[tuple[int, bytes]]:
    """For each block the keys that another document holds too."""
    keys = np.concatenate([a["key"] for a in arrays])
    many = np.concatenate([a["many"] for a in arrays])
    values, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    again = counts > 1
    again[inverse[many]] = True
    for block, a in zip(asked, arrays):
        found = a["key"][again[np.searchsorted(values, a["key"])]]
        if len(found):
            yield block, B.pack_arrays(key=found)


def later_holders(bucket: int, asked: list[int], arrays: list[dict[str, np.ndarray]]) -> Iterator[tuple[int, bytes]]:
    """For each block the keys that a smaller document of another block holds."""
    keys = np.concatenate([a["key"] for a in arrays])
    check = np.concatenate([a["check"] for a in arrays])
    owner = np.concatenate([a["owner"] for a in arrays])
    order = np.lexsort((owner, check, keys))
    k, c, o = keys[order], check[order], owner[order]
    first = np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1]))
    smallest = o[np.flatnonzero(first)][np.cumsum(first) - 1]
    loses = np.zeros(len(keys), bool)
    loses[order[o > smallest]] = True
    at = 0
    for block, a in zip(asked, arrays):
        mine = loses[at : at + len(a["key"])]
        at += len(mine)
        if mine.any():
            yield block, B.pack_arrays(key=a["key"][mine])


def remove_repeats(docs: DataFrame, window: int = 13, seed: int = 7, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """Every document without the words that a document with a smaller ``doc_id`` has in a window of its own.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Words are runs of bytes other than ASCII white
    space. A word goes if a window of ``window`` consecutive words that covers it also starts in a document with a
    smaller ``doc_id``; all windows are judged on the input. Returns ``doc_id, n_words, n_removed, kept`` (the words
    left, joined by single spaces), one row per input row.

    A null text has no words. A null ``doc_id`` counts as larger than any other; rows with equal ``doc_id`` (or null)
    do not remove each other's words. Documents shorter than a window stay whole. An empty table gives no rows.
    Windows are compared by 96 hash bits.
    """
    lengths = ladder(window, seed)
    blocks = B.as_blocks(docs, "doc_id", "text", block_bytes=block_bytes)
    buckets = B.bucket_count(blocks)
    width = lengths[1] - lengths[0] + 1

    def first_seeds(p: Passage) -> tuple[np.ndarray, np.ndarray]:
        """Of every window of the second level, the smallest seed; and which of these windows lie in one document."""
        smallest = sliding_min(p.windows(lengths[0])[0], width)
        return smallest, B.inside(p.at, lengths[1], len(smallest))

    def write_seeds(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
        p = Passage(batch)
        seeds, ok = first_seeds(p)
        new = ok.copy()
        new[1:] &= (seeds[1:] != seeds[:-1]) | ~ok[:-1]  # neighbours mostly share their seed
        at = np.flatnonzero(new)
        keys, _, low, high = grouped(seeds[at], p.owners(at))
        for bucket, part in B.deal(keys, buckets):
            yield bucket, B.pack_arrays(key=keys[part], many=(low != high)[part])

    def survivors(p: Passage, level: int, replies: list[dict[str, np.ndarray]]) -> np.ndarray:
        """Positions of windows of this level whose shorter windows all repeat."""
        repeated = gathered(replies)
        if level == 1:
            seeds, ok = first_seeds(p)
            return np.flatnonzero(ok & known(seeds, repeated))
        shorter, _ = p.windows(lengths[level - 1])
        again = known(shorter, repeated)
        step, n = lengths[level] - lengths[level - 1], max(0, len(p.words) - lengths[level] + 1)
        return np.flatnonzero(again[:n] & again[step : step + n] & B.inside(p.at, lengths[level], n))

    def write_level(level: int):
        last = level == len(lengths) - 1

        def write(block: int, batch: pa.RecordBatch, replies: list[dict[str, np.ndarray]]) -> pa.Table:
            p = Passage(batch)
            at = survivors(p, level, replies)
            keys, first, low, high = grouped(p.windows(lengths[level])[0][at], p.owners(at))
            if last:
                check = (B.window_hashes(p.words, lengths[level], _CHECK_BASE)[at[first]] >> np.uint64(32)).astype(np.uint32)
                columns = {"key": keys, "check": check, "owner": low}
            else:
                columns = {"key": keys, "many": low != high}
            return B.letters_table(block, ((b, B.pack_arrays(**{k: v[part] for k, v in columns.items()})) for b, part in B.deal(keys, buckets)))

        return write

    answers = B.answer(B.send(blocks, write_seeds), repeats_of)
    for level in range(1, len(lengths)):
        asked = B.with_answers(blocks, answers, write_level(level), B.MAIL_SCHEMA)
        answers = settle(B.answer(asked, later_holders if level == len(lengths) - 1 else repeats_of), "repeats")
        if answers.isEmpty():  # no candidate survives; repeats inside one block are still to be judged
            answers = answers.limit(0)
            break

    def strip(block: int, batch: pa.RecordBatch, replies: list[dict[str, np.ndarray]]) -> pa.Table:
        p = Passage(batch)
        hashes, ok = p.windows(window)
        at = np.flatnonzero(ok)
        h, owner = hashes[at], p.owners(at)
        order = np.argsort(h, kind="stable")
        ranked = h[order]
        first = np.append(True, ranked[1:] != ranked[:-1])[: len(ranked)]
        goes = np.zeros(len(at), bool)
        if len(ranked):
            goes[order] = owner[order] > owner[order][np.flatnonzero(first)][np.cumsum(first) - 1]
        goes |= known(h, gathered(replies))
        cover = np.zeros(len(p.words) + 1, np.int64)
        np.add.at(cover, at[goes], 1)
        np.add.at(cover, at[goes] + window, -1)
        gone = np.cumsum(cover[:-1]) > 0
        n_gone = np.add.reduceat(np.append(gone, False), p.at[:-1]) * (np.diff(p.at) > 0) if len(p.ids) else np.zeros(0, np.int64)
        raw, kept = p.data.tobytes(), []
        for i in range(len(p.ids)):
            words = raw[p.offsets[i] : p.offsets[i + 1]].split()
            if n_gone[i]:
                words = [w for w, g in zip(words, gone[p.at[i] : p.at[i + 1]]) if not g]
            kept.append(b" ".join(words).decode())
        return pa.table({"doc_id": p.batch.column(0).cast(pa.int64()), "n_words": pa.array(np.diff(p.at), pa.int64()), "n_removed": pa.array(n_gone, pa.int64()), "kept": pa.array(kept, pa.string())})

    return B.with_answers(blocks, answers, strip, KEPT_SCHEMA)

"""Language-model scores from a probabilistic suffix tree.

The tree predicts the next byte of a text from the longest suffix of what came before that is a state. Contexts of up to
``depth`` bytes are counted over all training documents. A context becomes a state if its next-byte distribution differs
enough from that of its parent (the context without its oldest byte), measured by twice the log-likelihood ratio; all
suffixes of a state are states too. The distributions are smoothed: each state's counts are mixed with its parent's
smoothed distribution, down to the single byte and to the uniform one. A text is its lower-cased words with single
spaces and one end sign, so its probability is that of its sequence of tokens (words and end), unseen words included.

Counting and scoring go through blocks (see ``blocks``): a block sends every distinct (context, next byte) once, with its
count in training documents, to the bucket of the two latest context bytes. A bucket thus holds whole subtrees and can
test and smooth them by itself; only the 256 x 256 table of single-byte contexts is known to all. The answers carry the
probability for each (context, next byte) asked for.

The same exchange gives the word counts of the base score (add-one over words).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from babelgauge.llm import blocks as B
from babelgauge.llm.work import settle, tidy

END = 0x0A  # stands for the end of a text, and for what precedes one; words contain neither it nor the space
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, known_log double, score double"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_SIGNS = np.where(B.SPACE, np.uint8(0x20), _LOWER)
_ENDS = np.uint64(END * 0x0101010101010101)


@dataclass(frozen=True)
class TreeSettings:
    depth: int = 5  # longest context, bytes (2 to 7)
    divergence: float = 12.0  # least value of 2 ln(likelihood ratio) for a state
    pull: float = 1.0  # weight of the parent's distribution, in distinct next bytes of the state


def tokens_only(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts as lower-cased words with single spaces, each followed by END; and the n + 1 offsets."""
    words = np.diff(at)
    letters = np.append(0, np.cumsum(ends - starts))[at]
    bounds = np.append(0, np.cumsum(np.diff(letters) + words + (words == 0)))
    signed = np.insert(data, offsets[1:], END)  # so that every word has a sign after it
    kept = ~B.SPACE[signed]
    kept[1:] |= kept[:-1].copy()  # the first sign after a word stays
    kept[(offsets[1:] + np.arange(len(words)))[words == 0]] = True
    out = _SIGNS[signed[kept]]
    out[bounds[1:] - 1] = END
    return out, bounds


class Texts:
    """One block's token texts: bytes, which documents train, grams and words."""

    def __init__(self, batch: pa.RecordBatch, depth: int) -> None:
        data, offsets = B.text_bytes(batch.column(2))
        starts, ends, self.at = B.word_spans(data, offsets)
        self.raw = data, starts, ends
        self.bytes, self.bounds = tokens_only(data, offsets, starts, ends, self.at)
        self.ids, self.trains = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
        self.sizes = np.diff(self.bounds)
        self.depth = depth

    def grams(self) -> np.ndarray:
        """For every byte: its context, the latest byte in the highest place, and the byte itself in the lowest."""
        n, depth = len(self.bytes), self.depth
        padded = np.full(n + 8, END, np.uint8)
        padded[depth : depth + n] = self.bytes
        # eight bytes read at a time, one byte further for every gram: the first depth of them are its context
        out = np.ndarray(n, "<u8", padded, strides=(1,)).astype(np.uint64)
        for before in range(min(depth, int(self.sizes.max(initial=0)))):  # bytes of the text before this one
            at = self.bounds[:-1][self.sizes > before] + before
            old = np.uint64(8 * (depth - before))
            out[at] = (out[at] >> old << old) | (_ENDS & ((np.uint64(1) << old) - np.uint64(1)))
        out <<= np.uint64(64 - 8 * depth)  # nothing but the context
        out >>= np.uint64(56 - 8 * depth)
        out |= self.bytes
        return out

    def words(self) -> np.ndarray:
        data, starts, ends = self.raw
        return B.word_hashes(_LOWER[data], starts, ends)

    def pair_counts(self) -> np.ndarray:
        """How often each byte comes after each byte in training documents, 256 x 256 end to end."""
        before = np.append(np.uint8(END), self.bytes[:-1])
        before[self.bounds[:-1]] = END
        pairs = (before.astype(np.uint16) << 8 | self.bytes)[self.training_bytes()]
        return np.bincount(pairs, minlength=1 << 16)

    def training_bytes(self) -> np.ndarray:
        return np.repeat(self.trains, self.sizes)

    def training_words(self) -> np.ndarray:
        return np.repeat(self.trains, np.diff(self.at))


def placed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values as they come, and the place of every value among them. Hashed, as most values come often."""
    coded = pa.array(values).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy()


def counted(values: np.ndarray, training: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and how many of each are in training documents."""
    keys, counts = np.unique(values[training], return_counts=True)
    rest = np.unique(values[~training])
    rest = rest[~np.isin(rest, keys, assume_unique=True)]
    both = np.concatenate([keys, rest])
    order = np.argsort(both, kind="stable")
    return both[order], np.concatenate([counts, np.zeros(len(rest), np.int64)])[order].astype(np.int64)


def subtree_bucket(grams: np.ndarray, depth: int, buckets: int) -> np.ndarray:
    """The bucket of the two latest context bytes."""
    root = grams >> np.uint64(8 * (depth - 1))
    return (B.mix(root) % np.uint64(buckets)).astype(np.int64)


def by_bucket(keys: np.ndarray, depth: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of keys bucket after bucket, in order within each, and the buckets' n + 1 offsets."""
    of = subtree_bucket(keys, depth, buckets)
    order = np.argsort(of, kind="stable")
    return order, np.searchsorted(of[order], np.arange(buckets + 1))


def single_byte_model(pairs: np.ndarray, pull: float) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed distributions after each single byte (256 x 256), and their unsmoothed counts."""
    total = pairs.sum(axis=0)
    base = (total + 1.0) / (total.sum() + 256.0)
    return (pairs + pull * base) / (pairs.sum(axis=1, keepdims=True) + pull), pairs


def tree_probabilities(grams: np.ndarray, counts: np.ndarray, first: np.ndarray, pairs: np.ndarray, s: TreeSettings) -> np.ndarray:
    """log10 probability of each gram's last byte after the longest suffix of its context that is a state."""
    symbol = (grams & np.uint64(0xFF)).astype(np.int64)
    latest = (grams >> np.uint64(8 * s.depth)).astype(np.int64)
    p = first[latest, symbol]
    seen = pairs.sum(axis=1)
    parent_n, parent_total = pairs[latest, symbol].astype(np.float64), seen[latest].astype(np.float64)
    levels = []
    for k in range(2, s.depth + 1):  # counts of each level, for every gram its own
        context = grams >> np.uint64(8 * (s.depth + 1 - k))
        starts = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
        group = np.cumsum(np.append(False, context[1:] != context[:-1]))
        cell = (group.astype(np.int64) << 8) | symbol
        cells, inverse = np.unique(cell, return_inverse=True)
        n = np.bincount(inverse, weights=counts, minlength=len(cells))
        total = np.add.reduceat(counts, starts).astype(np.float64)
        kinds = np.bincount(cells[n > 0] >> 8, minlength=len(starts))
        # the test of a context against its parent, summed over the bytes seen after it
        rep = np.zeros(len(cells), np.int64)
        rep[inverse] = np.arange(len(grams))
        of = cells >> 8
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(n > 0, n * np.log((n / total[of]) / (parent_n[rep] / parent_total[rep])), 0.0)
        state = 2 * np.bincount(of, weights=gain, minlength=len(starts)) >= s.divergence
        levels.append((group, n[inverse], total[group], state, s.pull * kinds[group]))
        parent_n, parent_total = n[inverse], total[group]
    for i in range(len(levels) - 2, -1, -1):  # suffixes of states are states
        group, deeper, below = levels[i][0], levels[i + 1][0], levels[i + 1][3]
        levels[i][3][group[below[deeper]]] = True
    alive = np.ones(len(grams), bool)
    for group, n, total, state, pull in levels:
        alive &= state[group]
        p = np.where(alive, (n + pull * p) / np.maximum(total + pull, 1e-9), p)
    return np.log10(p)


def suffix_tree_scores(docs: DataFrame, held_out, settings: TreeSettings = TreeSettings(), block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """Scores of all documents under a tree learnt from those for which the column ``held_out`` is not true.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Returns ``doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score``: tokens are words plus one end; ``n_known`` counts those that occur in training
    documents; ``base_score`` is the add-one word score, ``score`` the tree's log10 probability of the text.

    A null text is empty (its only token is the end). A null ``held_out`` counts as false. Repeated rows are scored,
    and counted, as often as they are there. Without training documents all distributions are uniform over 256 bytes
    (the word vocabulary is empty). An empty table gives no rows. Words are told apart by 64 hash bits.
    """
    s = settings
    if not 2 <= s.depth <= 7:
        raise ValueError("depth must be 2 to 7 bytes")
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~F.coalesce(held_out, F.lit(False))).alias("trains"), F.col("text").cast("string").alias("text"))
    blocks = B.as_blocks(marked, "doc_id", "trains", "text", block_bytes=block_bytes)
    buckets = B.bucket_count(blocks)

    def pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, tokens, texts = np.zeros(1 << 16, np.int64), 0, 0
        for batch in batches:
            for body in batch.column("body"):
                t = Texts(B.unpack(body.as_py()), 1)
                pairs += t.pair_counts()
                texts += int(t.trains.sum())
                tokens += int(np.diff(t.at)[t.trains].sum())
        at = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_pydict({"pair": pa.array(np.append(at, [-1, -2])), "n": pa.array(np.append(pairs[at], [tokens, texts]))})

    sums = blocks.mapInArrow(tidy(pair_counts), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()  # at most 65,538 rows
    found = {r["pair"]: r["n"] for r in sums}
    texts = int(found.pop(-2, 0))  # each has one end
    train_tokens = int(found.pop(-1, 0)) + texts
    pairs = np.zeros(1 << 16, np.int64)
    pairs[list(found)] = list(found.values())
    first, pairs = single_byte_model(pairs.reshape(256, 256), s.pull)

    def ask(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
        t = Texts(batch, s.depth)
        keys, counts = counted(t.grams(), t.training_bytes())
        order, edges = by_bucket(keys, s.depth, buckets)
        for b in np.flatnonzero(np.diff(edges)):
            part = order[edges[b] : edges[b + 1]]
            yield int(b), B.pack_arrays(key=keys[part], n=counts[part])
        keys, counts = counted(t.words(), t.training_words())
        for b, part in B.deal(keys, buckets):
            yield buckets + b, B.pack_arrays(key=keys[part], n=counts[part])

    def settle_keys(bucket: int, asked: list[int], arrays: list[dict[str, np.ndarray]]) -> Iterator[tuple[int, bytes]]:
        words = bucket >= buckets
        keys, inverse = np.unique(np.concatenate([a["key"] for a in arrays]), return_inverse=True)
        counts = np.bincount(inverse, weights=np.concatenate([a["n"] for a in arrays]), minlength=len(keys)).astype(np.int64)
        if words:
            yield -1, B.pack_arrays(types=np.array([(counts > 0).sum()], np.int64))
        value = counts if words else tree_probabilities(keys, counts, first, pairs, s)
        at = 0
        for block, a in zip(asked, arrays):
            mine = value[inverse[at : at + len(a["key"])]]
            at += len(mine)
            yield block, B.pack_arrays(n=mine) if words else B.pack_arrays(log=mine)

    answers = settle(B.answer(B.send(blocks, ask), settle_keys), "scores")

    def count_types(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = sum(int(B.unpack_arrays(body.as_py())["types"][0]) for body in batch.column("body"))
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    types = answers.where("block = -1").select("body").mapInArrow(tidy(count_types), "n long").agg(F.sum("n")).first()[0] or 0

    def score(block: int, batch: pa.RecordBatch, replies: list[dict[str, np.ndarray]]) -> pa.Table:
        t = Texts(batch, s.depth)
        keys, place = placed(t.grams())
        rank = np.argsort(keys)
        order, _ = by_bucket(keys[rank], s.depth, buckets)
        logs = np.empty(len(keys))
        logs[rank[order]] = np.concatenate([r["log"] for r in replies if "log" in r])  # in the order they were asked for
        each = logs[place]
        n_words = np.diff(t.at)
        words, place = placed(t.words())
        c = np.empty(len(words), np.int64)
        c[np.argsort(words)] = np.concatenate([c[:0], *[r["n"] for r in replies if "n" in r]])
        c = c[place]
        total = np.add.reduceat(each, t.bounds[:-1])
        sums = np.concatenate([np.zeros((2, 1)), np.cumsum([c > 0, np.log10(c + 1.0)], axis=1)], axis=1)[:, t.at]
        known, known_log = np.diff(sums, axis=1)
        return pa.table({"doc_id": t.ids, "held_out": pa.array(~t.trains), "n_tokens": pa.array(n_words + 1, pa.int64()), "n_known": pa.array(np.rint(known).astype(np.int64)), "known_log": pa.array(known_log), "score": pa.array(total)})

    vocabulary = types + (1 if texts else 0)
    norm = float(np.log10(train_tokens + vocabulary + 1))
    scored = B.with_answers(blocks, answers.where("block >= 0"), score, SCHEMA)
    return scored.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.lit(1 if texts else 0)).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("known_log") + F.lit(float(np.log10(texts + 1))) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        "score",
    )

"""Packing token sequences into fixed windows by Karmarkar-Karp multiway differencing.

A document's ids are cut into full windows, which are sequences by themselves, and one rest. Rests are dealt into groups
of bounded size, and each group is partitioned into the number of windows its tokens need: every rest starts as a partial
partition, and the two partial partitions with the largest imbalance are merged again and again, the fullest windows of
one meeting the emptiest of the other. That leaves near-equal windows. If one exceeds the capacity, the group gets one
more window and is partitioned anew. What a window lacks is padding. One rest in 40 is cut small before, which gives
differencing the small pieces to level windows with (measured: padding of rests 3.3 % without, about 1 % with it).
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from babelgauge.llm.blocks import text_bytes, word_hashes
from babelgauge.llm.work import settle, share_package, tidy

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
GROUP = 384  # rests partitioned together
GRIT, GRIT_SHARE = 32, 40  # one rest in so many is cut into pieces of 32 ids, with which windows become level
SLICE = 4 << 20  # bytes of text encoded together
CACHED = 1 << 19  # encoded words kept per worker
#: Fixed by GPT-2's byte-level scheme: the words that byte pairs are merged in.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Ids of texts by a ``tokenizers`` file, without added special tokens.

    Byte-level files whose ids follow the order of the merges are read as ranks for ``tiktoken``, which gives the same
    ids several times faster; there, texts are cut before single spaces between plain letters, which no token crosses,
    and each distinct piece is encoded once. All other files go through ``tokenizers`` as they are.
    """

    def __init__(self, path: str) -> None:
        self.known: dict[int, int] = {}
        self.ids: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        spec = json.load(open(path, encoding="utf-8"))
        ranks = self._ranks(spec)
        if ranks is None:
            from tokenizers import Tokenizer

            self.fast, self.slow = None, Tokenizer.from_file(path)
        else:
            import tiktoken

            special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
            self.fast = tiktoken.Encoding("ranks", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens=special)
            self.lengths = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
            for token, i in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
                self.lengths[i] = len(token)

    @staticmethod
    def _ranks(spec: dict) -> dict[bytes, int] | None:
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and not spec.get("normalizer")
        plain = plain and before.get("use_regex", True) and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in spec.get("added_tokens", []))
        special = {t["content"] for t in spec.get("added_tokens", [])}
        if not plain:
            return None
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # the scheme shows these bytes as themselves
        hidden = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        order = [model["vocab"][m] for m in merged]
        return ranks if order == sorted(order) and len(ranks) == 256 + len(merged) else None

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and the n + 1 offsets of the texts in them."""
        if self.fast is None:
            raw = data.tobytes()
            found = [e.ids for e in self.slow.encode_batch([raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:])], add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *[np.array(x, np.uint32) for x in found]]), np.append(0, np.cumsum([len(x) for x in found], dtype=np.int64))
        full = np.flatnonzero(np.diff(offsets) > 0)
        cut = self._cuts(data)
        edges = offsets[:-1][full]
        cut[edges] = False  # a space there starts a text
        starts = np.sort(np.append(np.flatnonzero(cut), edges))
        ends = np.append(starts[1:], len(data))[: len(starts)]
        keys, first, inverse = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > CACHED:
            self.known, self.ids, self.sizes = {}, [], []
        find = self.known.get
        place = np.array([find(key, -1) for key in keys.tolist()], np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = np.arange(len(new)) + len(self.known)
            self.known.update(zip(keys[new].tolist(), place[new].tolist()))
            found, sizes = self._encode(data, starts[first[new]], ends[first[new]], cut)
            self.ids.append(found)
            self.sizes.append(sizes)
        ids, sizes = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.ids, self.sizes))
        self.ids, self.sizes = [ids], [sizes]
        piece = place[inverse]
        size = sizes[piece]
        total = np.append(0, np.cumsum(size))
        out = ids[np.arange(total[-1]) - np.repeat(total[:-1] - (np.cumsum(sizes) - sizes)[piece], size)]
        return out, total[np.searchsorted(starts, offsets)]

    def _encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after another, and how many each has. Pieces between cuts are encoded in one go."""
        inner = np.append(cut, False)
        between = inner[starts] & inner[ends]
        order = np.argsort(~between, kind="stable")
        starts, ends, n = starts[order], ends[order], int(between.sum())
        raw = data.tobytes()
        joined = b"".join([raw[a:b] for a, b in zip(starts[:n].tolist(), ends[:n].tolist())])
        ids = [np.array(self.fast.encode(joined.decode(), allowed_special="all"), np.uint32)]
        reach = np.append(0, np.cumsum(self.lengths[ids[0]]))
        counts = np.diff(np.searchsorted(reach, np.append(0, np.cumsum(ends[:n] - starts[:n]))))
        for a, b in zip(starts[n:].tolist(), ends[n:].tolist()):
            ids.append(np.array(self.fast.encode(raw[a:b].decode(), allowed_special="all"), np.uint32))
        counts = np.append(counts, [len(x) for x in ids[1:]]).astype(np.int64)
        flat, before = np.concatenate(ids), np.cumsum(counts) - counts
        back = np.argsort(order)  # into the order asked for
        sizes = counts[back]
        return flat[np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - before[back], sizes)], sizes

    @staticmethod
    def _cuts(data: np.ndarray) -> np.ndarray:
        """Where a space stands between two characters that are surely neither white space nor parts of one."""
        plain = (data > 0x20) & (data < 0x7F)
        latin = np.zeros(len(data), bool)
        latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80)  # letters and signs from U+00C0 to U+00FF
        cut = data == 0x20
        cut[:1] = cut[-1:] = False
        cut[1:] &= (plain | latin)[:-1]
        cut[:-1] &= (plain | (data == 0xC3))[1:]
        return cut


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """Loaded once per worker."""
    return Encoder(path)


def differencing(sizes: np.ndarray, ways: int) -> np.ndarray:
    """The window (0 to ``ways`` - 1) of every size: Karmarkar-Karp multiway differencing.

    A partial partition keeps its windows' sums in descending order; only those that are not empty are stored.
    """
    heap = [(-int(s), i, [int(s)], [[i]]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        _, _, a, a_items = heapq.heappop(heap)
        _, _, b, b_items = heapq.heappop(heap)
        free = ways - len(a)
        joined = list(zip(a, a_items))
        for k, (value, items) in enumerate(zip(b, b_items)):
            if k < free:
                joined.append((value, items))  # meets an empty window
            else:
                at = len(a) - 1 - (k - free)  # meets the emptiest left
                joined[at] = (joined[at][0] + value, joined[at][1] + items)
        joined.sort(key=lambda x: -x[0])
        sums = [x[0] for x in joined]
        spread = sums[0] - (sums[-1] if len(sums) == ways else 0)
        heapq.heappush(heap, (-spread, serial, sums, [x[1] for x in joined]))
        serial += 1
    out = np.zeros(len(sizes), np.int64)
    if heap:
        for window, items in enumerate(heap[0][3]):
            out[items] = window
    return out


def windows_for(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Windows of near-equal fill within the capacity; their count rises until all fit."""
    ways = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = differencing(sizes, ways)
        if np.bincount(window, weights=sizes).max(initial=0) <= capacity:
            return window
        ways += 1


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Every document's ids, with ``end_id`` after them, cut into full windows and a rest: rows of ``PIECE_SCHEMA``."""

    share_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
                ids, bounds = encode(data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at])
                rows = []
                for i in range(stop - at):
                    whole = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype("<u4")
                    full = len(whole) // capacity * capacity
                    fine = zlib.crc32(whole[full:].tobytes()) % GRIT_SHARE == 0
                    for start in [*range(0, full, capacity), *range(full, len(whole), GRIT if fine else capacity)]:
                        part = whole[start : min(len(whole), start + (capacity if start < full or not fine else GRIT))]
                        rows.append((at + i, start, len(part), zlib.crc32(part.tobytes()), len(whole)))
                row, start, length, crc, total = np.array(rows, np.int64).T
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *map(pa.array, (start, length, crc, total))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
                at = stop

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), PIECE_SCHEMA)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, group: int = GROUP) -> DataFrame:
    """Pieces of all documents with their place: ``PIECE_SCHEMA`` and ``sequence_id, offset``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Each id of a document, and one ``end_id`` after
    them, lies in exactly one piece; the pieces of a sequence follow each other without gaps, at most ``capacity`` ids in
    all. A null or empty text is its end id alone. Repeated rows and null ``doc_id`` are packed as often as they are
    there. An empty table gives no rows. ``tokenizer`` is the path of a ``tokenizers`` file that every executor has.

    Rests meet in groups of about ``group`` by a hash of their row in the written pieces, so no key decides on a group's
    size; a group costs one small task, however many documents there are.
    """
    numbered = settle(pieces(docs, tokenizer, capacity, end_id), "pieces").withColumn("row", F.monotonically_increasing_id())
    rests = numbered.where(F.col("length") < capacity)
    groups = max(1, -(-rests.count() // group))

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        size = table.column("length").to_numpy()
        window = windows_for(size, capacity)
        order = np.lexsort((np.arange(len(size)), window))
        before = np.cumsum(size[order]) - size[order]
        new = np.append(True, np.diff(window[order]) != 0)
        offset = np.empty(len(size), np.int64)
        offset[order] = before - before[np.flatnonzero(new)][np.cumsum(new) - 1]
        sequence = (table.column("bucket")[0].as_py() * 2 * group_limit + window) * 2 + 1
        return table.drop_columns(["row", "bucket"]).append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    group_limit = 1 << 20  # windows of a group, far more than it can have rests
    dealt = rests.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(groups)))
    packed = dealt.groupBy("bucket").applyInArrow(place, PIECE_SCHEMA + ", sequence_id long, offset long")
    full = numbered.where(F.col("length") == capacity).select(*packed.columns[:5], (F.col("row") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.unionByName(packed)

"""SimHash near-duplicates, candidates by the pigeonring principle.

A fingerprint is a ring of 16 segments of 4 bits. If two fingerprints differ in at most ``distance`` bits, there is a
segment from which every chain of l consecutive segments differs in at most l * distance / 16 bits (the budget of the
chain, rounded down). For a distance of 3 such a chain starts with 5 equal segments and has at most one differing bit in
its first 10. The equal 20 bits and one equal half of the next 20 are the key of a lookup (32 keys for each fingerprint,
30 bits each); the chain's budgets are checked step by step, and only what remains is compared in full.

Equal fingerprints are one before any of this. Groups of many near copies share keys: a bucket gives the links of a
spanning forest only, and a large bucket is split by the bits its key leaves open, again by pigeonhole, before anything
is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from babelgauge.llm.components import components
from babelgauge.llm.repeats import salted_join
from babelgauge.llm.work import settle, share_package, tidy

SEGMENTS, WIDTH = 16, 4  # of the ring; WIDTH bits each
MOST_EQUAL = 12  # segments in a key
SMALL = 4096  # members of a bucket that are compared directly


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of the lower-cased text; fewer words: of the whole sequence; none: nothing."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, 42)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = len(words) - shingle + 1
    return np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist())), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in more than half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # flat memory for very long texts
        part = hashes[i : i + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, text_hash, fp`` (the 64 bits as a signed long) of every document, one Arrow pass."""
    share_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for i, text in enumerate(batch.column(2).cast(pa.binary())):
                found = shingle_hashes(text.as_py() or b"", shingle)
                if len(found):
                    out[i] = fingerprint(found)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text_hash": batch.column(1), "fp": pa.array(out.view(np.int64))})

    text = F.col("text").cast("string")
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return told.mapInArrow(tidy(run), "doc_id long, text_hash long, fp long")


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def rotated(fps: np.ndarray, segment: int) -> np.ndarray:
    """The ring read from a segment on: that segment becomes the lowest bits."""
    shift = np.uint64(segment * WIDTH)
    return fps if not segment else (fps >> shift) | (fps << (np.uint64(64) - shift))


def budgets(distance: int) -> list[int]:
    """What chains of 1 to 16 segments may differ in."""
    return [length * distance // SEGMENTS for length in range(1, SEGMENTS + 1)]


def plan(distance: int) -> tuple[int, int]:
    """Bits at the start of a chain that are equal, and bits after them of which at most one differs."""
    allowed = budgets(distance)
    equal = sum(b == 0 for b in allowed)
    if equal > MOST_EQUAL:
        return MOST_EQUAL * WIDTH, 0
    return equal * WIDTH, sum(b == 1 for b in allowed) * WIDTH


def ring_keys(fps: np.ndarray, distance: int) -> Iterator[tuple[int, np.ndarray]]:
    """For every table (segment, half of the bits with one difference) the key of each fingerprint."""
    equal, one = plan(distance)
    half = one // 2
    for segment in range(SEGMENTS):
        turned = rotated(fps, segment)
        head = turned & np.uint64((1 << equal) - 1)
        for h in range(2 if half else 1):
            piece = (turned >> np.uint64(equal + h * half)) & np.uint64((1 << half) - 1)
            yield segment * 2 + h, head | (piece << np.uint64(equal))


def near(diff: np.ndarray, segment: int, distance: int) -> np.ndarray:
    """Which differences keep every chain from the segment on within its budget, and the distance in full."""
    allowed, turned = budgets(distance), rotated(diff, segment)
    left = np.arange(len(diff))
    for step in range(SEGMENTS - 1):
        if allowed[step + 1] > allowed[step]:  # the longest chain with this budget stands for the shorter ones
            chain = turned[left] & np.uint64((1 << (step + 1) * WIDTH) - 1)
            left = left[popcount(chain) <= allowed[step]]
    return left[popcount(diff[left]) <= distance]


class Forest:
    """Links between members that joins two trees each, so at most one fewer than there are members."""

    def __init__(self, n: int) -> None:
        self.up, self.links = list(range(n)), []

    def top(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def link(self, a: int, b: int) -> None:
        x, y = self.top(a), self.top(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.links.append((a, b))


def link_bucket(fps: np.ndarray, members: np.ndarray, open_bits: list[int], segment: int, distance: int, forest: Forest) -> None:
    """Link the members within the distance. Large sets are split by ``open_bits``, which may differ among them."""
    if len(members) > SMALL and len(open_bits) > distance:
        for cut in np.array_split(np.array(open_bits), distance + 1):  # at most ``distance`` cuts can differ
            key = np.zeros(len(members), np.uint64)
            for i, bit in enumerate(cut):
                key |= ((fps[members] >> np.uint64(bit)) & np.uint64(1)) << np.uint64(i)
            order = np.argsort(key, kind="stable")
            edges = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
            rest = [b for b in open_bits if b not in set(cut.tolist())]
            for part in np.split(members[order], edges[1:]):
                if len(part) > 1:
                    link_bucket(fps, part, rest, segment, distance, forest)
        return
    waiting = members
    while len(waiting):  # breadth first: every member looks once at those that no one has reached yet
        front, waiting = [int(waiting[0])], waiting[1:]
        while front and len(waiting):
            at = front.pop()
            found = near(fps[waiting] ^ fps[at], segment, distance)
            for other in waiting[found].tolist():
                forest.link(at, other)
                front.append(other)
            waiting = np.delete(waiting, found)


def linked_pairs(fps: DataFrame, distance: int) -> DataFrame:
    """Pairs ``a, b`` of distinct fingerprints whose links connect all fingerprints within ``distance`` bits."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for table, key in ring_keys(values, distance):
                yield pa.RecordBatch.from_pydict({"key": pa.array((key | np.uint64(table << 56)).view(np.int64)), "fp": pa.array(values.view(np.int64))})

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of equal keys in sorted rows; a run may go on in the next batch."""
        held_key, held = None, []
        for batch in batches:
            keys, values = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            edges = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
            stops = np.append(edges[1:], len(keys))
            out = []
            many = np.flatnonzero((stops - edges > 1) | (np.arange(len(edges)) == 0) | (np.arange(len(edges)) == len(edges) - 1))
            for i in many.tolist():
                key, part = int(keys[edges[i]]), values[edges[i] : stops[i]]
                if key != held_key:
                    if held:
                        out += links_of(held_key, np.concatenate(held))
                    held_key, held = key, []
                held.append(part)
            if out:
                yield pairs(out)
        if held and (out := links_of(held_key, np.concatenate(held))):
            yield pairs(out)

    def pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = np.array(out, np.int64).T
        return pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b)})

    def links_of(key: int, values: np.ndarray) -> list[tuple[int, int]]:
        values = np.unique(values)
        if len(values) < 2:
            return []
        table = (key & (2**64 - 1)) >> 56
        segment, forest, fps = table // 2, Forest(len(values)), values.view(np.uint64)
        same = int(np.bitwise_or.reduce(fps ^ fps[0]))
        link_bucket(fps, np.arange(len(values)), [b for b in range(64) if same >> b & 1], segment, distance, forest)
        return [(int(values[a]), int(values[b])) for a, b in forest.links]

    keyed = fps.select("fp").mapInArrow(tidy(spread), "key long, fp long")
    return keyed.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(tidy(solve), "a long, b long")


def _groups(docs: DataFrame, shingle: int, distance: int) -> DataFrame:
    """``row, doc_id, text_hash, fp, group``: the fingerprint that names each document's group, a written table."""
    if not 1 <= distance <= 3:
        raise ValueError("distance must be 1, 2 or 3")
    found = settle(fingerprints(docs, shingle).withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    distinct = settle(found.select("fp").distinct(), "distinct-fingerprints")
    roots = components(linked_pairs(distinct, distance)).where("node != root").select(F.col("node").alias("fp"), F.col("root").alias("group"))
    grouped = salted_join(found, roots, ["fp"], "row", how="left")  # a fingerprint may be that of any share of the rows
    return settle(grouped.withColumn("group", F.coalesce("group", "fp")), "simhash-groups")


def simhash_groups(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """``doc_id, fp, component_id`` of every document: groups of fingerprints linked at ``distance`` or fewer bits.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. ``component_id`` is the smallest ``doc_id`` that
    can be reached by links, the own one included; a null ``doc_id`` is never the smallest and a group of nulls only has
    none. A null or empty text has fingerprint zero and is linked like any other. Repeated rows come back as often as
    they are there. An empty table gives no rows. ``distance`` is 1 to 3 (beyond that the ring's keys get short).
    """
    found = _groups(docs, shingle, distance)
    least = found.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return salted_join(found, least, ["group"], "row").select("doc_id", "fp", "component_id")


def keep_one_of_each(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """The documents, all columns, without near-duplicates: of each group one row stays.

    It is the one with the smallest ``doc_id`` (null last), of equal ids the one with the smallest hash of its text; of
    rows equal in both, one. All null and empty texts are one group.
    """
    found = _groups(docs, shingle, distance)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    best = found.groupBy("group").agg(F.min(place).alias("best"))
    judged = salted_join(found, best, ["group"], "row").withColumn("stays", place == F.col("best"))
    losers = judged.where(~F.col("stays")).select("doc_id", "text_hash").distinct()
    again = judged.where("stays").groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash")
    kept = _without(docs, losers)
    if again.isEmpty():
        return kept
    key = [F.col("doc_id").cast("long").alias(_ID), F.xxhash64(F.col("text").cast("string")).alias(_HASH)]
    single = kept.select("*", *key).join(again.select(F.col("doc_id").alias("a"), F.col("text_hash").alias("b")), F.col(_ID).eqNullSafe(F.col("a")) & (F.col(_HASH) == F.col("b")), "left_semi")
    return _without(kept, again).unionByName(single.dropDuplicates([_ID, _HASH]).select(*kept.columns))


_ID, _HASH = "__simhash_doc", "__simhash_text"  # beside any columns of the documents


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(_ID)) & (F.xxhash64(F.col("text").cast("string")) == F.col(_HASH))
    return docs.join(rows.select(F.col("doc_id").alias(_ID), F.col("text_hash").alias(_HASH)), same, "left_anti")

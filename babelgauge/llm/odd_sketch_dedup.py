"""MinHash near-duplicates, candidates verified by odd sketches and then on the full sets.

A document is the set of its distinct word shingles. ``SAMPLES`` MinHash values are grouped in bands; equal bands are
candidates. Before a candidate costs anything, its odd sketches are compared: a sketch has one bit per cell, flipped by
every (function, MinHash value) that falls on it, so the XOR of two sketches holds the parities of the samples that
differ, and its population count tells their number closely where the sets are alike. The cut-off is the count that a
pair at the threshold exceeds with a probability of ``MISS`` (``most_flips``), so the sketch only takes away pairs that
are clearly too far apart. What remains is judged on the full sets of shingle hashes.

No pair list is ever made. Equal sets are one node. A bucket of equal bands gives a forest of candidates, a hot bucket a
star. Candidates form groups; the sets of a group meet once, in parts of bounded bytes. A part is searched breadth first
(a member looks only at members that nothing has reached yet). In a group of several parts, the part's sets are also
compared with a few pivots that visit every part, and the members that are then outside the group's main component visit
every part too: every pair within the threshold lies in one part, or has a member that visits, or is connected anyway.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from babelgauge.llm import blocks as B
from babelgauge.llm.components import components
from babelgauge.llm.pigeonring_simhash import Forest
from babelgauge.llm.repeats import salted_join
from babelgauge.llm.work import give_back, settle, tidy

BANDS, ROWS = 28, 4  # a pair at 0.85 shares no band with a probability of (1 - 0.85 ** 4) ** 28 = 1.3e-9
SAMPLES = BANDS * ROWS
BITS = 256  # of a sketch
MISS = 1e-9
HOT = 1 << 12  # sets in a bucket from which it is a star
PART_BYTES = 2 << 20  # sets that are searched together
BLOCK_BYTES = 2 << 20
PIVOTS = 8
SLICE = 1 << 17  # shingles that are sampled together
_RNG = np.random.Generator(np.random.PCG64(13))
_MULTIPLY = _RNG.integers(0, 2**32, SAMPLES, dtype=np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 2**32, SAMPLES, dtype=np.uint32)
_SECOND = np.uint64(0x5851F42D4C957F2D)
SKETCH_SCHEMA = "block long, row int, doc_id long, n_shingles long, s1 long, s2 long, bands binary, sketch binary"


@lru_cache(maxsize=8)
def most_flips(threshold: float, samples: int = SAMPLES, bits: int = BITS, miss: float = MISS) -> int:
    """The XOR count that sketches of two sets at the threshold exceed with at most this probability.

    The number of differing samples is binomial; each flips two cells at random, and the count of odd cells is a chain
    that goes up or down by one.
    """
    odd, total = np.zeros(bits + 1), np.zeros(bits + 1)
    odd[0], p = 1.0, threshold**samples
    cells = np.arange(bits + 1)
    for differing in range(samples + 1):
        total += p * odd
        p *= (samples - differing) / (differing + 1) * (1 - threshold) / threshold
        for _ in range(2):
            up, down = odd * (bits - cells) / bits, odd * cells / bits
            odd = np.append(0, up[:-1]) + np.append(down[1:], 0)
    beyond = 1 - np.cumsum(total)
    return int(np.argmax(beyond <= miss))


class Shingles:
    """The distinct shingles of every text of a block, as ascending hashes one text after another."""

    def __init__(self, texts: pa.Array, words: int) -> None:
        data, offsets = B.text_bytes(texts)
        data = data + np.uint8(32) * ((data >= 0x41) & (data <= 0x5A)).astype(np.uint8)
        starts, ends, at = B.word_spans(data, offsets)
        hashes = B.word_hashes(data, starts, ends)
        windows = B.window_hashes(hashes, words)
        ok = B.inside(at, words, len(windows))
        sizes = np.diff(at)
        short = np.flatnonzero((sizes > 0) & (sizes < words))
        whole = [B.window_hashes(hashes[at[i] : at[i + 1]], int(sizes[i]))[0] for i in short]
        owner = np.concatenate([np.repeat(np.arange(len(sizes)), sizes)[: len(windows)][ok], short])
        values = np.concatenate([windows[ok], np.array(whole, np.uint64)])
        order = np.lexsort((values, owner))
        owner, values = owner[order], values[order]
        new = np.append(True, (owner[1:] != owner[:-1]) | (values[1:] != values[:-1]))[: len(values)]
        self.values, self.at = values[new], np.searchsorted(owner[new], np.arange(len(sizes) + 1))

    def of(self, row: int) -> np.ndarray:
        return self.values[self.at[row] : self.at[row + 1]]


def samples_of(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MinHash values (32 bits) of the runs of ``values`` that begin at ``starts``: runs x samples."""
    head = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), SAMPLES), np.uint32)
    for i in range(SAMPLES):
        x = head * _MULTIPLY[i] + _ADD[i]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(12)
        out[:, i] = np.minimum.reduceat(x, starts)
    return out


def sketches(found: Shingles) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every text: two sums that name its set, its bands, and its odd sketch. Long texts are sampled in slices."""
    n = len(found.at) - 1
    lowest = np.full((n, SAMPLES), 2**32 - 1, np.uint32)
    sums = np.zeros((2, n), np.uint64)
    total = len(found.values)
    for low in range(0, total, SLICE):
        part = found.values[low : low + SLICE]
        first = int(np.searchsorted(found.at, low, side="right")) - 1
        last = int(np.searchsorted(found.at, low + len(part), side="left"))
        rows = np.arange(first, last)
        rows = rows[found.at[rows + 1] > np.maximum(found.at[rows], low)]
        starts = np.maximum(found.at[rows] - low, 0)
        lowest[rows] = np.minimum(lowest[rows], samples_of(part, starts))
        for j, named in enumerate((B.mix(part), B.mix(part ^ _SECOND))):
            sums[j, rows] += np.add.reduceat(named, starts)
    number = np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)
    tagged = B.mix(lowest.astype(np.uint64) | number)
    bands = np.zeros((n, BANDS), np.uint64)
    for i in range(ROWS):
        bands = B.mix(bands ^ tagged[:, i::ROWS])
    cells = (tagged % np.uint64(BITS)).astype(np.int64)
    odd = np.zeros((n, BITS), np.uint8)
    np.bitwise_xor.at(odd, (np.repeat(np.arange(n), SAMPLES), cells.ravel()), 1)
    return sums[0], sums[1], bands, np.packbits(odd, axis=1)


def _binary(rows: np.ndarray) -> pa.Array:
    """One binary value for each row of a matrix."""
    width = rows.shape[1] * rows.itemsize
    offsets = pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32))
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(np.ascontiguousarray(rows))])


def sketch_rows(blocks: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body in zip(batch.column("block").to_pylist(), batch.column("body")):
                docs = B.unpack(body.as_py())
                found = Shingles(docs.column(1), words)
                s1, s2, bands, odd = sketches(found)
                n = docs.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, block)), pa.array(np.arange(n, dtype=np.int32)), docs.column(0).cast(pa.int64()), pa.array(np.diff(found.at).astype(np.int64)),
                     pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), _binary(bands), _binary(odd)],
                    names=["block", "row", "doc_id", "n_shingles", "s1", "s2", "bands", "sketch"])
            give_back()

    return blocks.mapInArrow(tidy(run), SKETCH_SCHEMA)


def matrix(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    """The rows of a binary column of fixed width as a matrix."""
    joined = b"".join(v.as_py() for v in column)
    return np.frombuffer(joined, dtype).reshape(-1, width)


def _runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Rows sorted by the keys, one table for each run of equal keys; a run may go on in the next batch."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        columns = [part.column(k).to_numpy() for k in keys]
        change = np.zeros(part.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        edges = np.concatenate([[0], np.flatnonzero(change) + 1, [part.num_rows]])
        same = held and all(held[-1].column(k)[-1].as_py() == part.column(k)[0].as_py() for k in keys)
        if held and not same:
            yield pa.concat_tables(held)
            held = []
        for start, stop in zip(edges[:-1].tolist(), edges[1:].tolist()):
            held.append(part.slice(start, stop - start))
            if stop < part.num_rows:
                yield pa.concat_tables(held)
                held = []
    if held:
        yield pa.concat_tables(held)


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = np.array(found, np.int64).reshape(-1, 2).T
    return pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b)})


def forest_of(nodes: np.ndarray, near) -> list[tuple[int, int]]:
    """Links of a spanning forest; ``near(at, waiting)`` marks the waiting members that a member is linked with."""
    forest, waiting = Forest(len(nodes)), np.arange(len(nodes))
    while len(waiting):
        front, waiting = [int(waiting[0])], waiting[1:]
        while front and len(waiting):
            at = front.pop()
            found = near(at, waiting)
            for other in waiting[found].tolist():
                forest.link(at, other)
                front.append(other)
            waiting = waiting[~found]
    return [(int(nodes[a]), int(nodes[b])) for a, b in forest.links]


def candidate_links(sets: DataFrame, flips: int) -> DataFrame:
    """Pairs ``a, b`` of nodes whose links connect all sets that share a band and have sketches within ``flips`` bits."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = matrix(batch.column("bands"), np.int64, BANDS)
            for i in range(BANDS):
                yield pa.RecordBatch.from_pydict({"key": pa.array(bands[:, i]), "node": batch.column("node")})

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, "key"):
            if run.num_rows < 2:
                continue
            odd = matrix(run.column("sketch"), np.uint64, BITS // 64)

            def near(at: int, waiting: np.ndarray) -> np.ndarray:
                return np.bitwise_count(odd[waiting] ^ odd[at]).sum(axis=1) <= flips

            found = forest_of(run.column("node").to_numpy(), near)
            if found:
                yield _pairs(found)

    # what is dealt by band is only names: sketches join the few that share one
    spread_sets = sets.select("node", "bands").mapInArrow(tidy(spread), "key long, node long")
    shared = spread_sets.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    met = settle(spread_sets.join(shared, "key"), "bands")
    hot = met.where(F.col("members") > HOT)
    star = hot.join(hot.groupBy("key").agg(F.min("node").alias("least")), "key").select(F.col("node").alias("a"), F.col("least").alias("b")).where("a != b")
    small = met.where(F.col("members") <= HOT).join(sets.select("node", "sketch"), "node").select("key", "node", "sketch")
    return small.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(solve), "a long, b long").union(star)


class Part:
    """Sets that are searched together: an index from shingles to their holders, and the sketches."""

    def __init__(self, table: pa.Table, flips: int, percent: int) -> None:
        self.nodes = table.column("node").to_numpy()
        bodies = [np.frombuffer(v.as_py(), np.uint64) for v in table.column("shingles")]
        self.sizes = np.array([len(b) for b in bodies], np.int64)
        self.odd = matrix(table.column("sketch"), np.uint64, BITS // 64)
        self.flips, self.percent = flips, percent
        values = np.concatenate(bodies) if bodies else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(bodies)), self.sizes)
        self.terms, code, count = np.unique(values, return_inverse=True, return_counts=True)
        self.own, self.at = code, np.append(0, np.cumsum(self.sizes))
        self.holders = owner[np.argsort(code, kind="stable")]
        self.first = np.append(0, np.cumsum(count))

    def near(self, at: int, waiting: np.ndarray) -> np.ndarray:
        """The waiting members within the flips of the sketch whose full sets meet the threshold."""
        found = np.bitwise_count(self.odd[waiting] ^ self.odd[at]).sum(axis=1) <= self.flips
        if not found.any():
            return found
        mine = self.own[self.at[at] : self.at[at + 1]]
        if found.sum() <= 4:
            shared = np.zeros(len(self.nodes), np.int64)
            for other in waiting[found].tolist():
                shared[other] = np.isin(self.own[self.at[other] : self.at[other + 1]], mine).sum()
        else:
            holders = np.concatenate([self.holders[self.first[c] : self.first[c + 1]] for c in mine.tolist()])
            shared = np.bincount(holders, minlength=len(self.nodes))
        both = shared[waiting]
        return found & (100 * both >= self.percent * (self.sizes[at] + self.sizes[waiting] - both))


def _search(members: DataFrame, flips: int, percent: int) -> DataFrame:
    """Verified links among the rows of equal ``group, part``."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, "group", "part"):
            if run.num_rows > 1:
                part = Part(run, flips, percent)
                found = forest_of(part.nodes, part.near)
                if found:
                    yield _pairs(found)

    told = members.select("group", "part", "node", "sketch", "shingles")
    return told.repartition("group", "part").sortWithinPartitions("group", "part").mapInArrow(tidy(solve), "a long, b long")


def near_duplicate_sets(docs: DataFrame, words: int = 5, percent: int = 85, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document: classes linked at ``percent`` Jaccard similarity.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. A-Z are lower-cased; words are runs of bytes other
    than ASCII white space. The set is the distinct shingles of ``words`` words; with fewer words the whole sequence is
    one, without words (null, empty or blank text) the set is empty and linked with nothing. ``component_id`` is the
    smallest ``doc_id`` that can be reached by links, the own one included; a null ``doc_id`` is never the smallest, and
    classes of nulls only have none. ``kept`` is whether the two are the same (null and null too). Repeated rows come
    back as often as they are there. An empty table gives no rows.

    Sets are compared by 64-bit hashes of shingles. A pair at the threshold is missed with a probability below 3e-9
    (bands and sketch together), and less the more alike it is; no link outside the threshold is ever made.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be 50 to 100")
    flips = most_flips(percent / 100)
    blocks = B.as_blocks(docs, "doc_id", "text", block_bytes=block_bytes)
    rows = settle(sketch_rows(blocks, words), "sketches")
    named = ["s1", "s2", "n_shingles"]
    place = F.min(F.struct("block", "row"))
    distinct = rows.where("n_shingles > 0").groupBy(*named).agg(F.min("doc_id").alias("least"), place.alias("at"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    sets = settle(distinct.withColumn("node", F.monotonically_increasing_id()), "sets")
    groups = components(candidate_links(sets, flips)).select("node", F.col("root").alias("group"))
    joined = sets.select("node", "at", "sketch", F.col("n_shingles").alias("n")).join(groups, "node")
    parts = groups.join(sets.select("node", "n_shingles"), "node").groupBy("group").agg(F.ceil(F.sum(F.col("n_shingles") * 8) / part_bytes).alias("parts")).where("parts > 1")
    placed = salted_join(joined, parts, ["group"], "node", how="left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    wanted = placed.select(F.col("at.block").alias("block"), F.col("at.row").alias("row"), "node", "group", "part", "parts", "sketch")

    def fetch(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["node", "group", "part", "parts", "sketch", "shingles"]
        bodies: list[bytes] = []
        if right.num_rows and left.num_rows:
            texts = B.unpack(left.column("body")[0].as_py()).column(1).take(right.column("row").combine_chunks())
            found = Shingles(texts, words)
            bodies = [found.of(i).tobytes() for i in range(right.num_rows)]
        out = pa.table([*[right.column(c) for c in names[:-1]], pa.array(bodies, pa.binary())], names=names)
        give_back()
        return out

    full = blocks.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(fetch, "node long, group long, part long, parts long, sketch binary, shingles binary")
    members = settle(full, "shingle-sets")
    links = _linked(members, flips, percent, part_bytes)
    roots = components(links).select("node", "root")
    named_sets = sets.select(*named, "node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named_sets = settle(named_sets, "classes")
    least = named_sets.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = salted_join(named_sets.select(*named, "root", "node"), least, ["root"], "node").select(*named, "component_id")
    told = salted_join(rows.select("doc_id", "block", "row", *named), classes, named, "block", "row", how="left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return told.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _linked(members: DataFrame, flips: int, percent: int, part_bytes: int) -> DataFrame:
    """Verified links that connect all sets of each group that are within the threshold."""
    large = members.where("parts > 1")
    if large.isEmpty():
        return _search(members, flips, percent)
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    columns = ["node", "group", "parts", "sketch", "shingles"]
    pivots = large.groupBy("group").agg(F.array(*[F.min_by("node", F.xxhash64(F.lit(i), "node")) for i in range(PIVOTS)]).alias("pivots"))
    chosen = pivots.select(F.explode("pivots").alias("node")).distinct()
    visiting = large.join(chosen, "node").select(*columns, F.col("part").alias("home"), everywhere).where("part != home").drop("home")
    first = settle(_search(members.select(*columns, "part").unionByName(visiting), flips, percent), "links")
    roots = settle(components(first), "roots")
    # the roots connect what the first links do, in stars
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(_visits(large, roots, flips, percent, part_bytes))


def _visits(large: DataFrame, roots: DataFrame, flips: int, percent: int, part_bytes: int) -> DataFrame:
    """Links of members outside the main component of their group, each compared with all parts of the group."""
    told = large.select("node", "group").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = told.groupBy("group", "root").agg(F.count("*").alias("n"))
    main = sizes.groupBy("group").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    outside = settle(salted_join(told, main, ["group"], "node").where("root != main").select("node"), "outside")
    if outside.isEmpty():
        return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).limit(0)
    visitors = large.join(outside, "node")
    chunks = visitors.groupBy("group").agg(F.ceil(F.sum(F.length("shingles")) / part_bytes).alias("chunks"))
    chunk = F.pmod(F.xxhash64(F.lit(1), "node"), F.col("chunks"))
    columns = ["node", "group", "sketch", "shingles"]
    every = visitors.join(chunks, "group").select(*columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("p"), "chunks", chunk.alias("c"), "part")
    # a visitor's own part is searched already, but other visitors of the chunk are met only here
    residents = salted_join(large, chunks, ["group"], "node").select(*columns, F.col("part").alias("p"), "chunks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("c"))
    both = every.where("p != part").select(*columns, (F.col("p") * F.col("chunks") + F.col("c")).alias("part")).unionByName(
        residents.select(*columns, (F.col("p") * F.col("chunks") + F.col("c")).alias("part")))
    return _search(both, flips, percent)

"""Document fingerprints by winnowing.

Every run of ``gram`` code points has a rolling polynomial hash; of every ``window`` neighbouring hashes the smallest is
kept, the rightmost one on ties. Whatever two texts share in ``window + gram - 1`` or more code points in a row therefore
leaves a common hash in both. A fingerprint is the list of kept hashes with their positions.

``edited_neighbours`` also fingerprints a text edited with its neighbour's words. Documents are dealt by ranges of
their identifier and streamed in order; the first document of a range is sent to the range before as well, so every
document meets its neighbour without any task seeing more than its range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from babelgauge.llm.repeats import index_among
from babelgauge.llm.work import share_package, tidy

GRAM, WINDOW = 16, 32
CHUNK = 1 << 18  # code points hashed together
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_BASE = 0x5851F42D4C957F2D
_PLACE = np.uint64((1 << 28) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_FORWARD = _powers(_BASE, CHUNK + 64)
_BACKWARD = _powers(pow(_BASE, -1, 1 << 64), CHUNK + 64)


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def rolling(codes: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all runs of ``gram`` code points, from running sums in pieces of bounded size."""
    out = np.empty(max(0, len(codes) - gram + 1), np.uint64)
    for at in range(0, len(out), CHUNK):
        n = min(CHUNK, len(out) - at)
        piece = scrambled(codes[at : at + n + gram - 1].astype(np.uint64))
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece * _FORWARD[: len(piece)] if len(piece) <= len(_FORWARD) else piece * _powers(_BASE, len(piece)), out=sums[1:])
        out[at : at + n] = (sums[gram : gram + n] - sums[:n]) * _BACKWARD[:n]
    return scrambled(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def winnow(texts: list[str], gram: int = GRAM, window: int = WINDOW) -> list[tuple[np.ndarray, np.ndarray]]:
    """Positions and 32-bit hashes of every text's fingerprint. Equal texts have equal ones.

    A text shorter than a gram is one gram; fewer grams than a window are one window; an empty text keeps nothing.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.cumsum(lengths) - lengths
    hashes = rolling(codes, gram)
    keys = (hashes & ~_PLACE) | (_PLACE - (np.arange(len(hashes), dtype=np.uint64) & _PLACE))  # ties: the larger place
    least = sliding_min(keys, window) if len(keys) >= window else keys[:0]
    out = []
    for at, n in zip(begin.tolist(), lengths.tolist()):
        grams = n - gram + 1
        if grams >= window:
            run = least[at : at + grams - window + 1]
            kept = run[np.flatnonzero(np.append(True, run[1:] != run[:-1]))]
        elif grams > 0:
            kept = keys[at : at + grams].min(keepdims=True)
        elif n:
            alone = rolling(codes[at : at + n], n)
            out.append((np.zeros(1, np.uint32), (alone >> np.uint64(32)).astype(np.uint32)))
            continue
        else:
            kept = keys[:0]
        place = (_PLACE - (kept & _PLACE)).astype(np.int64)
        out.append(((place - at).astype(np.uint32), (hashes[place] >> np.uint64(32)).astype(np.uint32)))
    return out


def as_string(print_: tuple[np.ndarray, np.ndarray]) -> str:
    """16 hex digits for each kept hash: its position, then the hash."""
    return np.stack(print_, axis=1).astype(">u4").tobytes().hex()


def likeness(a: set[int], b: set[int]) -> float:
    """Share of common hashes among all; 1 for two empty fingerprints."""
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def ordered_ranges(told: DataFrame, ranges: int) -> tuple[Column, int]:
    """The range of every row of ``told (doc_id, text, hash)``, 0 holding the largest ids, and the first range of null ids.

    Bounds come from a quantile sketch. An identifier (or null) that alone is more than a range's share of the rows has
    ranges of its own, even stretches of the text hashes, by which equal ids are ordered.
    """
    steps = [k / ranges for k in range(1, ranges)] or [0.5]
    counted = told.agg(F.count("*").alias("n"), F.percentile_approx("doc_id", F.array(*map(F.lit, steps)), 10 * ranges).alias("cuts")).first()
    share = max(1, -(-counted["n"] // ranges))
    hot = {r["doc_id"]: -(-r["n"] // share) for r in told.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > share).collect()}  # fewer than ranges
    ids = [x for x in hot if x is not None]
    bounds = sorted({*(counted["cuts"] or []), *ids, *(x - 1 for x in ids if x > -(2**63))})
    segment_of = {x: len(bounds) - sum(b < x for b in bounds) for x in ids} | {None: len(bounds) + 1}
    pieces = {segment_of[x]: n for x, n in hot.items()}
    starts = [0]
    for segment in range(len(bounds) + 1):
        starts.append(starts[-1] + pieces.get(segment, 1))
    segment = F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(F.lit(len(bounds)) - index_among(F.col("doc_id"), bounds))
    start = F.get(F.array(*map(F.lit, starts)), segment)
    many = F.get(F.array(*[F.lit(pieces.get(k, 1)) for k in range(len(starts))]), segment)
    place = F.floor((F.col("hash").cast("double") / 2.0**64 + 0.5) * many)  # descending hashes: the largest first
    return (start + many - 1 - F.least(place, many - 1)).cast("int"), starts[-1]


def edited_neighbours(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every text and of the text edited with its neighbour, and how alike they are.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Documents follow each other by descending
    ``doc_id`` (null ones last; equal ids by a hash of the text), after the last comes the first. The edited text has its
    last ``n // 2`` code points replaced by the first as many of the next document (or all it has). Returns ``doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``, one row per input row.

    A null text is empty. A single document is its own neighbour. An empty table gives no rows. Ranges of the order are
    the tasks; ids that many rows share are several ranges, rows equal in id and text are neighbours in one.
    """
    spark = docs.sparkSession
    share_package(spark)
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    told = told.withColumn("hash", F.xxhash64("text"))
    of, _ = ordered_ranges(told, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = told.withColumn("range", of)
    found = dealt.groupBy("range").agg(F.max(F.struct("doc_id", "hash")).alias("top")).collect()  # one row per range
    tops = {r["range"]: r["top"] for r in found}
    order = sorted(tops)
    size = (order[-1] if order else 0) + 1
    before = {r: order[k - 1] for k, r in enumerate(order)}  # the last range comes before the first

    def by_range(values: dict[int, int]) -> Column:
        return F.get(F.array(*[F.lit(values.get(r, 0)).cast("long") for r in range(size)]), F.col("range"))

    top_id = by_range({r: t["doc_id"] or 0 for r, t in tops.items()})
    guest = (F.col("doc_id").isNull() | (F.col("doc_id") == top_id)) & (F.col("hash") == by_range({r: t["hash"] for r, t in tops.items()}))
    own = F.struct(F.col("range").cast("long").alias("at"), F.lit(False).alias("guest"))
    both = F.when(guest, F.array(own, F.struct(by_range(before).alias("at"), F.lit(True).alias("guest")))).otherwise(F.array(own))
    sent = dealt.select("doc_id", "text", "hash", F.explode(both).alias("to")).select(F.col("to.at").cast("int").alias("at"), "to.guest", "doc_id", "text", "hash")
    ordered = sent.repartitionById(size, F.col("at")).sortWithinPartitions("at", "guest", F.col("doc_id").desc_nulls_last(), F.col("hash").desc()).drop("hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int | None, str]] = []  # waiting, in order; the last one waits for its neighbour
        size, range_, done = 0, None, False

        def out() -> pa.RecordBatch:
            texts = [t for _, t in rows]
            edited = [t[: len(t) - len(t) // 2] + nxt[: len(t) // 2] for t, nxt in zip(texts[:-1], texts[1:])]
            prints = winnow(texts + edited, gram, window)
            sets = [set(h.tolist()) for _, h in prints]
            n, m = len(edited), len(texts)
            return pa.RecordBatch.from_pydict({
                "doc_id": pa.array([d for d, _ in rows[:n]], pa.int64()),
                "n_chars": pa.array([len(t) for t in texts[:n]], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], pa.string()),
                "fingerprint": pa.array([as_string(p) for p in prints[:n]], pa.string()),
                "edited_fingerprint": pa.array([as_string(p) for p in prints[m:]], pa.string()),
                "near_edited": pa.array([likeness(sets[i], sets[m + i]) for i in range(n)], pa.float64()),
                "near_next": pa.array([likeness(sets[i], sets[i + 1]) for i in range(n)], pa.float64()),
            })

        few = (batch.slice(i, 64) for batch in batches for i in range(0, batch.num_rows, 64))  # texts as Python strings are few
        for batch in few:
            for at, is_guest, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if at != range_:
                    rows, size, range_, done = [], 0, at, False
                if done:
                    continue
                rows.append((doc_id, text))
                size += len(text)
                if is_guest or size > CHUNK:
                    if len(rows) > 1:
                        yield out()
                        rows, size, done = rows[-1:], len(text), is_guest

    return ordered.mapInArrow(tidy(run), SCHEMA)

"""Documents in blocks, and the exchange of per-block dictionaries.

Several operators need, for every window (word, gram) of a document, a fact about the whole corpus. Shuffling one row
per occurrence would move many times the input. Here documents are cut into blocks of bounded size; a block sends each
*distinct* key once, dealt by hash into buckets, a bucket settles the facts of its keys over all blocks, and the answers
come back to the blocks that asked. A key that a third of all documents hold costs one entry per block.

A block is one row: an identifier and a compressed Arrow record batch. Blocks are written to the shared folder once, so
retried tasks and later steps see the same blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from babelgauge.llm.work import give_back, settle, share_package, tidy

BLOCK_BYTES = 8 << 20  # text of a block; one longer document is a block of its own
BLOCK_SCHEMA = "block long, body binary"
MAIL_SCHEMA = "bucket long, block long, body binary"
_ZSTD = pa.ipc.IpcWriteOptions(compression="zstd")


def pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_ZSTD) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(body: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(pa.py_buffer(body)) as reader:
        return reader.read_next_batch()


def pack_arrays(**columns: np.ndarray) -> bytes:
    return pack(pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()}))


def unpack_arrays(body: bytes) -> dict[str, np.ndarray]:
    batch = unpack(body)
    return {name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names}


def as_blocks(docs: DataFrame, *columns: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The named columns (the last one is the text) in blocks of bounded bytes, as a written table."""

    share_package(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            body = pack(table.to_batches()[0])
            return pa.RecordBatch.from_pydict({"block": pa.array([(part << 33) + serial], pa.int64()), "body": pa.array([body], pa.binary())})

        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            lengths = pa.compute.fill_null(pa.compute.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16
            start = 0
            ends = np.cumsum(lengths)
            while start < batch.num_rows:
                base = ends[start - 1] if start else 0
                stop = int(np.searchsorted(ends, base + block_bytes - size, side="right"))
                if stop == start and not held:
                    stop = start + 1
                if stop > start:
                    held.append(batch.slice(start, stop - start))
                    size += int(ends[stop - 1] - base)
                if stop < batch.num_rows:
                    yield block()
                    serial, held, size = serial + 1, [], 0
                start = stop
        if held:
            yield block()

    return settle(docs.select(*[F.col(c) for c in columns]).mapInArrow(tidy(cut), BLOCK_SCHEMA), "blocks")


def bucket_count(blocks: DataFrame) -> int:
    """As many buckets as blocks (a power of two), so that a bucket's share of keys is about what a block holds."""
    n = blocks.select("block").count()
    return 1 << max(3, (max(1, n) - 1).bit_length())


def deal(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """The slices of sorted 64-bit keys that belong to each bucket (by the leading bits)."""
    bits = np.uint64(64 - (buckets.bit_length() - 1))
    edges = np.searchsorted(keys, np.arange(buckets, dtype=np.uint64) << bits)
    edges = np.append(edges, len(keys))
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), slice(int(edges[b]), int(edges[b + 1]))


def send(blocks: DataFrame, write: Callable[[pa.RecordBatch], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """What each block sends, as rows of ``MAIL_SCHEMA``. ``write`` gets a block's record batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body in zip(batch.column("block").to_pylist(), batch.column("body")):
                yield from mail(block, write(unpack(body.as_py())))

    return blocks.mapInArrow(tidy(run), MAIL_SCHEMA)


def mail(block: int, letters: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    for bucket, body in letters:
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int64()), "block": pa.array([block], pa.int64()), "body": pa.array([body], pa.binary())})


def answer(letters: DataFrame, settle_bucket: Callable[[int, list[int], list[dict[str, np.ndarray]]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """What each bucket answers, as rows of ``MAIL_SCHEMA``. ``settle_bucket`` gets its number, the asking blocks and their arrays."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        bucket = table.column("bucket")[0].as_py()
        asked = table.column("block").to_pylist()
        arrays = [unpack_arrays(body.as_py()) for body in table.column("body")]
        out = list(settle_bucket(bucket, asked, arrays))
        del arrays
        give_back()
        return pa.table({"bucket": pa.array([bucket] * len(out), pa.int64()), "block": pa.array([b for b, _ in out], pa.int64()), "body": pa.array([x for _, x in out], pa.binary())})

    return letters.groupBy("bucket").applyInArrow(run, MAIL_SCHEMA)


def with_answers(blocks: DataFrame, answers: DataFrame, use: Callable[[int, pa.RecordBatch, list[dict[str, np.ndarray]]], pa.Table], schema: str) -> DataFrame:
    """``use`` for every block with the answers it got, in the order of the buckets."""
    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return empty
        right = right.sort_by("bucket")
        replies = [unpack_arrays(body.as_py()) for body in right.column("body")]
        try:
            return use(left.column("block")[0].as_py(), unpack(left.column("body")[0].as_py()), replies)
        finally:
            give_back()

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def letters_table(block: int, letters: Iterator[tuple[int, bytes]]) -> pa.Table:
    """Letters of one block as a table, for blocks that write again after reading their answers."""
    out = list(letters)
    return pa.table({"bucket": pa.array([b for b, _ in out], pa.int64()), "block": pa.array([block] * len(out), pa.int64()), "body": pa.array([x for _, x in out], pa.binary())})


# --- words -----------------------------------------------------------------------------------------------------------

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_FORWARD, _BACKWARD = _powers(_BASE, _CHUNK + 1), _powers(_INVERSE, _CHUNK + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column and the n + 1 offsets of its texts. A null text is empty."""
    column = pa.compute.fill_null(column, "").cast(pa.large_binary())
    _, offsets, values = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the n + 1 word offsets of the texts."""
    solid = ~SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] |= solid[inner]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[inner - 1] |= solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word: a polynomial over random values of its bytes, from running sums."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, low + _CHUNK, side="right")))
        piece = data[low : ends[stop - 1]]
        if len(piece) > _CHUNK:  # one huge word
            total, values = 0, _BYTE[piece]
            for i in range(0, len(piece), _CHUNK):
                part = values[i : i + _CHUNK]
                total = (total + int((part * _FORWARD[: len(part)]).sum(dtype=np.uint64)) * pow(_BASE, i, 1 << 64)) % (1 << 64)
            out[at] = total
        else:
            run = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(_BYTE[piece] * _FORWARD[: len(piece)], out=run[1:])
            s = starts[at:stop] - low
            out[at:stop] = (run[ends[at:stop] - low] - run[s]) * _BACKWARD[s]
        at = stop
    return mix(out ^ mix((ends - starts).astype(np.uint64)))


def window_hashes(words: np.ndarray, length: int, base: int = _BASE) -> np.ndarray:
    """Hashes of all windows of ``length`` words over one run of words (windows across texts are the caller's to skip)."""
    n = max(0, len(words) - length + 1)
    out = np.zeros(n, np.uint64)
    for i in range(length):
        out *= np.uint64(base)
        out += words[i : i + n]
    return mix(out)


def inside(word_offsets: np.ndarray, length: int, n_windows: int) -> np.ndarray:
    """Which windows lie in one text."""
    ok = np.ones(n_windows, bool)
    for end in word_offsets[1:-1]:
        ok[max(0, end - length + 1) : end] = False
    return ok


def signed(doc_ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers as integers and which of them are null; a null one counts as larger than all others."""
    null = pa.compute.is_null(doc_ids).to_numpy(zero_copy_only=False)
    return pa.compute.fill_null(doc_ids.cast(pa.int64()), 2**63 - 1).to_numpy(zero_copy_only=False), null



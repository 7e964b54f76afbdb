"""Collocations by best-first branch-and-bound growth of phrases.

Phrases grow to the right, word by word. A phrase with count a under a prefix p with count f(p) has a <= f(p), and the cut
after its first word w alone gives it a score of at most floor(SCALE * f(p) / (f(w) + f(p))): the bound of every phrase
that grows from p. Two-word phrases are counted first. The best of each language are expanded, with every prefix whose
bound reaches them: their three-word phrases are counted, which tells which of the best are dropped for a longer phrase.
The 2000th survivor gives a threshold that only rises from there; what grows from a prefix with a lower bound is never
counted. Three-word phrases are treated alike. Growth ends when nothing with a bound at the threshold or above is open, so
the first 2000 and their ties are settled. If too few survive, the frontier of that language is widened and counted anew.

Counting runs over blocks (see ``blocks``). Words that are too rare to be in a candidate are zeros in a block of word
numbers, as are the borders of pieces; numbers are exact names, so no phrase is known by a hash. A block asks once for
each distinct phrase, hash buckets add up the counts, and blocks are told which phrases to grow. Blocks write letters to
all buckets, which is a product of two numbers that grow with the input, so blocks are large and buckets as few as memory
allows. Texts and first numbers are removed as soon as nothing reads them any more, so the disk holds one form of the
input at a time.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from babelgauge.llm import blocks as B
from babelgauge.llm.work import give_back, settle, tidy
from babelgauge.session import release

BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAP = BREAK.copy()
GAP[[0x20, 0x09]] = True
BLOCK_BYTES = 8 << 20
PART_BYTES = 4 << 20  # text of a block that is parsed at once
STEP = 1 << 19  # positions whose phrases are looked up at once
MAIL_BYTES = 1 << 20  # letters of a block in an Arrow batch
BUCKET_SIZE = 1 << 22  # words of the corpus for each bucket
SCALE = 2_000_000
KEEP, EXPAND = np.int8(1), np.int8(2)  # flags: both neighbours are wanted; what grows from it is wanted
MAIL = B.MAIL_SCHEMA
_MAIL = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("body", pa.binary())])
_CODEC = pa.Codec("zstd")
COUNT_SCHEMA = "bucket long, hi long, lo long, a long"


class Words:
    """The words of a block: spans, hashes (of language and word), and where a phrase cannot go on."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.langs = batch.column(0).fill_null("und").dictionary_encode()
        data, offsets = B.text_bytes(batch.column(1))
        self.data = data + np.uint8(32) * ((data >= 0x41) & (data <= 0x5A)).astype(np.uint8)
        solid = ~GAP[data]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        first[inner] |= solid[inner]
        last[inner - 1] |= solid[inner - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        at = np.searchsorted(self.starts, offsets)
        doc = np.repeat(np.arange(batch.num_rows), np.diff(at))
        pieces = np.searchsorted(np.flatnonzero(BREAK[data]), self.starts) + doc
        self.new_piece = np.append(True, pieces[1:] != pieces[:-1])[: len(pieces)]
        self.lang = self.langs.indices.to_numpy(zero_copy_only=False)[doc]
        lang_data, lang_offsets = B.text_bytes(self.langs.dictionary)
        named = B.word_hashes(lang_data, lang_offsets[:-1], lang_offsets[1:])
        self.keys = B.mix(B.word_hashes(self.data, self.starts, self.ends) + B.mix(named)[self.lang])


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A block in parts of bounded text; one longer text is a part of its own."""
    ends = np.cumsum(np.diff(B.text_bytes(batch.column(1))[1]) + 16)
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PART_BYTES, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _first(code: np.ndarray, n: int) -> np.ndarray:
    """Where each of n codes occurs first."""
    at = np.zeros(n, np.int64)
    at[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    return at


def _coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the values among the distinct ones, and these, by a hash table."""
    d = pa.array(values).dictionary_encode()
    return d.indices.to_numpy(), d.dictionary.to_numpy()


def _ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the values among the distinct ones in order, and these."""
    code, distinct = _coded(values)
    order = np.argsort(distinct)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[code], distinct[order]


def parsed(blocks: DataFrame) -> DataFrame:
    """``block, size, body, words``, written: every block as numbers of its own distinct words (0 between pieces), and
    these words with language, count and leading hash bits, in the order of their hashes. Texts are read this once."""

    def part(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array]:
        code, keys = _coded(w.keys)
        at = _first(code, len(keys))
        numbers = np.insert((code + 1).astype(np.uint32), np.flatnonzero(w.new_piece), np.uint32(0))
        sizes = w.ends[at] - w.starts[at]
        offsets = np.append(0, np.cumsum(sizes))
        letters = np.repeat(w.starts[at] - offsets[:-1], sizes) + np.arange(offsets[-1])
        words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(w.data[letters]))
        return numbers, keys, np.bincount(code, minlength=len(keys)), w.langs.dictionary.take(pa.array(w.lang[at])).cast(pa.large_string()), words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body in zip(batch.column("block").to_pylist(), batch.column("body")):
                numbers, keys, counts, langs, words = zip(*(part(Words(x)) for x in _parts(B.unpack(body.as_py()))))
                starts = np.cumsum([0, *map(len, keys)])
                code, keys = _ranked(np.concatenate(keys))
                at = _first(code, len(keys))
                number = (code + 1).astype(np.uint32)
                ids = np.concatenate([np.append(np.uint32(0), number[i:j])[x] for x, i, j in zip(numbers, starts[:-1], starts[1:])])
                c = np.zeros(len(keys), np.int64)
                np.add.at(c, code, np.concatenate(counts))
                words = pa.concat_arrays(words).take(pa.array(at))
                named = pa.RecordBatch.from_arrays([pa.concat_arrays(langs).take(pa.array(at)), words, pa.array(c), pa.array((keys >> np.uint64(32)).astype(np.uint32))], names=["lang", "word", "c", "bits"])
                size = len(ids) + int(pa.compute.sum(pa.compute.binary_length(words)).as_py() or 0) // 8
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "size": pa.array([size], pa.int64()),
                                                  "body": pa.array([B.pack_arrays(ids=ids)], pa.binary()), "words": pa.array([B.pack(named)], pa.binary())})
                give_back()

    return settle(blocks.mapInArrow(tidy(run), "block long, size long, body binary, words binary"), "parsed")


def bucket_count(own: DataFrame) -> int:
    """As many buckets (a power of two) as keep a bucket's share within bounds, however many blocks there are: a letter
    to each bucket from each block has then a size that pays."""
    size = own.agg(F.sum("size")).first()[0] or 0
    return 1 << max(3, (-(-size // BUCKET_SIZE) - 1).bit_length())


def asked_words(own: DataFrame, buckets: int) -> DataFrame:
    """The distinct words of every block to the buckets of their hashes, written. ``first``: how many are before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body in zip(batch.column("block").to_pylist(), batch.column("words")):
                named = B.unpack(body.as_py())
                bits = named.column("bits").to_numpy().astype(np.uint64) << np.uint64(32)
                named = named.select(["lang", "word", "c"])
                letters = ((b, named.slice(at.start, at.stop - at.start), at.start) for b, at in B.deal(bits, buckets))
                yield from _mailed(block, ((b, B.pack(x.append_column("first", pa.array(np.full(x.num_rows, first))))) for b, x, first in letters))

    return settle(own.select("block", "words").mapInArrow(tidy(run), MAIL), "words")


def known_words(letters: DataFrame, least: int, buckets: int) -> DataFrame:
    """What the buckets know of their words, written. Rows with ``word``: the words with at least this count, and a number
    of each. Rows with ``lang`` alone: its number of words. Rows with ``block``: the block's own numbers and the new ones.

    Numbers are given out by turns, so they are dense, no two buckets have the same, and no global order is needed.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        bucket = table.column("bucket")[0].as_py()
        parts = [B.unpack(x.as_py()) for x in table.column("body")]
        lang, word, c, first = pa.Table.from_batches(parts).combine_chunks().to_batches()[0].columns
        lang = lang.dictionary_encode()
        named = pa.compute.binary_join_element_wise(lang.indices.cast(pa.large_string()), word, pa.scalar(" ", pa.large_string())).dictionary_encode()
        code, n = named.indices.to_numpy(), len(named.dictionary)
        f, total = np.zeros(n, np.int64), np.zeros(len(lang.dictionary), np.int64)
        np.add.at(f, code, c.to_numpy())
        np.add.at(total, lang.indices.to_numpy(), c.to_numpy())
        frequent = np.flatnonzero(f >= least)
        number = np.zeros(n, np.int64)
        number[frequent] = np.arange(len(frequent)) * buckets + bucket + 1
        if len(frequent) and number[frequent[-1]] >> 32:
            raise OverflowError("more words than numbers of 32 bits")
        ids, own = number[code].astype(np.uint32), first.to_numpy().astype(np.uint32)
        replies, start = [], 0
        for block, x in zip(table.column("block").to_pylist(), parts):
            at = np.flatnonzero(ids[start : start + x.num_rows])
            if len(at):
                replies.append((block, B.pack_arrays(key=own[start] + 1 + at.astype(np.uint32), id=ids[start + at])))
            start += x.num_rows
        at = pa.array(_first(code, n)[frequent])
        del parts
        give_back()
        k, m, r = len(frequent), len(total), len(replies)
        return pa.table({
            "bucket": pa.array(np.full(k + m + r, bucket)),
            "block": pa.array([None] * (k + m) + [b for b, _ in replies], pa.int64()),
            "body": pa.array([None] * (k + m) + [x for _, x in replies], pa.binary()),
            "lang": pa.concat_arrays([lang.dictionary.take(lang.indices.take(at)), lang.dictionary, pa.nulls(r, pa.large_string())]).cast(pa.string()),
            "word": pa.concat_arrays([word.take(at), pa.nulls(m + r, pa.large_string())]).cast(pa.string()),
            "f": pa.concat_arrays([pa.array(f[frequent]), pa.array(total), pa.nulls(r, pa.int64())]),
            "id": pa.concat_arrays([pa.array(number[frequent]), pa.nulls(m + r, pa.int64())]),
        })

    return settle(letters.groupBy("bucket").applyInArrow(run, f"{MAIL}, lang string, word string, f long, id long"), "word-numbers")


def numbered(own: DataFrame, answers: DataFrame) -> DataFrame:
    """Blocks of word numbers of the whole corpus: 0 for rare words and between pieces, one after another only where
    something is."""

    def use(block: int, batch: pa.RecordBatch, replies: list[dict[str, np.ndarray]]) -> pa.Table:
        ids = batch.column("ids").to_numpy(zero_copy_only=False)
        table = np.zeros(int(ids.max(initial=0)) + 1, np.uint32)
        for r in replies:
            table[r["key"]] = r["id"]
        numbers = table[ids]
        numbers = numbers[(numbers > 0) | np.append(True, numbers[:-1] > 0)[: len(numbers)]]
        return pa.table({"block": pa.array([block], pa.int64()), "body": pa.array([B.pack_arrays(ids=numbers)], pa.binary())})

    return settle(B.with_answers(own.select("block", "body"), answers, use, B.BLOCK_SCHEMA), "numbered")


def grams(ids: np.ndarray, length: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of all phrases of this length (of the wanted ones), and their names: two words in a number."""
    n = max(0, len(ids) - length + 1)
    ok = ids[:n] > 0 if wanted is None else (ids[:n] > 0) & wanted[:n]
    for i in range(1, length):
        ok &= ids[i : i + n] > 0
    at = np.flatnonzero(ok)
    wide = [ids[at + i].astype(np.uint64) for i in range(length)] + [np.uint64(0)] * (4 - length)
    lo = wide[2] << np.uint64(32) | wide[3] if length > 2 else np.zeros(len(at), np.uint64)
    return at, wide[0] << np.uint64(32) | wide[1], lo


def letters_of(hi: np.ndarray, lo: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Distinct phrases with their counts, dealt to buckets by a hash, in order in each."""
    hi, lo, counts = _distinct(hi, lo)
    counts = counts.astype(np.uint32)
    bucket = (B.mix(hi ^ B.mix(lo + np.uint64(1))) >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    hi, lo, bucket, counts = hi[order], lo[order], bucket[order], counts[order]
    edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)]), len(bucket))
    for start, stop in zip(edges[:-1].tolist(), edges[1:].tolist()):
        part = slice(start, stop)
        yield int(bucket[start]), _packed(hi[part], lo[part], c=counts[part])


def pairs(blocks: DataFrame, buckets: int) -> DataFrame:
    """Letters with all two-word phrases of the blocks, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body in zip(batch.column("block").to_pylist(), batch.column("body")):
                ids = B.unpack_arrays(body.as_py())["ids"]
                hi = np.concatenate([grams(ids[i : i + STEP + 1], 2)[1] for i in range(0, max(1, len(ids)), STEP)])
                yield from _mailed(block, letters_of(hi, np.zeros(len(hi), np.uint64), buckets))
                give_back()

    return settle(blocks.mapInArrow(tidy(run), MAIL), "letters")


def _distinct(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct names in order, and how often each is there."""
    if not lo.any():
        hi.sort()
        first = np.flatnonzero(np.append(True, hi[1:] != hi[:-1])[: len(hi)])
        return hi[first], lo[: len(first)], np.diff(np.append(first, len(hi)))
    (a, his), (b, los) = _ranked(hi), _ranked(lo)
    key = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return his[key[first] >> np.uint64(32)], los[key[first] & np.uint64(0xFFFFFFFF)], np.diff(np.append(first, len(key)))


def _packed(hi: np.ndarray, lo: np.ndarray, **more: np.ndarray) -> bytes:
    """Names word by word and one more column, without the overhead of an Arrow stream, which is larger than a small
    letter. Names are in order, so steps of the first word are small numbers and compress well."""
    low = np.uint64(0xFFFFFFFF)
    words = [hi >> np.uint64(32), hi & low, lo >> np.uint64(32), lo & low]
    columns = [x.astype(np.uint32) for i, x in enumerate(words) if i < 2 or x.any()]
    columns[0] = np.diff(columns[0], prepend=np.uint32(0))
    (last,) = more.values()
    return struct.pack("<IBB", len(hi), len(columns), last.itemsize) + _CODEC.compress(b"".join([*(x.tobytes() for x in columns), last.tobytes()]), asbytes=True)


def _read(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, k, size = struct.unpack_from("<IBB", body)
    data = _CODEC.decompress(memoryview(body)[6:], n * (4 * k + size))
    words = [*np.frombuffer(data, np.uint32, n * k).reshape(k, n).astype(np.uint64), *[np.zeros(n, np.uint64)] * (4 - k)]
    first = np.cumsum(words[0]) & np.uint64(0xFFFFFFFF)
    return first << np.uint64(32) | words[1], words[2] << np.uint64(32) | words[3], np.frombuffer(data, {1: np.int8, 4: np.uint32}[size], n, 4 * k * n)


def _mailed(block: int, letters: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """The letters of a block, about a MB in a batch."""
    held, size = [], 0
    for letter in letters:
        held.append(letter)
        size += len(letter[1])
        if size > MAIL_BYTES:
            yield B.letters_table(block, iter(held)).cast(_MAIL).to_batches()[0]
            held, size = [], 0
    if held:
        yield B.letters_table(block, iter(held)).cast(_MAIL).to_batches()[0]


def totals(letters: DataFrame, least: int) -> DataFrame:
    """``bucket, hi, lo, a`` of all phrases with at least this count, written."""

    def run(table: pa.Table) -> pa.Table:
        bucket, parts = table.column("bucket")[0].as_py(), [_read(x.as_py()) for x in table.column("body")]
        names = pa.table(dict(zip(("hi", "lo", "a"), (np.concatenate(x) for x in zip(*parts)))))
        del parts
        found = names.group_by(["hi", "lo"], use_threads=False).aggregate([("a", "sum")])
        found = found.filter(pa.compute.field("a_sum") >= least)
        hi, lo, a = (found.column(x).to_numpy() for x in ("hi", "lo", "a_sum"))
        del names, found
        give_back()
        return pa.table({"bucket": pa.array(np.full(len(a), bucket)), "hi": pa.array(hi.view(np.int64)), "lo": pa.array(lo.view(np.int64)), "a": pa.array(a.astype(np.int64))})

    return settle(letters.groupBy("bucket").applyInArrow(run, COUNT_SCHEMA), "totals")


def told(letters: DataFrame, flagged: DataFrame) -> DataFrame:
    """Letters back to the blocks: those of their phrases that are in ``flagged (bucket, hi, lo, flag)``."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, bytes]] = []
        if left.num_rows and right.num_rows:
            bucket = left.column("bucket")[0].as_py()
            hi, lo, flag = right.column("hi").to_numpy().view(np.uint64), right.column("lo").to_numpy().view(np.uint64), right.column("flag").to_numpy().astype(np.int8)
            names = [_read(body.as_py())[:2] for body in left.column("body")]
            place = find(hi, lo, *(np.concatenate(x) for x in zip(*names)))
            start = 0
            for block, (mine_hi, mine_lo) in zip(left.column("block").to_pylist(), names):
                mine = place[start : start + len(mine_hi)]
                start += len(mine_hi)
                at = np.flatnonzero(mine >= 0)
                if len(at):
                    out.append((bucket, block, _packed(mine_hi[at], mine_lo[at], flag=flag[mine[at]])))
        give_back()
        return pa.table({"bucket": pa.array([x[0] for x in out], pa.int64()), "block": pa.array([x[1] for x in out], pa.int64()), "body": pa.array([x[2] for x in out], pa.binary())})

    return letters.groupBy("bucket").cogroup(flagged.groupBy("bucket")).applyInArrow(run, MAIL)


def find(hi: np.ndarray, lo: np.ndarray, want_hi: np.ndarray, want_lo: np.ndarray) -> np.ndarray:
    """The places of names among distinct names; -1 for those that are not there. First halves are looked up first."""
    out = np.full(len(want_hi), -1, np.int64)
    (a, his), (b, los) = _coded(hi), _coded(lo)
    first = _places(want_hi, his)
    at = np.flatnonzero(first >= 0)
    second = _places(want_lo[at], los)
    at, second = at[second >= 0], second[second >= 0]
    out[at] = _places(first[at].astype(np.int64) << 32 | second, a.astype(np.int64) << 32 | b)
    return out


def _places(want: np.ndarray, among: np.ndarray) -> np.ndarray:
    return pa.compute.index_in(pa.array(want), value_set=pa.array(among)).fill_null(-1).to_numpy()


def grown(blocks: DataFrame, answers: DataFrame, length: int, buckets: int) -> DataFrame:
    """Letters with the phrases of ``length`` words that a block was told to grow, written.

    A phrase is counted if its first part is to be grown, or one of its two parts wants its neighbours. All its
    occurrences are then counted, in every block, because the same parts are told to every block that holds them.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _MAIL.empty_table()
        ids = B.unpack_arrays(left.column("body")[0].as_py())["ids"]
        names = [_read(body.as_py()) for body in right.column("body")] or [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int8))]
        hi, lo, flag = (np.concatenate(x) for x in zip(*names))
        marks = np.zeros(len(ids) + 1, np.int8)
        for start in range(0, len(ids), STEP):
            at, want_hi, want_lo = grams(ids[start : start + STEP + length - 2], length - 1)
            place = find(hi, lo, want_hi, want_lo)
            marks[start + at[place >= 0]] = flag[place[place >= 0]]
        _, want_hi, want_lo = grams(ids, length, ((marks[:-1] & (KEEP | EXPAND)) > 0) | ((marks[1:] & KEEP) > 0))
        out = B.letters_table(left.column("block")[0].as_py(), letters_of(want_hi, want_lo, buckets))
        give_back()
        return out

    return settle(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, MAIL), "letters")


def score(a: Column, *pair: Column) -> Column:
    """floor(SCALE * a / (sum of the pair)), exact however large the counts are."""
    total = sum((c.cast("decimal(38,0)") for c in pair[1:]), pair[0].cast("decimal(38,0)"))
    product = a.cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(8,0)")
    return F.call_function("div", product, total.cast("decimal(28,0)"))


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, share: int = 80, block_bytes: int = BLOCK_BYTES, frontier: int | None = None) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the first ``top`` surviving phrases of every language.

    ``docs`` needs ``lang`` and ``text``; other columns are ignored. A-Z are lower-cased, texts are split at
    ``.,;:!?`` and line ends into pieces and those at blanks and tabs into words. Candidates are phrases of 2 to 4 words of
    one piece with a count ``a`` of at least ``least``, overlaps included. The cut with the lowest score
    floor(2000000 * a / (l + r)) counts, of equal ones the leftmost. A candidate goes if a longer candidate holds it and
    has at least ``share`` percent of its count. Order: score and ``a`` descending, then the phrase by UTF-8 bytes.
    ``n`` is the number of words of the language.

    A null language is ``und`` (together with documents that say ``und``); a null or empty text has no words. Repeated
    rows count as often as they are there; texts of any length are read whole. Languages without candidates have no rows;
    an empty table gives none. ``frontier`` is how many two-word phrases of a language are expanded first (32 times
    ``top`` if not given); it does not change the result. In a block (some MB of text) words are told apart by 64-bit hashes.
    """
    frontier = frontier or 32 * top
    blocks = B.as_blocks(docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")), "lang", "text", block_bytes=block_bytes)
    own = parsed(blocks)
    release(blocks)
    buckets = bucket_count(own)
    asked = asked_words(own, buckets)
    known = known_words(asked, least, buckets)
    release(asked)
    n = known.where("block IS NULL AND word IS NULL").groupBy("lang").agg(F.sum("f").alias("n"))  # one row a language
    words = known.where("word IS NOT NULL").select("id", "lang", "word", "f")
    encoded = numbered(own, known.where("block IS NOT NULL").select("bucket", "block", "body"))
    release(own)

    letters = pairs(encoded, buckets)
    f = words.select("id", "f")
    two = _with(totals(letters, least), f, "l", _word(1))
    two = _with(_with(two, f, "r", _word(2)), words.select("id", "lang"), "lang", _word(1))
    two = settle(two.withColumn("score", score(F.col("a"), F.col("l"), F.col("r"))).withColumn("bound", score(F.col("a"), F.col("l"), F.col("a"))), "pairs")

    wide = frontier
    while True:
        order = Window.partitionBy("lang").orderBy(F.col("score").desc())
        best = two.select("lang", "score").withColumn("i", F.row_number().over(order)).where(F.col("i") <= wide)
        edge = best.groupBy("lang").agg(F.min("score").alias("edge"), (F.count("*") < wide).alias("whole"))
        edge = settle(edge.withColumn("edge", F.when(F.col("whole"), F.lit(0)).otherwise(F.col("edge"))), "edge")  # one row a language
        open_ = two.join(edge, "lang")
        flags = F.when(F.col("score") >= F.col("edge"), int(KEEP)).otherwise(0) + F.when(F.col("bound") >= F.col("edge"), int(EXPAND)).otherwise(0)
        letters3 = grown(encoded, told(letters, open_.withColumn("flag", flags).where("flag > 0").select("bucket", "hi", "lo", "flag")), 3, buckets)
        three = totals(letters3, least)
        kept2 = _survivors(open_.where(F.col("score") >= F.col("edge")), three, share).select(*two.columns)
        settled = settle(kept2, "survivors")
        limit = settled.withColumn("i", F.row_number().over(order)).where(F.col("i") == top).select("lang", F.col("score").alias("limit"))
        limit = settle(edge.join(limit, "lang", "left").withColumn("limit", F.coalesce("limit", F.when(F.col("whole"), F.lit(0)))), "limits")
        if limit.where("limit IS NULL").isEmpty():
            break
        release(letters3, three)
        wide *= 4
    limit = limit.select("lang", "limit")

    three = _scored_three(three, two, words, limit)
    flags = F.when(F.col("score") >= F.col("limit"), int(KEEP)).otherwise(0) + F.when(F.col("bound") >= F.col("limit"), int(EXPAND)).otherwise(0)
    letters4 = grown(encoded, told(letters3, three.withColumn("flag", flags).where("flag > 0").select("bucket", "hi", "lo", "flag")), 4, buckets)
    four = totals(letters4, least)
    kept3 = _survivors(three.where(F.col("score") >= F.col("limit")), four, share)
    kept4 = _scored_four(four, three, two, words, limit, encoded, letters, buckets, least)

    columns = ["lang", "hi", "lo", "a", "l", "r", "score"]
    kept2 = settled.join(limit, "lang").where(F.col("score") >= F.col("limit"))
    found = kept2.select(*columns).unionByName(kept3.select(*columns)).unionByName(kept4.select(*columns))
    found = settle(found, "found")
    named = found
    for i in range(1, 5):
        named = named.join(words.select(F.col("id").alias(f"w{i}"), F.col("word").alias(f"t{i}")), _word(i) == F.col(f"w{i}"), "left").drop(f"w{i}")
    phrase = F.concat_ws(" ", *[F.col(f"t{i}") for i in range(1, 5)])
    place = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = named.withColumn("phrase", phrase).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    out = ranked.join(n, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def _word(i: int) -> Column:
    """The number of the i-th word of a name; 0 if there is none."""
    half = F.col("hi") if i <= 2 else F.col("lo")
    return F.shiftrightunsigned(half, 32) if i % 2 else half.bitwiseAND(F.lit(0xFFFFFFFF))


def _pair(first: int) -> Column:
    """The name of the two words from the first on."""
    return F.shiftleft(_word(first), 32).bitwiseOR(_word(first + 1))


def _with(df: DataFrame, table: DataFrame, name: str, key: Column) -> DataFrame:
    """``name``: the second column of ``table`` where its first is the key; null where it is not there."""
    found = table.select(F.col(table.columns[0]).alias("__key"), F.col(table.columns[1]).alias(name))
    return df.join(found, key == F.col("__key"), "left").drop("__key")


def _survivors(phrases: DataFrame, longer: DataFrame, share: int) -> DataFrame:
    """The phrases without those that a phrase one word longer holds with at least ``share`` percent of the count.

    One word is enough: what a phrase two words longer holds, the one between has at least as often.
    """
    heads = longer.select(F.col("hi").alias("h"), F.when(_word(4) == 0, F.lit(0)).otherwise(F.shiftleft(_word(3), 32)).alias("o"), "a")
    tails = longer.select(_pair(2).alias("h"), F.when(_word(4) == 0, F.lit(0)).otherwise(F.shiftleft(_word(4), 32)).alias("o"), "a")
    most = heads.union(tails).groupBy("h", "o").agg(F.max("a").alias("most"))
    joined = phrases.join(most, (F.col("hi") == F.col("h")) & (F.col("lo") == F.col("o")), "left")
    stays = 100 * F.coalesce("most", F.lit(0)).cast("decimal(38,0)") < share * F.col("a").cast("decimal(38,0)")
    return joined.where(stays).drop("h", "o", "most")


def _lowest(cuts: list[tuple[Column, Column]]) -> tuple[Column, Column, Column]:
    """l, r and score of the cut with the lowest score, the leftmost of equal ones. Cuts with an unknown count give way."""
    each = [F.struct(score(F.col("a"), l, r).alias("s"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")) for k, (l, r) in enumerate(cuts, 1)]
    known = F.array_min(F.filter(F.array(*each), lambda c: c["s"].isNotNull()))
    return known["l"], known["r"], known["s"]


def _scored_three(three: DataFrame, two: DataFrame, words: DataFrame, limit: DataFrame) -> DataFrame:
    f, pair = words.select("id", "f"), two.select("hi", "a")
    df = _with(_with(three, f, "f1", _word(1)), f, "f3", _word(3))
    df = _with(_with(df, pair, "p1", F.col("hi")), pair, "p2", _pair(2))
    df = _with(df, words.select("id", "lang"), "lang", _word(1)).join(limit, "lang")
    l, r, s = _lowest([(F.col("f1"), F.col("p2")), (F.col("p1"), F.col("f3"))])
    return settle(df.withColumn("score", s).withColumn("l", l).withColumn("r", r).withColumn("bound", score(F.col("a"), F.col("f1"), F.col("a"))), "triples")


def _scored_four(four: DataFrame, three: DataFrame, two: DataFrame, words: DataFrame, limit: DataFrame, encoded: DataFrame, letters: DataFrame, buckets: int, least: int) -> DataFrame:
    """Four-word phrases that reach the limit. Nothing is longer, so they stay."""
    f, pair = words.select("id", "f"), two.select("hi", "a")

    def cuts(df: DataFrame, triples: DataFrame) -> DataFrame:
        head = triples.select(F.col("hi").alias("h1"), F.col("lo").alias("o1"), F.col("a").alias("t1"))
        tail = triples.select(F.col("hi").alias("h2"), F.col("lo").alias("o2"), F.col("a").alias("t2"))
        df = df.join(head, (F.col("h1") == F.col("hi")) & (F.col("o1") == F.shiftleft(_word(3), 32)), "left")
        df = df.join(tail, (F.col("h2") == _pair(2)) & (F.col("o2") == F.shiftleft(_word(4), 32)), "left")
        l, r, s = _lowest([(F.col("f1"), F.col("t2")), (F.col("p1"), F.col("p2")), (F.col("t1"), F.col("f4"))])
        return df.withColumn("score", s).withColumn("l", l).withColumn("r", r)

    df = _with(_with(four, f, "f1", _word(1)), f, "f4", _word(4))
    df = _with(_with(df, pair, "p1", F.col("hi")), pair, "p2", _pair(3))
    df = _with(df, words.select("id", "lang"), "lang", _word(1)).join(limit, "lang")
    df = settle(cuts(df, three).where(F.col("score") >= F.col("limit")), "quadruples")
    # the parts that no bound asked for and that decide now; a first part that was not counted has a bound below the limit
    missing = df.where("t2 IS NULL AND t1 IS NOT NULL").select(_pair(2).alias("pair")).distinct()
    open_ = two.join(missing, F.col("hi") == F.col("pair"), "left_semi")
    if open_.isEmpty():
        return df.where("t1 IS NOT NULL")
    more = totals(grown(encoded, told(letters, open_.select("bucket", "hi", "lo", F.lit(int(EXPAND)).alias("flag"))), 3, buckets), least)
    both = three.select("hi", "lo", "a").union(more.select("hi", "lo", "a")).distinct()
    again = cuts(df.where("t1 IS NOT NULL").drop("h1", "o1", "t1", "h2", "o2", "t2", "score", "l", "r"), both)
    return again.where(F.col("score") >= F.col("limit"))

"""Per-row sufficient statistics of prediction/reference pairs, as Arrow functions.

A text pair is one row, so its n-grams never have to leave the row: matching is map-side work and only a
handful of counts per row reaches the shuffle. The functions work on runs of rows (integer codes and one sort
per order), not row by row. A batch is cut into pieces of about ``SLICE`` symbols before anything is made of it,
so memory stays flat whatever the batch holds.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

from babelgauge.functions.stems import porter
from babelgauge.functions.subwords import cut, load_ranks
from babelgauge.functions.text import CLEAN_13A, PUNCTUATION, SPACE_CHARACTERS, SPACE_POINTS

# Workers get this module with the function, so they need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICE = 1 << 18  # symbols whose arrays stay in the cache of a core


class Side:
    """One side of a batch: integer symbol codes of all rows end to end, and the length of every row."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray):
        self.codes, self.lengths = codes, lengths

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lengths)), self.lengths)


def _pieces(*arrays: pa.Array) -> Iterator[list[pa.Array]]:
    """The arrays in row ranges of at most SLICE tokens or bytes; a longer single row is a range of its own."""
    measured = [pc.list_value_length(a) if pa.types.is_list(a.type) else pc.binary_length(a) for a in arrays]
    ends = np.concatenate(([0], np.cumsum(sum(pc.fill_null(m, 0).to_numpy(zero_copy_only=False).astype(np.int64) for m in measured))))
    start = 0
    while start < len(arrays[0]):
        stop = max(int(np.searchsorted(ends, ends[start] + SLICE, side="right")) - 1, start + 1)
        yield [a.slice(start, stop - start) for a in arrays]
        start = stop


def _joined(parts: list[pa.Array]) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int64()))


# What a byte means to the tokenisers. All their marks, and the neighbours that they ask for, are ASCII.
BLANK, APART, DIGIT, POINT, HYPHEN, MARK = 1, 2, 4, 8, 16, 32
BYTES = np.zeros(256, np.uint8)
for _characters, _kind in (("".join(chr(p) for p in SPACE_POINTS if p < 0x80), BLANK), ("!\"#$%&()*+/:;<=>?@[\\]^_`{|}~", APART),
                           ("0123456789", DIGIT), (".,", POINT), ("-", HYPHEN), (PUNCTUATION, MARK)):
    BYTES[np.frombuffer(_characters.encode(), np.uint8)] |= _kind
WIDE_BLANKS = [chr(p).encode() for p in SPACE_POINTS if p >= 0x80]
LEADS = sorted({blank[0] for blank in WIDE_BLANKS})


def _raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where every text begins (with the end of the last)."""
    texts = texts.cast(pa.large_string())
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def _blanks(data: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Which bytes are white space; a wide blank is two or three of them."""
    blank = (kinds & BLANK) > 0
    if (data >= 0x80).any():
        for lead in LEADS:
            at = np.flatnonzero(data == lead)
            for wide in (w for w in WIDE_BLANKS if w[0] == lead):
                found = at[at + len(wide) <= len(data)]
                for i, byte in enumerate(wide[1:], 1):
                    found = found[data[found + i] == byte]
                for i in range(len(wide)):
                    blank[found + i] = True
    return blank


def _cut_13a(kinds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the mteval 13a rules put a blank in front of a byte. ``first`` marks where texts begin.

    A rule reads its neighbours as the rules before have left them, and no character twice: of neighbouring points every
    other one is taken as "after no digit", from the first or the second, by what stands before them.
    """
    size = len(kinds)
    cut = np.zeros(size + 1, bool)
    digit = (kinds & DIGIT) > 0

    def apart(at: np.ndarray) -> None:
        cut[at] = True
        cut[at + 1] = True

    def after_digit(at: np.ndarray) -> np.ndarray:
        return ~first[at] & digit[at - 1]

    apart(np.flatnonzero(kinds & APART))
    point = np.flatnonzero(kinds & POINT)
    opens = np.ones(len(point), bool)
    opens[1:] = (point[1:] != point[:-1] + 1) | first[point[1:]]
    start = point[opens][np.cumsum(opens) - 1]
    taken = ((point - start) % 2 == 0) ^ after_digit(start)
    beyond = np.minimum(point + 1, size - 1)
    before_digit = (point + 1 < size) & ~first[beyond] & digit[beyond]
    apart(point[taken | ~before_digit])
    hyphen = np.flatnonzero(kinds & HYPHEN)
    apart(hyphen[after_digit(hyphen)])
    return cut[:size]


def _split(texts: pa.Array, rule: str) -> tuple[pa.Array, np.ndarray]:
    """The tokens of texts by ``rule`` (``13a``, ``chrf``, else between white space) end to end, and how many each text has:
    what the column expressions ``tokens_13a``, ``chrf_words`` and ``pieces`` make, from byte classes instead of regular
    expressions."""
    data, offsets = _raw(pc.fill_null(texts, ""))
    if rule == "13a" and any((data == ord(sign)).any() for sign in "<&\n"):  # nothing to clean without these
        texts = pc.utf8_rtrim(texts, SPACE_CHARACTERS)
        for old, new in CLEAN_13A:
            texts = pc.replace_substring(texts, old, new)
        data, offsets = _raw(pc.fill_null(texts, ""))
    kinds = BYTES[data]
    blank = _blanks(data, kinds)
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    first = first[:-1]
    begins = first.copy()
    begins[1:] |= blank[:-1]
    if rule == "13a":
        begins |= _cut_13a(kinds, first)
    kept = ~blank
    start = np.flatnonzero(begins & kept)
    gone = np.append(0, np.cumsum(blank, dtype=np.int64))
    letters, at, rows = data[kept], start - gone[start], offsets - gone[offsets]
    if rule == "chrf" and len(at):  # one trailing, else one leading mark of words of more than a character
        end = np.append(at[1:], len(letters))
        mark = (kinds[kept] & MARK) > 0
        trailing = mark[end - 1] & (end - at > 1)
        leading = mark[at] & (end - at > 1) & ~trailing
        at = np.sort(np.concatenate((at, end[trailing] - 1, at[leading] + 1)))
    ends = np.append(at, len(letters))
    tokens = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(letters)])
    return tokens, np.diff(np.searchsorted(at, rows))


def _flat(array: pa.Array, rule: str | None) -> tuple[pa.Array, np.ndarray]:
    """Tokens end to end and how many each row has, of token lists or of texts."""
    if pa.types.is_list(array.type):
        return array.flatten().cast(pa.large_string()), pc.fill_null(pc.list_value_length(array), 0).to_numpy().astype(np.int64)
    return _split(array, rule)


def _token_sides(arrays: tuple[pa.Array, ...], lower: bool = False, rule: str | None = None) -> tuple[list[Side], pa.Array]:
    """Token lists, or texts that ``rule`` splits, as codes over one shared dictionary, and that dictionary."""
    flat = [_flat(array, rule) for array in arrays]
    encoded = pa.concat_arrays([tokens for tokens, _ in flat]).dictionary_encode()
    codes, words = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary
    sides, at = [], 0
    for _, lengths in flat:
        sides.append(Side(codes[at:at + lengths.sum()], lengths))
        at += lengths.sum()
    return _folded(sides, words) if lower else (sides, words)


KNOWN = 1 << 17  # words that a task keeps with what was made of them; most occurrences are of few


def _made(words: pa.Array, make, known: dict) -> list:
    """``make`` of every word. ``known`` keeps results from batch to batch."""
    if len(known) > KNOWN:
        known.clear()
    out = []
    for word in words.to_pylist():
        found = known.get(word)
        if found is None:
            found = known[word] = make(word)
        out.append(found)
    return out


def _piece_sides(sides: list[Side], words: pa.Array, ranks: dict[bytes, int], known: dict) -> tuple[list[Side], int]:
    """The words as codes of their subword pieces, and how many pieces there are: the dictionary is cut, not the texts."""
    found = _made(words, lambda word: cut(b" " + word.encode(), ranks), known)
    sizes = np.array([len(f) for f in found], np.int64)
    pieces, codes = np.unique(np.array([i for f in found for i in f], np.int64), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    out = []
    for side in sides:
        each = sizes[side.codes]
        ends = np.append(0, np.cumsum(each))
        at = np.arange(ends[-1]) - np.repeat(ends[:-1] - starts[side.codes], each)
        out.append(Side(codes[at].astype(np.int64), np.diff(ends[np.append(0, np.cumsum(side.lengths))])))
    return out, len(pieces)


def _character_sides(*arrays: pa.Array) -> tuple[list[Side], int]:
    """Strings as character codes over one shared alphabet, white space left out."""
    texts = [pc.fill_null(array, "") for array in arrays]
    points = [np.frombuffer("".join(a.to_pylist()).encode("utf-32-le"), np.uint32) for a in texts]
    size = max([int(p.max()) + 1 for p in points if len(p)], default=0)
    present = np.flatnonzero(sum(np.bincount(p, minlength=size) for p in points))
    table = np.zeros(max(size, max(SPACE_POINTS) + 1), np.int64)
    table[present] = np.arange(1, len(present) + 1)
    table[SPACE_POINTS] = 0
    sides = []
    for text, point in zip(texts, points):
        codes = table[point]
        kept = np.concatenate(([0], np.cumsum(codes > 0)))
        ends = np.concatenate(([0], np.cumsum(pc.utf8_length(text).to_numpy())))
        sides.append(Side(codes[codes > 0] - 1, np.diff(kept[ends])))
    return sides, max(len(present), 1)


def _clipped(hyp: Side, ref: Side, alphabet: int, orders: int) -> np.ndarray:
    """Clipped n-gram matches: rows x orders.

    Where row, gram and side fit a 64-bit number, one sort serves all orders: shorter grams are beginnings of longer ones.
    Many symbols are first numbered within their row.
    """
    rows = len(hyp.lengths)
    codes, row = np.concatenate((hyp.codes, ref.codes)), np.concatenate((hyp.row, ref.row))
    room = 62 - max(rows - 1, 0).bit_length()
    if len(codes) and alphabet.bit_length() * orders > room:
        held, place = np.unique(row * alphabet + codes, return_inverse=True)
        place = place - np.searchsorted(held, np.arange(rows) * alphabet)[row]
        if (int(place.max()) + 1).bit_length() * orders <= room:
            codes, alphabet = place, int(place.max()) + 1
    if alphabet.bit_length() * orders > room:
        return _clipped_by_order(hyp, ref, alphabet, orders)
    bits, size = alphabet.bit_length(), len(hyp.codes)
    side = np.repeat((0, 1), (size, len(ref.codes)))
    # every text is followed by zeros, which no symbol is, so that no gram runs into the next text
    at = np.arange(len(codes)) + (row + side * rows) * (orders - 1)
    spaced = np.zeros(len(codes) + 2 * rows * (orders - 1) + orders - 1, np.int64)
    spaced[at] = codes + 1
    grams = spaced[:len(spaced) - orders + 1].copy()
    for i in range(1, orders):
        grams <<= bits
        grams |= spaced[i:len(spaced) - orders + 1 + i]
    key = ((row << (bits * orders) | grams[at]) << 1) | side
    key.sort()
    change = key[1:] ^ key[:-1]
    in_ref = np.append(0, np.cumsum(key & 1, dtype=np.int32))
    out = np.zeros((rows, orders), np.int64)
    for order in range(1, orders + 1):
        shift = 1 + bits * (orders - order)
        bounds = np.concatenate(([0], np.flatnonzero(change >= 1 << shift) + 1, [len(key)]))
        first = key[bounds[:-1][:len(key)]] >> shift
        theirs = np.diff(in_ref[bounds])[:len(first)]
        found = np.minimum(theirs, np.diff(bounds)[:len(first)] - theirs)
        met = np.flatnonzero((found > 0) & (first & ((1 << bits) - 1) > 0))
        out[:, order - 1] = np.bincount(first[met] >> (bits * order), weights=found[met], minlength=rows)
    return out


def _clipped_by_order(hyp: Side, ref: Side, alphabet: int, orders: int) -> np.ndarray:
    """The same with a sort for every order, for any number of symbols."""
    rows = len(hyp.lengths)
    codes = np.concatenate((hyp.codes, ref.codes))
    row = np.concatenate((hyp.row, ref.row))
    side = np.repeat((0, 1), (len(hyp.codes), len(ref.codes)))
    text = row * 2 + side
    out = np.zeros((rows, orders), np.int64)
    gram, values = codes, alphabet
    for order in range(1, orders + 1):
        if order > 1:
            if values * alphabet * rows * 2 >= 1 << 62:  # re-number the grams before the key overflows
                gram = np.unique(gram, return_inverse=True)[1].astype(np.int64)
                values = int(gram.max(initial=0)) + 1
            gram = gram[:-1] * alphabet + codes[order - 1:]
            values *= alphabet
        size = len(gram)
        if size == 0:
            break
        whole = text[:size] == text[order - 1:]  # the gram does not run into the next text
        key = ((row[:size] * values + gram) * 2 + side[:size])[whole]
        key.sort()
        first = np.flatnonzero(np.concatenate((key[:1] == key[:1], key[1:] != key[:-1])))
        count = np.diff(np.append(first, len(key)))
        key = key[first]
        both = np.flatnonzero((key[:-1] % 2 == 0) & (key[1:] == key[:-1] + 1))
        out[:, order - 1] = np.bincount(key[both] // (2 * values),
                                        weights=np.minimum(count[both], count[both + 1]), minlength=rows)
    return out


def _counts(sides: list[Side], alphabet: int, orders: int) -> pa.Array:
    """Per row: the matches of every order, then the two lengths."""
    hyp, ref = sides
    table = np.column_stack((_clipped(hyp, ref, alphabet, orders), hyp.lengths, ref.lengths))
    offsets = pa.array(np.arange(len(table) + 1) * (orders + 2), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(table.ravel()))


def token_overlap(prediction: Column, reference: Column, orders: int, rule: str | None = None) -> Column:
    """``array<long>`` of two ``array<string>`` columns: clipped n-gram matches of order 1..n, both lengths. With a ``rule``
    (``13a``, ``chrf``, ``ranks:<path>``) of two string columns, which are split in the same pass."""
    path = rule[6:] if rule and rule.startswith("ranks:") else None
    ranks: dict[bytes, int] = {}
    known: dict[str, list[int]] = {}

    def coded(piece: list[pa.Array]) -> tuple[list[Side], int]:
        sides, words = _token_sides(tuple(piece), rule=rule)
        if path is None:
            return sides, len(words)
        if not ranks:
            ranks.update(load_ranks(path))
        return _piece_sides(sides, words, ranks, known)

    @F.arrow_udf("array<bigint>")
    def token_overlap_udf(hyp: pa.Array, ref: pa.Array) -> pa.Array:
        found = map(coded, _pieces(hyp, ref))
        return _joined([_counts(sides, max(alphabet, 1), orders) for sides, alphabet in found])

    return token_overlap_udf(prediction, reference)


def overlap_and_alignment(prediction: Column, reference: Column, orders: int, rule: str) -> Column:
    """``token_overlap`` of two string columns followed by the matches and chunks of their ``alignment``: split once."""

    def counted(piece: list[pa.Array]) -> pa.Array:
        sides, words = _token_sides(tuple(piece), rule=rule)
        folded, small = _folded(sides, words)
        hyp, ref = sides
        table = np.column_stack((_clipped(hyp, ref, max(len(words), 1), orders), hyp.lengths, ref.lengths,
                                 _align([tuple(folded)], max(len(small), 1))))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1) * (orders + 4), pa.int32()), pa.array(table.ravel()))

    @F.arrow_udf("array<bigint>")
    def overlap_and_alignment_udf(hyp: pa.Array, ref: pa.Array) -> pa.Array:
        return _joined([counted(piece) for piece in _pieces(hyp, ref)])

    return overlap_and_alignment_udf(prediction, reference)


def character_overlap(prediction: Column, reference: Column, orders: int) -> Column:
    """The same over the characters of two string columns, white space left out."""

    @F.arrow_udf("array<bigint>")
    def character_overlap_udf(hyp: pa.Array, ref: pa.Array) -> pa.Array:
        return _joined([_counts(*_character_sides(*piece), orders) for piece in _pieces(hyp, ref)])

    return character_overlap_udf(prediction, reference)


def _common(hyp: np.ndarray, ref: np.ndarray) -> int:
    """Length of the longest common subsequence: one addition of long integers for each token (a bit for each opposite)."""
    places: dict[int, int] = {}
    for i, code in enumerate(ref.tolist()):
        places[code] = places.get(code, 0) | 1 << i
    row = whole = (1 << len(ref)) - 1
    for code in hyp.tolist():
        if code in places:
            met = row & places[code]
            row = ((row + met) | (row - met)) & whole
    return len(ref) - row.bit_count()


def common_subsequence(prediction: Column, reference: Column) -> Column:
    """``array<long>`` of two ``array<string>`` columns: length of the longest common subsequence, both lengths."""

    def counted(piece: list[pa.Array]) -> pa.Array:
        (hyp, ref), _ = _token_sides(tuple(piece))
        h, r = (np.append(0, np.cumsum(side.lengths)) for side in (hyp, ref))
        found = [_common(hyp.codes[h[i]:h[i + 1]], ref.codes[r[i]:r[i + 1]]) for i in range(len(hyp.lengths))]
        table = np.column_stack((np.array(found, np.int64), hyp.lengths, ref.lengths))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1) * 3, pa.int32()), pa.array(table.ravel()))

    @F.arrow_udf("array<bigint>")
    def common_subsequence_udf(hyp: pa.Array, ref: pa.Array) -> pa.Array:
        return _joined([counted(piece) for piece in _pieces(hyp, ref)])

    return common_subsequence_udf(prediction, reference)


def own_numbers(prediction: Column, reference: Column, row, fields: int) -> Column:
    """``array<double>``: what a user's function counts in every row."""

    @F.arrow_udf("array<double>")
    def own_numbers_udf(hyp: pa.Array, ref: pa.Array) -> pa.Array:
        found = [np.asarray(row(h.to_pylist(), r.to_pylist()), np.float64).reshape(-1, fields) for h, r in _pieces(hyp, ref)]
        table = np.concatenate(found) if found else np.zeros((0, fields))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1) * fields, pa.int32()), pa.array(table.ravel()))

    return own_numbers_udf(prediction, reference)


def _paired(hyp: np.ndarray, ref: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal keys on both sides: the first of a key with the first, the second with the second, and so on."""
    keys = np.concatenate((hyp, ref))
    bits = len(keys).bit_length()
    if len(keys) and int(keys.max()).bit_length() + bits > 62:
        keys = np.unique(keys, return_inverse=True)[1].astype(np.int64)
    key = keys << bits | np.arange(len(keys))  # the place behind the key: one sort of numbers, the predictions first
    key.sort()
    place = key & ((1 << bits) - 1)
    key >>= bits
    starts = np.flatnonzero(np.concatenate((key[:1] == key[:1], key[1:] != key[:-1])))
    size = np.diff(np.append(starts, len(key)))
    mine = np.add.reduceat(place < len(hyp), starts, dtype=np.int64) if len(starts) else size
    pairs = np.minimum(mine, size - mine)
    first = np.repeat(starts - np.cumsum(pairs) + pairs, pairs) + np.arange(pairs.sum())
    return place[first], place[first + np.repeat(mine, pairs)] - len(hyp)


def _align(stages: list[tuple[Side, Side]], alphabet: int) -> np.ndarray:
    """(matches, chunks) per row. The last free occurrence of a token pairs with the last one opposite."""
    hyp, ref = stages[0]
    rows = len(hyp.lengths)
    target = np.full(len(hyp.codes), -1, np.int64)
    taken = np.zeros(len(ref.codes), bool)
    hyp_row, ref_row = hyp.row, ref.row
    for h, r in stages:
        h_free, r_free = np.flatnonzero(target < 0)[::-1], np.flatnonzero(~taken)[::-1]
        h_at, r_at = _paired(hyp_row[h_free] * alphabet + h.codes[h_free], ref_row[r_free] * alphabet + r.codes[r_free])
        target[h_free[h_at]] = r_free[r_at]
        taken[r_free[r_at]] = True
    at = np.flatnonzero(target >= 0)
    to, row = target[at], hyp_row[at]
    start = np.ones(len(at), bool)
    start[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1) | (to[1:] != to[:-1] + 1)
    return np.stack((np.bincount(row, minlength=rows), np.bincount(row[start], minlength=rows)), axis=1)


def _folded(sides: list[Side], words: pa.Array) -> tuple[list[Side], pa.Array]:
    """The same tokens without case."""
    folded = pc.utf8_lower(words).dictionary_encode()
    codes = folded.indices.to_numpy().astype(np.int64)
    return [Side(codes[side.codes], side.lengths) for side in sides], folded.dictionary


def _stem_sides(sides: list[Side], words: pa.Array, known: dict[str, str]) -> list[Side]:
    """The same tokens as codes of their stems: the dictionary is stemmed, no token leaves its row."""
    stems = pa.array(_made(words, porter, known), pa.string()).dictionary_encode()
    code = stems.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return [Side(code[side.codes], side.lengths) for side in sides]


def alignment(*token_pairs: tuple[Column, Column], stem: bool = False, rule: str | None = None) -> Column:
    """``array<long>`` (matches, chunks, both lengths) of an alignment that pairs tokens from the end.

    Every pair of ``array<string>`` columns is one stage (surface forms, then stems or synonym classes); a
    stage sees the tokens that earlier stages left free. All stages must have equal token counts. Case is ignored.
    ``stem`` adds a stage of Porter stems right after the surface forms. String columns are split by ``rule``.
    """

    known: dict[str, str] = {}

    def aligned(piece: list[pa.Array]) -> pa.Array:
        sides, words = _token_sides(tuple(piece), lower=True, rule=rule)
        stages = list(zip(sides[::2], sides[1::2]))
        if stem:
            stages.insert(1, tuple(_stem_sides(sides[:2], words, known)))
        table = np.column_stack((_align(stages, max(len(words), 1)), sides[0].lengths, sides[1].lengths))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1) * 4, pa.int32()), pa.array(table.ravel()))

    @F.arrow_udf("array<bigint>")
    def alignment_udf(*arrays: pa.Array) -> pa.Array:
        return _joined([aligned(piece) for piece in _pieces(*arrays)])

    return alignment_udf(*[column for pair in token_pairs for column in pair])

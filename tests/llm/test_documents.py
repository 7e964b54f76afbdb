"""The document operators against brute force, on rows with nulls, repeats, long texts and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from babelgauge.llm.catalog import tokenizer_path
from babelgauge.llm.doubling_dedup import remove_repeats
from babelgauge.llm.hash_ring import ring, shard_documents, walk
from babelgauge.llm.kernel_language import UNKNOWN, Settings, fit, identify, keep_identified, sample
from babelgauge.llm.kk_packing import Encoder, differencing, pack_documents, windows_for
from babelgauge.llm.line_templates import drop_recurring_lines, line_dedup
from babelgauge.llm.pigeonring_simhash import Forest, budgets, keep_one_of_each, link_bucket, simhash_groups
from babelgauge.llm.pivotal_mix import mix_sources, take_mix
from babelgauge.llm.suffix_tree_lm import suffix_tree_scores
from babelgauge.llm.winnowing import as_string, edited_neighbours, likeness, ordered_ranges, winnow
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 2**63 - 1


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def same(a, b):
    assert Counter(a) == Counter(b)


# --- substring dedup ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("window", "seed", "block_bytes"), [(13, 7, 8 << 20), (13, 7, 2000), (9, 2, 5000)])
def test_repeated_windows(docs, rows, window, seed, block_bytes):
    words = [WORD.findall(t or "") for _, t, *_ in rows]
    first = {}
    for (doc_id, *_), w in zip(rows, words):
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, LAST), LAST if doc_id is None else doc_id)
    want = []
    for (doc_id, *_), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (LAST if doc_id is None else doc_id):
                gone |= set(range(i, i + window))
        want.append((doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    got = [tuple(r) for r in remove_repeats(docs, window, seed, block_bytes).collect()]
    same(got, want)
    assert sum(r[2] for r in got) > 500


# --- line dedup --------------------------------------------------------------------------------------------------------


def expected_lines(rows, min_docs=3, similarity=0.8, constants=5, support=3):
    def shape(line):
        return re.sub(r"[^ ]*[0-9][^ ]*", "<*>", re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" "))

    holders = defaultdict(set)
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            if shape(line):
                holders[shape(line)].add(LAST if doc_id is None else doc_id)
    leaves = defaultdict(list)
    for s in holders:
        leaves[len(s.split(" ")), tuple(s.split(" ")[:3])].append(s)
    template = {}
    for leaf, shapes in leaves.items():
        held = Counter()
        for s in shapes:
            for place, token in enumerate(s.split(" ")):
                held[place, token] += len(holders[s])
        enough = len(set().union(*(holders[s] for s in shapes))) >= min_docs and len(shapes) > 1
        for s in shapes:
            tokens = s.split(" ")
            kept = tuple((i, t) for i, t in enumerate(tokens) if t != "<*>" and (i < 3 or held[i, t] >= support))
            general = enough and len(tokens) >= constants and len(kept) >= max(constants, math.ceil(len(tokens) * similarity))
            template[s] = (leaf, kept) if general else (leaf, s)
    found = defaultdict(set)
    for s in holders:
        found[template[s]] |= holders[s]
    out = []
    for doc_id, text, *_ in rows:
        mine = LAST if doc_id is None else doc_id
        lines = [] if text is None else text.split("\n")
        kept = [x for x in lines if not shape(x) or len(found[template[shape(x)]]) < min_docs or min(found[template[shape(x)]]) == mine]
        out.append((doc_id, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_recurring_lines_go(docs, rows):
    want = expected_lines(rows)
    same([tuple(r) for r in line_dedup(docs).collect()], want)
    assert sum(w[3] for w in want) >= 11 + 8
    kept = drop_recurring_lines(docs)
    assert kept.columns == docs.columns
    same([(r.doc_id, r.text) for r in kept.collect()], [w[:2] for w in want])


def test_variable_fields_are_generalised(spark):
    lines = [(i, f"report number {i} was made by user{i} on monday for {name}") for i, name in enumerate(["ann", "bob", "cid", "dan"])]
    lines += [(9, "report number 9 was never written by any one at all")]
    got = {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(lines, "doc_id long, text string"), similarity=0.6).collect()}
    assert got[0] == lines[0][1] and got[1] == got[2] == got[3] == "" and got[9] == lines[4][1]


def test_lines_of_two_documents_go(spark, tmp_path):
    """The queries keep a line that two documents share in the smaller one only; variable fields still need three."""
    import corpus_pipeline
    from babelgauge.llm.catalog import op2_line_templates

    texts = {1: "one line of its own\nthe quick brown fox jumps over the lazy dog", 2: "the quick  brown fox jumps over the lazy dog\nlast line here",
             3: "the cat sat on a mat with ann today", 4: "the cat sat on a mat with bob today"}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.n_dropped for r in op2_line_templates(spark, str(tmp_path)).collect()} == {1: 0, 2: 1, 3: 0, 4: 0}
    kept = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, str(tmp_path)).collect()}
    assert kept == texts | {2: "last line here"}


def test_lines_of_numbers_stay(spark):
    """Digits are fields only where the other tokens make a template; equal lines of numbers still go."""
    own = [["2019 41 7", "Chapter 4", "1 2.50 3 4.75 5", "in 1990 the price was 7", "a b c 1 2", "a b c d 1 2"],
           ["1873 9 2", "Chapter 9", "6 7.25 8 9.10 0", "in 1991 the price was 8", "a b c 3 4", "a b c d 3 4"],
           ["1 2 3", "Chapter 11", "0 0.00 0 0.00 1", "in 1992 the price was 9", "a b c 5 6", "a b c d 5 6"]]
    shared, form = "10 20 30 40 50 60", "see page {} of the yearly report on water and air"
    docs = [(i, "\n".join([*x, shared, form.format(i)])) for i, x in enumerate(own)]
    for min_docs in (2, 3):
        got = {r.doc_id: r.text.split("\n") for r in line_dedup(spark.createDataFrame(docs, "doc_id long, text string"), min_docs=min_docs).collect()}
        assert got == {0: [*own[0], shared, form.format(0)], 1: own[1], 2: own[2]}


# --- SimHash -----------------------------------------------------------------------------------------------------------


def fingerprint(text, shingle):
    words = WORD.findall(lower(text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected_groups(prints, distance):
    group = {p: {p} for p in prints}
    for a in group:
        for b in group:
            if (a ^ b).bit_count() <= distance and group[a] is not group[b]:
                group[a] |= group[b]
                for x in group[b]:
                    group[x] = group[a]
    return group


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_simhash_groups(docs, rows, distance):
    prints = [fingerprint(t, 3) for _, t, *_ in rows]
    group = expected_groups(set(prints), distance)
    least = [min((d for (d, *_), q in zip(rows, prints) if q in group[p] and d is not None), default=None) for p in prints]
    got = [(r.doc_id, r.fp % 2**64, r.component_id) for r in simhash_groups(docs, 3, distance).collect()]
    same(got, [(d, p, x) for (d, *_), p, x in zip(rows, prints, least)])
    assert len({id(group[p]) for p in prints}) < len(set(prints)) or distance < 3


def test_one_of_each_group_stays(docs, rows):
    prints = [fingerprint(t, 3) for _, t, *_ in rows]
    group = expected_groups(set(prints), 3)
    best = {}
    for (d, *_), p in zip(rows, prints):
        name = min(group[p])
        best[name] = min(best.get(name, LAST), LAST if d is None else d)
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    same([r.doc_id for r in kept.collect()], [None if d == LAST else d for d in best.values()])


def test_every_close_pair_is_linked():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 300, dtype=np.uint64)
    close = base ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (300, 3)).astype(np.uint64), axis=1)
    for a, b in zip(base.tolist(), close.tolist()):  # the ring: some start keeps every chain within its budget
        diff = [((a ^ b) >> 4 * s & 15).bit_count() for s in range(16)]
        assert any(all(sum(diff[(s + i) % 16] for i in range(n)) <= budgets(3)[n - 1] for n in range(1, 17)) for s in range(16))


def test_large_buckets_are_split(monkeypatch):
    monkeypatch.setattr("babelgauge.llm.pigeonring_simhash.SMALL", 8)
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 2**12, 400, dtype=np.uint64) << np.uint64(30))
    forest = Forest(len(fps))
    for segment in range(16):
        link_bucket(fps, np.arange(len(fps)), list(range(30, 42)), segment, 3, forest)
    group = expected_groups({int(f) for f in fps}, 3)
    assert len({forest.top(i) for i in range(len(fps))}) == len({id(g) for g in group.values()})


# --- mixing ------------------------------------------------------------------------------------------------------------


def test_mix(docs, rows):
    sizes = defaultdict(int)
    for _, text, _, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    stopped, total = {}, 1.5 * sum(sizes.values())
    while True:
        rate = (total - sum(stopped.values())) / sum(weight[s] for s in order if s not in stopped)
        above = [s for s in order if s not in stopped and rate * weight[s] > 2 * sizes[s]]
        if not above:
            break
        stopped |= {s: 2 * sizes[s] for s in above}
    target = {s: stopped.get(s, rate * weight[s]) for s in order}
    got = mix_sources(docs).collect()
    assert len(got) == len(rows)
    same([(r.doc_id, r.size) for r in got], [(d, len(WORD.findall(t or ""))) for d, t, *_ in rows])
    for s in order:
        mine = [r for r in got if r.source == s]
        assert all(abs(r.target - target[s]) < 1e-6 * max(1, target[s]) and r.source_size == sizes[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= max(r.size for r in mine) / 2 + 1e-6
        assert all(r.taken == r.size * r.copies and 0 <= r.copies <= 2 for r in mine)
    same([tuple(r) for r in got], [tuple(r) for r in mix_sources(docs.repartition(3)).collect()])
    taken = take_mix(docs)
    assert taken.columns == docs.columns
    copies = Counter()
    for r in got:
        copies[r.doc_id, r.size] += r.copies
    same([(r.doc_id, len(WORD.findall(r.text or ""))) for r in taken.collect()], [k for k, n in copies.items() for _ in range(n)])


# --- packing -----------------------------------------------------------------------------------------------------------


def check_packing(found, ids_of, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    assert set(by_doc) == set(ids_of)
    for doc_id, texts in ids_of.items():
        want = Counter((start, zlib.crc32(ids[start : start + n].astype("<u4").tobytes())) for ids in texts for start, n in {(r.start, r.length) for r in by_doc[doc_id] if r.doc_tokens == len(ids)})
        assert sum(r.length for r in by_doc[doc_id]) == sum(map(len, texts))
        for r in by_doc[doc_id]:
            assert (r.start, r.ids_crc32) in want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_packing(docs, rows, name):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(name))
    ids = defaultdict(list)
    for doc_id, text, *_ in rows:
        ids[doc_id].append(np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]))
    check_packing(pack_documents(docs, tokenizer_path(name), capacity=256).collect(), ids, 256)


def test_fast_ids_are_the_tokenizers(rows):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from babelgauge.llm.blocks import text_bytes

    encoder, tokenizer = Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    assert encoder.fast is not None
    texts = [t or "" for _, t, *_ in rows] + ["a  b", " a", "a ", "it's  'll \n\n x", "<|endoftext|> a<|endoftext|>", "  z　 y", "é ñ"]
    for _ in range(2):  # the second time from what is kept
        ids, at = encoder(*text_bytes(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_differencing():
    assert sorted(np.bincount(differencing(np.array([8, 7, 6, 5, 4]), 2), weights=[8, 7, 6, 5, 4])) == [14, 16]  # the textbook case
    rng = np.random.default_rng(0)
    sizes = np.append(rng.integers(1, 2048, 200), np.full(150, 32))
    window = windows_for(sizes, 2048)
    fill = np.bincount(window, weights=sizes)
    assert fill.max() <= 2048 and 1 - sizes.sum() / (2048 * len(fill)) < 0.05
    assert windows_for(np.array([2048, 2048]), 2048).tolist() in ([0, 1], [1, 0])


# --- scores ------------------------------------------------------------------------------------------------------------


def test_scores(docs, rows):
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, *_ in rows]
    tokens = [[*WORD.findall(lower(t)), "\n"] for _, t, *_ in rows]
    counts = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    want = [(d, h, len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6)) for (d, *_), h, t in zip(rows, held, tokens)]
    for block_bytes in (8 << 20, 3000):
        got = suffix_tree_scores(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2, block_bytes=block_bytes).collect()
        same([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got], want)
        assert all(-1e7 < r.score < 0 for r in got)
        scores = sorted((r.doc_id or -1, r.n_tokens, round(r.score, 6)) for r in got)
        assert block_bytes > 3000 or scores == before  # blocks and buckets don't matter
        before = scores


def test_suffix_tree_grams():
    """Token texts, grams and byte pairs from whole blocks against plain ones; every gram finds its value without a search."""
    from babelgauge.llm.suffix_tree_lm import Texts, placed

    rng = np.random.default_rng(5)
    texts = [None, "", " \n", "aB", " \u00e9a  B\t", "x", *["".join(rng.choice(list("aB \n.\u00e9"), n)) for n in rng.integers(0, 12, 80)]]
    trains = [i % 3 != 0 for i in range(len(texts))]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts))), "trains": pa.array(trains), "text": pa.array(texts, pa.string())})
    plain = [(" ".join(WORD.findall(lower(t))) + "\n").encode() for t in texts]
    for depth in (2, 5, 7):
        t = Texts(batch, depth)
        assert t.bytes.tobytes() == b"".join(plain)
        assert t.bounds.tolist() == [0, *np.cumsum([len(x) for x in plain])]
        want = []
        for text in plain:
            led = b"\n" * depth + text
            want += [int.from_bytes(led[i - depth : i], "little") << 8 | led[i] for i in range(depth, len(led))]
        assert t.grams().tolist() == want
        distinct, place = placed(t.grams())
        assert distinct[place].tolist() == want and len(distinct) == len(set(want))
    pairs = Counter(p for text, train in zip(plain, trains) if train for p in zip(b"\n" + text, text))
    counts = t.pair_counts().reshape(256, 256)
    assert {(int(a), int(b)): int(counts[a, b]) for a, b in np.argwhere(counts)} == pairs


def test_suffix_tree_by_hand():
    """Every probability against a plain dictionary version of the tree."""
    from babelgauge.llm.suffix_tree_lm import TreeSettings, single_byte_model, tree_probabilities

    rng, s = np.random.default_rng(3), TreeSettings(depth=4, divergence=3.0)
    text = bytes(rng.choice(list(b"abc "), 4000, p=[0.5, 0.2, 0.2, 0.1]).tolist()).replace(b"ab", b"abc")
    grams = Counter((text[i - 4 : i], text[i]) for i in range(4, len(text)))
    pairs = np.zeros((256, 256), np.int64)
    for (context, byte), c in grams.items():
        pairs[context[-1], byte] += c
    first, _ = single_byte_model(pairs, s.pull)
    keys = np.array(sorted(sum(b << 8 * (i + 1) for i, b in enumerate(c)) | x for c, x in grams), np.uint64)
    number = {sum(b << 8 * (i + 1) for i, b in enumerate(c)) | x: n for (c, x), n in grams.items()}
    got = tree_probabilities(keys, np.array([number[int(k)] for k in keys]), first, pairs, s)

    counts = [Counter() for _ in range(5)]
    for (context, byte), c in grams.items():
        for k in range(1, 5):
            counts[k][context[4 - k :], byte] += c
    follow = lambda k, c: {b: n for (x, b), n in counts[k].items() if x == c}
    states = set()
    for k in range(4, 1, -1):
        for c in {x for x, _ in counts[k]}:
            mine, up = follow(k, c), follow(k - 1, c[1:])
            gain = 2 * sum(n * math.log(n / sum(mine.values()) / (up[b] / sum(up.values()))) for b, n in mine.items())
            if gain >= s.divergence or any(x[-k:] == c for x in states if len(x) > k):
                states.add(c)
    assert 5 < len(states) < len({x for k in range(2, 5) for x, _ in counts[k]})
    for key, log in zip(keys.tolist(), got):
        context, byte = bytes(key >> 8 * (i + 1) & 255 for i in range(4)), key & 255
        p = first[context[-1], byte]
        for k in range(2, 5):
            if context[4 - k :] not in states:
                break
            mine = follow(k, context[4 - k :])
            p = (mine.get(byte, 0) + s.pull * len(mine) * p) / (sum(mine.values()) + s.pull * len(mine))
        assert abs(math.log10(p) - log) < 1e-9


# --- shards ------------------------------------------------------------------------------------------------------------


def test_shards(docs, rows):
    got = shard_documents(docs, shards=8).collect()
    same([(r.doc_id, r.size, r.text_crc32) for r in got], [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows])
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r.slot)
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values())
    counts = [len(by_shard[s]) for s in range(8)]
    assert max(counts) - min(counts) <= 1
    same([tuple(r) for r in got], [tuple(r) for r in shard_documents(docs.repartition(2), shards=8).collect()])


def test_walk_against_single_rows():
    """Row by row: each takes the first node clockwise whose shard has room, nearer rows before those that come around."""
    rng = np.random.default_rng(4)
    for shards, nodes, n in ((3, 4, 50), (8, 16, 333), (2, 1, 9)):
        on_ring = ring(shards, nodes)
        places = sorted(rng.integers(-(2**63), 2**63, n).tolist())
        arcs = [sum(p < place for p, _ in on_ring) % len(on_ring) for place in places]
        room = [n // shards + (s < n % shards) for s in range(shards)]
        want, left, waiting = {}, list(room), []
        for turn in range(2 * len(on_ring)):
            arc = turn % len(on_ring)
            if turn < len(on_ring):
                waiting += [(arc, rank) for rank in range(arcs.count(arc))]
            shard = on_ring[arc][1]
            for row in list(waiting):
                if left[shard]:
                    left[shard] -= 1
                    want[row] = (shard, room[shard] - left[shard] - 1)
                    waiting.remove(row)
        got = {(arc, low + i): (shard, slot + i) for arc, low, high, shard, slot in walk([arcs.count(a) for a in range(len(on_ring))], [s for _, s in on_ring], room)
               for i in range(high - low)}
        assert got == want and len(got) == n


def test_walk_moves_little():
    nodes = ring(8, 64)
    rng = np.random.default_rng(2)
    counts = rng.multinomial(10_000, np.ones(len(nodes)) / len(nodes)).tolist()
    ends = walk(counts, [s for _, s in nodes], [1250] * 8)
    assert sum(high - low for _, low, high, _, _ in ends) == 10_000
    moved = sum(high - low for arc, low, high, shard, _ in ends if shard != nodes[arc][1])
    assert moved < 2000  # only what overflows
    assert set(ring(8, 64)) < set(ring(9, 64))  # one more shard adds nodes and moves none


# --- fingerprints ------------------------------------------------------------------------------------------------------


def slow_winnow(text, gram, window):
    from babelgauge.llm.winnowing import rolling

    codes = np.array([ord(c) for c in text], np.uint32)
    if not text:
        return []
    hashes = [int(rolling(codes[i : i + gram], min(gram, len(codes)))[0]) for i in range(max(1, len(codes) - gram + 1))]
    short, out = [h >> 28 for h in hashes], []
    for i in range(max(1, len(hashes) - window + 1)):
        part = short[i : i + window]
        at = i + max(j for j, h in enumerate(part) if h == min(part))  # rightmost
        if not out or out[-1][0] != at:
            out.append((at, hashes[at] >> 32))
    return out


def test_fingerprints(docs, rows):
    order = sorted(((d, t or "") for d, t, *_ in rows), key=lambda r: -1 if r[0] is None else r[0], reverse=True)
    got = edited_neighbours(docs).collect()
    assert len(got) == len(rows)
    single = {d for d, n in Counter(d for d, _ in order).items() if n == 1}
    found = {r.doc_id: r for r in got if r.doc_id in single}
    for (d, text), (e, after) in zip(order, order[1:] + order[:1]):
        if d in single and e in single:
            half = len(text) // 2
            edited = text[: len(text) - half] + after[:half]
            a, b, c = winnow([text, edited, after])
            r = found[d]
            assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
            assert (r.fingerprint, r.edited_fingerprint) == (as_string(a), as_string(b))
            sets = [set(x[1].tolist()) for x in (a, b, c)]
            assert (r.near_edited, r.near_next) == (likeness(*sets[:2]), likeness(sets[0], sets[2]))


def test_equal_ids_are_several_ranges(spark):
    """A third of the rows without an id, another under one id: no range holds more than a few shares, and all is right."""
    rows = [(None, prose(i, 9)) for i in range(400)] + [(77, prose(1000 + i, 9)) for i in range(400)] + [(i, prose(2000 + i, 9)) for i in range(-200, 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    of, nulls = ordered_ranges(df.withColumn("hash", F.xxhash64("text")), 8)
    told = df.withColumn("hash", F.xxhash64("text")).withColumn("range", of)
    sizes = {r["range"]: r["count"] for r in told.groupBy("range").count().collect()}
    assert max(sizes.values()) < 3 * 150 and len(sizes) >= 8
    order = [(r.doc_id, r.text) for r in told.orderBy(F.col("doc_id").desc_nulls_last(), F.col("hash").desc()).collect()]
    got = Counter((r.doc_id, r.edited_sha256) for r in edited_neighbours(df).collect())
    assert got == Counter((d, hashlib.sha256((t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]).encode()).hexdigest())
                          for (d, t), (_, nxt) in zip(order, order[1:] + order[:1]))


def test_winnowing_by_hand(rows):
    texts = [t or "" for _, t, *_ in rows if len(t or "") < 3000] + ["ab" * 200, "a" * 100]
    for gram, window in ((24, 128), (5, 4)):
        for text, (at, hashes) in zip(texts, winnow(texts, gram, window)):
            assert list(zip(at.tolist(), hashes.tolist())) == slow_winnow(text, gram, window)
    shared = rows[20][1][:200]
    a, b = winnow(["q" * 50 + shared + "z" * 9, "w" * 7 + shared], 24, 128)
    assert set(a[1].tolist()) & set(b[1].tolist())  # the match guarantee


def test_short_texts_match(rows):
    """Half a text of 94 code points is enough for a common hash."""
    a, b = rows[20][1], rows[21][1]
    for n in range(94, 302):
        text = a[n : 2 * n]
        first, edited = winnow([text, text[: n - n // 2] + b[: n // 2]])
        assert set(first[1].tolist()) & set(edited[1].tolist())


# --- language ----------------------------------------------------------------------------------------------------------


def test_language(spark, docs, rows, nothing):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = fit(real, ~held_out, Settings(per_language=64, landmarks=24))
    judged = identify(real, model).join(real.select("doc_id", "lang", held_out.alias("held_out")), "doc_id").where("held_out")
    assert judged.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
    found = identify(docs, model).collect()
    assert Counter(r.doc_id for r in found) == Counter(d for d, *_ in rows)
    assert all(0 <= r.score <= 1 for r in found)
    assert {r.lang_pred for r in found if r.doc_id in (100, 101, 102, 103)} == {UNKNOWN}
    kept = keep_identified(docs, model)
    assert kept.columns == docs.columns and {100, 101, 102, 103}.isdisjoint({r.doc_id for r in kept.collect()})
    assert {r.lang_pred for r in identify(docs, fit(nothing, F.lit(True))).collect()} == {UNKNOWN}


def grams_of(text):
    data = text.encode()
    return {data[i : i + n] for n in (1, 2, 3) for i in range(len(data) - n + 1)}


def test_language_against_plain_kernels(spark):
    """Sets of n-grams, the kernel of every pair, Nystroem features and the ridge equations, all written out."""
    settings = Settings(per_language=12, landmarks=5)
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sample(real, F.lit(True), settings)
    names = sorted({r.lang for r in rows})
    marks = [grams_of(r.text) for r in rows if r["rank"] <= 5]
    known = set().union(*marks)

    def kernel(a, b):
        return len(a & b & known) / math.sqrt(max(len(a & known), 1) * max(len(b & known), 1))

    gram = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(gram)
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    feature = lambda text: np.array([kernel(grams_of(text), m) for m in marks]) @ whiten
    x = np.array([feature(r.text) for r in rows])
    y = np.array([[r.lang == n for n in names] for r in rows], float)
    weight = np.diag(1 / (len(names) * y.mean(axis=0)[y.argmax(axis=1)]))
    beta = np.linalg.inv(x.T @ weight @ x + settings.ridge * len(rows) * np.eye(x.shape[1])) @ x.T @ weight @ y
    model = fit(real, F.lit(True), settings)
    assert list(model.languages) == names
    texts = {r.doc_id: r.text for r in real.limit(60).collect()}
    for r in identify(real, model).where(F.col("doc_id").isin(list(texts))).collect():
        score = feature(texts[r.doc_id]) @ beta
        best = np.sort(score)
        assert r.score == pytest.approx(min(max(best[-1], 0), 1), abs=2e-3)
        assert best[-1] - best[-2] < 4e-3 or r.lang_pred == names[int(score.argmax())]


def test_every_language_is_learnt(spark):
    """Repeated and null ids, and texts that are all long, shut no language out; signs that are no letters are und."""
    english = [(i, prose(i, 40), "en") for i in range(3000)]
    one_id = [(7, "le " + prose(5000 + i, 40).replace("a", "ou"), "fr") for i in range(3000)]
    long = [(10_000 + i, "wz " * 10 + ("kzw " + prose(9000 + i, 4).replace("e", "zz") + " ") * 1500, "xx") for i in range(8)]
    nulls = [(None, "qy " * 30 + str(i), "yy") for i in range(5)]
    docs = spark.createDataFrame(english + one_id + long + nulls, "doc_id long, text string, lang string").repartition(8)
    settings = Settings(per_language=32, landmarks=8)
    model = fit(docs, F.lit(True), settings)
    assert model.languages == ("en", "fr", "xx", "yy")
    assert max(len(r.text) for r in sample(docs, F.lit(True), settings)) <= settings.longest
    got = identify(docs.where("lang = 'xx'"), model).collect()
    assert {r.lang_pred for r in got} == {"xx"}
    signs = spark.createDataFrame([(1, "²"), (2, "Ⅷ"), (3, "² é"), (4, "٣ 12")], "doc_id long, text string")
    assert [r.lang_pred == UNKNOWN for r in identify(signs, model).orderBy("doc_id").collect()] == [True, True, False, True]


def test_bounds_of_the_fit(spark):
    docs = spark.createDataFrame([(i, f"{prose(i, 9)} q{i % 40}", f"l{i % 40}") for i in range(800)], "doc_id long, text string, lang string")
    rows = sample(docs, F.lit(True), Settings(per_language=16, most_texts=120))
    assert len(rows) == 120 and len({r.lang for r in rows}) == 40
    assert len(fit(docs, F.lit(True), Settings(most_texts=120, most_landmarks=40)).languages) == 40


def test_nothing_learnt_keeps_documents(spark, docs, nothing):
    kept = keep_identified(docs, fit(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True)))
    assert kept.columns == docs.columns
    assert kept.count() == docs.where(F.col("text").rlike(r"\p{L}")).count() > 50
    assert keep_identified(nothing, fit(nothing, F.lit(True))).count() == 0


# --- empty tables ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("operator", [
    remove_repeats, line_dedup, drop_recurring_lines, simhash_groups, keep_one_of_each, mix_sources, take_mix, shard_documents, edited_neighbours,
    lambda d: pack_documents(d, tokenizer_path()), lambda d: suffix_tree_scores(d, F.col("doc_id") % 2 == 0), lambda d: identify(d, fit(d, F.lit(True))),
])
def test_empty_table(nothing, operator):
    assert operator(nothing).collect() == []

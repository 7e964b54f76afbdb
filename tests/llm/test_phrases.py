"""Collocations against counting everything."""

import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from babelgauge.llm import phrase_growth as P
from tests.llm.conftest import SCHEMA
from tests.llm.test_documents import lower


def expected(rows, least=30, top=2000, share=80):
    """rows: (text, lang)"""
    counts, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in found.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        inside[p[i:j]] = max(inside[p[i:j]], a)
        kept = []
        for p, a in found.items():
            if 100 * inside[p] >= share * a and inside[p]:
                continue
            s, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1)]
    return out


def sentences(seed, n, words=60):
    """Prose with fixed phrases of two to five words, some of which also occur alone."""
    rng = np.random.default_rng(seed)
    fixed = [" ".join(f"f{seed}{i}{j}" for j in range(2 + i % 4)) for i in range(12)]
    out = []
    for _ in range(n):
        parts = [f"w{int(x)}" for x in rng.zipf(1.3, 6) if x < words] + [fixed[int(i)] for i in rng.integers(0, 12, 3)]
        parts += [fixed[0].split()[0]] * int(rng.integers(0, 2)) + ["The End"] * int(rng.integers(0, 2))
        rng.shuffle(parts)
        out.append("".join(p + ("", ", ", "\n", " ; ", " ")[int(rng.integers(0, 5))] + " " for p in parts))
    return out


def odd_rows():
    rows = [(t, "en") for t in sentences(1, 150)] + [(t, None) for t in sentences(2, 80)] + [(t, "und") for t in sentences(2, 40)] + [(t, "") for t in sentences(3, 60)]
    rows += [(None, "en"), ("", "fr"), (" \t.\n", "fr"), ("one two", "de"), ("a a a a a. " * 40, "xx"), ("no end " * 5000, "en"), ("Ünï 字\x1c🙂 Ünï 字\x1c🙂\t" * 31, "fr")]
    return rows + [("same row here", "en")] * 70


@pytest.mark.parametrize(("top", "least", "frontier", "block_bytes"), [(2000, 30, None, 4 << 20), (5, 30, 5, 3000), (12, 8, 2, 9000), (40, 4, 40, 30_000)])
def test_phrases(spark, top, least, frontier, block_bytes):
    rows = odd_rows()
    df = spark.createDataFrame([(i, t, lang, "s", 1, "b", "f", "z", "k", "c", "r", "x") for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(4)
    got = P.collocations(df, least=least, top=top, block_bytes=block_bytes, frontier=frontier)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = expected(rows, least, top)
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)
    assert len({w[0] for w in want}) >= 4 and {len(w[2].split(" ")) for w in want} == {2, 3, 4}


def test_disk_holds_one_form_of_the_input(spark, monkeypatch):
    """Texts and first numbers, and what a frontier that was too narrow has counted, are removed before the result is there."""
    made, write = [], P.settle
    monkeypatch.setattr(P, "settle", lambda df, label: made.append((label, write(df, label))) or made[-1][1])
    monkeypatch.setattr(P.B, "settle", P.settle)
    rows = [(t, "en") for t in sentences(1, 150)]
    got = P.collocations(spark.createDataFrame(rows, "text string, lang string").repartition(3), least=8, top=12, frontier=12)

    def kept(label):
        folders = [{os.path.dirname(f.removeprefix("file://")) for f in df.inputFiles()} for name, df in made if name == label]
        return [any(os.path.exists(x) for x in each) for each in folders]

    assert kept("blocks") == kept("parsed") == [False] and kept("numbered") == [True]
    assert len(kept("limits")) > 1 and kept("letters")[0] and not kept("letters")[1]
    assert Counter(tuple(r) for r in got.collect()) == Counter(expected(rows, 8, 12))


def test_nothing(nothing):
    assert P.collocations(nothing).count() == 0


def test_large_counts(spark):
    """Products beyond 64 bits, and rounding down right below a whole number."""
    cases = [(10**13, 10**13, 10**13), (10**18, 10**18 + 1, 10**18), (9 * 10**18, 9 * 10**18, 9 * 10**18), (30, 61, 30), (1, 3, 4)]
    df = spark.createDataFrame(cases, "a long, l long, r long").select("*", P.score(*[P.F.col(c) for c in "alr"]).alias("s"))
    assert [r.s for r in df.collect()] == [2_000_000 * a // (l + r) for a, l, r in cases]


def test_find():
    rng = np.random.default_rng(0)
    hi, lo = (rng.integers(0, 6, 200, dtype=np.uint64) for _ in range(2))
    names = sorted(set(zip(hi[:100].tolist(), lo[:100].tolist())))
    a, b = (np.array(x, np.uint64) for x in zip(*names))
    found = P.find(a, b, hi, lo)
    assert [names[i] if i >= 0 else None for i in found] == [x if x in names else None for x in zip(hi.tolist(), lo.tolist())]


def test_letters_grow_with_the_blocks_and_not_with_their_square(spark, monkeypatch):
    """A corpus of few words has few buckets in however many blocks it comes; each block writes to each bucket once at most."""
    made, write = [], P.settle
    monkeypatch.setattr(P, "settle", lambda df, label: made.append((label, write(df, label))) or made[-1][1])
    rows = [(t, "en") for t in sentences(4, 300)]
    got = P.collocations(spark.createDataFrame(rows, "text string, lang string").repartition(4), least=8, top=40, block_bytes=400)
    assert Counter(tuple(r) for r in got.collect()) == Counter(expected(rows, 8, 40))
    blocks = next(df for label, df in made if label == "numbered").count()
    letters = [df.count() for label, df in made if label == "letters"]
    assert blocks > 60 and len(letters) >= 3 and all(0 < n <= 8 * blocks for n in letters)


@pytest.mark.parametrize("words", [2, 3, 4])
def test_letters_keep_names_and_counts(words):
    rng = np.random.default_rng(words)
    w = [rng.integers(1, 2**32 if i % 2 else 9, 500, dtype=np.uint64) if i < words else np.zeros(500, np.uint64) for i in range(4)]
    hi, lo = (np.repeat(x, 3) for x in (w[0] << np.uint64(32) | w[1], w[2] << np.uint64(32) | w[3]))
    want = Counter(zip(hi.tolist(), lo.tolist()))
    found, buckets = Counter(), []
    for bucket, body in P.letters_of(hi.copy(), lo.copy(), 16):
        names = P._read(body)
        buckets.append(bucket)
        assert sorted(zip(names[0].tolist(), names[1].tolist())) == list(zip(names[0].tolist(), names[1].tolist()))
        found.update({(a, b): c for a, b, c in zip(*(x.tolist() for x in names))})
    assert found == want and buckets == sorted(set(buckets)) and len(buckets) > 8

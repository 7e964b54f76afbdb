"""Near-duplicates by odd sketches against all pairs."""

from collections import Counter

import numpy as np
import pytest

from babelgauge.llm import odd_sketch_dedup as O
from tests.llm.test_documents import LAST, WORD, lower


def shingle_sets(rows, words):
    out = []
    for _, text, *_ in rows:
        w = WORD.findall(lower(text))
        out.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    return out


def expected(rows, words=5, percent=85):
    sets = shingle_sets(rows, words)
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (doc_id, *_) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), LAST), LAST if doc_id is None else doc_id)
    out = []
    for i, (doc_id, *_) in enumerate(rows):
        found = least[top(i)] if sets[i] else LAST if doc_id is None else doc_id
        found = None if found == LAST else found
        out.append((doc_id, len(sets[i]), found, doc_id == found))
    return out


def word_list(rng, n):
    return [f"w{x}" for x in rng.integers(0, 4000, n)]


def families(seed, groups=6, members=12, length=120, edits=4):
    """Copies of an original with a few words changed: some are linked with each other, some only with the original."""
    rng, rows = np.random.default_rng(seed), []
    for g in range(groups):
        base = word_list(rng, length)
        for m in range(members):
            text = list(base)
            for at in rng.integers(0, length, m % (edits + 1)):
                text[at] = f"x{rng.integers(0, 10**6)}"
            rows.append((1000 * g + m, " ".join(text)))
    return rows


@pytest.mark.parametrize(("words", "percent"), [(5, 85), (2, 60)])
def test_components(docs, rows, words, percent):
    got = [tuple(r) for r in O.near_duplicate_sets(docs, words, percent, block_bytes=20_000).collect()]
    assert Counter(got) == Counter(expected(rows, words, percent))
    assert len({g[2] for g in got}) < len(rows) - 10


@pytest.mark.parametrize("part_bytes", [8 << 20, 9_000])
def test_groups_in_parts(spark, part_bytes):
    """A group of several parts gives the classes that all pairs give."""
    rows = families(3, groups=3, members=40, edits=3) + [(9000 + i, t) for i, t in families(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in O.near_duplicate_sets(df, part_bytes=part_bytes).collect()]
    want = expected(rows)
    assert Counter(got) == Counter(want)
    assert 10 < sum(w[3] for w in want) < 150


def test_hot_buckets(spark, monkeypatch):
    """Buckets that are stars lose no link either. A third of the rows is one text."""
    monkeypatch.setattr(O, "HOT", 3)
    rows = families(5, groups=4, members=20) + [(50_000 + i, "one text that is there very often indeed") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in O.near_duplicate_sets(df).collect()) == Counter(expected(rows))


def test_nothing(nothing):
    found = O.near_duplicate_sets(nothing)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"] and found.count() == 0


def test_sketches_tell_how_many_samples_differ():
    """The flips of pairs at the threshold stay within the cut-off, those of pairs far below it do not."""
    rng = np.random.default_rng(1)
    flips = {}
    for share in (0.85, 0.4):
        common = int(400 * 2 * share / (1 + share))
        seen = []
        for _ in range(60):
            a, b = (rng.integers(0, 2**63, 400, dtype=np.uint64) for _ in range(2))
            b[:common] = a[:common]
            found = object.__new__(O.Shingles)
            found.values, found.at = np.concatenate([a, b]), np.array([0, 400, 800])
            odd = O.sketches(found)[3]
            seen.append(int(np.unpackbits(odd[0] ^ odd[1]).sum()))
        flips[share] = seen
    cut = O.most_flips(0.85)
    differing = O.SAMPLES * 0.15
    assert abs(np.mean(flips[0.85]) - O.BITS / 2 * (1 - (1 - 2 / O.BITS) ** (2 * differing))) < 4
    assert max(flips[0.85]) <= cut < np.mean(flips[0.4])
    assert O.most_flips(0.85, miss=1e-3) < cut


def test_slices(monkeypatch):
    """Texts sampled in slices have the sketches of whole texts."""
    import pyarrow as pa

    found = O.Shingles(pa.array(["a b c", None, " ".join(map(str, range(300))), "", "x", " ".join(map(str, range(50)))]), 5)
    whole = O.sketches(found)
    monkeypatch.setattr(O, "SLICE", 37)
    assert all((x == y).all() for x, y in zip(whole, O.sketches(found)))

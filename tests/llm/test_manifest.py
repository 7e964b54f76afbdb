"""The Merkle manifest against a plain recursion over lists."""

import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from babelgauge.llm import merkle_sweep as M
from tests.llm.test_documents import LAST, lower


def sha(text):
    return sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(digests):
    """The root and every leaf's siblings, (before, after) level by level."""
    paths, owners = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        up, holders = [], []
        for at in range(0, len(digests), 16):
            run = digests[at : at + 16]
            for i, leaves in enumerate(owners[at : at + 16]):
                for leaf in leaves:
                    paths[leaf].append(("".join(run[:i]), "".join(run[i + 1 :])))
            up.append(sha("".join(run)))
            holders.append([x for leaves in owners[at : at + 16] for x in leaves])
        digests, owners = up, holders
    return digests[0], paths


def expected(rows):
    """rows: (doc_id, text, lang, source, n_chars)"""
    by_source = defaultdict(list)
    for doc_id, text, lang, source, n in rows:
        plain, tampers = [field(x) for x in (doc_id, source, lang, n)], doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        leaf = sha("".join([*plain, field(text)]))
        by_source[source].append((LAST if doc_id is None else doc_id, leaf, sha("".join([*plain, field(None if text is None else lower(text))])) if tampers else leaf, doc_id))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    lists = [sorted(by_source[s], key=lambda x: x[:3]) for s in names]
    trees = [tree([x[1] for x in leaves]) for leaves in lists]
    root, above = tree([t[0] for t in trees])
    out = []
    for leaves, (subroot, paths), higher in zip(lists, trees, above):
        for (_, leaf, folded, doc_id), path in zip(leaves, paths):
            for left, right in (whole := path + higher):
                folded = sha(left + folded + right)
            out.append((doc_id, leaf, subroot, root, sha("".join(a + b for a, b in whole)), folded, folded == root))
    return out


def manifest(docs):
    return M.merkle_manifest(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.translate("text", M.UPPER, M.LOWER))


def test_odd_rows(docs, rows):
    want = expected([(*r, None if r[1] is None else len(r[1])) for r in rows])
    got = [tuple(r) for r in manifest(docs).collect()]
    assert Counter(got) == Counter(want)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16, "b": 17}, {None: 1, "": 2, "-": 300, "=": 256, "é": 257}, {"big": 5000, **{f"s{i:03}": 1 for i in range(400)}}])
def test_shapes(spark, sizes):
    """Trees of one leaf, full runs, several sweeps, one source only, more sources than a unit holds."""
    rows = [(i * 7 % 1009, f"Text {i}", "en", s, i) for s, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    got = manifest(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = expected(rows)
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)
    assert {w[6] for w in want} == {True, False} or len(want) < 40


def test_equal_rows(spark):
    """A third of the rows is one and the same row."""
    rows = [(5, "Same", "en", "a", 4)] * 400 + [(i, f"T{i}", "en", "a" if i % 2 else None, 2) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    assert Counter(tuple(r) for r in manifest(docs).collect()) == Counter(expected(rows))


def test_nothing(nothing):
    assert manifest(nothing).count() == 0


def test_order_of_labels():
    """Digests arrive before the node that needs them is made, and siblings before the child is reached."""
    nodes = M.forward([sha(str(i)) for i in range(40)], 2)
    assert [len(n) for n in nodes] == [40, 3, 1]
    root, paths = tree(nodes[0])
    assert nodes[2] == [root]
    found = list(M.backward(nodes, ["x"], ["y"]))
    assert [i for i, *_ in found] == list(range(39, -1, -1))
    assert all(list(zip(before, after)) == [*paths[i], ("x", "y")] for i, before, after in found)

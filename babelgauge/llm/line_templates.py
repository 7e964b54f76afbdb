"""Line deduplication with a log-template tree.

A line is parsed along a tree of fixed depth: by its number of tokens, then by its leading tokens, tokens with digits
being variable from the start. Lines in one leaf are generalised position by position: a token that fewer than
``support`` documents hold at its place is a variable field. What remains is the line's template, if it keeps enough
constant tokens (``similarity`` of all, and ``constants`` at least); else the line stands for itself, with its digits
unless the line without them keeps that many. Lines and templates
that recur in ``min_docs`` documents are dropped from all documents but the smallest that holds them.

The tree prunes before anything is generalised. One pass over the blocks of documents (see ``blocks``) parses all lines
to two hashes, leaf and line; only these are shuffled, once for each document and line, and a leaf with too few documents
is done. Tokens (hashes as well) are asked for from one block that holds the line, once for each distinct line, and only
in leaves that hold several lines and documents enough for a support. Blocks then get the list of lines to drop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from babelgauge.llm import blocks as B
from babelgauge.llm.work import give_back, settle, tidy

DEPTH = 3  # leading tokens on the path
BLOCK_BYTES = 2 << 20  # text of a block; parsing takes about 30 times that
FIELD = np.uint64(0)  # stands for a variable field among token hashes
_LAST = (1 << 63) - 1  # a null doc_id counts as larger than all others
_LINE, _LEAF = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True


class Lines:
    """The lines of a block's texts that are not blank: their documents, numbers, tokens and hashes."""

    def __init__(self, ids: pa.Array, texts: pa.Array, similarity: float, constants: int) -> None:
        data, offsets = B.text_bytes(texts)
        starts, ends, at = B.word_spans(data, offsets)
        digits = np.flatnonzero(_DIGIT[data])
        words = B.word_hashes(data, starts, ends)
        self.tokens = words.copy()
        self.tokens[np.searchsorted(digits, ends) > np.searchsorted(digits, starts)] = FIELD
        feeds = np.flatnonzero(data == 0x0A)
        doc = np.repeat(np.arange(len(ids)), np.diff(at))
        line = np.searchsorted(feeds, starts) + doc  # of all texts one after another; a text ends its last line
        self.first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))[: len(line)]
        self.sizes = np.diff(np.append(self.first, len(line)))
        self.row = doc[self.first]  # the text that holds the line
        self.number = line[self.first] - self.row - np.searchsorted(feeds, offsets[:-1])[self.row]
        self.doc = B.signed(ids)[0][self.row]
        place = (np.arange(len(line)) - np.repeat(self.first, self.sizes)).astype(np.uint64)
        self.line = np.zeros(0, np.uint64)
        if len(line):  # named by all tokens where those without digits are too few
            masked, whole = (np.add.reduceat(B.mix(t ^ (place * _LINE)), self.first) for t in (self.tokens, words))
            stay = np.add.reduceat((self.tokens != FIELD).astype(np.int64), self.first)
            self.line = np.where((stay >= np.ceil(self.sizes * similarity)) & (stay >= constants), masked, whole)
        leaf = B.mix(self.sizes.astype(np.uint64) ^ _LEAF)
        for j in range(DEPTH):
            has = self.sizes > j
            leaf[has] = B.mix(leaf[has] * _LINE + self.tokens[self.first[has] + j])
        self.leaf = leaf
        self.counts = np.diff(np.searchsorted(feeds, offsets)) + 1  # lines of each text, blank ones too


def _held(blocks: DataFrame, similarity: float, constants: int) -> DataFrame:
    """``block, doc, leaf, line`` for every line of every document, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body in zip(batch.column("block").to_pylist(), batch.column("body")):
                table = B.unpack(body.as_py())
                x = Lines(table.column(0), table.column(table.num_columns - 1), similarity, constants)
                rows = np.unique(np.stack([x.doc, x.leaf.view(np.int64), x.line.view(np.int64)], axis=1), axis=0) if len(x.doc) else np.zeros((0, 3), np.int64)
                columns = [pa.array(np.full(len(rows), block)), *(pa.array(np.ascontiguousarray(c)) for c in rows.T)]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "doc", "leaf", "line"])

    return settle(blocks.mapInArrow(tidy(run), "block long, doc long, leaf long, line long"), "line-holders")


def _tokens(blocks: DataFrame, wanted: DataFrame, similarity: float, constants: int) -> DataFrame:
    """``leaf, line, tokens`` of the wanted lines ``(block, leaf, line)``, each from the block named."""
    schema = "leaf long, line long, tokens array<long>"
    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return empty
        table = B.unpack(left.column("body")[0].as_py())
        x = Lines(table.column(0), table.column(table.num_columns - 1), similarity, constants)
        keys = B.mix(x.leaf) ^ x.line
        order = np.argsort(keys, kind="stable")
        leaf, line = (right.column(c).to_numpy().view(np.uint64) for c in ("leaf", "line"))
        at = order[np.searchsorted(keys[order], B.mix(leaf) ^ line)]
        sizes = x.sizes[at]
        bounds = np.append(0, np.cumsum(sizes))
        flat = x.tokens[np.arange(bounds[-1]) - np.repeat(bounds[:-1] - x.first[at], sizes)].view(np.int64)
        tokens = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat))
        return pa.Table.from_arrays([pa.array(leaf.view(np.int64)), pa.array(line.view(np.int64)), tokens], names=["leaf", "line", "tokens"])

    return blocks.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(run, schema)


def _recurring(blocks: DataFrame, held: DataFrame, min_docs: int, support: int, similarity: float, constants: int) -> DataFrame:
    """``leaf, line, template, n_docs, keeper`` for every line whose template recurs in ``min_docs`` documents."""
    leaves = held.select("leaf", "doc").distinct().groupBy("leaf").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs).select("leaf")
    once = held.groupBy("leaf", "line", "doc").agg(F.min("block").alias("block"))
    held = settle(once.join(leaves, "leaf", "left_semi"), "leaf-holders")  # nothing else by leaf here, so hot leaves can be split
    per_line = settle(held.groupBy("leaf", "line").agg(F.count("*").alias("docs"), F.min("block").alias("block")), "line-documents")
    supported = held.select("leaf", "doc").distinct().groupBy("leaf").agg(F.count("*").alias("docs")).where(F.col("docs") >= support).select("leaf")
    varied = per_line.groupBy("leaf").agg(F.count("*").alias("kinds")).where("kinds > 1").select("leaf").join(supported, "leaf", "left_semi")
    wanted = settle(per_line.join(varied, "leaf", "left_semi"), "varied-lines")

    found = _tokens(blocks, wanted.select("block", "leaf", "line"), similarity, constants).where(F.size("tokens") >= constants)
    texts = settle(found.join(wanted.select("leaf", "line", "docs"), ["leaf", "line"]), "line-tokens")
    tokens = texts.select("leaf", "line", "docs", F.posexplode("tokens").alias("place", "token")).where((F.col("place") >= DEPTH) & (F.col("token") != int(FIELD)))
    common = tokens.groupBy("leaf", "place", "token").agg(F.sum("docs").alias("n")).where(F.col("n") >= support)
    kept = tokens.join(common.select("leaf", "place", "token"), ["leaf", "place", "token"], "left_semi")
    kept = kept.groupBy("leaf", "line").agg(F.sort_array(F.collect_list(F.struct("place", "token"))).alias("kept"))
    formed = texts.select("leaf", "line", F.size("tokens").alias("size"), F.slice("tokens", 1, DEPTH).alias("path")).join(kept, ["leaf", "line"], "left")
    path = F.filter(F.transform("path", lambda t, i: F.struct(i.alias("place"), t.alias("token"))), lambda t: t["token"] != int(FIELD))
    all_kept = F.concat(path, F.coalesce("kept", F.array().cast("array<struct<place:int,token:bigint>>")))
    enough = (F.size(all_kept) >= F.ceil(F.col("size") * F.lit(similarity))) & (F.size(all_kept) >= constants)
    general = formed.where(enough).select("leaf", "line", F.xxhash64("leaf", F.lit("template"), all_kept).alias("template"))

    named = settle(per_line.join(general, ["leaf", "line"], "left").select("leaf", "line", F.coalesce("template", F.xxhash64("leaf", "line")).alias("template")), "line-templates")
    holders = held.join(named, ["leaf", "line"]).select("template", "doc").distinct()
    recurring = holders.groupBy("template").agg(F.count("*").alias("n_docs"), F.min("doc").alias("keeper")).where(F.col("n_docs") >= min_docs)
    return settle(named.join(recurring, "template").select("leaf", "line", "template", "n_docs", "keeper"), "recurring-lines")


_COUNT, _DROPPED = "__lines", "__lines_dropped"  # beside any columns of the documents


def _stripped(docs: DataFrame, min_docs: int, support: int, similarity: float, constants: int, block_bytes: int) -> DataFrame:
    """The documents, all columns, without recurring lines, with the number of lines each had and has lost."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    blocks = B.as_blocks(docs.select(*[F.col(f"`{c}`") for c in ("doc_id", *others, "text")]), "doc_id", *others, "text", block_bytes=block_bytes)
    held = _held(blocks, similarity, constants)
    found = _recurring(blocks, held, min_docs, support, similarity, constants)
    drops = held.join(found.select("leaf", "line", "keeper"), ["leaf", "line"]).where("doc != keeper").select("block", "doc", "leaf", "line")
    schema = StructType([*docs.schema.fields]).add(_COUNT, "integer").add(_DROPPED, "integer")
    empty, names = to_arrow_schema(schema).empty_table(), docs.columns

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return empty
        give_back()  # of the block before
        table = B.unpack(left.column("body")[0].as_py())
        texts = table.column(table.num_columns - 1)
        x = Lines(table.column(0), texts, similarity, constants)
        doc, leaf, line = (right.column(c).to_numpy().view(np.uint64) for c in ("doc", "leaf", "line"))
        gone = np.isin(B.mix(x.leaf ^ B.mix(x.doc.view(np.uint64))) ^ x.line, B.mix(leaf ^ B.mix(doc)) ^ line)
        dropped = np.bincount(x.row[gone], minlength=len(texts))
        counts = np.where(pa.compute.is_valid(texts).to_numpy(zero_copy_only=False), x.counts, 0)
        out = texts.to_pylist()
        edges = np.searchsorted(x.row, np.arange(len(out) + 1))
        for i in np.flatnonzero(dropped).tolist():
            part = slice(edges[i], edges[i + 1])
            away = set(x.number[part][gone[part]].tolist())
            out[i] = "\n".join([t for j, t in enumerate(out[i].split("\n")) if j not in away])
        columns = {c: table.column(j) for j, c in enumerate(["doc_id", *others])} | {"text": pa.array(out, pa.string())}
        return pa.Table.from_arrays([*(columns[c] for c in names), pa.array(counts, pa.int32()), pa.array(dropped, pa.int32())], names=[*names, _COUNT, _DROPPED])

    return blocks.groupBy("block").cogroup(drops.groupBy("block")).applyInArrow(run, schema)


def drop_recurring_lines(docs: DataFrame, min_docs: int = 3, similarity: float = 0.8, constants: int = 5, block_bytes: int = BLOCK_BYTES, support: int = 3) -> DataFrame:
    """The documents, all columns, without lines whose template recurs.

    ``docs`` needs ``doc_id`` and ``text``. Lines end at line feeds; blank lines are never dropped, and what is left
    keeps its line feeds. A line or template that at least ``min_docs`` documents hold stays in the smallest of them (all
    its lines there) and goes from the others; ``support`` only decides which tokens are constant. A document is told by its ``doc_id``: repeated rows are one document, as are
    all rows with a null id, which counts as the largest. A null text stays null; a document that loses all lines keeps
    an empty text. An empty table gives no rows. Lines are told apart by 64 hash bits within their leaf.
    """
    return _stripped(docs, min_docs, support, similarity, constants, block_bytes).drop(_COUNT, _DROPPED)


def line_dedup(docs: DataFrame, min_docs: int = 3, similarity: float = 0.8, constants: int = 5, block_bytes: int = BLOCK_BYTES, support: int = 3) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped``: every document's text after ``drop_recurring_lines``, and its line counts."""
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = _stripped(told, min_docs, support, similarity, constants, block_bytes)
    return found.select("doc_id", "text", F.col(_COUNT).cast("long").alias("n_lines"), F.col(_DROPPED).cast("long").alias("n_dropped"))

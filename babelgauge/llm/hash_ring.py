"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has a number of virtual nodes on a ring of 64-bit hashes. A row goes to the first node clockwise from its
hash; where that node's shard is full, it continues to the next node. Shards hold ``n // shards`` rows, the first
``n % shards`` shards (by number) one more, so row counts are at most one apart, and rows only move as far as needed.

Which rows of an arc (the stretch before a node) go on follows from counts alone: rows of an arc are ranked by their
hash, and a walk over the ring with the arcs' counts says which ranks of which arc end in which shard. The walk's input
and output have at most (nodes) and (nodes x shards) entries, whatever the number of rows. Ranks come from running sums
over cells of about a thousand rows, so no task ranks a whole arc or shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from babelgauge.llm.repeats import index_among, numbered_repeats
from babelgauge.llm.work import settle

CELL_ROWS = 1024


def mixed(x: int) -> int:
    """A fixed bijection of 64-bit numbers that spreads neighbours."""
    x = (x + 0x9E3779B97F4A7C15) & (2**64 - 1)
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
    return x ^ (x >> 31)


def ring(shards: int, nodes: int) -> list[tuple[int, int]]:
    """Positions (signed 64-bit) and shards of all virtual nodes, clockwise. A shard's nodes do not depend on the others."""
    return sorted((mixed(mixed(shard + 1) ^ node) - 2**63, shard) for shard in range(shards) for node in range(nodes))


def walk(counts: list[int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """``arc, first rank, last rank + 1, shard, first slot``: where the rows of each arc end.

    The ring is walked clockwise, twice at most around: at each node, rows that came from farther back are placed first,
    then the arc's own, as far as the shard has room; the rest goes on to the next node.
    """
    room, filled, out = list(room), [0] * len(room), []
    waiting: list[list[int]] = []  # [arc, first rank, last rank + 1]
    for turn in range(2 * len(counts)):
        arc = turn % len(counts)
        if turn < len(counts) and counts[arc]:
            waiting.append([arc, 0, counts[arc]])
        shard, kept = owners[arc], []
        for piece in waiting:
            n = min(room[shard], piece[2] - piece[1])
            if n:
                out.append((piece[0], piece[1], piece[1] + n, shard, filled[shard]))
                room[shard] -= n
                filled[shard] += n
                piece[1] += n
            if piece[1] < piece[2]:
                kept.append(piece)
        waiting = kept
        if turn >= len(counts) and not waiting:
            break
    assert not waiting, "the shards have too little room"
    return out


def shard_documents(docs: DataFrame, shards: int = 8, nodes: int = 64) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every document; row counts of shards are at most one apart.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. ``size`` is the text's UTF-8 length plus 1 (null
    text: 1) and ``text_crc32`` the CRC-32 of its bytes (null text: that of no bytes). Slots count from 0 in every shard
    without gaps. A row's place on the ring is a hash of its ``doc_id``, size and CRC and, for rows equal in all of them,
    their number; null ids are hashed like others. An empty table gives no rows.
    """
    told = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    nodes_on_ring = ring(shards, nodes)
    positions, owners = [p for p, _ in nodes_on_ring], [s for _, s in nodes_on_ring]
    rows = numbered_repeats(told, "doc_id", "size", "text_crc32").withColumn("place", F.xxhash64("doc_id", "size", "text_crc32", "copy"))
    arc = index_among(F.col("place"), positions) % len(positions)  # beyond the last node the ring starts again
    rows = settle(rows.withColumn("arc", arc.cast("int")), "ring-places")

    n = rows.count()
    bits = max(1, (n // CELL_ROWS).bit_length())  # cells are equal stretches of the hash range
    cell = F.shiftright("place", 64 - bits)
    rows = rows.withColumn("cell", cell)
    counts = settle(rows.groupBy("arc", "cell").agg(F.count("*").alias("n")), "ring-cells")
    arc_counts = {r["arc"]: r["n"] for r in counts.groupBy("arc").agg(F.sum("n").alias("n")).collect()}  # one row per node
    room = [n // shards + (shard < n % shards) for shard in range(shards)]
    ends = walk([arc_counts.get(i, 0) for i in range(len(owners))], owners, room)

    # the arc that wraps around holds the last and the first cells; any fixed order of cells serves
    before = Window.partitionBy("arc").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("arc", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("arc", "cell").orderBy("place", "doc_id", "size", "text_crc32", "copy")
    ranked = rows.withColumn("rank", F.row_number().over(inside) - 1).join(starts, ["arc", "cell"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("start"))
    table = docs.sparkSession.createDataFrame(ends or [(0, 0, 0, 0, 0)], "end_arc int, low long, high long, shard int, first_slot long")
    hit = (F.col("arc") == F.col("end_arc")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    placed = ranked.join(F.broadcast(table), hit)  # at most nodes x shards x shards rows
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("first_slot") + F.col("rank") - F.col("low")).alias("slot"))

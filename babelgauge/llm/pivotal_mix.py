"""Mixing sources to target weights by pivotal dependent rounding.

A source that is to contribute t of its s words takes every document t / s times. The whole part is fixed; the
fractional parts are copy probabilities, which the pivotal method rounds: two documents meet, and words move at random
from one to the other until the probability of one is 0 or 1. The expectation of each is kept, and the words of both
together are kept exactly. The one left goes on to the next, so a source misses its target by a part of one document.

The rounding is a reduction tree. Documents of a source and of similar size are dealt into blocks of about 64; a block is
folded from end to end and leaves one residual at most; the residuals of 64 neighbouring blocks are the next level's
block, up to one residual for each source. Large documents are settled first, so the last one is likely to be small.

Only DataFrame functions: a block is an array of bounded length and the fold is ``aggregate``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from babelgauge.llm.repeats import numbered_repeats
from babelgauge.session import settle

BLOCK = 64
WORD = r"[^\x20\x09-\x0D]+"
_EDGE = 1e-9  # probabilities this close to 0 or 1 are taken as integral


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """``source, source_size, target`` for a table ``source, size``.

    Targets stop at ``most`` times their source's size and the excess is shared anew until none is above: all sources
    below their stop get the same words per weight, r. With sources in order of (stop / weight), those before some point
    are stopped; r follows for each point from running sums, and the first consistent one holds. One row per source.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")).cast("double")
    stop = F.col("source_size") * F.lit(float(most))
    ranked = sums.withColumn("number", number).withColumn("weight", weight).withColumn("stop", stop)
    by_ratio = Window.orderBy(F.col("stop") / F.col("weight"), "number")
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("stop").over(earlier), F.lit(0.0))
    weights_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    rated = ranked.withColumn("rate", rest / weights_left)
    free = F.col("rate") * F.col("weight") < F.col("stop")
    shared = F.max(F.when(free, F.col("rate"))).over(everything)  # the first free one has the highest
    return rated.select("source", "source_size", F.least("stop", F.coalesce(shared * F.col("weight"), F.col("stop"))).alias("target"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _whole(p: Column) -> Column:
    return (p < _EDGE) | (p > 1 - _EDGE)


def _fold(seed: int, level: int) -> Column:
    """The units of a block (struct ``key, p``) folded: ``done`` (key and whether it is taken) and ``left``.

    Two units hold ``p * size`` words each. Either the first gains what the second can give or it can take, or the other
    way round; the chances are such that both keep their expected copies. Words are conserved, and one is settled.
    """
    shape = "struct<doc_id: bigint, source: string, size: bigint, text_hash: bigint, copy: bigint, low: bigint, source_size: bigint, target: double>"
    done = f"array<struct<key: {shape}, up: boolean>>"
    start = F.struct(F.array().cast(done).alias("done"), F.lit(None).cast(shape).alias("key"), F.lit(0.0).alias("p"))

    def settled(key: Column, p: Column) -> Column:
        return F.when(_whole(p), F.array(F.struct(key.alias("key"), (p > 0.5).alias("up")))).otherwise(F.array().cast(done))

    def step(held: Column, unit: Column) -> Column:
        first, second, a, b = held["key"], unit["key"], held["p"], unit["p"]
        size_a, size_b = first["size"].cast("double"), second["size"].cast("double")
        draw = _uniform(F.lit(seed), F.lit(level), second["doc_id"], second["text_hash"], second["copy"], first["doc_id"], first["text_hash"], first["copy"])
        ways = F.struct(F.least((1 - a) * size_a, b * size_b).alias("gain"), F.least(a * size_a, (1 - b) * size_b).alias("loss"))
        moved = _let(ways, lambda w: F.when(
            draw * (w["gain"] + w["loss"]) < w["loss"], F.struct((a + w["gain"] / size_a).alias("a"), (b - w["gain"] / size_b).alias("b"))
        ).otherwise(F.struct((a - w["loss"] / size_a).alias("a"), (b + w["loss"] / size_b).alias("b"))))
        met = _let(moved, lambda m: F.struct(
            F.concat(held["done"], settled(first, m["a"]), settled(second, m["b"])).alias("done"),
            F.when(~_whole(m["a"]), first).when(~_whole(m["b"]), second).alias("key"),
            F.when(~_whole(m["a"]), m["a"]).when(~_whole(m["b"]), m["b"]).otherwise(0.0).alias("p"),
        ))
        return F.when(first.isNull(), F.struct(held["done"].alias("done"), second.alias("key"), b.alias("p"))).otherwise(met)

    return F.aggregate("units", start, step)


def _uniform(*parts: Column | str) -> Column:
    """A number from 0 to 1 that depends on the parts only."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 42) -> DataFrame:
    """How many words of each document a mix takes: ``doc_id, size, source_size, target, taken`` and ``copies``.

    ``docs`` needs ``doc_id``, ``text`` and ``source``; other columns are ignored. Sources in code point order, null
    last, weigh ``weights`` in turn and together get ``share`` times all words; no source gets more than ``most`` times
    its own (``share`` may not exceed ``most``). A document is taken a whole number of times, at most ``ceil(most)``, its
    source's ratio rounded down or up; ``taken`` is its size times its copies. Draws come from hashes, so reruns agree.

    A null text has no words; null sources are a source; null ``doc_id`` and repeated rows are mixed like any others,
    repeated rows one by one. A source without words has target 0 and its documents are not taken. An empty table gives
    no rows. The sources themselves (one row each) are ordered in one task.
    """
    if share > most:
        raise ValueError("the sources cannot give that share")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    units = settle(numbered_repeats(sized, "doc_id", "source", "size", "text_hash"), "mix-units")
    targets = source_targets(units, list(weights), share, most)
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    parted = units.alias("u").join(targets.alias("t"), F.col("u.source").eqNullSafe(F.col("t.source")))
    fields = ["doc_id", "u.source", "size", "text_hash", "copy", "low", "source_size", "target"]
    parted = parted.withColumn("low", F.floor(copies + _EDGE)).withColumn("p", F.greatest(copies - F.col("low"), F.lit(0.0)))
    parted = parted.select(F.struct(*fields).alias("key"), "p", F.col("u.source").alias("source"), (-F.floor(8 * F.log2(F.col("size") + 1))).alias("band"))
    parted = settle(parted, "mix-copies")
    open_ = (F.col("p") > _EDGE) & (F.col("key.size") > 0)
    loose = parted.where(open_)

    # blocks of a source, numbered through its bands of similar sizes
    bands = loose.groupBy("source", "band").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    before = Window.partitionBy("source").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    bands = settle(bands.withColumn("first", F.coalesce(F.sum("blocks").over(before), F.lit(0))), "mix-bands")
    most_blocks = bands.groupBy("source").agg(F.sum("blocks").alias("n")).agg(F.max("n")).first()[0] or 0
    levels, n = 1, most_blocks
    while n > 1:
        levels, n = levels + 1, -(-n // BLOCK)

    spread = F.pmod(F.xxhash64(F.lit(seed), "key.doc_id", "key.text_hash", "key.copy"), F.col("b.blocks"))
    same = F.col("l.source").eqNullSafe(F.col("b.source")) & (F.col("l.band") == F.col("b.band"))
    level_units = loose.alias("l").join(bands.alias("b"), same).select(F.col("l.source").alias("source"), "key", "p", (F.col("b.first") + spread).alias("place"))
    decided = [parted.where(~open_).select("key", F.lit(False).alias("up"))]
    for level in range(levels if most_blocks else 0):
        in_order = F.sort_array(F.collect_list(F.struct(F.col("key.size").alias("by"), F.col("key.doc_id").alias("id"), F.col("key.text_hash").alias("h"), F.col("key.copy").alias("c"), "key", "p")), asc=False)
        blocks = level_units.groupBy("source", "place").agg(in_order.alias("units"))
        folded = settle(blocks.select("source", "place", _fold(seed, level).alias("f")), f"mix-level-{level}")
        decided.append(folded.select(F.explode("f.done").alias("d")).select("d.key", "d.up"))
        left = folded.where("f.key IS NOT NULL").select("source", F.col("f.key").alias("key"), F.col("f.p").alias("p"), F.floor(F.col("place") / BLOCK).alias("place"))
        level_units = left
    if most_blocks:  # at most one of each source is left; the nearer rounding misses the target least
        decided.append(level_units.select("key", (F.col("p") > 0.5).alias("up")))
    out = decided[0]
    for part in decided[1:]:
        out = out.unionByName(part)
    n_copies = F.col("key.low") + F.col("up").cast("long")
    return out.select("key.doc_id", "key.size", "key.source_size", "key.target", (F.col("key.size") * n_copies).alias("taken"), n_copies.alias("copies"), F.col("key.source").alias("source"), F.col("key.text_hash").alias("text_hash"))


def take_mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 42) -> DataFrame:
    """The mix itself: the documents, all columns, each as often as ``mix_sources`` takes it.

    Rows equal in ``doc_id``, ``source`` and ``text`` share their copies evenly, as far as whole copies allow: they are
    counted first and laid out anew from one of them.
    """
    mixed = mix_sources(docs, weights, share, most, seed)
    taken = settle(mixed.groupBy("doc_id", "source", "text_hash").agg(F.count("*").alias("n"), F.sum("copies").cast("int").alias("copies")), "mix-taken")
    key = {"__mix_doc": F.col("doc_id").cast("long"), "__mix_source": F.col("source").cast("string"), "__mix_text": F.xxhash64(F.col("text").cast("string"))}
    keyed = docs.withColumns(key)

    def laid_out(rows: DataFrame, copies: DataFrame) -> DataFrame:
        t = copies.select(F.col("doc_id").alias("__a"), F.col("source").alias("__b"), F.col("text_hash").alias("__c"), F.col("copies").alias("__copies"))
        same = F.col("__mix_doc").eqNullSafe(F.col("__a")) & F.col("__mix_source").eqNullSafe(F.col("__b")) & (F.col("__mix_text") == F.col("__c"))
        joined = rows.join(t, same).where("__copies > 0")
        return joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), "__copies")).alias("__copy")).drop("__copy")

    out = laid_out(keyed, taken.where("n = 1"))
    again = taken.where("n > 1")
    if again.isEmpty():
        return out
    single = keyed.join(again.select(F.col("text_hash").alias("__mix_text")).distinct(), "__mix_text", "left_semi").dropDuplicates(list(key))
    return out.unionByName(laid_out(single, again))

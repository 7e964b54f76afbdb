"""Small helpers: a key of its own for every row of a narrow table, and lookups among sorted bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numbered_repeats(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns with ``copy``: 1 to n for n rows that are equal in all of them.

    Equal rows are counted before they meet (so a row that makes up a third of the table is no hot key), and a hash of
    the columns and ``copy`` then spreads them evenly and alike in every run.
    """
    counted = df.groupBy(*columns).agg(F.count("*").alias("copies"))
    return counted.select(*columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))


SALTS = 1024  # most shares that the rows of one key are dealt to


def salted_join(left: DataFrame, right: DataFrame, on: list[str], *row: str, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` (one row a key) where a key may hold any share of ``left``.

    A hash of the ``row`` columns deals the rows of a key to salts; the right side goes only to the salts that a key has,
    which a grouping with map-side counts tells. Keys are not null.
    """
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(*row), F.lit(SALTS)).cast("int"))
    present = salted.groupBy(*on, "__salt").count().select(*on, "__salt")
    return salted.join(present.join(right, on), [*on, "__salt"], how).drop("__salt")


def index_among(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are smaller than the value: halvings, as deep as the logarithm of their number."""

    def half(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value <= F.lit(bounds[middle]), half(low, middle)).otherwise(half(middle + 1, high))

    return half(0, len(bounds))

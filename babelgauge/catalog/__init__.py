"""The runnable query catalogue: every operator applied to the given tables, with a DuckDB query to check it.

``views`` derives the inputs (corpora, logs, runs, failures) from the driver's tables; the other modules pair a
Spark query with an independently written SQL query per operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from babelgauge.catalog.views import Inputs, with_views

Query = Callable[[Inputs], DataFrame]


class Catalogue:
    def __init__(self) -> None:
        self.spark: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, key: str, query: Query, sql: str | None = None) -> None:
        if key in self.spark:
            raise ValueError(f"duplicate query {key}")
        self.spark[key] = query
        if sql is not None:
            self.sql[key] = with_views(sql)


def build() -> Catalogue:
    from babelgauge.catalog import analysis, control, latency, quality, sources, text

    catalogue = Catalogue()
    for module in (sources, text, latency, analysis, quality, control):
        module.register(catalogue.add)
    return catalogue


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(query: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: query(Inputs(spark, sf_dir))

    return {key: bind(query) for key, query in build().spark.items()}


def oracle_sql() -> dict[str, str]:
    return build().sql

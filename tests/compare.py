"""Run catalogue queries next to their SQL. ``python -m tests.compare [sf] [key prefix ...]``"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

from babelgauge.catalog import oracle_sql, queries
from babelgauge.session import get_spark

ROOT = "/root/testdata"


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return repr(v + 0.0)
    return f"{type(v).__name__}:{v}"


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(value(row[i]) for i in order) for row in data)


def differences(spark_rows: list[tuple], duck_rows: list[tuple]) -> str | None:
    if len(spark_rows) != len(duck_rows):
        return f"{len(spark_rows)} rows against {len(duck_rows)}"
    for a, b in zip(spark_rows, duck_rows):
        if a != b:
            return f"{a}\n     != {b}"
    return None


def check(spark, con, folder: str, key: str, query, sql: str | None) -> tuple[str | None, float, float, int]:
    start = time.time()
    df = query(spark, folder)
    got = rows(df.columns, df.collect())
    spent = time.time() - start
    if sql is None:
        return None, spent, 0.0, len(got)
    start = time.time()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = rows(names, result.fetchall())
    problem = None
    if sorted(names) != sorted(df.columns):
        problem = f"columns {sorted(df.columns)} against {sorted(names)}"
    return problem or differences(got, expected), spent, time.time() - start, len(got)


def main(sf: str = "0.01", *prefixes: str) -> int:
    spark = get_spark("compare", cores=8)
    folder = f"{ROOT}/sf{sf}"
    con, sqls, bad = database(folder), oracle_sql(), []
    for key, query in queries().items():
        if prefixes and not key.startswith(prefixes):
            continue
        try:
            problem, spent, duck, n = check(spark, con, folder, key, query, sqls.get(key))
        except Exception as error:  # report and go on with the other queries
            problem, spent, duck, n = f"{type(error).__name__}: {str(error)[:700]}", 0, 0, 0
        note = "" if key in sqls else " (no SQL)"
        print(f"{'FAIL' if problem else 'ok  '} {key:32} {n:7} rows  spark {spent:6.2f}s  duck {duck:6.2f}s{note}", flush=True)
        if problem:
            bad.append(key)
            print("    ", problem, flush=True)
    print(len(bad), "failed:", bad)
    return len(bad)


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))

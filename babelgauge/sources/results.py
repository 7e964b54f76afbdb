"""Result files: reading one or many CSVs of drifting schemas, and writing result tables."""

from __future__ import annotations

import csv
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from babelgauge.functions.models import canonical_dataset, short_name
from babelgauge.functions.text import SPACE_CHARACTERS
from babelgauge.schemas import run_schema
from babelgauge.session import settle
from babelgauge.sources.tables import Table

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def read_results(spark: SparkSession, path: str | list[str], version: int = 24) -> DataFrame:
    """Result CSVs with a header, of one known schema version."""
    return spark.read.schema(run_schema(version)).option("header", True).option("enforceSchema", False).csv(path)


NOT_A_HEADER = "not a result file header"


def _cells(line: str) -> list[str]:
    return [cell.strip() for cell in next(csv.reader([line], skipinitialspace=True), [])]


def _places(header: list[str], names: Sequence[str], file: str) -> list[int]:
    """Where every result column stands in a file's rows; -1 for those it does not have."""
    if set(header) - set(names) or len(set(header)) < len(header):
        raise ValueError(f"{NOT_A_HEADER}: {header} in {file}")
    return [header.index(name) if name in header else -1 for name in names]


def _picked(line: str, places: list[int]) -> list[str | None]:
    cells = _cells(line)
    return [(cells[p] or None) if 0 <= p < len(cells) else None for p in places]


def _columns(lines: pa.Array, places: list[int]) -> list[pa.Array]:
    """``_picked`` of many lines of one file, a column for each name. Only lines with a quote need the reader of CSV."""
    cells = pc.split_pattern(lines, ",")
    lengths = pc.list_value_length(cells).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, start = pc.utf8_trim(cells.flatten(), SPACE_CHARACTERS), np.cumsum(lengths) - lengths
    flat = pc.if_else(pc.equal(flat, ""), pa.scalar(None, pa.string()), flat)
    out = [flat.take(pa.array(start + p, mask=p >= lengths)) if p >= 0 else pa.nulls(len(lines), pa.string()) for p in places]
    quoted = pc.match_substring(lines, '"')
    if pc.any(quoted).as_py():
        picked = [_picked(line, places) for line in lines.filter(quoted).to_pylist()]
        out = [pc.replace_with_mask(column, quoted, pa.array(values, pa.string())) for column, values in zip(out, zip(*picked))]
    return out


def _parsed(names: Sequence[str]):
    """An Arrow function over the lines of files (value, file, start): rows by name. ``header`` is a file's first line;
    ``later`` a line of a part of a file whose header another task has read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, places = None, None

        def rows(file: str, lines: pa.Array, header: bool = False) -> pa.RecordBatch:
            empty = pa.nulls(len(lines), pa.string())
            known = not header and places is not None
            columns = _columns(lines, places) if known else [empty] * len(names)
            labels = [pa.array([file] * len(lines), pa.string()), lines if header else empty, empty if header or known else lines]
            return pa.RecordBatch.from_arrays([*labels, *columns], names=["file", "header", "later", *names])

        for batch in batches:
            lines, starts = batch.column(0).cast(pa.string()), batch.column(2)
            files = batch.column(1).dictionary_encode()
            code = files.indices.to_numpy(zero_copy_only=False)
            bounds = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(code)] if len(code) else []
            for at, stop in zip(bounds, bounds[1:]):
                file = batch.column(1)[at].as_py()
                if file != current:
                    current, places = file, None
                    if starts[at].as_py() == 0:
                        places = _places(_cells(lines[at].as_py()), names, file)
                        yield rows(file, lines.slice(at, 1), header=True)
                        at += 1
                part = lines.slice(at, stop - at)
                part = part.filter(pc.not_equal(pc.utf8_trim(part, SPACE_CHARACTERS), ""))
                if len(part):
                    yield rows(file, part)

    return run


def _parsed_later(names: Sequence[str]):
    """The same over (file, header, later): lines that have been given their header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_picked(line, _places(_cells(header), names, file)) for file, header, line in zip(*(batch.column(i).to_pylist() for i in range(3)))]
            columns = [pa.array(c, pa.string()) for c in zip(*rows)] if rows else [pa.array([], pa.string())] * len(names)
            yield pa.RecordBatch.from_arrays(columns, names=list(names))

    return run


def read_result_folder(spark: SparkSession, path: str, pattern: str = "*metric*") -> DataFrame:
    """All result files of a folder whose names match. Columns go by name, in any order; missing ones are null.

    One scan, whatever the number of files and headers: a task reads a file's first line and then its rows by name. Only a
    file so large that it is read in several parts needs more: the lines of its later parts are joined to its header.
    Values that do not fit a column's type are null. A column that result rows do not have is an error, never dropped.
    The result is a written table.
    """
    lines = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(path)
    placed = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    fields = run_schema().fields
    names = [f.name for f in fields]
    texts = ", ".join(f"`{name}` string" for name in names)
    try:
        found = settle(placed.mapInArrow(_parsed(names), f"file string, header string, later string, {texts}"), "result-files")
    except PySparkException as error:
        if NOT_A_HEADER in str(error):
            raise ValueError(next(line for line in str(error).splitlines() if NOT_A_HEADER in line).strip()) from error
        raise
    headers = found.where("header IS NOT NULL").select("file", "header")
    later = found.where("later IS NOT NULL").select("file", "later").join(headers, "file").select("file", "header", "later")
    rows = found.where("header IS NULL AND later IS NULL").select(*names).union(later.mapInArrow(_parsed_later(names), texts))
    return rows.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in fields])


def union_versions(frames: Sequence[DataFrame], empty: DataFrame | None = None) -> DataFrame:
    """Union by name. Columns a version lacks are null; the result has the newest layout."""
    merged = empty if empty is not None else frames[0].sparkSession.createDataFrame([], run_schema())
    for frame in frames:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    return merged


def write_results(runs: DataFrame, path: str, mode: str = "append", batch: tuple[str, int] | None = None) -> bool:
    """Append to (or overwrite) a result table laid out by dataset and model; readers see all of it or nothing.

    ``batch`` (a writer and its batch number) makes a retried append harmless. The rebalance hint gives every part a few
    files of even size: a hot model is split over several tasks and a rare one does not cost a file per task.
    """
    out = runs.withColumn("dataset", canonical_dataset(F.col("dataset_name"))).withColumn("model", short_name(F.col("model_name")))
    table, part = Table(runs.sparkSession, path), result_part(F.col("dataset"), F.col("model"))
    if mode not in ("append", "overwrite"):
        raise ValueError(f"unknown mode {mode!r}")
    return table.append(out, batch, part) if mode == "append" else table.replace(out, batch, part)


def result_part(dataset: Column, model: Column) -> Column:
    return F.concat_ws("|", F.coalesce(dataset, F.lit("")), F.coalesce(model, F.lit("")))


def read_result_table(spark: SparkSession, path: str, dataset: str | None = None, model: str | None = None) -> DataFrame:
    """A table made by ``write_results``, all of it or one dataset and model (only their folders are read)."""
    parts = [f"{dataset}|{model}"] if dataset is not None and model is not None else None
    return Table(spark, path).read(run_schema().add("dataset", "string").add("model", "string"), parts)


def write_sample_counts(parts: DataFrame, path: str) -> DataFrame:
    """Append one row per split with the number of samples used, as train and eval reports do."""
    parts.groupBy("part").agg(F.count("*").alias("samples")).write.mode("append").parquet(path)
    return parts.sparkSession.read.schema("part string, samples long").parquet(path)

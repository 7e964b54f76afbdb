"""What the corpus operators need from the session: written tables, an importable package, and memory given back."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from babelgauge import session
from babelgauge.session import is_local

ROWS = 512  # of whole texts in an Arrow batch: the default of 10,000 is held several times over, in the JVM and in Python
_PACKAGE_AT: set[str] = set()  # applications whose workers have the package


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most ``ROWS`` rows while a table is written; the session's own setting holds again after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= ROWS:
        spark.conf.set(key, str(ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def settle(df: DataFrame, label: str) -> DataFrame:
    """``session.settle`` with small Arrow batches."""
    with small_batches(df.sparkSession):
        return session.settle(df, label)


def share_package(spark: SparkSession) -> None:
    """Let the Python workers of a local session import this package from any working folder.

    On a cluster the submitter ships it, as with every package (``--py-files``, or a path all executors have).
    """
    app = spark.sparkContext.applicationId
    if app not in _PACKAGE_AT and is_local(spark):
        spark.sparkContext.addFile(os.path.dirname(os.path.abspath(session.__file__)), recursive=True)
        _PACKAGE_AT.add(app)


def give_back() -> None:
    """Return freed memory to the system: workers are kept for later tasks, and what they hold adds up beside the heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def tidy(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A function over batches that gives its memory back at the end of a task."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped

"""Session set-up and the shared work folder."""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "babelgauge", cores: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benches. On a cluster the submitter provides the session."""
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    cores = cores or os.cpu_count() or 1
    settings = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(max(cores, 8)),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "12g",
        "spark.babelgauge.textTasks": str(2 * cores),  # test tables are small
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process (``local-cluster`` is not)."""
    return spark.sparkContext.master.split("[")[0] == "local"


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local session that has none set works below its warehouse folder. On a cluster an unset value is an error,
    because a machine-local folder would lose data with the executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not is_local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"


_WORK: dict[str, list[str]] = {}  # paths handed out, by application


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _WORK.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


@contextmanager
def work_scope(spark: SparkSession) -> Iterator[None]:
    """Remove the intermediate tables made inside when it ends. Results that are read later must be written inside:
    a query's DataFrame reads its intermediate tables when it runs.

    ``with work_scope(spark): query(spark, folder).write.parquet(out)``
    """
    paths = _WORK.setdefault(spark.sparkContext.applicationId, [])
    before = len(paths)
    try:
        yield
    finally:
        for path in paths[before:]:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        del paths[before:]


def settle(df: DataFrame, label: str, **options: str) -> DataFrame:
    """The same rows from a table in the shared folder, for results that several later steps read.

    A written table survives lost executors and is computed once, where a lazy plan would be computed per reader.
    """
    path = work_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Remove settled tables that nothing reads any more: what was made from them must be written by now."""
    for df in tables:
        spark = df.sparkSession
        names = {file.split("/")[-2] for file in df.inputFiles()}
        for path in _WORK.get(spark.sparkContext.applicationId, []):
            if path.split("/")[-1] in names:
                place = spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def read_spread(spark: SparkSession, path: str) -> DataFrame:
    """Read a Parquet table of texts, in as many tasks as ``spark.babelgauge.textTasks`` asks for.

    A file with a single row group is one task however many cores there are, so small test tables are worth dealing
    out; whoever makes the session says so. Without the setting the scan is left as it is.
    """
    df = spark.read.parquet(path)
    tasks = spark.conf.get("spark.babelgauge.textTasks", None)
    return df.repartition(int(tasks)) if tasks else df

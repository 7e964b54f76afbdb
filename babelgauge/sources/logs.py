"""Forward-pass logs, failure records and failure texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from babelgauge.schemas import FAILURE_DDL, FORWARD_DDL, schema_of
from babelgauge.sources.tables import Table


def read_forward_files(spark: SparkSession, path: str) -> DataFrame:
    """Header-less ``layer_type, latency_s`` files; also those with a column before these two."""
    rows = spark.read.schema("a string, b string, c string").csv(path)
    short = F.col("c").isNull()
    return rows.select(F.when(short, F.col("a")).otherwise(F.col("b")).alias("layer_type"),
                       F.when(short, F.col("b")).otherwise(F.col("c")).cast("double").alias("latency_s"))


def append_forward_log(log: DataFrame, path: str, batch: tuple[str, int] | None = None) -> bool:
    """Add the calls of one or more runs to the log table. A batch the table has already is not added again."""
    return Table(log.sparkSession, path).append(log.select(*schema_of(FORWARD_DDL).names), batch, F.col("run_id"))


def reset_forward_log(log: DataFrame, path: str, batch: tuple[str, int] | None = None) -> bool:
    """Replace the calls of exactly the runs in ``log``; all other runs stay as they are."""
    return Table(log.sparkSession, path).replace_parts(log.select(*schema_of(FORWARD_DDL).names), F.col("run_id"), batch)


def read_forward_log(spark: SparkSession, path: str) -> DataFrame:
    return Table(spark, path).read(FORWARD_DDL)


def append_failures(failures: DataFrame, path: str) -> None:
    """Header-less failure records."""
    failures.select(*schema_of(FAILURE_DDL).names).write.mode("append").csv(path)


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FAILURE_DDL).csv(path)


# Label and column of every entry of a failure text, in order, with the separator it uses.
TEXT_ENTRIES = [("model_name", "model_name", ": "), ("Batch_size", "batch_size", ": "),
                ("dataset_size", "dataset_size", ": "), ("max_gen_length", "max_gen_length", ": "),
                ("beam_size", "beam_size", ": "), ("max_input_seq_length", "max_input_seq_length", ": "),
                ("tokenizer_padding_setting", "tokenizer_padding_setting", ": "),
                ("dataset_name", "dataset_name", "= ")]


# The lines around a record, and what a warning starts with.
RECORD, TRACE, RULE, DONE = ("ERROR: Exception occured during runtime!", "Full traceback message:", "**********",
                             "End of traceback message")
WARNING = "WARNING! Number of total encoded tokens and number of encoder forward passes are not equal."
WARNINGS = 20_000  # lines of a file of warnings


def failure_text() -> Column:
    """The ``Hyperparameters: ...`` line of a failure record. A null is written as ``None``."""
    entries = [F.concat(F.lit(label + separator), F.coalesce(F.col(column).cast("string"), F.lit("None")))
               for label, column, separator in TEXT_ENTRIES]
    return F.concat(F.lit("Hyperparameters: "), F.concat_ws(", ", *entries))


def write_failure_texts(failures: DataFrame, path: str) -> None:
    """Failure records with their traceback (column ``message``) as text. The message is one line of JSON, so whatever it
    holds (rules, record lines, settings) cannot be taken for a part of the log."""
    message = F.concat(F.lit(RULE), F.to_json(F.struct("message")))
    lines = F.concat_ws("\n", F.lit(RECORD), failure_text(), F.lit(TRACE), message, F.lit(RULE), F.lit(DONE))
    failures.select(lines.alias("value")).write.mode("append").text(path)


def write_warning_texts(runs: DataFrame, path: str) -> None:
    """Warnings that batches and forward passes do not match, one line each. Between two record lines, or in a file without
    any, a reader takes all of them as one record, so files hold ``WARNINGS`` lines at most."""
    runs.select(F.concat(F.lit(WARNING), failure_text()).alias("value")) \
        .write.mode("append").option("maxRecordsPerFile", WARNINGS).text(path)


def read_failure_texts(spark: SparkSession, path: str) -> DataFrame:
    """Failures and warnings back from the text logs: ``kind`` (error or warning), the settings, and ``message``.

    A record goes from one record line to the next, whatever lies between (warnings). Settings are read from the lines
    outside the traceback and found by their labels in order, so commas inside a value are kept. Messages are JSON as
    written here, or the raw text of older logs.
    """
    records = spark.read.option("lineSep", RECORD + "\n").text(path)
    body = rf"(?s)\n?{TRACE}\n\*{{10}}(.*?)\n?\*{{10}}(?:\n{DONE}|$|\n)"
    trace = F.regexp_extract("value", body, 1)
    outside = F.regexp_replace("value", body, "\n")
    # both are taken from a record once, below the explode: above it they would search the whole record for every line
    found = records.select(trace.alias("trace"), F.regexp_extract_all(
        outside, F.lit(r"([^\n]*)Hyperparameters: [^\n]*"), F.lit(0)).alias("lines"))
    each = found.select("trace", F.explode("lines").alias("line"))
    pattern = "".join(rf"(?:, dataset_size_after[^:]*: \d+)?,? ?{label}{separator}(.*?)" for label, _, separator in TEXT_ENTRIES)
    types = {field.name: field.dataType for field in schema_of(FAILURE_DDL).fields}
    warned = F.col("line").startswith("WARNING")
    values = [F.nullif(F.regexp_extract("line", rf"Hyperparameters:{pattern}\s*$", i + 1), F.lit("None")).cast(types[column])
              .alias(column) for i, (_, column, _) in enumerate(TEXT_ENTRIES)]
    quoted = F.col("trace").rlike(r"^\{.*\}$")
    message = F.when(quoted, F.get_json_object("trace", "$.message")).otherwise(F.nullif("trace", F.lit("")))
    return each.select(F.when(warned, "warning").otherwise("error").alias("kind"), *values, F.when(~warned, message).alias("message"))

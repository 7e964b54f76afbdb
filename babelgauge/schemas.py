"""Table schemas. Column names are part of the result-file format and must not change."""

from __future__ import annotations

from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

TYPES = {"string": StringType(), "long": LongType(), "double": DoubleType(), "boolean": BooleanType()}

# The result row, in file order.
RUN_DDL = """
    model_name string, total_params long, use_archer boolean, device_memory_ratio double,
    dataset_name string, dataset_size long, dataset_size_after_filter_wrt_input_len long,
    src_lang string, tgt_lang string, batch_size long, beam_size long, max_gen_length long,
    max_input_seq_length long, tokenizer_padding_setting string, sacrebleu double, spBleu double,
    chrf double, chrfpp double, meteor double, gen_len double, encoder_latency_s double,
    decoder_latency_s double, encoder_throughput double, decoder_throughput double
"""
FAILURE_DDL = """
    model_name string, batch_size long, dataset_size string, max_gen_length long, beam_size long,
    max_input_seq_length long, tokenizer_padding_setting string, dataset_name string
"""
FORWARD_DDL = "run_id long, call_seq long, layer_type string, latency_s double"
QUALITY_COLUMNS = ["sacrebleu", "spBleu", "chrf", "chrfpp", "meteor"]
SPEED_COLUMNS = ["encoder_latency_s", "decoder_latency_s", "encoder_throughput", "decoder_throughput"]
# Columns that older result files lack, by number of columns.
MISSING_BY_VERSION = {
    24: [],
    23: ["device_memory_ratio"],
    22: ["use_archer", "device_memory_ratio"],
    21: ["use_archer", "device_memory_ratio", "dataset_size_after_filter_wrt_input_len"],
}
# The keys that identify one experiment (batch size is not one of them).
EXPERIMENT_KEYS = [
    "model_name", "dataset_name", "dataset_size", "max_gen_length", "beam_size",
    "max_input_seq_length", "tokenizer_padding_setting", "use_archer", "device_memory_ratio",
]


def schema_of(ddl: str) -> StructType:
    """A flat schema from ``name type, ...``; needs no running session, so modules can use it on import."""
    parts = [part.split() for part in ddl.split(",")]
    return StructType([StructField(name, TYPES[kind]) for name, kind in parts])


def run_schema(version: int = 24) -> StructType:
    """Schema of a result file with the given number of columns."""
    missing = MISSING_BY_VERSION[version]
    return StructType([field for field in schema_of(RUN_DDL).fields if field.name not in missing])


RUN_COLUMNS = run_schema().names

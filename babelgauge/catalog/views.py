"""Inputs derived from the driver's tables, in both dialects.

The engine's real inputs are parallel corpora, forward-pass logs, experiment rows and failure logs. Each is
derived from a whole table; the derivation only reshapes, it never leaves out rows to make a check cheaper.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from babelgauge.operators.ordering import running_sum
from babelgauge.plans.studies import merged_runs
from babelgauge.session import read_spread

TEXT_TABLES = ["documents"]  # read with enough partitions for text work
TABLES = ["documents", "conversations", "events", "lineitem"]

# name -> SQL that both engines read the same way
SHARED = {
    "corpus": """
        SELECT a.conv_id * 1000 + a.turn AS id, a.text AS en, b.text AS fr
        FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
        WHERE a.role = 'user' AND b.role = 'assistant'""",
    "forward_log": """
        SELECT user_id % 20 AS run_id, event_id AS call_seq, ts,
            CASE WHEN event_type IN ('signup', 'purchase') THEN 'encoder' ELSE 'decoder' END AS layer_type,
            value / 1000 AS latency_s
        FROM events WHERE event_type <> 'error'""",
    # batches without tokens and a quick call were not recorded, so some runs miss batches
    "batch_tokens": """
        SELECT run_id, batch_idx, n_tokens FROM (
            SELECT user_id % 20 AS run_id, value, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS n_tokens,
                CAST(row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) - 1 AS BIGINT) AS batch_idx
            FROM events WHERE event_type IN ('signup', 'purchase')) t
        WHERE n_tokens > 0 OR value > 25""",
    "run_tokens": """
        SELECT user_id % 20 AS run_id,
            CAST(sum(CASE WHEN event_type IN ('signup', 'purchase')
                THEN CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) ELSE 0 END) AS BIGINT) AS encoder_tokens,
            CAST(sum(CASE WHEN event_type IN ('view', 'click')
                THEN CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) ELSE 0 END) AS BIGINT) AS decoder_tokens,
            count(*) AS n_rows
        FROM events WHERE event_type <> 'error' GROUP BY user_id % 20""",
    "runs": """
        SELECT CASE l_suppkey % 6 WHEN 0 THEN 't5-base' WHEN 1 THEN 't5-large'
                WHEN 2 THEN 'facebook/nllb-200-distilled-600M' WHEN 3 THEN 'facebook/nllb-moe-54b'
                WHEN 4 THEN 'google/switch-base-128' ELSE 'google/switch_16_finetuned' END AS model_name,
            CAST(220000000 + (l_suppkey % 6) * 100000000 AS BIGINT) AS total_params,
            CASE l_returnflag WHEN 'A' THEN true WHEN 'N' THEN false END AS use_archer,
            CASE WHEN l_returnflag = 'A' THEN CASE CAST(l_quantity AS BIGINT) % 4
                WHEN 0 THEN 0.1e0 WHEN 1 THEN 0.3e0 WHEN 2 THEN 0.6e0 ELSE 0.9e0 END END AS device_memory_ratio,
            CASE WHEN l_linestatus = 'F' THEN 'wmt14' ELSE 'facebook/flores' END AS dataset_name,
            CAST(CASE WHEN l_partkey % 5 = 0 THEN 1 WHEN l_linestatus = 'F' THEN 3000 ELSE 997 END AS BIGINT)
                AS dataset_size,
            CAST(CASE WHEN l_partkey % 5 = 0 THEN 1
                WHEN l_linestatus = 'F' THEN CASE l_orderkey % 3 WHEN 0 THEN 3000 WHEN 1 THEN 1370 ELSE 2627 END
                ELSE CASE l_orderkey % 3 WHEN 0 THEN 997 WHEN 1 THEN 199 ELSE 898 END END AS BIGINT)
                AS dataset_size_after_filter_wrt_input_len,
            'en' AS src_lang, 'fr' AS tgt_lang,
            CAST(CASE l_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 16 ELSE 32 END AS BIGINT) AS batch_size,
            CAST(CASE l_linenumber % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 8 WHEN 4 THEN 16
                ELSE 64 END AS BIGINT) AS beam_size,
            CAST(CASE l_orderkey % 5 WHEN 0 THEN 32 WHEN 1 THEN 64 WHEN 2 THEN 128 WHEN 3 THEN 256 ELSE 512 END
                AS BIGINT) AS max_gen_length,
            CAST(CASE l_orderkey % 3 WHEN 0 THEN -1 WHEN 1 THEN 15 ELSE 30 END AS BIGINT) AS max_input_seq_length,
            CASE l_partkey % 2 WHEN 0 THEN 'pad_to_max_length' ELSE 'do_not_pad' END AS tokenizer_padding_setting,
            floor(l_extendedprice / 200) / 10e0 AS sacrebleu, floor(l_extendedprice / 180) / 10e0 AS spBleu,
            floor(l_extendedprice / 150) / 10e0 AS chrf, floor(l_extendedprice / 155) / 10e0 AS chrfpp,
            floor(l_extendedprice / 150) / 1000e0 AS meteor, l_quantity AS gen_len,
            (1 + l_partkey % 97) / 1000e0 AS encoder_latency_s, (1 + l_orderkey % 89) / 1000e0 AS decoder_latency_s,
            CAST(l_partkey % 2003 AS DOUBLE) AS encoder_throughput,
            CAST(l_orderkey % 5003 AS DOUBLE) AS decoder_throughput
        FROM lineitem""",
    # four schema versions of the result rows; they overlap, so that deduplication has work to do
    "frag_24": "SELECT * FROM runs WHERE gen_len > 20",
    "failures": """
        SELECT user_id % 20 AS sweep_id, event_id AS seq,
            CAST(CASE CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4
                WHEN 3 THEN 8 WHEN 4 THEN 16 ELSE 32 END AS BIGINT) AS batch_size,
            CASE WHEN user_id % 3 = 0 THEN 'all' ELSE '1' END AS dataset_size,
            CASE WHEN value > 20 THEN 'torch.cuda.OutOfMemoryError: CUDA Out Of Memory. Tried to allocate more'
                ELSE 'TypeError: NoneType object is not callable' END AS message
        FROM events WHERE event_type = 'error'""",
    "failure_records": """
        SELECT CASE WHEN sweep_id < 7 THEN 't5-large' WHEN sweep_id < 14 THEN 'facebook/nllb-moe-54b'
                ELSE 'google/switch_16_finetuned' END AS model_name,
            batch_size, dataset_size, CAST(32 * batch_size AS BIGINT) AS max_gen_length, batch_size AS beam_size,
            CAST(CASE WHEN dataset_size = 'all' THEN -1 ELSE 15 END AS BIGINT) AS max_input_seq_length,
            CASE WHEN sweep_id < 10 THEN 'do_not_pad' ELSE 'no_pad_fill' END AS tokenizer_padding_setting,
            CASE WHEN seq < 5000 THEN 'wmt14' ELSE 'flores200' END AS dataset_name, message
        FROM failures""",
    "run_config": """
        SELECT run_id, CASE WHEN run_id < 7 THEN 't5-base' WHEN run_id < 14 THEN 'facebook/nllb-200-distilled-600M'
                ELSE 'google/switch_16_finetuned' END AS model_name,
            CAST(220000000 + run_id * 1000000 AS BIGINT) AS total_params, run_id >= 14 AS use_archer,
            CASE WHEN run_id >= 14 THEN 0.9e0 END AS device_memory_ratio, 'wmt14' AS dataset_name,
            'en' AS src_lang, 'fr' AS tgt_lang, CAST(32 AS BIGINT) AS batch_size, CAST(4 AS BIGINT) AS beam_size,
            CAST(128 AS BIGINT) AS max_gen_length,
            CAST(CASE WHEN run_id < 5 THEN 300 WHEN run_id < 10 THEN 600 ELSE -1 END AS BIGINT) AS max_input_seq_length,
            'do_not_pad' AS tokenizer_padding_setting
        FROM (SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS run_id FROM documents) s""",
}
# Columns the older fragments lack, and their slice of the runs.
FRAGMENTS = {
    "frag_21": ("gen_len <= 10", ["use_archer", "device_memory_ratio", "dataset_size_after_filter_wrt_input_len"]),
    "frag_22": ("gen_len > 10 AND gen_len <= 25", ["use_archer", "device_memory_ratio"]),
    "frag_23": ("gen_len > 25 AND gen_len <= 40", ["device_memory_ratio"]),
}

# A stand-in translator: two-letter words are lost and three-letter words come out inflected.
SPARK_VIEWS = {
    "pairs": """
        SELECT doc_id AS id, lang, CAST(substr(source, 4) AS BIGINT) AS run_id, text AS reference,
            array_join(transform(filter(split(text, ' ', -1), w -> length(w) <> 2),
                w -> CASE WHEN length(w) = 3 THEN concat(w, 's') ELSE w END), ' ') AS prediction
        FROM documents""",
    "token_ids": """
        SELECT doc_id AS idx, transform(split(text, ' ', -1), w -> CASE WHEN length(w) = 2 THEN -100
            WHEN length(w) <= 1 THEN 0 ELSE length(w) + 2 END) AS ids FROM documents""",
}
DUCK_VIEWS = {
    "pairs": """
        SELECT doc_id AS id, lang, CAST(substr(source, 4) AS BIGINT) AS run_id, text AS reference,
            array_to_string(list_transform(list_filter(string_split(text, ' '), lambda w: length(w) <> 2),
                lambda w: CASE WHEN length(w) = 3 THEN w || 's' ELSE w END), ' ') AS prediction
        FROM documents""",
    "token_ids": """
        SELECT doc_id AS idx, list_transform(string_split(text, ' '), lambda w: CASE WHEN length(w) = 2 THEN -100
            WHEN length(w) <= 1 THEN 0 ELSE CAST(length(w) AS INTEGER) + 2 END) AS ids FROM documents""",
}
for _name, (_rows, _missing) in FRAGMENTS.items():
    SPARK_VIEWS[_name] = f"SELECT * EXCEPT ({', '.join(_missing)}) FROM runs WHERE {_rows}"
    DUCK_VIEWS[_name] = f"SELECT * EXCLUDE ({', '.join(_missing)}) FROM runs WHERE {_rows}"


# The clean run table, restated in SQL: the input of the analysis queries.
DUCK_VIEWS["runs_all"] = """
    SELECT * FROM frag_21 UNION ALL BY NAME SELECT * FROM frag_22 UNION ALL BY NAME SELECT * FROM frag_23
    UNION ALL BY NAME SELECT * FROM frag_24"""
DUCK_VIEWS["clean"] = """
    SELECT DISTINCT * REPLACE (coalesce(use_archer, false) AS use_archer) FROM runs_all
    WHERE beam_size <= 32 AND max_gen_length <= 128"""
DUCK_VIEWS["short_clean"] = """
    SELECT * REPLACE (replace(replace(model_name, 'facebook/', ''), 'google/', '') AS model_name) FROM clean"""


def _used(sql: str, views: dict[str, str]) -> list[str]:
    """The views a query needs, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in views:
            if name not in order and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                visit(views[name])
                order.append(name)

    visit(sql)
    return order


def with_views(sql: str) -> str:
    """A DuckDB query with the views it uses put in front."""
    views = SHARED | DUCK_VIEWS
    ctes = [f"{name} AS ({views[name]})" for name in _used(sql, views)]
    if not ctes:
        return sql
    body = sql.strip()
    if found := re.match(r"WITH\s+(RECURSIVE\s)?", body):
        return f"WITH {found[1] or ''}" + ",\n".join(ctes) + ",\n" + body[found.end():]
    return "WITH " + ",\n".join(ctes) + "\n" + body


class Inputs:
    """The derived tables of one data folder, as lazy DataFrames: ``Inputs(spark, folder).pairs``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        return read_spread(self.spark, path) if name in TEXT_TABLES else self.spark.read.parquet(path)

    def __getattr__(self, name: str) -> DataFrame:
        views = SHARED | SPARK_VIEWS
        if name in TABLES:
            return self.table(name)
        if name not in views:
            raise AttributeError(name)
        sources = {source: getattr(self, source) for source in [*TABLES, *views]
                   if re.search(rf"\b(FROM|JOIN)\s+{source}\b", views[name])}
        sql = re.sub(r"\b(FROM|JOIN)\s+(\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in sources else m[0],
                     views[name])
        return self.spark.sql(sql, **sources)

    @property
    def batch_tokens(self) -> DataFrame:
        """As the SQL view, but batches are numbered without a window over a whole run."""
        calls = self.events.where("event_type IN ('signup', 'purchase')").selectExpr(
            "user_id % 20 AS run_id", "event_id", "value",
            "CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS n_tokens")
        return running_sum(calls, ["run_id"], "event_id", F.lit(1), "place").where("n_tokens > 0 OR value > 25") \
            .selectExpr("run_id", "CAST(place - 1 AS BIGINT) AS batch_idx", "n_tokens")

    @property
    def fragments(self) -> list[DataFrame]:
        return [self.frag_21, self.frag_22, self.frag_23, self.frag_24]

    @property
    def clean(self) -> DataFrame:
        """The merged and cleaned run table."""
        return merged_runs(self.fragments)

"""The corpus operators as queries over the given tables, each with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_voronoi_knn(spark: SparkSession, folder: str) -> DataFrame:
    from babelgauge.llm.voronoi_knn import top_products

    return top_products(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op2_line_templates(spark: SparkSession, folder: str) -> DataFrame:
    from babelgauge.llm.line_templates import line_dedup

    found = line_dedup(table(spark, folder, "documents"), min_docs=2, support=3, similarity=0.8)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    from babelgauge.llm.pivotal_mix import mix_sources

    return mix_sources(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    from babelgauge.llm.kk_packing import pack_documents

    return pack_documents(table(spark, folder, "documents"), tokenizer_path(), capacity=2048, end_id=1)


def op5_suffix_tree_score(spark: SparkSession, folder: str) -> DataFrame:
    from babelgauge.llm.suffix_tree_lm import suffix_tree_scores

    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return suffix_tree_scores(table(spark, folder, "documents"), held_out)


def op6_hash_ring(spark: SparkSession, folder: str) -> DataFrame:
    from babelgauge.llm.hash_ring import shard_documents

    placed = shard_documents(table(spark, folder, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    from babelgauge.llm.winnowing import edited_neighbours

    return edited_neighbours(table(spark, folder, "documents"), gram=16, window=32)


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from babelgauge.llm.doubling_dedup import remove_repeats

    found = remove_repeats(table(spark, folder, "documents"), window=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    from babelgauge.llm.kernel_language import fit, identify

    docs = table(spark, folder, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    found = identify(docs, fit(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from babelgauge.llm.pigeonring_simhash import simhash_groups

    found = simhash_groups(table(spark, folder, "documents"), shingle=3, distance=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_phrase_growth(spark: SparkSession, folder: str) -> DataFrame:
    from babelgauge.llm.phrase_growth import collocations

    return collocations(table(spark, folder, "documents"), least=30, top=2000, share=80)


def op12_merkle_sweep(spark: SparkSession, folder: str) -> DataFrame:
    from babelgauge.llm.merkle_sweep import LOWER, UPPER, merkle_manifest

    tampers = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return merkle_manifest(table(spark, folder, "documents"), tampers, F.translate("text", UPPER, LOWER))


def op13_odd_sketch_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from babelgauge.llm.odd_sketch_dedup import near_duplicate_sets

    return near_duplicate_sets(table(spark, folder, "documents"), words=5, percent=85)


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP8_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
p AS (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
h AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM p),
f AS (SELECT s, min(coalesce(doc_id, 9223372036854775807)) AS m FROM h GROUP BY s),
x AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS i FROM h JOIN f USING (s) WHERE coalesce(doc_id, 9223372036854775807) > m),
n AS (SELECT r, count(*) AS c, list(i) AS g FROM x GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(c, 0)::BIGINT AS n_removed,
  sha256(CASE WHEN c IS NULL THEN array_to_string(w, ' ') ELSE coalesce(array_to_string(
    list_filter(w, lambda e, j: NOT list_contains(g, j)), ' '), '') END) AS kept_sha256
FROM d LEFT JOIN n USING (r)
"""


OP11_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS s FROM documents),
w AS MATERIALIZED (SELECT lang, w FROM (SELECT lang, regexp_extract_all(s, '[^\x20\x09]+') AS w FROM p) t WHERE len(w) > 0),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS MATERIALIZED (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS s, count(*) AS a
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w) t, (SELECT unnest([1, 2, 3, 4]) AS k) k WHERE i + k - 1 <= len(w) GROUP BY ALL),
c AS MATERIALIZED (SELECT *, string_split(s, ' ') AS w FROM g WHERE k > 1 AND a >= 30),
x AS (SELECT lang, s, k, a, j, array_to_string(w[1:j], ' ') AS u, array_to_string(w[j + 1:], ' ') AS v FROM (SELECT *, unnest(range(1, k)) AS j FROM c) t),
y AS (SELECT x.lang, x.s, x.k, x.a, x.j, l.a AS l, r.a AS r, 2000000::HUGEINT * x.a // (l.a + r.a) AS score
  FROM x JOIN g l ON l.lang = x.lang AND l.s = u JOIN g r ON r.lang = x.lang AND r.s = v),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, s ORDER BY score, j) = 1),
b AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS s, max(a) AS most
  FROM (SELECT *, unnest(range(1, k + 1)) AS i FROM c) t, (SELECT unnest([2, 3]) AS m) m WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
o AS (SELECT z.* FROM z LEFT JOIN b USING (lang, s) WHERE most IS NULL OR 100 * most < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, s) AS rank, s AS phrase, a, l, r, n, score::BIGINT AS score
FROM o JOIN n USING (lang) QUALIFY rank <= 2000
"""


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE octet_length(encode({value}::VARCHAR))::VARCHAR || ':' || {value}::VARCHAR END"


def _climb(name: str, leaves: str, tree: str, levels: int) -> str:
    """CTEs name_0 .. name_levels: (tree, p, h, m, b, a): nodes of a level, their siblings before and after; m nodes in the tree."""
    sides = """coalesce(string_agg(h, '') OVER (PARTITION BY t, p // 16 ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
      coalesce(string_agg(h, '') OVER (PARTITION BY t, p // 16 ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a"""
    nodes, parts = leaves, []
    for level in range(levels + 1):
        parts.append(f"{name}_{level} AS MATERIALIZED (SELECT *, {sides} FROM (SELECT *, count(*) OVER (PARTITION BY t) AS m FROM ({nodes}) n) n)")
        nodes = f"SELECT t, p // 16 AS p, CASE WHEN any_value(m) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY p)) END AS h FROM {name}_{level} GROUP BY t, p // 16"
    return ",\n".join(parts)


def _fold(name: str, levels: int, digest: str, place: str) -> tuple[str, str, str]:
    """The digest folded up the levels, the siblings met, and the joins they come from."""
    met, joins = [], []
    for level in range(levels):
        node = f"{name}{level}"
        joins.append(f"JOIN {name}_{level} {node} ON {node}.t = d.{name}t AND {node}.p = {place} // {16**level}")
        digest = f"CASE WHEN {node}.m = 1 THEN {digest} ELSE sha256({node}.b || {digest} || {node}.a) END"
        met.append(f"{node}.b || {node}.a")
    return digest, " || ".join(met), "\n".join(joins)


def _op12_sql(levels: int = 6, upper: int = 3) -> str:
    """Trees of at most 16 ** levels leaves and 16 ** upper sources; a level of one node hands it on."""
    fields = [_field(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = _field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    crc = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
      lambda r, c: list_reduce(list_prepend(xor(r, c), range(8)::UBIGINT[]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)),
      4294967295::UBIGINT)"""
    leaf = f"sha256({' || '.join([*fields, _field('text')])})"
    low, low_met, low_joins = _fold("s", levels, "d.c", "d.p")
    top, top_met, top_joins = _fold("u", upper, "sub", "d.q")
    return f"""
WITH d0 AS MATERIALIZED (SELECT doc_id, source, {leaf} AS h, CASE WHEN {crc} % 5 = 0 THEN sha256({' || '.join([*fields, changed])}) ELSE {leaf} END AS c FROM documents),
d1 AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS t,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS LAST, h, c) - 1 AS p FROM d0),
{_climb("s", "SELECT t, p, h FROM d1", "t", levels)},
{_climb("u", f"SELECT 0 AS t, t AS p, h FROM s_{levels}", "t", upper)},
d AS (SELECT *, t AS st, t AS q, 0 AS ut FROM d1),
v AS (SELECT d.*, {low} AS sub, {low_met} AS met FROM d {low_joins}),
w AS (SELECT d.*, {top} AS folded_root, d.met || {top_met} AS proof FROM v d {top_joins})
SELECT w.doc_id, w.h AS leaf, x.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, folded_root, folded_root = r.h AS verified
FROM w JOIN s_{levels} x ON x.t = w.t JOIN u_{upper} r ON true
"""


OP13_SQL = rf"""
WITH RECURSIVE w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5
    THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM w),
g AS MATERIALIZED (SELECT min(r) AS g, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
u AS MATERIALIZED (SELECT g, n, unnest(s) AS x FROM g),
e AS MATERIALIZED (SELECT a, b FROM (SELECT a.g AS a, b.g AS b, any_value(a.n) AS m, any_value(b.n) AS n, count(*) AS c
    FROM u a JOIN u b ON a.x = b.x AND a.g <> b.g GROUP BY a.g, b.g) p WHERE 100 * c >= 85 * (m + n - c)),
t AS (SELECT g AS a, g AS b FROM g UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a),
d AS (SELECT g.g, s.doc_id FROM s JOIN g USING (s)),
m AS (SELECT t.a AS g, min(d.doc_id) AS m FROM t JOIN d ON t.b = d.g GROUP BY t.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, CASE WHEN len(s) = 0 THEN doc_id ELSE m END AS component_id,
  doc_id IS NOT DISTINCT FROM CASE WHEN len(s) = 0 THEN doc_id ELSE m END AS kept
FROM s LEFT JOIN g USING (s) LEFT JOIN m USING (g)
"""

OP1_SQL = """
WITH x AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score
  FROM x q JOIN x d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id AND len(q.v) = len(d.v))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_voronoi_knn": OP1_SQL, "op11_phrase_growth": OP11_SQL, "op8_substring_dedup": OP8_SQL, "op12_merkle_sweep": _op12_sql(), "op13_odd_sketch_dedup": OP13_SQL}

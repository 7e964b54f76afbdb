"""The stand-in model of the inference queries, in Python and in SQL.

It translates word by word, runs out of memory on batches of many words, and cannot handle some texts at all. It records
one call of each layer, with a time that depends on the words alone.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH, ROOM = 32, 6000  # rows; words that fit into memory together
MEMORY, OTHER = "CUDA out of memory. Tried to allocate more", "'NoneType' object is not callable"


def stand_in(texts, timer):
    words = [text.split(" ") for text in texts]
    total = sum(map(len, words))
    if total > ROOM:
        raise RuntimeError(MEMORY)
    if any(len(w) % 97 == 13 for w in words):
        raise TypeError(OTHER)
    out = [" ".join(w + "s" if len(w) == 3 else w for w in row if len(w) != 2) for row in words]
    timer.record("encoder", total / 1000)
    timer.record("decoder", sum(o.count(" ") + 1 for o in out) / 1000)
    return out


def words_in_place(predictions, references):
    """The stand-in of a user's metric: words that stand at their place, and words."""
    out = []
    for hyp, ref in zip(predictions, references):
        h, r = hyp.split(" "), ref.split(" ")
        out.append((sum(a == b for a, b in zip(h, r)), max(len(h), len(r))))
    return out


PREDICTED = """array_to_string(list_transform(list_filter(string_split({text}, ' '), lambda w: length(w) <> 2),
    lambda w: CASE WHEN length(w) = 3 THEN w || 's' ELSE w END), ' ')"""


def tries_sql(rows: str) -> str:
    """CTEs over ``rows (run_id, n, text)``: ``said`` (rows with a prediction), ``calls``, ``failed`` (in order n, size DESC)."""
    sizes = [32, 8, 2, 1]
    ctes = [f"""t0 AS (SELECT *, n // {BATCH} AS batch_id, len(string_split(text, ' ')) AS w, {PREDICTED.format(text='text')} AS p,
        0 AS s, false AS q FROM {rows})"""]
    before = "t0"
    for size in sizes:
        whole = f"OVER (PARTITION BY run_id, n // {size})"
        ctes.append(f"t{size} AS (SELECT * REPLACE (sum(w) {whole} AS s, bool_or(w % 97 = 13) {whole} AS q) FROM {before})")
        before = f"(SELECT * FROM t{size} WHERE s > {ROOM})"
    done = " UNION ALL ".join(f"SELECT *, {size} AS size FROM t{size} WHERE s <= {ROOM}" for size in sizes)
    memory = " UNION ALL ".join(f"""SELECT run_id, any_value(batch_id), min(n), CAST({size} AS BIGINT), 'RuntimeError: {MEMORY}' FROM t{size}
        WHERE s > {ROOM} GROUP BY run_id, n // {size}""" for size in sizes)
    other = OTHER.replace("'", "''")
    return ",\n".join([*ctes, f"done AS (SELECT *, count(*) OVER (PARTITION BY run_id, size, n // size) = 1 AS alone FROM ({done}) d)", "said AS (SELECT * FROM done WHERE w % 97 <> 13)",
        """calls AS (SELECT run_id, w / 1000 AS e, d / 1000 AS d FROM (
            SELECT run_id, sum(w) AS w, sum(len(string_split(p, ' '))) AS d FROM said WHERE NOT q GROUP BY run_id, size, n // size
            UNION ALL SELECT run_id, w, len(string_split(p, ' ')) FROM said WHERE q) c)""",
        f"""failed AS (SELECT * FROM (SELECT run_id, batch_id, n AS idx, CAST(CASE WHEN alone THEN size ELSE 1 END AS BIGINT) AS batch_size, 'TypeError: {other}' AS message
            FROM done WHERE w % 97 = 13 UNION ALL {memory}) f)"""])

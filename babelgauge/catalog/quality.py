"""Metrics: M1 to M9 and the per-length report."""

from __future__ import annotations

from pyspark.sql import functions as F

from babelgauge.catalog.standin import words_in_place
from babelgauge.functions.stems import STEP_2, STEP_3, STEP_4
from babelgauge.functions.text import word_count
from babelgauge.operators.quality import (Meteor, evaluate, metric, metrics, register_metric, row_statistics, scores,
                                          sum_statistics, unregister_metric)
from babelgauge.operators.vocabulary import canonical_tokens, token_counts
from babelgauge.functions.text import tokens_13a
from babelgauge.session import settle

DIGITS = 9  # scores are compared to nine decimals; exp and ln differ in the last bits between engines
NAMES = ["sacrebleu", "spBleu", "chrf", "chrfpp", "meteor"]
OPTIONS = {"spBleu": {"tokenize": "char"}}

CLEAN_SQL = ("replace(replace(replace(replace(replace(replace(replace({x}, '<skipped>', ''), '-' || chr(10), ''), "
             "chr(10), ' '), '&quot;', '\"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')")


def words_sql(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda s: s <> '')"


def tokens_13a_sql(x: str) -> str:
    x = "' ' || " + CLEAN_SQL.format(x=f"regexp_replace({x}, '\\s+$', '')") + " || ' '"
    for pattern, replacement in ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "),
                                 (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        x = f"regexp_replace({x}, '{pattern}', '{replacement}', 'g')"
    return words_sql(x)


def chars_sql(x: str) -> str:
    return f"list_filter(string_split(regexp_replace({x}, '\\s+', '', 'g'), ''), lambda c: c <> '')"


def chrf_words_sql(x: str) -> str:
    marks = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~'"
    return f"""flatten(list_transform({words_sql(x)}, lambda w: CASE WHEN length(w) = 1 THEN [w]
        WHEN contains({marks}, w[-1]) THEN [w[:-2], w[-1]] WHEN contains({marks}, w[1]) THEN [w[1], w[2:]]
        ELSE [w] END))"""


def overlap_sql(name: str, source: str, by: str, tokens, orders: int) -> str:
    """CTE ``name``: per group and order the sums of matches, prediction grams and reference grams."""
    leads = ", ".join(f"lead(tok, {i}) OVER w AS t{i}" for i in range(1, orders))
    grams = ", ".join("tok" + "".join(f" || chr(1) || t{i}" for i in range(1, n)) for n in range(1, orders + 1))
    return f"""
    {name}_t AS (SELECT id, {by} AS grp, {tokens('prediction')} AS h, {tokens('reference')} AS r FROM {source}),
    {name}_w AS (
        SELECT id, side, tok, {leads} FROM (
            SELECT id, 'h' AS side, unnest(range(1, len(h) + 1)) AS pos, unnest(h) AS tok FROM {name}_t UNION ALL
            SELECT id, 'r', unnest(range(1, len(r) + 1)), unnest(r) FROM {name}_t) s
        WINDOW w AS (PARTITION BY id, side ORDER BY pos)),
    {name}_g AS (
        SELECT id, n, side, gram, count(*) AS c FROM (
            SELECT id, side, unnest(range(1, {orders} + 1)) AS n, unnest([{grams}]) AS gram FROM {name}_w) e
        WHERE gram IS NOT NULL GROUP BY ALL),
    {name}_m AS (
        SELECT a.id, a.n, sum(least(a.c, b.c)) AS m FROM {name}_g a JOIN {name}_g b
            ON a.id = b.id AND a.n = b.n AND a.gram = b.gram AND a.side = 'h' AND b.side = 'r' GROUP BY ALL),
    {name} AS (
        SELECT t.grp, o.n, coalesce(sum(m.m), 0) AS m, sum(greatest(len(t.h) - o.n + 1, 0)) AS th,
            sum(CASE WHEN len(t.r) >= o.n THEN greatest(len(t.h) - o.n + 1, 0) ELSE 0 END) AS th_seen,
            sum(greatest(len(t.r) - o.n + 1, 0)) AS tr
        FROM {name}_t t CROSS JOIN (SELECT unnest(range(1, {orders} + 1)) AS n) o
        LEFT JOIN {name}_m m ON m.id = t.id AND m.n = o.n GROUP BY ALL)"""


def bleu_sql(name: str, source: str, by: str, tokens) -> str:
    """CTE ``name_score(grp, score)``."""
    return overlap_sql(name, source, by, tokens, 4) + f""",
    {name}_p AS (
        SELECT *, CASE WHEN m = 0 THEN 100e0 / (pow(2, sum(CASE WHEN m = 0 THEN 1 ELSE 0 END)
            OVER (PARTITION BY grp ORDER BY n)) * th) ELSE 100e0 * m / th END AS p FROM {name}),
    {name}_score AS (
        SELECT grp, CASE WHEN sum(m) = 0 OR min(th) = 0 THEN 0e0 ELSE
            CASE WHEN max(th) >= max(tr) THEN 1e0 ELSE exp(1 - CAST(max(tr) AS DOUBLE) / max(th)) END
            * exp(sum(ln(CASE WHEN p > 0 THEN p END)) / 4) END AS score
        FROM {name}_p GROUP BY grp)"""


def chrf_sql(name: str, overlaps: list[str]) -> str:
    """CTE ``name_score(grp, score)`` over the rows of one or two overlap CTEs."""
    rows = " UNION ALL ".join(f"SELECT grp, m, th_seen, tr FROM {o}" for o in overlaps)
    return f"""
    {name}_pr AS (
        SELECT grp, avg(CAST(m AS DOUBLE) / th_seen) AS p, avg(CAST(m AS DOUBLE) / tr) AS r
        FROM ({rows}) u WHERE th_seen > 0 AND tr > 0 GROUP BY grp),
    {name}_score AS (SELECT grp, CASE WHEN p + r > 0 THEN 500e0 * p * r / (4 * p + r) ELSE 0e0 END AS score
        FROM {name}_pr)"""


def stems_sql(words: str) -> str:
    """CTEs up to ``stems (w, stem)``: Porter's rules as one regular expression for each condition."""
    c, v = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
    some, one, more, vowel = f"^({c})?{v}{c}", f"^({c})?{v}{c}({v})?$", f"^({c})?{v}{c}{v}{c}", f"^({c})?[aeiouy]"
    short = f"^{c}[aeiouy][^aeiouwxy]$"

    def rules(pairs, condition):
        cases = "".join(f""" WHEN ends_with(s, '{a}') THEN CASE WHEN regexp_matches(s[:-{len(a) + 1}], '{condition}') {more_}
            THEN s[:-{len(a) + 1}] || '{b}' ELSE s END""" for a, b, more_ in sorted(pairs, key=lambda p: -len(p[0])))
        return f"CASE{cases} ELSE s END"

    left = "CASE WHEN ends_with(s, 'ed') THEN s[:-3] ELSE s[:-4] END"
    steps = [
        "CASE WHEN ends_with(s, 'sses') OR ends_with(s, 'ies') THEN s[:-3] WHEN ends_with(s, 's') AND NOT ends_with(s, 'ss') THEN s[:-2] ELSE s END",
        f"""CASE WHEN ends_with(s, 'eed') THEN CASE WHEN regexp_matches(s[:-4], '{some}') THEN s[:-2] ELSE s END
            WHEN (ends_with(s, 'ed') OR ends_with(s, 'ing')) AND regexp_matches({left}, '{vowel}') THEN
                CASE WHEN regexp_matches({left}, '(at|bl|iz)$') THEN {left} || 'e'
                WHEN ({left})[-1] = ({left})[-2] AND regexp_matches({left}, '[^aeiouylsz]$') THEN ({left})[:-2]
                WHEN regexp_matches({left}, '{short}') THEN {left} || 'e' ELSE {left} END ELSE s END""",
        f"CASE WHEN ends_with(s, 'y') AND regexp_matches(s[:-2], '{vowel}') THEN s[:-2] || 'i' ELSE s END",
        rules([(a, b, "") for a, b in STEP_2], some), rules([(a, b, "") for a, b in STEP_3], some),
        rules([(a, "", "AND regexp_matches(s, '[st]ion$')" if a == "ion" else "") for a in STEP_4], more),
        f"""CASE WHEN ends_with(s, 'e') AND (regexp_matches(s[:-2], '{more}') OR (regexp_matches(s[:-2], '{one}')
            AND NOT regexp_matches(s[:-2], '{short}'))) THEN s[:-2] ELSE s END""",
        f"CASE WHEN ends_with(s, 'll') AND regexp_matches(s, '{more}') THEN s[:-2] ELSE s END"]
    ctes = [f"stem_0 AS (SELECT DISTINCT w, w AS s FROM {words} x)"]
    ctes += [f"stem_{i} AS (SELECT w, CASE WHEN length(w) < 3 THEN w ELSE {step} END AS s FROM stem_{i - 1})" for i, step in enumerate(steps, 1)]
    return ", ".join([*ctes, f"stems AS (SELECT w, s AS stem FROM stem_{len(steps)})"])


def meteor_sql(name: str, source: str, by: str, tokens=tokens_13a_sql, second: str | None = None, join: str = "") -> str:
    """CTE ``name_score(grp, score)``: the alignment as a join of k-th last occurrences.

    ``second`` is an expression over ``tok`` (and the columns of ``join``): a second stage that matches what the first left
    free by it.
    """
    both = f"""
    {name}_f AS (
        SELECT id, side, pos, tok, row_number() OVER (PARTITION BY id, side, tok ORDER BY pos DESC) AS k FROM (
            SELECT id, side, pos, {second} AS tok FROM {name}_k x {join} WHERE NOT EXISTS (
                SELECT 1 FROM {name}_e e WHERE e.id = x.id AND x.pos = CASE x.side WHEN 'h' THEN e.hp ELSE e.rp END)) y),
    {name}_a AS (
        SELECT * FROM {name}_e UNION ALL
        SELECT a.id, a.pos, b.pos FROM {name}_f a JOIN {name}_f b
            ON a.id = b.id AND a.tok = b.tok AND a.k = b.k AND a.side = 'h' AND b.side = 'r'),""" if second else f"""
    {name}_a AS (SELECT * FROM {name}_e),"""
    side = """SELECT id, '{s}' AS side, unnest(range(1, len({s}) + 1)) AS pos, lower(unnest({s})) AS tok FROM {name}_t"""
    return f"""
    {name}_t AS (SELECT id, {by} AS grp, {tokens('prediction')} AS h, {tokens('reference')} AS r FROM {source}),
    {name}_k AS (
        SELECT *, row_number() OVER (PARTITION BY id, side, tok ORDER BY pos DESC) AS k
        FROM ({side.format(s='h', name=name)} UNION ALL {side.format(s='r', name=name)}) u),
    {name}_e AS (
        SELECT a.id, a.pos AS hp, b.pos AS rp FROM {name}_k a JOIN {name}_k b
            ON a.id = b.id AND a.tok = b.tok AND a.k = b.k AND a.side = 'h' AND b.side = 'r'),{both}
    {name}_c AS (
        SELECT id, count(*) AS m, sum(CASE WHEN hp = php + 1 AND rp = prp + 1 THEN 0 ELSE 1 END) AS ch FROM (
            SELECT id, hp, rp, lag(hp) OVER w AS php, lag(rp) OVER w AS prp FROM {name}_a
            WINDOW w AS (PARTITION BY id ORDER BY hp)) l GROUP BY id),
    {name}_s AS (
        SELECT t.grp, coalesce((1 - 0.5e0 * pow(CAST(ch AS DOUBLE) / m, 3)) * (CAST(m AS DOUBLE) / len(h))
            * (CAST(m AS DOUBLE) / len(r)) / (0.9e0 * m / len(h) + 0.1e0 * m / len(r)), 0e0) AS s
        FROM {name}_t t LEFT JOIN {name}_c c ON c.id = t.id),
    {name}_score AS (SELECT grp, avg(s) AS score FROM {name}_s GROUP BY grp)"""


def all_metrics_sql(source: str, by: str) -> str:
    """The CTEs of all five metrics: b, s, c, p and m ``_score``."""
    return ",".join([
        bleu_sql("b", source, by, tokens_13a_sql), bleu_sql("s", source, by, chars_sql),
        overlap_sql("co", source, by, chars_sql, 6), overlap_sql("wo", source, by, chrf_words_sql, 2),
        chrf_sql("c", ["co"]), chrf_sql("p", ["co", "wo"]), meteor_sql("m", source, by)])


ALL_SCORES = f"""round(b.score, {DIGITS}) AS sacrebleu, round(s.score, {DIGITS}) AS "spBleu",
    round(c.score, {DIGITS}) AS chrf, round(p.score, {DIGITS}) AS chrfpp, round(m.score, {DIGITS}) AS meteor"""
ALL_JOINS = "b_score b JOIN s_score s USING (grp) JOIN c_score c USING (grp) JOIN p_score p USING (grp) JOIN m_score m USING (grp)"


def rounded(df, columns=NAMES):
    return df.select(*[F.round(c, DIGITS).alias(c) if c in columns else F.col(c) for c in df.columns])


SPACES_SQL = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"


def register(add) -> None:
    def one(key, m, ctes, name):
        add(key, lambda t: rounded(evaluate(t.pairs, [m], ["lang"]), [m.name]),
            f"WITH {ctes} SELECT grp AS lang, round(score, {DIGITS}) AS {m.name} FROM {name}_score")

    one("m1_bleu", metric("sacrebleu"), bleu_sql("b", "pairs", "lang", tokens_13a_sql), "b")
    one("m2_subword_bleu", metric("spBleu", tokenize="char"), bleu_sql("s", "pairs", "lang", chars_sql), "s")
    one("m3_chrf", metric("chrf"), overlap_sql("co", "pairs", "lang", chars_sql, 6) + "," + chrf_sql("c", ["co"]), "c")
    one("m4_chrfpp", metric("chrfpp"), overlap_sql("co", "pairs", "lang", chars_sql, 6) + ","
        + overlap_sql("wo", "pairs", "lang", chrf_words_sql, 2) + "," + chrf_sql("c", ["co", "wo"]), "c")
    one("m5_meteor", metric("meteor"), meteor_sql("m", "pairs", "lang"), "m")

    one("m5_meteor_with_stems", metric("meteor", stem=True), stems_sql(f"(SELECT lower(unnest({tokens_13a_sql('prediction')})) AS w FROM pairs UNION "
        f"SELECT lower(unnest({tokens_13a_sql('reference')})) FROM pairs)") + "," + meteor_sql("m", "pairs", "lang", second="stem", join="JOIN stems ON w = tok"), "m")

    def m5_classes(t):
        """METEOR with a second stage of word classes from a table: a word and the same word with a final s."""
        pairs = t.pairs.select("id", "lang", "prediction", "reference", tokens_13a(F.col("prediction")).alias("hyp_tokens"),
                               tokens_13a(F.col("reference")).alias("ref_tokens"))
        words = token_counts(pairs, F.transform(F.concat("hyp_tokens", "ref_tokens"), F.lower))
        mapping = settle(words.withColumn("canonical", F.regexp_replace("token", "s$", "")), "classes")
        staged = canonical_tokens(pairs, "id", ["hyp_tokens", "ref_tokens"], mapping, keep=False)
        m = Meteor(stages=(("hyp_tokens_canonical", "ref_tokens_canonical"),))
        return rounded(evaluate(staged, [m], ["lang"]))

    add("m5_meteor_with_classes", m5_classes, f"""WITH {meteor_sql("m", "pairs", "lang", second="regexp_replace(tok, 's$', '')")}
        SELECT grp AS lang, round(score, {DIGITS}) AS meteor FROM m_score""")
    lcs = """RECURSIVE words AS (SELECT id, regexp_extract_all(lower(en), '[a-z0-9]+') AS h, regexp_extract_all(lower(fr), '[a-z0-9]+') AS r FROM corpus),
        lcs AS (SELECT id, h, r, 0 AS i, list_transform(r, lambda x: 0) AS row FROM words UNION ALL
            SELECT id, h, r, i + 1, list_transform(range(1, len(r) + 1), lambda j: greatest(row[j], list_max(list_transform(
                range(1, j + 1), lambda k: CASE WHEN r[k] = h[i + 1] THEN coalesce(row[k - 1], 0) + 1 ELSE 0 END)))) FROM lcs WHERE i < len(h))"""
    add("m10_rouge_l", lambda t: evaluate(t.corpus.select(F.col("en").alias("prediction"), F.col("fr").alias("reference")),
                                          [metric("rouge")]).select(F.round("rougeL", DIGITS).alias("rougeL")),
        f"""WITH {lcs} SELECT round(avg(CASE WHEN len(h) + len(r) = 0 THEN 0 ELSE 2e0 * coalesce(row[-1], 0) / (len(h) + len(r)) END), {DIGITS}) AS "rougeL"
        FROM lcs WHERE i = len(h)""")
    add("m10_rouge_l_long", lambda t: rounded(evaluate(t.pairs, [metric("rouge")], ["lang"]), ["rougeL"]))
    def u4(t):
        """A metric of one's own: the share of words that stand at their place."""
        register_metric("in_place", ["hits", "words"], words_in_place, "{hits} / nullif({words}, 0D)",
                        [("a b c", "a c b"), ("", "x"), ("one two", "one two three"), ("x", "")])
        try:
            return rounded(evaluate(t.pairs, metrics(["in_place", "sacrebleu"]), ["lang"]), ["in_place", "sacrebleu"])
        finally:
            unregister_metric("in_place")

    add("u4_own_metric", u4, f"""WITH {bleu_sql("b", "pairs", "lang", tokens_13a_sql)},
        w AS (SELECT lang, string_split(trim(prediction, {SPACES_SQL}), ' ') AS h, string_split(trim(reference, {SPACES_SQL}), ' ') AS r FROM pairs),
        s AS (SELECT lang, sum(len(list_filter(range(1, least(len(h), len(r)) + 1), lambda i: h[i] = r[i]))) AS hits,
            sum(greatest(len(h), len(r))) AS words FROM w GROUP BY lang)
        SELECT lang, round(hits / words, {DIGITS}) AS in_place, round(score, {DIGITS}) AS sacrebleu FROM s JOIN b_score ON grp = lang""")

    def m2_pieces(t):
        """BLEU over the pieces of a published vocabulary."""
        import public_tokenizers

        m = metric("spBleu", tokenize=f"ranks:{public_tokenizers.path('byte_bpe_multi_50k.tiktoken')}")
        return rounded(evaluate(t.pairs, [m], ["lang"]))

    add("m2_published_pieces", m2_pieces)
    add("m6_registry", lambda t: rounded(evaluate(t.pairs, metrics(["sacrebleu", "chrf++"]))
                                         .withColumnRenamed("chrf++", "chrfpp")),
        f"""WITH {bleu_sql("b", "pairs", "1", tokens_13a_sql)}, {overlap_sql("co", "pairs", "1", chars_sql, 6)},
        {overlap_sql("wo", "pairs", "1", chrf_words_sql, 2)}, {chrf_sql("p", ["co", "wo"])}
        SELECT round(b.score, {DIGITS}) AS sacrebleu, round(p.score, {DIGITS}) AS chrfpp
        FROM b_score b JOIN p_score p USING (grp)""")
    add("m7_report", lambda t: rounded(
        evaluate(t.pairs, metrics(NAMES, **OPTIONS), gen_len=word_count(F.col("prediction"))), [*NAMES, "gen_len"]),
        f"""WITH {all_metrics_sql("pairs", "1")}
        SELECT {ALL_SCORES}, round((SELECT avg(len(string_split(prediction, ' '))) FROM pairs), {DIGITS}) AS gen_len
        FROM {ALL_JOINS}""")

    def m8(t):
        chosen = metrics(["sacrebleu", "meteor"])
        batches = sum_statistics(row_statistics(t.pairs, chosen, ["run_id", "lang"]), ["run_id", "lang"])
        merged = sum_statistics(batches.drop("run_id"), ["lang"])
        return rounded(scores(merged, chosen, ["lang"]))

    add("m8_merged_batches", m8,
        f"""WITH {bleu_sql("b", "pairs", "lang", tokens_13a_sql)}, {meteor_sql("m", "pairs", "lang")}
        SELECT grp AS lang, round(b.score, {DIGITS}) AS sacrebleu, round(m.score, {DIGITS}) AS meteor
        FROM b_score b JOIN m_score m USING (grp)""")
    add("m9_grouped", lambda t: rounded(evaluate(t.pairs, metrics(NAMES, **OPTIONS), ["run_id"])),
        f"WITH {all_metrics_sql('pairs', 'run_id')} SELECT grp AS run_id, {ALL_SCORES} FROM {ALL_JOINS}")
    bucket = "CASE WHEN {n} <= 15 THEN '15' WHEN {n} <= 30 THEN '30' WHEN {n} <= 82 THEN '82' ELSE 'more' END"
    add("m9_by_length", lambda t: rounded(evaluate(
        t.pairs.withColumn("words", word_count(F.col("reference")))
        .withColumn("length", F.expr(bucket.format(n="words"))), metrics(["sacrebleu", "chrf"]), ["length"])),
        f"""WITH sized AS (SELECT *, {bucket.format(n="len(string_split(reference, ' '))")} AS length FROM pairs),
        {bleu_sql("b", "sized", "length", tokens_13a_sql)}, {overlap_sql("co", "sized", "length", chars_sql, 6)},
        {chrf_sql("c", ["co"])}
        SELECT grp AS length, round(b.score, {DIGITS}) AS sacrebleu, round(c.score, {DIGITS}) AS chrf
        FROM b_score b JOIN c_score c USING (grp)""")

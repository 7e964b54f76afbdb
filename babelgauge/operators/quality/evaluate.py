"""Running metrics over a table of pairs: one scan, one grouped sum, whatever the number of metrics."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from babelgauge.functions.text import strip
from babelgauge.operators.quality.metrics import HYP, REF, Bleu, Meteor, Metric


def row_statistics(pairs: DataFrame, metrics: Sequence[Metric], keep: Sequence[str | Column] = (),
                   prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    """``keep`` columns and the summable statistics of every pair."""
    stages = {c for m in metrics for pair in getattr(m, "stages", ()) for c in pair}
    texts = pairs.select(*keep, *[strip(F.coalesce(F.col(c), F.lit(""))).alias(name)
                                  for c, name in ((prediction, HYP), (reference, REF))], *sorted(stages))
    names = texts.columns[:len(keep)]
    tokens: dict[str, Column] = {HYP: F.col(HYP), REF: F.col(REF)}
    overlaps: dict[str, Column] = {}
    counts: dict[str, str] = {}
    for m in metrics:
        for name, column in m.tokens().items():
            tokens.setdefault(name, column)
        for name, column in m.overlaps().items():
            overlaps.setdefault(name, column)
        counts |= {m.part(part): formula for part, formula in m.counts().items()}
    counts = _split_once(metrics, overlaps, _shared(overlaps, counts))
    return texts.select(*names, *_named(tokens)).select(*names, *_named(overlaps)) \
        .selectExpr(*names, *[f"{formula} AS {name}" for name, formula in counts.items()])


def _shared(overlaps: dict[str, Column], counts: dict[str, str]) -> dict[str, str]:
    """``counts`` with the character overlaps of lower orders read from the highest one, which holds them; those are dropped."""
    orders = sorted(int(found[1]) for name in overlaps if (found := re.fullmatch(r"_overlap_char_(\d+)", name)))
    for low in orders[:-1]:
        del overlaps[f"_overlap_char_{low}"]

        def place(found: re.Match) -> str:
            i = int(found[1])
            return f"_overlap_char_{orders[-1]}[{i if i < low else i - low + orders[-1]}]"  # after the matches both lengths

        counts = {name: re.sub(rf"\b_overlap_char_{low}\[(\d+)\]", place, formula) for name, formula in counts.items()}
    return counts


def _split_once(metrics: Sequence[Metric], overlaps: dict[str, Column], counts: dict[str, str]) -> dict[str, str]:
    """``counts`` with METEOR's alignment read from the pass of a BLEU that splits texts by the same rule; its own is dropped."""
    for meteor in metrics:
        if not isinstance(meteor, Meteor) or not meteor.plain():
            continue
        bleu = next((m for m in metrics if isinstance(m, Bleu) and m.tokenize == meteor.tokenize), None)
        own = meteor.part("aligned")
        if bleu is None or own not in overlaps:
            continue
        del overlaps[own]
        shared, orders = next(iter(bleu.overlaps())), bleu.orders
        overlaps[shared] = bleu.with_alignment()
        place = [orders + 2, orders + 3, orders, orders + 1]  # matches, chunks and the two lengths
        counts = {name: re.sub(rf"\b{own}\[(\d)\]", lambda found: f"{shared}[{place[int(found[1])]}]", formula)
                  for name, formula in counts.items()}
    return counts


def _named(columns: dict[str, Column]) -> list[Column]:
    return [column.alias(name) for name, column in columns.items()]


def sum_statistics(statistics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add the statistics up, per group or over everything. Sums of sums are sums, so this also merges."""
    parts = [c for c in statistics.columns if c not in by]
    sums = statistics.groupBy(*by).agg({c: "sum" for c in parts})
    return sums.selectExpr(*by, *[f"`sum({c})` AS {c}" for c in parts])


def scores(sums: DataFrame, metrics: Sequence[Metric], by: Sequence[str] = (), extra: Sequence[str] = ()) -> DataFrame:
    return sums.selectExpr(*by, *[f"{m.score()} AS `{m.name}`" for m in metrics], *extra)


def evaluate(pairs: DataFrame, metrics: Sequence[Metric], by: Sequence[str] = (), prediction: str = "prediction",
             reference: str = "reference", gen_len: Column | None = None) -> DataFrame:
    """One row of scores per group (one in all without ``by``).

    ``gen_len`` is an optional per-row generated length; its mean is reported as column ``gen_len``.
    """
    keep: list[str | Column] = list(by)
    extra = []
    if gen_len is not None:
        keep += [gen_len.cast("double").alias("_gen"), F.lit(1).cast("long").alias("_rows")]
        extra = ["_gen / _rows AS gen_len"]
    statistics = row_statistics(pairs, metrics, keep, prediction, reference)
    return scores(sum_statistics(statistics, by), metrics, by, extra)

"""The metrics. Each one names its row statistics and the closed form over their sums.

Statistics are plain sums, so partial aggregation, grouping, merging of batches and streaming all work alike.
Intermediate columns are named after what they hold, not after the metric, so metrics share them: BLEU and
METEOR share tokens, chrF and chrF++ share character overlaps.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

from babelgauge.functions import overlap
from babelgauge.functions.text import chrf_words, rouge_words, tokenizer

Tokenizer = str | Callable[[Column], Column]
HYP, REF = "_prediction", "_reference"


@dataclass(frozen=True)
class Metric:
    """Four steps: ``tokens`` -> ``overlaps`` -> ``counts`` (summed over rows) -> ``score``.

    The arithmetic is SQL text: formulas read as formulas, and one expression is one call into the JVM where a
    tree of column objects would be hundreds.
    """

    name: str

    def tokens(self) -> dict[str, Column]:
        return {}

    def overlaps(self) -> dict[str, Column]:
        raise NotImplementedError

    def counts(self) -> dict[str, str]:
        raise NotImplementedError

    def score(self) -> str:
        raise NotImplementedError

    def part(self, part: str) -> str:
        return f"{self.name.replace('+', 'p')}_{part}"


def label(tokenize: Tokenizer) -> str:
    """A column-name-safe label, equal for equal tokenisers."""
    text = tokenize if isinstance(tokenize, str) else f"fn{id(tokenize)}"
    return "".join(c if c.isalnum() else "_" for c in text)


# Tokenisers that are a rule over byte classes: texts go to the overlap function as they are and are split there.
RULES = {"13a": "13a", chrf_words: "chrf"}


def rule(tokenize: Tokenizer) -> str | None:
    ranked = isinstance(tokenize, str) and tokenize.startswith("ranks:")
    return tokenize if ranked else RULES.get(tokenize)


def token_columns(tokenize: Tokenizer, ranked: bool = True) -> dict[str, Column]:
    """The columns that hold the two sides' tokens, or their texts where a rule splits these (with ``ranked`` into pieces too)."""
    if tokenize in RULES or (ranked and rule(tokenize) is not None):
        return {HYP: F.col(HYP), REF: F.col(REF)}
    split = tokenizer(tokenize)
    return {f"{side}_{label(tokenize)}": split(F.col(side)) for side in (HYP, REF)}


def ngram_count(length: str, order: int) -> str:
    return f"greatest({length} - {order - 1}L, 0L)"


@dataclass(frozen=True)
class Bleu(Metric):
    """Corpus BLEU with exponential smoothing of empty orders and the brevity penalty, 0 to 100."""

    name: str = "sacrebleu"
    tokenize: Tokenizer = "13a"
    orders: int = 4

    def tokens(self) -> dict[str, Column]:
        return {} if self.tokenize == "char" else token_columns(self.tokenize)

    def _overlap(self) -> str:
        return f"_overlap_{label(self.tokenize)}_{self.orders}"

    def overlaps(self) -> dict[str, Column]:
        if self.tokenize == "char":
            return {self._overlap(): overlap.character_overlap(F.col(HYP), F.col(REF), self.orders)}
        hyp, ref = token_columns(self.tokenize)
        return {self._overlap(): overlap.token_overlap(F.col(hyp), F.col(ref), self.orders, rule(self.tokenize))}

    def with_alignment(self) -> Column:
        """The overlap and, after it, the alignment of a METEOR that splits the texts by the same rule."""
        return overlap.overlap_and_alignment(F.col(HYP), F.col(REF), self.orders, RULES[self.tokenize])

    def counts(self) -> dict[str, str]:
        counted = self._overlap()
        out = {"hyp_len": f"{counted}[{self.orders}]", "ref_len": f"{counted}[{self.orders + 1}]"}
        for n in range(1, self.orders + 1):
            out |= {f"match_{n}": f"{counted}[{n - 1}]", f"total_{n}": ngram_count(out["hyp_len"], n)}
        return out

    def score(self) -> str:
        match, total = ([self.part(f"{kind}_{n}") for n in range(1, self.orders + 1)] for kind in ("match", "total"))
        logs = []
        for n, (m, t) in enumerate(zip(match, total), 1):
            empty_orders = " + ".join(f"int({c} = 0)" for c in match[:n])
            logs.append(f"ln(if({m} = 0, 100D / (pow(2D, {empty_orders}) * {t}), 100D * {m} / {t}))")
        hyp_len, ref_len = self.part("hyp_len"), self.part("ref_len")
        brevity = f"if({hyp_len} >= {ref_len}, 1D, exp(1D - {ref_len} / {hyp_len}))"
        # unigram matches bound those of every order from above, and the highest order has the fewest grams
        return f"""CASE WHEN {match[0]} > 0 AND {total[-1]} > 0
            THEN {brevity} * exp(({" + ".join(logs)}) / {self.orders}) ELSE 0D END"""


@dataclass(frozen=True)
class ChrF(Metric):
    """Character n-gram F-score, 0 to 100; ``word_order=2`` is the ++ form."""

    name: str = "chrf"
    char_order: int = 6
    word_order: int = 0
    beta: float = 2.0

    def tokens(self) -> dict[str, Column]:
        return token_columns(chrf_words) if self.word_order else {}

    def overlaps(self) -> dict[str, Column]:
        out = {f"_overlap_char_{self.char_order}": overlap.character_overlap(F.col(HYP), F.col(REF), self.char_order)}
        if self.word_order:
            hyp, ref = token_columns(chrf_words)
            out[f"_overlap_word_{self.word_order}"] = overlap.token_overlap(F.col(hyp), F.col(ref), self.word_order, rule(chrf_words))
        return out

    def _orders(self) -> list[tuple[str, int, int]]:
        """(overlap column, highest order, order) of every order that is averaged."""
        sizes = [("char", self.char_order), ("word", self.word_order)]
        return [(f"_overlap_{kind}_{top}", top, n) for kind, top in sizes for n in range(1, top + 1)]

    def counts(self) -> dict[str, str]:
        out = {}
        for i, (counted, top, n) in enumerate(self._orders()):
            in_hyp, in_ref = ngram_count(f"{counted}[{top}]", n), ngram_count(f"{counted}[{top + 1}]", n)
            # a prediction's grams count only where the reference has grams of that order
            out |= {f"match_{i}": f"{counted}[{n - 1}]", f"ref_{i}": in_ref, f"hyp_{i}": f"if({in_ref} > 0, {in_hyp}, 0L)"}
        return out

    def score(self) -> str:
        used, precision, recall = [], [], []
        for i in range(self.char_order + self.word_order):
            match, hyp, ref = (self.part(f"{kind}_{i}") for kind in ("match", "hyp", "ref"))
            used.append(f"int({hyp} > 0 AND {ref} > 0)")
            precision.append(f"if({hyp} > 0 AND {ref} > 0, {match} / {hyp}, 0D)")
            recall.append(f"if({hyp} > 0 AND {ref} > 0, {match} / {ref}, 0D)")
        orders = f"nullif({' + '.join(used)}, 0)"
        p, r = (f"(({' + '.join(x)}) / {orders})" for x in (precision, recall))
        weight = self.beta ** 2
        return f"coalesce({100 * (1 + weight)}D * {p} * {r} / nullif({weight}D * {p} + {r}, 0D), 0D)"


@dataclass(frozen=True)
class Meteor(Metric):
    """Mean of sentence scores: harmonic mean of unigram precision and recall with a fragmentation penalty.

    ``stem`` adds a stage of Porter stems. ``stages`` names further columns holding (prediction, reference) token arrays,
    e.g. synonym classes as made by ``canonical_tokens``; each stage matches what the earlier ones left free.
    """

    name: str = "meteor"
    tokenize: Tokenizer = "13a"
    alpha: float = 0.9
    beta: float = 3.0
    gamma: float = 0.5
    stages: tuple[tuple[str, str], ...] = field(default=())
    stem: bool = False

    def tokens(self) -> dict[str, Column]:
        return token_columns(self.tokenize, ranked=False) | {c: F.col(c) for pair in self.stages for c in pair}

    def overlaps(self) -> dict[str, Column]:
        hyp, ref = token_columns(self.tokenize, ranked=False)
        pairs = [(hyp, ref), *self.stages]
        return {self.part("aligned"): overlap.alignment(*[(F.col(h), F.col(r)) for h, r in pairs], stem=self.stem,
                                                         rule=RULES.get(self.tokenize))}

    def plain(self) -> bool:
        """Whether texts are split by a rule and aligned by their surface forms alone."""
        return self.tokenize in RULES and not self.stages and not self.stem

    def counts(self) -> dict[str, str]:
        matches, chunks, hyp_len, ref_len = (f"{self.part('aligned')}[{i}]" for i in range(4))
        p, r = f"({matches} / {hyp_len})", f"({matches} / {ref_len})"
        f_mean = f"({p} * {r} / ({self.alpha}D * {p} + (1D - {self.alpha}D) * {r}))"
        penalty = f"{self.gamma}D * pow({chunks} / {matches}, {self.beta}D)"
        return {"sum": f"if({matches} > 0, (1D - {penalty}) * {f_mean}, 0D)", "rows": "1L"}

    def score(self) -> str:
        return f"{self.part('sum')} / {self.part('rows')}"


@dataclass(frozen=True)
class RougeL(Metric):
    """Mean of sentence scores, 0 to 1: F-measure of the longest common subsequence of the words (letters a-z and digits)."""

    name: str = "rougeL"

    def tokens(self) -> dict[str, Column]:
        return token_columns(rouge_words)

    def overlaps(self) -> dict[str, Column]:
        hyp, ref = token_columns(rouge_words)
        return {self.part("common"): overlap.common_subsequence(F.col(hyp), F.col(ref))}

    def counts(self) -> dict[str, str]:
        common, hyp_len, ref_len = (f"{self.part('common')}[{i}]" for i in range(3))
        # 2PR / (P + R) with P = common / hyp_len and R = common / ref_len
        return {"sum": f"if({common} > 0, 2D * {common} / ({hyp_len} + {ref_len}), 0D)", "rows": "1L"}

    def score(self) -> str:
        return f"{self.part('sum')} / {self.part('rows')}"


@dataclass(frozen=True)
class OwnMetric(Metric):
    """A user's metric: numbers for each row from a function over a batch, and a formula over their sums."""

    fields: tuple[str, ...]
    row: Callable[[list[str], list[str]], object]
    formula: str

    def overlaps(self) -> dict[str, Column]:
        return {self.part("numbers"): overlap.own_numbers(F.col(HYP), F.col(REF), self.row, len(self.fields))}

    def counts(self) -> dict[str, str]:
        return {field: f"{self.part('numbers')}[{i}]" for i, field in enumerate(self.fields)}

    def score(self) -> str:
        return self.formula.format(**{field: self.part(field) for field in self.fields})

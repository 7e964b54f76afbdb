"""Metrics by name."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np

from babelgauge.operators.quality.metrics import Bleu, ChrF, Meteor, Metric, OwnMetric, RougeL


def _subword_bleu(tokenize=None, **options) -> Metric:
    if tokenize is None:
        raise ValueError("spBleu needs tokenize='ranks:<file>', 'spm:<model>', 'char' or a function: no vocabulary is bundled")
    return Bleu(name="spBleu", tokenize=tokenize, **options)


# The accepted names. A name without a factory is known but not available.
REGISTRY: dict[str, Callable[..., Metric] | None] = {
    "sacrebleu": Bleu,
    "spBleu": _subword_bleu,
    "chrf": ChrF,
    "chrf++": lambda **options: ChrF(**{"name": "chrf++", "word_order": 2, **options}),
    "chrfpp": lambda **options: ChrF(**{"name": "chrfpp", "word_order": 2, **options}),
    "comet": None,
    "rouge": RougeL,
    "rougeL": RougeL,
    "meteor": Meteor,
}


def metric(name: str, **options) -> Metric:
    factory = REGISTRY.get(name)
    if factory is None:
        raise ValueError(f"metric {name!r} is not supported; use one of {sorted(k for k, v in REGISTRY.items() if v)}")
    return factory(**options)


def metrics(names: Iterable[str], **options: dict) -> list[Metric]:
    """Several metrics; ``options`` maps a metric name to its keyword arguments."""
    return [metric(name, **options.get(name, {})) for name in names]


def register_metric(name: str, fields: Sequence[str], row: Callable[[list[str], list[str]], np.ndarray], formula: str,
                    examples: Sequence[tuple[str, str]]) -> None:
    """Make a metric of one's own available by name, next to the built-in ones.

    ``row`` gets the predictions and references of some rows and returns one number for each row and field; ``formula`` is
    SQL over the sums of the fields, written ``{field}``. Scores are formulas over sums, which is what lets them be
    grouped, merged and streamed, so ``row`` must treat every row by itself. That is checked on the ``examples``, whole
    and in parts; a metric that is no sum (a median, say) is not accepted.
    """
    if name in REGISTRY:
        raise ValueError(f"metric {name!r} is there already")
    predictions, references = ([pair[i] for pair in examples] for i in (0, 1))
    if len(examples) < 2:
        raise ValueError("at least two examples are needed to check a metric")
    whole = np.asarray(row(predictions, references), np.float64)
    if whole.shape != (len(examples), len(fields)) or not np.isfinite(whole).all():
        raise ValueError(f"{name!r}: one finite number for each of {len(examples)} rows and {len(fields)} fields, not {whole.shape}")
    for size in sorted({1, 2, len(examples) // 2, len(examples) - 1} - {0}):
        cut = range(0, len(examples), size)
        parts = [np.asarray(row(predictions[i:i + size], references[i:i + size]), np.float64).reshape(-1, len(fields)) for i in cut]
        if not np.allclose(np.concatenate(parts), whole, rtol=1e-12, atol=0):
            raise ValueError(f"{name!r}: rows count differently in parts of {size}, so sums cannot be merged")
    formula.format(**{f: "0" for f in fields})  # every field that is used is known
    REGISTRY[name] = lambda **options: OwnMetric(name=name, fields=tuple(fields), row=row, formula=formula, **options)


def unregister_metric(name: str) -> None:
    """Take a metric of one's own out again. Built-in ones stay."""
    factory = REGISTRY.get(name)
    if factory is None or factory is _subword_bleu or not isinstance(factory(), OwnMetric):
        raise ValueError(f"{name!r} is not a metric of one's own")
    del REGISTRY[name]

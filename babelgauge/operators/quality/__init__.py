"""Corpus quality metrics: per-row statistics, one grouped sum, one closed form."""

from babelgauge.operators.quality.evaluate import evaluate, row_statistics, scores, sum_statistics
from babelgauge.operators.quality.metrics import Bleu, ChrF, Meteor, Metric
from babelgauge.operators.quality.registry import metric, metrics, register_metric, unregister_metric

__all__ = ["Bleu", "ChrF", "Meteor", "Metric", "evaluate", "metric", "metrics", "register_metric", "row_statistics",
           "scores", "sum_statistics", "unregister_metric"]

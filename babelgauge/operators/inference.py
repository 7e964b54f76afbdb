"""The data side of batched inference: a user function over sentence batches, every call timed, failures survived.

One pass makes a table of events: predictions, the forward calls of both layers, and failures. Write it (``settle``)
before deriving anything from it, as the function is expensive; ``predictions``, ``forward_log`` and ``failures`` are its
parts.
"""

from __future__ import annotations

import inspect
import sys
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from babelgauge.operators.batching import with_batches
from babelgauge.operators.triage import ERROR_BUDGET, triage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

Translate = Callable[..., list[str]]
UNIT = 64  # batches dealt to a task together
CALL_BITS = 24  # of a call's number: which call of its batch
EVENTS = ("kind string, run_id long, batch_id long, call_seq long, idx long, prediction string, layer_type string, "
          "latency_s double, batch_size long, message string")


class Timer:
    """Forward calls of one attempt: ``with timer("decoder"): ...``, or ``timer.record("decoder", seconds)``."""

    def __init__(self) -> None:
        self.calls: list[tuple[str, float]] = []

    def record(self, layer: str, seconds: float) -> None:
        self.calls.append((layer, float(seconds)))

    @contextmanager
    def __call__(self, layer: str) -> Iterator[None]:
        start = time.perf_counter()
        yield
        self.record(layer, time.perf_counter() - start)


def out_of_memory(error: BaseException) -> bool:
    return isinstance(error, MemoryError) or "out of memory" in str(error).lower()


def smaller(size: int) -> int | None:
    """The batch size after a memory failure (``triage.next_batch_size``): a quarter, but one for two."""
    return None if size == 1 else max(1, size // 4)


def attempt(translate: Translate, texts: list[str], timed: bool) -> tuple[list[str], list[tuple[str, float]]]:
    """Predictions and calls of one attempt. A function without a timer is one encoder call."""
    timer, start = Timer(), time.perf_counter()
    predictions = translate(texts, timer) if timed else translate(texts)
    if not timed:
        timer.record("encoder", time.perf_counter() - start)
    if len(predictions) != len(texts):
        raise ValueError(f"{len(predictions)} predictions for {len(texts)} sentences")
    return predictions, timer.calls


def translate_piece(translate: Translate, texts: list[str], size: int, timed: bool) -> Iterator[tuple]:
    """What comes of the rows of one batch tried with ``size`` rows at a time, as (kind, row, ...) in the order of events.

    A memory failure is recorded and its rows are tried again in smaller pieces, down to single rows. After any other
    failure the rows are tried one by one, so that the row that causes it is the only one lost, and is the record.
    """
    waiting = [(start, min(start + size, len(texts)), size, False) for start in range(0, len(texts), size)][::-1]
    while waiting:
        start, stop, tried, alone = waiting.pop()
        try:
            predictions, calls = attempt(translate, texts[start:stop], timed)
        except Exception as error:  # noqa: BLE001 - whatever the function raises is a record
            message = f"{type(error).__name__}: {error}"
            if out_of_memory(error) and not alone:
                yield "failure", start, tried, message
                rest = smaller(tried)
                if rest:
                    waiting += [(at, min(at + rest, stop), rest, False) for at in range(start, stop, rest)][::-1]
            elif stop - start == 1:
                yield "failure", start, tried, message
            else:
                waiting += [(at, at + 1, 1, True) for at in range(start, stop)][::-1]
            continue
        for layer, seconds in calls:
            yield "call", start, layer, seconds
        for row, prediction in zip(range(start, stop), predictions):
            yield "prediction", row, prediction


def run_batches(corpus: DataFrame, translate: Translate, batch_size: int, text: str = "source", tasks: int | None = None) -> DataFrame:
    """The events (``EVENTS``) of all batches of ``corpus (run_id, idx, <text>)``.

    ``translate(texts)`` or ``translate(texts, timer)`` gives one prediction for each text; with a timer it records the
    forward calls of both layers, else a call is one encoder call. Batches are fixed by ``idx`` within the run, so they
    hold the same rows however the input is partitioned, and failures and retries repeat; a text that is null is empty.
    Tasks get units of ``UNIT`` whole batches by a hash and cut them from their sorted rows, so neither a long run nor
    one with many rows is one task. Rows without ``idx`` are dealt as they come, a bounded number together; their
    batches have no number. ``tasks`` sets their number, as with ``repartition``; else it is left to the session.

    Kinds of events: ``prediction`` (idx, prediction), ``call`` (layer_type, latency_s) of attempts that succeeded, and
    ``failure`` (idx of the first row, batch_size tried, message). ``call_seq`` orders the events of a run.
    """
    timed = len(inspect.signature(translate).parameters) > 1

    names = [c.split()[0] for c in EVENTS.split(", ")]
    types = {c: "Int64" for c in ("run_id", "batch_id", "call_seq", "idx", "batch_size")} | {"latency_s": "float64"}

    def events(held: pd.DataFrame, edges: list[int]) -> pd.DataFrame:
        """What comes of the batches that begin at the edges (the last edge is their end)."""
        runs, numbers, idx = (held[c].astype(object).where(held[c].notna(), None).tolist() for c in ("run_id", "batch_id", "idx"))
        texts = held["text"].fillna("").tolist()
        out = []
        for start, stop in zip(edges[:-1], edges[1:]):
            run, number = runs[start], numbers[start]
            for i, (kind, row, *rest) in enumerate(translate_piece(translate, texts[start:stop], batch_size, timed)):
                head = kind, run, number, None if number is None else (int(number) << CALL_BITS) + i
                if kind == "prediction":
                    out.append((*head, idx[start + row], rest[0], None, None, None, None))
                elif kind == "call":
                    out.append((*head, None, None, rest[0], rest[-1], None, None))
                else:
                    out.append((*head, idx[start + row], None, None, None, rest[0], rest[-1]))
        return pd.DataFrame(out, columns=names, dtype=object).astype(types)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            for c in ("run_id", "batch_id", "idx"):
                frame[c] = frame[c].astype("Int64")
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            if not len(held):
                continue
            keys = held[["run_id", "batch_id"]].astype("float64").fillna(-1)
            run = keys.ne(keys.shift()).any(axis=1).cumsum()
            part = run * (1 << 20) + held.groupby(run).cumcount() // batch_size
            edges = [*part.drop_duplicates().index, len(held)]
            if len(edges) > 2:  # the last batch may go on in the next frame
                yield events(held, edges[:-1])
            held = held.iloc[edges[-2]:].reset_index(drop=True)
        if held is not None and len(held):
            yield events(held, [0, len(held)])

    rows = with_batches(corpus.select(F.col("run_id").cast("long").alias("run_id"), F.col("idx").cast("long").alias("idx"),
                                      F.col(text).alias("text")), batch_size)
    loose = -1 - F.floor(F.monotonically_increasing_id() / (UNIT * batch_size))
    unit = F.when(F.col("idx").isNull(), loose).otherwise(F.floor(F.col("batch_id") / UNIT))
    dealt = rows.withColumn("unit", unit).repartition(*([tasks] if tasks else []), "run_id", "unit").sortWithinPartitions("run_id", "unit", "batch_id", "idx", "text")
    return dealt.select("run_id", "batch_id", "idx", "text").mapInPandas(cut, EVENTS)


def predictions(events: DataFrame) -> DataFrame:
    """``run_id, idx, batch_id, prediction`` of every row that got one."""
    return events.where("kind = 'prediction'").select("run_id", "idx", "batch_id", "prediction")


def forward_log(events: DataFrame) -> DataFrame:
    """``run_id, call_seq, layer_type, latency_s``: both layers, in call order. Failed attempts made no calls."""
    return events.where("kind = 'call'").select("run_id", "call_seq", "layer_type", "latency_s")


def failures(events: DataFrame) -> DataFrame:
    """``sweep_id, seq, batch_id, idx, batch_size, message``: what ``triage`` reads. A run is its own sweep."""
    return events.where("kind = 'failure'").select(F.col("run_id").alias("sweep_id"), F.col("call_seq").alias("seq"),
                                                   "batch_id", "idx", "batch_size", "message")


def failure_records(events: DataFrame, config: DataFrame) -> DataFrame:
    """The failures with the settings of their run: records for the failure log. The batch size is the one tried.

    ``config (run_id, ...)`` has one row a run. Every failure is a record, also of runs without settings.
    """
    told = failures(events).select(F.col("sweep_id").alias("run_id"), "seq", F.col("batch_size").alias("tried"), "message")
    return told.join(config, "run_id", "left").select(
        "run_id", "seq", "model_name", F.col("tried").alias("batch_size"), F.col("dataset_size").cast("string").alias("dataset_size"),
        "max_gen_length", "beam_size", "max_input_seq_length", "tokenizer_padding_setting", "dataset_name", "message")


def within_budget(events: DataFrame, budget: int = ERROR_BUDGET) -> DataFrame:
    """The events before each run was given up: the failure that exceeds the error budget is the last one.

    A sequential sweep stops there; here later batches have run already, so what came of them is left out. Events of
    batches without a number have no place in the order and stay.
    """
    ended = triage(failures(events).where("seq IS NOT NULL"), budget).where("action = 'abort'").groupBy("sweep_id") \
        .agg(F.min("seq").alias("_end")).withColumnRenamed("sweep_id", "run_id")
    return events.join(ended, "run_id", "left").where("_end IS NULL OR call_seq IS NULL OR call_seq <= _end").drop("_end")


def translate_batches(corpus: DataFrame, translate: Translate, batch_size: int, run_id: int | Column = 0, idx: str = "idx",
                      text: str = "source") -> DataFrame:
    """The events of one run over ``corpus (<idx>, <text>)``; see ``run_batches``."""
    run = run_id if isinstance(run_id, Column) else F.lit(run_id)
    return run_batches(corpus.select(run.alias("run_id"), F.col(idx).alias("idx"), F.col(text).alias("source")), translate, batch_size)


def word_map(table: dict[str, str]) -> Translate:
    """A dictionary translator, for tests and dry runs."""
    return lambda sentences: [" ".join(table.get(w, w) for w in s.split(" ")) for s in sentences]

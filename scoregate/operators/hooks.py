"""Python scorers and feature extractors over rows: what they raise becomes a failed row, never a failed task.

Defined cases: a null value is handed to the scorer as None; null and repeated items stay; an empty table gives an empty result;
other columns of the input, whatever their names, aren't read."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, types as T

RESULT = [T.StructField("score_status", T.StringType()), T.StructField("failure_code", T.StringType()), T.StructField("score", T.DoubleType())]


_ready: dict[str, object] = {}


def worker_state(token: str, setup: Callable) -> object:
    """What setup makes, once in each worker for a token, however many tasks and batches the worker sees."""
    if token not in _ready:
        _ready.clear()  # of an earlier job
        _ready[token] = setup()
    return _ready[token]


def score_with_state(items: DataFrame, item: str, value: str, setup: Callable, scorer: Callable) -> DataFrame:
    """score_items with a scorer of (state, value), whose state (a model, a bank) is set up once in each worker. A setup that fails
    makes failed rows with the code SETUP_ERROR:<its type>, and is tried again by the next task."""
    token = uuid.uuid4().hex

    def scored(v) -> float:
        try:
            state = worker_state(token, setup)
        except Exception as problem:
            raise SetupError(type(problem).__name__) from problem
        return scorer(state, v)

    return score_items(items, item, value, scored)


class SetupError(Exception):
    """A scorer's state couldn't be set up."""


def score_items(items: DataFrame, item: str, value: str, scorer: Callable, prepare: Callable | None = None) -> DataFrame:
    """item, score_status, failure_code and score of every row. scorer takes what `prepare` makes of the value (the value itself
    without it) and returns a number; an exception gives the code SCORER_ERROR:<its type>, a number that isn't finite SCORE_INVALID."""
    own = next(f for f in items.schema.fields if f.name == item)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for v in batch[value]:
                try:
                    score = float(scorer(prepare(v) if prepare else v))
                except SetupError as problem:
                    rows.append(("failed", f"SETUP_ERROR:{problem}", None))
                except Exception as problem:  # noqa: BLE001  any failure of a scorer is a failed row
                    rows.append(("failed", f"SCORER_ERROR:{type(problem).__name__}", None))
                else:
                    ok = score - score == 0
                    rows.append(("ok", None, score) if ok else ("failed", "SCORE_INVALID", None))
            yield pd.concat([batch[[item]].reset_index(drop=True), pd.DataFrame(rows, columns=[f.name for f in RESULT])], axis=1)

    return items.select(item, value).mapInPandas(run, T.StructType([own, *RESULT]))


def extract_features(items: DataFrame, item: str, value: str, extractor: Callable, name: str = "features") -> DataFrame:
    """item, the array of doubles that the extractor gives for each value, and failure_code: null, or where it fails (the array is
    then null) EXTRACTOR_ERROR:<type of the exception>."""
    own = next(f for f in items.schema.fields if f.name == item)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for v in batch[value]:
                try:
                    out.append(([float(x) for x in extractor(v)], None))
                except Exception as problem:  # noqa: BLE001
                    out.append((None, f"EXTRACTOR_ERROR:{type(problem).__name__}"))
            yield pd.DataFrame({item: batch[item], name: [o[0] for o in out], "failure_code": [o[1] for o in out]})

    return items.select(item, value).mapInPandas(
        run, T.StructType([own, T.StructField(name, T.ArrayType(T.DoubleType())), T.StructField("failure_code", T.StringType())])
    )

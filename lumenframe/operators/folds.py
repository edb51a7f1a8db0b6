"""Ordered folds: operators whose state depends on the rows before, such as moving averages, deduplication against accepted
rows and token buckets.

Rows are spread by key and sorted within their partition; a task walks them batch by batch and holds one key's state at a
time. So no group is collected, however large, and a key's rows cost a sort that can spill.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], start: Callable, step: Callable, output: str) -> DataFrame:
    """df's keys, order and inputs with the columns of `output` ("name type, ..."): step(state, row) gives (state, values).

    The order must be total for a defined result; null keys are a key of their own.
    """
    columns = list(dict.fromkeys([*keys, *order, *inputs]))
    names = [c.split()[0] for c in output.split(", ")]
    kinds = dict(df.dtypes)
    shape = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", " + output

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = object(), None
        for batch in batches:
            made = []
            at = [batch.columns.get_loc(k) for k in keys]
            put = [batch.columns.get_loc(c) for c in [*order, *inputs]]
            for row in batch.itertuples(index=False, name=None):
                key = tuple(None if row[i] != row[i] else row[i] for i in at)
                if key != last:
                    last, state = key, start()
                state, values = step(state, *(row[i] for i in put))
                made.append(values)
            yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(made, columns=names)], axis=1)

    spread = df.select(*columns).repartition(*keys).sortWithinPartitions(*keys, *order)
    return spread.mapInPandas(run, shape)


def smoothed(df: DataFrame, keys: list[str], order: list[str], value: str, weight: float = 0.2) -> DataFrame:
    """Exponentially weighted mean after every row; the first value is taken whole, nulls leave it as it was."""

    def step(state, *row):
        x = row[-1]
        if x is not None and x == x:
            state = x if state is None else (1 - weight) * state + weight * x
        return state, (state,)

    return ordered_fold(df, keys, order, [value], lambda: None, step, "smoothed double")


def accepted(df: DataFrame, keys: list[str], time: str, tie: str, gap_seconds: int = 60) -> DataFrame:
    """Whether each row is at least `gap_seconds` after the last accepted row of its key."""

    def step(state, ts, *_):
        ok = state is None or (ts - state).total_seconds() >= gap_seconds
        return (ts if ok else state), (ok,)

    return ordered_fold(df, keys, [time, tie], [], lambda: None, step, "accepted boolean")


def bucket_waits(df: DataFrame, keys: list[str], time: str, tie: str, rate: float, burst: float) -> DataFrame:
    """Seconds each request must wait under a token bucket of the given rate and burst."""

    def step(state, ts, *_):
        tokens, then = state
        now = ts.timestamp()
        tokens = min(burst, tokens + (now - then) * rate if then is not None else burst) - 1
        return (tokens, now if then is None else max(now, then)), (max(0.0, -tokens / rate),)

    return ordered_fold(df, keys, [time, tie], [], lambda: (burst, None), step, "wait double")


def capped_mean(df: DataFrame, keys: list[str], order: list[str], value: str, cap: int = 200) -> DataFrame:
    """Running mean whose count stops at cap, so that old values fade."""

    def step(state, *row):
        mean, n = state
        n = min(n + 1, cap)
        mean += (row[-1] - mean) / n
        return (mean, n), (mean,)

    return ordered_fold(df, keys, order, [value], lambda: (0.0, 0), step, "mean double")

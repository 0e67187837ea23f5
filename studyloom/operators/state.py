"""Keyed state machines over ordered observations: spaced repetition, mastery, knowledge tracing.

Each step is a plain function of (state, row), used by the batch fold here and by the
streaming version. A fold streams its partition in key and time order with one state at a
time, so a key with very many rows costs time but no memory.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86400.0


def stream_groups(batches: Iterator[pd.DataFrame], start: Callable[[], Any], step: Callable[[Any, tuple], Any], result: Callable[[Any, Any], tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    """result(key, state) for each run of equal keys in the first column; a row is a tuple of the columns. Nulls are one key."""
    none = object()
    now, state = none, None
    for batch in batches:
        done = []
        for row in zip(*(batch[c].array for c in batch.columns)):
            k = None if pd.isna(row[0]) else row[0]
            if now is none or k != now:
                if now is not none:
                    done.append(result(now, state))
                now, state = k, start()
            state = step(state, row)
        if done:
            yield pd.DataFrame(done, columns=names)
    if now is not none:
        yield pd.DataFrame([result(now, state)], columns=names)


def fold_sorted(df: DataFrame, key: str, order: list[str], start: Callable[[], Any], step: Callable[[Any, Any], Any], result: Callable[[Any, Any], tuple], schema: str) -> DataFrame:
    """One row for each key: result(key, state) after all its rows in order. Rows with a null key are one group.

    step gets a row as a tuple, the key first.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    rows = df.select(key, *(c for c in df.columns if c != key))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from stream_groups(batches, start, step, result, names)

    return rows.repartition(F.col(key)).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def sm2_start() -> dict:
    return {"reps": 0, "interval": 0.0, "ease": 2.5, "due": None, "last": None, "reviews": 0}


def sm2_step(s: dict, ts: float, quality: int) -> dict:
    """An early review counts but leaves the schedule. ts and due are in seconds."""
    s = dict(s, reviews=s["reviews"] + 1)
    if s["last"] is not None and ts < s["due"] - 0.3 * s["interval"] * DAY:
        return s
    d = 5 - quality
    ease = max(1.3, s["ease"] + 0.1 - d * (0.08 + 0.02 * d))
    if quality < 3:
        reps, interval = 0, 1.0
    elif s["reps"] == 0:
        reps, interval = 1, 1.0
    elif s["reps"] == 1:
        reps, interval = 2, 6.0
    else:
        reps, interval = s["reps"] + 1, max(1.0, math.floor(s["interval"] * ease + 0.5))
    return dict(s, reps=reps, interval=interval, ease=ease, due=ts + interval * DAY, last=ts)


def sm2_fold(df: DataFrame, key: str) -> DataFrame:
    """df has key, ts (seconds), quality (0..5) and seq, which orders equal times."""
    return fold_sorted(
        df.select(key, "ts", "quality", "seq"),
        key,
        ["ts", "seq"],
        sm2_start,
        lambda s, r: sm2_step(s, r[1], r[2]),
        lambda k, s: (k, s["reviews"], s["reps"], s["interval"], round(s["ease"], 6), s["due"]),
        f"{key} {df.schema[key].dataType.simpleString()}, reviews long, reps long, interval double, ease double, due double",
    )


def mastery_step(m: tuple[float, float | None], ts: float, signal: float) -> tuple[float, float | None]:
    """Decay to ts, then 0.3 of the signal; time never runs backwards for the decay, but is stored."""
    base, last = m
    days = 0.0 if last is None else max(0.0, (ts - last) / DAY)
    base = min(1.0, max(0.0, base * math.exp(-0.05 * days)))
    return min(1.0, max(0.0, base + 0.3 * signal)), ts


def mastery_fold(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """df has key, ts (seconds), signal and the columns of the order, which need not be that of time."""
    return fold_sorted(
        df.select(key, "ts", "signal", *(c for c in order if c != "ts")),
        key,
        order,
        lambda: (0.0, None),
        lambda s, r: mastery_step(s, r[1], r[2]),
        lambda k, s: (k, round(s[0], 6), s[1]),
        f"{key} {df.schema[key].dataType.simpleString()}, mastery double, last_ts double",
    )


#: Prior, learn, guess and slip.
BKT = {"l0": 0.3, "t": 0.2, "g": 0.2, "s": 0.1}


def bkt_step(p: float, correct: bool) -> float:
    g, s = BKT["g"], BKT["s"]
    if correct:
        p = p * (1 - s) / (p * (1 - s) + (1 - p) * g)
    else:
        p = p * s / (p * s + (1 - p) * (1 - g))
    return p + (1 - p) * BKT["t"]


def bkt_fold(df: DataFrame, key: str) -> DataFrame:
    """df has key, correct (boolean) and seq."""
    return fold_sorted(
        df.select(key, "correct", "seq"),
        key,
        ["seq"],
        lambda: (BKT["l0"], 0),
        lambda s, r: (bkt_step(s[0], bool(r[1])), s[1] + 1),
        lambda k, s: (k, s[1], round(s[0], 6)),
        f"{key} {df.schema[key].dataType.simpleString()}, n long, p_known double",
    )


def bkt_column(answers: Column) -> Column:
    """The same for an array of booleans, as an expression."""
    g, s, t = F.lit(BKT["g"]), F.lit(BKT["s"]), F.lit(BKT["t"])

    def step(p: Column, ok: Column) -> Column:
        post = F.when(ok, p * (1 - s) / (p * (1 - s) + (1 - p) * g)).otherwise(p * s / (p * s + (1 - p) * (1 - g)))
        return post + (1 - post) * t

    return F.aggregate(answers, F.lit(BKT["l0"]), step)

"""Review queues, flashcards and the state that answers leave behind."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studyloom.operators.state import BKT, bkt_step, mastery_step, stream_groups


def review_queue(items: DataFrame, key: str, due: str, gap_fill: Column, position: str, most: int = 3) -> DataFrame:
    """items with `place` in their key's queue: by due date, then gap fillers last, then position.

    Rows without a due date come first. Of the gap fillers the first `most` stay.
    """
    order = [F.asc_nulls_first(due), F.asc("__gap"), F.asc(position)]
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = items.withColumn("__gap", gap_fill.cast("int")).withColumn("__seen", F.sum("__gap").over(w))
    kept = ranked.where((F.col("__gap") == 0) | (F.col("__seen") <= most))
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")).drop("__gap", "__seen")


def end_of_day(now: Column) -> Column:
    return F.date_trunc("day", now) + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 MILLISECOND")


def is_due(due: Column, until: Column) -> Column:
    return due.isNull() | (due <= until)


def first_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return best.select(*keys, *(F.col(f"__r.{c}").alias(c) for c in rest))


def replace_pool(pool: DataFrame, fresh: DataFrame, is_replaced: Column) -> DataFrame:
    """pool without the rows that are replaced, then the fresh ones, with `part` 0 and 1 to order them by."""
    return pool.where(~is_replaced).withColumn("part", F.lit(0)).unionByName(fresh.withColumn("part", F.lit(1)))


def traced_mastery(df: DataFrame, key: str, order: list[str], switch: int = 15) -> DataFrame:
    """(key, n, traced, mastery): decayed mastery, and from `switch` observations on knowledge tracing over all of them.

    df has key, ts (seconds) and signal; a signal above 0 is a right answer. Both states are
    carried along, so the switch needs no second look at the history.
    """
    names = [key, "ts", "signal", *(c for c in order if c not in (key, "ts", "signal"))]
    rows = df.select(*names)

    def start() -> tuple:
        return (0.0, None), BKT["l0"], 0

    def step(s: tuple, row: tuple) -> tuple:
        return mastery_step(s[0], row[1], row[2]), bkt_step(s[1], row[2] > 0), s[2] + 1

    def result(k: object, s: tuple) -> tuple:
        return k, s[2], s[2] >= switch, round(s[1] if s[2] >= switch else s[0][0], 6)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from stream_groups(batches, start, step, result, [key, "n", "traced", "mastery"])

    dealt = rows.repartition(F.col(key)).sortWithinPartitions(key, *order)
    return dealt.mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, n long, traced boolean, mastery double")


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

"""Order-dependent folds over one document's or one group's rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunk_numbers(lengths: Column, most: int, gap: int = 1) -> Column:
    """The chunk of each piece when pieces fill chunks of `most` in order; an oversized piece is its own chunk."""

    def step(acc: Column, n: Column) -> Column:
        fits = (acc["used"] > 0) & (acc["used"] + gap + n <= most)
        first = acc["used"] == 0
        chunk = F.when(fits | first, acc["chunk"]).otherwise(acc["chunk"] + 1)
        used = F.when(fits, acc["used"] + gap + n).otherwise(F.greatest(n, F.lit(1)))
        return F.struct(F.concat(acc["out"], F.array(chunk)).alias("out"), chunk.alias("chunk"), used.cast("int").alias("used"))

    zero = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("chunk"), F.lit(0).alias("used"))
    return F.aggregate(lengths, zero, step, lambda acc: acc["out"])


def smooth_levels(levels: Column) -> Column:
    """Heading levels without a step down of more than one."""
    step = lambda acc, x: F.concat(acc, F.array(F.least(x, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + 1)))
    return F.aggregate(levels, F.array().cast("array<int>"), step)


def greedy_budget(df: DataFrame, key: str, order: list[str], cost: str, budget: float) -> DataFrame:
    """The rows of each key taken in order, each that still fits the budget; others are passed over.

    df is sorted within partitions and streamed with one running sum, so a key may be of any size. Rows with a null key are one group.
    """
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = object()
        now, used = none, 0.0
        for batch in batches:
            keep = []
            for i, (k, c) in enumerate(zip(batch[key].array, batch[cost].array)):
                k = None if pd.isna(k) else k
                if now is none or k != now:
                    now, used = k, 0.0
                if used + c <= budget:
                    used += c
                    keep.append(i)
            yield batch.iloc[keep][names]

    return df.repartition(F.col(key)).sortWithinPartitions(key, *order).mapInPandas(run, df.schema)

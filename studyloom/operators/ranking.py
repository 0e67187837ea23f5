"""Ranking and ordering over whole tables and within keys, without gathering rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studyloom.session import materialize


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """row_number over the whole table, from 1, by a range-partitioned sort.

    The rows are written once, range-partitioned and sorted, with the number of their
    partition; each partition numbers its own from the count of those before it. order
    should be total.
    """
    kept = df.columns
    dealt = df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id())
    rows = materialize(dealt, "ranked")
    sizes = rows.groupBy("__p").agg(F.count("*").alias("__n"))
    # as many rows as partitions
    before = sizes.withColumn("__skip", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    local = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return rows.withColumn("__r", local).join(before, "__p").select(*kept, (F.col("__r") + F.col("__skip")).cast("long").alias(name))


def top_fraction(df: DataFrame, key: str, order: Sequence[Column], fraction: float, least: int = 1, name: str = "rank") -> DataFrame:
    """The first max(least, ceil(fraction * n)) rows of each key, with their rank; keys may be of any size."""
    n = df.groupBy(F.col(key).alias("__k")).agg(F.greatest(F.lit(least), F.ceil(F.lit(fraction) * F.count("*"))).alias("__most"))
    ranked = rank_in_key(df, key, order, name)
    return ranked.join(n, F.col(key).eqNullSafe(F.col("__k"))).where(F.col(name) <= F.col("__most")).drop("__k", "__most")


def distribute(df: DataFrame, weight: str, total: int, order: list[Column]) -> DataFrame:
    """df with `share`: total split by weight, rounded down, the rest one each from the first row on."""
    sums = df.agg(F.sum(weight).alias("__w"))
    shares = df.crossJoin(F.broadcast(sums)).withColumn("__floor", F.floor(F.lit(total) * F.col(weight) / F.col("__w")).cast("long"))
    ranked = global_rank(shares, order, "__rank")
    rest = ranked.agg((F.lit(total) - F.sum("__floor")).alias("__rest"))
    out = ranked.crossJoin(F.broadcast(rest))
    extra = F.when(F.col("__rank") <= F.col("__rest"), 1).otherwise(0)
    return out.withColumn("share", F.col("__floor") + extra).drop("__w", "__floor", "__rank", "__rest")


def _running(df: DataFrame, key: str, order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """df with `name`: the sum of value over the rows of the key up to each row.

    Rows are range-partitioned by key and order; a key that spans several partitions counts
    on from the partitions before, so no task holds a whole key. order should be total
    within a key.
    """
    kept = df.columns
    rows = materialize(df.withColumn("__v", value).repartitionByRange(F.col(key), *order).withColumn("__p", F.spark_partition_id()), "running")
    # as many rows as keys and partitions together
    sums = rows.groupBy(F.col(key).alias("__k"), F.col("__p").alias("__q")).agg(F.sum("__v").alias("__s"))
    before = F.coalesce(F.sum("__s").over(Window.partitionBy("__k").orderBy("__q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = F.sum("__v").over(Window.partitionBy(key, "__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = rows.withColumn("__r", local).join(sums.select("__k", "__q", before.alias("__b")), F.col(key).eqNullSafe(F.col("__k")) & (F.col("__p") == F.col("__q")))
    return out.select(*kept, (F.col("__r") + F.col("__b")).alias(name))


def rank_in_key(df: DataFrame, key: str, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """row_number within a key, from 1, for keys of any size."""
    return _running(df, key, order, F.lit(1).cast("long"), name)


def prefix_within_budget(df: DataFrame, key: str, order: Sequence[Column], cost: str, budget: Column) -> DataFrame:
    """The leading rows of each key whose running cost stays within the budget; keys may be of any size."""
    return _running(df, key, order, F.col(cost), "__run").where(F.col("__run") <= budget).drop("__run")

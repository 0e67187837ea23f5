"""Keyed writes as DataFrame operators: upserts, retention, ignore-on-conflict, beliefs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """One row for each key, the latest by `at`; on a tie the new table's row stays."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, "__new")).alias("r"))
    return best.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest if c != "__new"))


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new whose key is new; of several new rows of a key, the least one."""
    rest = [c for c in new.columns if c not in keys]
    fresh = new.join(old.select(*keys).distinct(), keys, "left_anti")
    fresh = fresh.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest)) if rest else fresh.distinct()
    return old.unionByName(fresh)


def merge_greatest(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The greater value of each key."""
    return old.select(*keys, value).unionByName(new.select(*keys, value)).groupBy(*keys).agg(F.max(value).alias(value))


def keep_last(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of each key. Spark keeps n rows of a key before it shuffles them."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")


def for_user(df: DataFrame, user: object, column: str = "user_id") -> DataFrame:
    """The rows that a user may see."""
    return df.where(F.col(column) == F.lit(user))


def stale_work(done: DataFrame, wanted: DataFrame, keys: list[str], fingerprint: str) -> DataFrame:
    """What has to run: wanted work without a finished row of the same fingerprint."""
    return wanted.join(done.select(*keys, fingerprint).distinct(), [*keys, fingerprint], "left_anti")


def append_log(log: DataFrame, rows: DataFrame) -> DataFrame:
    """log with rows behind it; columns that one side lacks are null."""
    return log.unionByName(rows, allowMissingColumns=True)


def upsert_matched(stored: DataFrame, incoming: DataFrame, id_: str, source: str, value: str, order: str) -> DataFrame:
    """(id, value) of stored rows, updated by the last incoming row of their id or of their source.

    An incoming row goes to the stored row of its id; without one, to the least id of its source.
    """
    firsts = stored.groupBy(source).agg(F.min(id_).alias("__first"))
    known = stored.select(F.col(id_).alias("__known"))
    met = incoming.join(known, incoming[id_] == known["__known"], "left").join(firsts, source, "left")
    met = met.select(F.coalesce("__known", "__first").alias(id_), value, order).where(F.col(id_).isNotNull())
    last = met.groupBy(id_).agg(F.max_by(value, order).alias("__value"))
    return stored.join(last, id_, "left").select(id_, F.coalesce("__value", value).alias(value))


def published_by_code(packs: DataFrame, asked: DataFrame) -> DataFrame:
    """The published packs (code, status, ...) that codes ask for, each code's pack of the least id: asked columns, and the pack's.

    packs: id, code, status and more. asked: code. Codes are trimmed and in capitals; blank ones find nothing.
    """
    shaped = lambda c: F.nullif(F.upper(F.trim(c)), F.lit(""))
    rest = [c for c in packs.columns if c != "code"]
    first = packs.where(F.col("status") == "published").groupBy(shaped(F.col("code")).alias("__code")).agg(F.min_by(F.struct(*rest), "id").alias("p"))
    return asked.withColumn("__code", shaped(F.col("code"))).join(first, "__code").select(*asked.columns, *(F.col(f"p.{c}").alias(c) for c in rest))


def cached_by_key(cache: DataFrame, keys: DataFrame, key: str, at: str) -> DataFrame:
    """The newest row of the cache for each distinct key that is asked for."""
    asked = keys.select(key).where(F.col(key).isNotNull()).distinct()
    newest = cache.join(asked, key, "left_semi").groupBy(key).agg(F.max_by(F.struct(*cache.columns), at).alias("r"))
    return newest.select(*(F.col(f"r.{c}").alias(c) for c in cache.columns))


def exported_json(df: DataFrame, owner: str, order: str) -> DataFrame:
    """(owner, json): each owner's rows as one JSON array, in order; its size is that of the owner's own store."""
    rest = [c for c in df.columns if c not in (owner, order)]
    rows = df.groupBy(owner).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias("r"))
    return rows.select(owner, F.to_json("r").alias("json"))

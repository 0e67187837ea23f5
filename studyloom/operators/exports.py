"""What leaves the tables: packs, sessions as Markdown, large payloads, caches; and late or frozen rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A payload above this many bytes is stored apart.
LARGE = 300 * 1024


def without_source(columns: list[str], hidden: tuple[str, ...]) -> list[str]:
    """The columns of an export: those that hold source text stay at home."""
    return [c for c in columns if c not in hidden]


def front_matter(fields: dict[str, Column], body: Column) -> Column:
    """A Markdown text with its fields in front, as YAML; quotes in values are escaped."""
    line = lambda k, v: F.concat(F.lit(f'{k}: "'), F.replace(F.replace(F.coalesce(v.cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.concat_ws("\n", F.lit("---"), *(line(k, v) for k, v in fields.items()), F.lit("---"), F.lit(""), body)


def split_payload(df: DataFrame, key: str, payload: str, limit: int = LARGE) -> tuple[DataFrame, DataFrame]:
    """(rows, large): rows with payload null and `stored` true where it has more than limit bytes; large (key, payload) of those."""
    size = F.octet_length(payload)
    rows = df.withColumn("stored", F.coalesce(size > limit, F.lit(False))).withColumn(payload, F.when(~F.col("stored"), F.col(payload)))
    return rows, df.where(size > limit).select(key, payload)


def touched(old: DataFrame, new: DataFrame, key: str, value: str, at: str, frozen: Column) -> DataFrame:
    """old (key, value, at) updated by new (key, value, at): at moves where the value changed; frozen rows, a Column of old, stay."""
    n = new.select(F.col(key).alias("__k"), F.col(value).alias("__v"), F.col(at).alias("__at"))
    j = old.withColumn("__frozen", frozen).join(n, F.col(key) == F.col("__k"), "left")
    change = F.coalesce(~F.col("__frozen") & ~F.col("__v").eqNullSafe(F.col(value)) & F.col("__k").isNotNull(), F.lit(False))
    return j.select(key, F.when(change, F.col("__v")).otherwise(F.col(value)).alias(value), F.when(change, F.col("__at")).otherwise(F.col(at)).alias(at), change.alias("changed"))


def capped_upsert(cache: DataFrame, rows: DataFrame, key: str, payload: str, limit: int) -> DataFrame:
    """cache with rows of at most limit bytes put in by key; larger ones are turned away."""
    fits = rows.where(F.octet_length(payload) <= limit)
    return cache.join(fits.select(key).distinct(), key, "left_anti").unionByName(fits)

"""Questions of fact: answers verified in their source, and wrong options of the same kind.

A wrong option comes from the ordered distinct values of the answer's kind: the nearest
ones stand within n places of it, the farthest ones at the ends, so an answer meets 2n
values, however many its kind has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.operators.ranking import rank_in_key
from studyloom.session import materialize

#: A year, and a number with its unit.
YEAR, NUMBER = "\\b(1[0-9]{3}|20[0-9]{2})\\b", "\\b\\d+(?:[.,]\\d+)?\\s*(?:%|[a-zA-Z]+)"


def in_source(answer: Column, text: Column, start: Column | None = None, end: Column | None = None) -> Column:
    """Whether the answer, in any case, stands in the span start..end of its source, or else anywhere in it."""
    a, t = F.lower(F.trim(F.coalesce(answer, F.lit("")))), F.lower(F.coalesce(text, F.lit("")))
    found = F.contains(t, a)
    if start is not None and end is not None:
        found = F.coalesce(F.contains(F.substring(t, start + 1, end - start), a), F.lit(False)) | found
    return (a != "") & found


def fact_behind(text: Column, label: Column, pattern: str) -> Column:
    """The first match at or behind the label, or of the whole text where it doesn't stand; null without a match."""
    at = F.call_function("locate", F.lower(F.trim(label)), F.lower(text))
    return F.nullif(F.regexp_extract(F.substring(text, F.greatest(at, F.lit(1)), F.length(text)), pattern, 0), F.lit(""))


def distractors(facts: DataFrame, n: int = 3) -> DataFrame:
    """(id, place, value): up to n other values of each fact's kind, the best first.

    facts: id, kind, value (a text), measure (a number to compare by, null for none) and far
    (whether the farthest measures are best, else the nearest). Values without measures are
    ordered by length and letters, and the nearest places are best. Values that differ in
    capitals only are one, that of the least spelling. Ties go to the lower place.
    """
    spelt = facts.where("kind is not null and trim(value) <> ''").withColumn("low", F.lower(F.trim("value")))
    values = spelt.groupBy("kind", "low").agg(F.min("value").alias("value"), F.min("measure").alias("measure"), F.bool_or("far").alias("far"))
    order = [F.col("measure").asc_nulls_last(), F.length("low"), F.col("low")]
    ranked = materialize(rank_in_key(values, "kind", order, "rank"), "values")
    last = ranked.groupBy("kind").agg(F.max("rank").alias("last"))
    asked = ranked.join(last, "kind")
    near = F.sequence(F.greatest(F.lit(1).cast("long"), F.col("rank") - n), F.least(F.col("last"), F.col("rank") + n))
    ends = F.concat(F.sequence(F.lit(1).cast("long"), F.least(F.col("last"), F.lit(n + 1).cast("long"))), F.sequence(F.greatest(F.lit(1).cast("long"), F.col("last") - n), F.col("last")))
    offers = asked.select("kind", "low", "measure", "far", F.col("rank").alias("own"), F.explode(F.array_distinct(F.when(F.col("far"), ends).otherwise(near))).alias("rank")).where("rank <> own")
    met = offers.join(ranked.select("kind", "rank", F.col("value").alias("other"), F.col("measure").alias("other_measure")), ["kind", "rank"])
    apart = F.coalesce(F.abs(F.col("measure") - F.col("other_measure")), F.abs(F.col("rank") - F.col("own")).cast("double"))
    key = F.struct(F.when(F.col("far"), -apart).otherwise(apart).alias("apart"), "rank", F.col("other").alias("value"))
    best = met.groupBy("kind", "low").agg(F.slice(F.array_sort(F.collect_list(key)), 1, n).alias("best"))
    out = spelt.select("id", "kind", "low").join(best, ["kind", "low"])
    return out.select("id", F.posexplode("best").alias("place", "b")).select("id", (F.col("place") + 1).alias("place"), "b.value")


def options(facts: DataFrame, n: int = 3) -> DataFrame:
    """(id, options, answer): the answer among its distractors, in an order that the id and the values decide; answer counts from 1."""
    wrong = distractors(facts, n).select("id", "value", F.lit(False).alias("right"))
    both = wrong.unionByName(facts.select("id", "value", F.lit(True).alias("right")))
    key = F.struct(F.md5(F.concat_ws(":", F.col("id").cast("string"), "value")).alias("h"), "value", "right")
    rows = both.groupBy("id").agg(F.array_sort(F.collect_list(key)).alias("o"))
    return rows.select("id", F.transform("o", lambda x: x["value"]).alias("options"), F.array_position(F.transform("o", lambda x: x["right"]), True).cast("int").alias("answer"))

"""Queries on answers that change several states at once.

Events are answers: purchases and errors of tests, clicks of tutor questions; others are
none. A user is a document, a fifth of the value its block, which has two concepts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.plans.registry import Book
from studyloom.session import table
from studyloom.streaming import fanout

BOOK = Book()
A_SQL = """e AS (SELECT *, CAST(least(4, greatest(0, floor(value / 20))) AS BIGINT) AS b FROM events),
a AS (SELECT event_id AS answer, epoch_us(ts) / 1e6 AS ts, user_id AS doc, b, list_distinct([user_id * 10 + b, user_id * 10 + (b + 1 + event_id % 3) % 5]) AS concepts, CASE WHEN event_type = 'click' THEN 'socratic' ELSE 'test' END AS kind,
  event_type = 'purchase' AS correct, event_id % 4 <> 0 AS first_try, event_id % 5 = 0 AS hint, event_id % 11 = 0 AS skipped, event_id % 2 = 0 AS said FROM e WHERE event_type IN ('purchase', 'error', 'click')),
q AS (SELECT *, CASE WHEN kind = 'socratic' THEN 4 WHEN skipped THEN 2 WHEN NOT correct THEN 1 WHEN hint THEN 3 WHEN NOT first_try THEN 4 ELSE 5 END AS q FROM a),
c AS (SELECT * EXCLUDE (concepts), unnest(concepts) AS concept FROM q)"""
_SM2_SQL = """o AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY ts, answer) AS rn FROM k),
r(item, rn, reps, ivl, ease, due, last) AS (SELECT DISTINCT item, 0::BIGINT, 0::BIGINT, 0.0::DOUBLE, 2.5::DOUBLE, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM o UNION ALL
  SELECT item, rn, CASE WHEN early THEN reps WHEN q < 3 THEN 0 ELSE reps + 1 END, CASE WHEN early THEN ivl ELSE ni END, CASE WHEN early THEN ease ELSE ef END, CASE WHEN early THEN due ELSE ts + 86400.0 * ni END, CASE WHEN early THEN last ELSE ts END
  FROM (SELECT *, CASE WHEN q < 3 OR reps = 0 THEN 1.0 WHEN reps = 1 THEN 6.0 ELSE greatest(1.0, floor(ivl * ef + 0.5)) END AS ni FROM (SELECT o.item, o.rn, o.q, o.ts, r.reps, r.ivl, r.ease, r.due, r.last, r.last IS NOT NULL AND o.ts < r.due - 0.3 * r.ivl * 86400.0 AS early,
    greatest(1.3, r.ease + 0.1 - (5 - o.q) * (0.08 + 0.02 * (5 - o.q))) AS ef FROM r JOIN o ON o.item = r.item AND o.rn = r.rn + 1)))
SELECT item, rn AS reviews, reps, ivl AS interval, round(ease, 6) AS ease, due, last FROM r QUALIFY row_number() OVER (PARTITION BY item ORDER BY rn DESC) = 1"""
_MASTERY_SQL = """o AS (SELECT concept, answer, ts, q, CASE WHEN q >= 4 THEN 1.0 WHEN q = 3 THEN 0.3 ELSE -0.5 END AS signal, row_number() OVER (PARTITION BY concept ORDER BY ts, answer) AS rn FROM c),
r(concept, rn, answer, q, was, m, last) AS (SELECT DISTINCT concept, 0::BIGINT, 0::BIGINT, 0, 0.0::DOUBLE, 0.0::DOUBLE, CAST(NULL AS DOUBLE) FROM o UNION ALL
  SELECT o.concept, o.rn, o.answer, o.q, m, least(1.0, greatest(0.0, least(1.0, greatest(0.0, m * exp(-0.05 * coalesce(greatest(0.0, (o.ts - r.last) / 86400.0), 0.0)))) + 0.3 * o.signal)), o.ts FROM r JOIN o ON o.concept = r.concept AND o.rn = r.rn + 1)"""


def event_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("b", F.least(F.lit(4), F.greatest(F.lit(0), F.floor(F.col("value") / 20))).cast("long"))
    of = lambda b: F.col("user_id") * 10 + b
    kind = F.when(F.col("event_type") == "click", "socratic").when(F.col("event_type").isin("purchase", "error"), "test")
    id_ = F.col("event_id")
    return e.select(
        id_.alias("answer"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.col("user_id").alias("doc"), F.col("b").cast("string").alias("block"),
        F.array(of(F.col("b")), of((F.col("b") + 1 + id_ % 3) % 5)).alias("concepts"), kind.alias("kind"), (F.col("event_type") == "purchase").alias("correct"),
        (id_ % 4 != 0).alias("first_try"), (id_ % 5 == 0).alias("hint"), (id_ % 11 == 0).alias("skipped"), F.when(id_ % 2 == 0, F.col("event_type")).otherwise("").alias("text"),
    )


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The states after all events; each user's concepts are connected in a ring."""
    answers = event_answers(spark, sf_dir)
    ring = answers.select("doc").distinct().select(F.col("doc"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("b"))
    known = ring.select((F.col("doc") * 10 + F.col("b")).alias("src"), (F.col("doc") * 10 + (F.col("b") + 1) % 5).alias("dst"), F.lit(0.3).alias("weight"))
    return fanout.fan_out(fanout.empty_tables(spark, known), answers)


@BOOK.query(f"""
WITH {A_SQL} SELECT doc, concept, count(*) FILTER (NOT correct) AS wrong, count(*) FILTER (correct) AS correct, max(ts) AS last_ts, arg_max(answer, struct_pack(t := ts, a := answer)) AS last_answer, arg_max(CASE WHEN correct THEN 'correct' ELSE 'wrong' END, struct_pack(t := ts, a := answer)) AS last_result FROM c WHERE kind = 'test' AND NOT skipped GROUP BY ALL""")
def fanout_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir)["signals"]


@BOOK.query(f"WITH RECURSIVE {A_SQL}, k AS (SELECT doc || ':' || b || CASE WHEN kind = 'socratic' THEN ':socratic' ELSE '' END AS item, ts, answer, q FROM q), {_SM2_SQL}")
def fanout_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir)["items"].withColumn("ease", F.round("ease", 6))


@BOOK.query(f"WITH RECURSIVE {A_SQL}, k AS (SELECT concept || ':' || CASE WHEN kind = 'socratic' THEN 'synthesis' ELSE 'recognition' END AS item, ts, answer, q FROM c), {_SM2_SQL}")
def fanout_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir)["facets"].withColumn("ease", F.round("ease", 6))


@BOOK.query(f"WITH {A_SQL} SELECT concept, count(*) FILTER (kind = 'socratic' AND said) AS deep, min(ts) FILTER (kind = 'socratic' AND said) AS green_since FROM c GROUP BY concept")
def fanout_promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir)["promotions"]


@BOOK.query(f"""
WITH {A_SQL}, n AS (SELECT DISTINCT user_id * 10 + i AS src, user_id * 10 + (i + 1) % 5 AS dst FROM events, range(5) t(i)),
g AS (SELECT src, dst, count(*) AS n, max(ts) AS at FROM n JOIN q ON list_contains(concepts, src) AND list_contains(concepts, dst) AND doc = src // 10 WHERE kind = 'socratic' OR correct GROUP BY ALL)
SELECT n.src, n.dst, round(least(1.0, 0.3 + 0.15 * coalesce(g.n, 0)), 6) AS weight, coalesce(g.n, 0) AS reinforced, g.at AS last_ts FROM n LEFT JOIN g ON g.src = n.src AND g.dst = n.dst""")
def fanout_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir)["connections"].withColumn("weight", F.round("weight", 6))


@BOOK.query(f"WITH RECURSIVE {A_SQL}, {_MASTERY_SQL} SELECT concept, round(m, 6) AS mastery, last AS last_ts, rn AS observations FROM r QUALIFY row_number() OVER (PARTITION BY concept ORDER BY rn DESC) = 1")
def fanout_mastery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir)["mastery"].withColumn("mastery", F.round("mastery", 6))


@BOOK.query(f'WITH RECURSIVE {A_SQL}, {_MASTERY_SQL} SELECT answer, concept, round(was, 6) AS "before", round(m, 6) AS "after", q AS quality FROM r WHERE rn > 0')
def fanout_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What mastery foretold of each observation."""
    c = _tables(spark, sf_dir)["calibration"]
    return c.withColumn("before", F.round("before", 6)).withColumn("after", F.round("after", 6))

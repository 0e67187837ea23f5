"""Queries on events: state folds, signals, queues, windows, upserts.

Events stand in for answers: purchase is a correct one, error a wrong one, view and click
are neutral, signup is a first exposure; a user is the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studyloom.functions import numeric as N
from studyloom.operators import joins, state, tables
from studyloom.operators.ranking import global_rank
from studyloom.plans.registry import Book
from studyloom.session import table

BOOK = Book()


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.withColumn("sec", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


ANSWERS_SQL = """
WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS sec, event_type,
  CAST(least(5, greatest(0, floor(value / 20 + 0.5))) AS INT) AS q,
  CASE event_type WHEN 'purchase' THEN 0.6 WHEN 'error' THEN -0.3 ELSE 0.1 END AS signal,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
"""


@BOOK.query(
    ANSWERS_SQL
    + """,
r(user_id, rn, reps, ivl, ease, due, seen) AS (
  SELECT user_id, 0::BIGINT, 0::BIGINT, 0.0::DOUBLE, 2.5::DOUBLE, CAST(NULL AS DOUBLE), false FROM (SELECT DISTINCT user_id FROM o)
  UNION ALL
  SELECT user_id, rn, CASE WHEN early THEN reps WHEN q < 3 THEN 0 ELSE least(reps, 1) + greatest(reps - 1, 0) + 1 END,
    CASE WHEN early THEN ivl WHEN q < 3 OR reps = 0 THEN 1.0 WHEN reps = 1 THEN 6.0 ELSE greatest(1.0, floor(ivl * ef + 0.5)) END,
    CASE WHEN early THEN ease ELSE ef END,
    CASE WHEN early THEN due ELSE sec + 86400.0 * CASE WHEN q < 3 OR reps = 0 THEN 1.0 WHEN reps = 1 THEN 6.0 ELSE greatest(1.0, floor(ivl * ef + 0.5)) END END, true
  FROM (SELECT o.user_id, o.rn, o.q, o.sec, r.reps, r.ivl, r.ease, r.due, r.seen AND o.sec < r.due - 0.3 * r.ivl * 86400.0 AS early,
      greatest(1.3, r.ease + 0.1 - (5 - o.q) * (0.08 + 0.02 * (5 - o.q))) AS ef FROM r JOIN o ON o.user_id = r.user_id AND o.rn = r.rn + 1))
SELECT user_id, rn AS reviews, reps, ivl AS interval, round(ease, 6) AS ease, due FROM (SELECT *, max(rn) OVER (PARTITION BY user_id) AS m FROM r) WHERE rn = m"""
)
def sm2_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spaced-repetition state of each user after all events; a fifth of value / 20 is the quality."""
    e = _events(spark, sf_dir)
    return state.sm2_fold(e.select("user_id", F.col("sec").alias("ts"), N.sm2_quality(F.col("value") / 20).alias("quality"), F.col("event_id").alias("seq")), "user_id")


@BOOK.query(
    ANSWERS_SQL
    + """,
r(user_id, rn, m, last) AS (
  SELECT user_id, 0::BIGINT, 0.0::DOUBLE, CAST(NULL AS DOUBLE) FROM (SELECT DISTINCT user_id FROM o)
  UNION ALL
  SELECT o.user_id, o.rn, least(1.0, greatest(0.0, least(1.0, greatest(0.0, m * exp(-0.05 * coalesce(greatest(0.0, (o.sec - r.last) / 86400.0), 0.0)))) + 0.3 * o.signal)), o.sec
  FROM r JOIN o ON o.user_id = r.user_id AND o.rn = r.rn + 1)
SELECT user_id, round(m, 6) AS mastery, last AS last_ts FROM (SELECT *, max(rn) OVER (PARTITION BY user_id) AS k FROM r) WHERE rn = k"""
)
def mastery_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    signal = F.when(F.col("event_type") == "purchase", 0.6).when(F.col("event_type") == "error", -0.3).otherwise(0.1)
    e = _events(spark, sf_dir).select("user_id", F.col("sec").alias("ts"), signal.alias("signal"), F.col("event_id").alias("seq"))
    return state.mastery_fold(e, "user_id", ["ts", "seq"])


@BOOK.query("""
WITH RECURSIVE o AS (SELECT user_id, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events WHERE event_type IN ('purchase', 'error')),
r(user_id, rn, p) AS (SELECT user_id, 0::BIGINT, 0.3::DOUBLE FROM (SELECT DISTINCT user_id FROM o)
  UNION ALL
  SELECT user_id, rn, post + (1 - post) * 0.2 FROM (SELECT o.user_id, o.rn, CASE WHEN ok THEN p * 0.9 / (p * 0.9 + (1 - p) * 0.2) ELSE p * 0.1 / (p * 0.1 + (1 - p) * 0.8) END AS post
    FROM r JOIN o ON o.user_id = r.user_id AND o.rn = r.rn + 1))
SELECT user_id, rn AS n, round(p, 6) AS p_known FROM (SELECT *, max(rn) OVER (PARTITION BY user_id) AS m FROM r) WHERE rn = m""")
def knowledge_tracing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "error"))
    return state.bkt_fold(e.select("user_id", (F.col("event_type") == "purchase").alias("correct"), F.col("event_id").alias("seq")), "user_id")


@BOOK.query("""
SELECT user_id, wrong, correct, last_result, round(CASE WHEN last_result = 'wrong' THEN w + 1 WHEN last_result = 'correct' AND correct > wrong THEN greatest(0, w - 1) ELSE w END, 6) AS weight
FROM (SELECT user_id, count(*) FILTER (event_type = 'error') AS wrong, count(*) FILTER (event_type = 'purchase') AS correct,
  arg_max(CASE WHEN event_type = 'error' THEN 'wrong' ELSE 'correct' END, struct_pack(t := ts, e := event_id)) AS last_result, wrong - 0.5 * correct AS w
  FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id)""")
def answer_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "error"))
    wrong = F.col("event_type") == "error"
    g = e.groupBy("user_id").agg(F.count_if(wrong).alias("wrong"), F.count_if(~wrong).alias("correct"), F.max_by(F.when(wrong, "wrong").otherwise("correct"), F.struct("ts", "event_id")).alias("last_result"))
    return g.withColumn("weight", F.round(N.assessment_weight(F.col("wrong").cast("double"), F.col("correct").cast("double"), F.col("last_result")), 6))


WEAK_SQL = """
WITH s AS (SELECT user_id, count(*) FILTER (event_type = 'error') - 0.5 * count(*) FILTER (event_type = 'purchase') AS w FROM events GROUP BY user_id),
k AS (SELECT *, CASE WHEN w > 0 THEN row_number() OVER (PARTITION BY w > 0 ORDER BY w DESC, user_id) END AS r, ceil(0.6 * count(*) OVER ()) AS most FROM s)
SELECT user_id, round(w, 6) AS weight, row_number() OVER (ORDER BY CASE WHEN r <= most THEN 0 ELSE 1 END, CASE WHEN r <= most THEN -w ELSE 0 END, user_id) AS place FROM k"""


@BOOK.query(WEAK_SQL)
def weak_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weak users first, by weight, 0.6 of all at most; then the others in order.

    Places come from range-partitioned counts, so no task holds all users.
    """
    e = table(spark, sf_dir, "events").groupBy("user_id").agg((F.count_if(F.col("event_type") == "error") - 0.5 * F.count_if(F.col("event_type") == "purchase")).cast("double").alias("w"))
    weak = global_rank(e.where("w > 0"), [F.col("w").desc(), F.col("user_id")], "r")
    both = weak.unionByName(e.where("w <= 0").withColumn("r", F.lit(None).cast("long")))
    total = e.agg(F.ceil(0.6 * F.count("*")).alias("most"))
    both = both.crossJoin(F.broadcast(total)).withColumn("lead", F.coalesce(F.col("r") <= F.col("most"), F.lit(False)))
    key = [F.when(F.col("lead"), 0).otherwise(1), F.when(F.col("lead"), -F.col("w")).otherwise(0.0), F.col("user_id")]
    return global_rank(both, key, "place").select("user_id", F.round("w", 6).alias("weight"), "place")


@BOOK.query("""
SELECT user_id, max(n) AS most_in_hour, count(*) FILTER (n > 3) AS over_limit FROM (
  SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM events) GROUP BY user_id""")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user in the hour up to each of them, against a limit of 3."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-3_600_000_000, 0)
    e = table(spark, sf_dir, "events").select("user_id", micros.alias("us")).withColumn("n", F.count("*").over(w))
    return e.groupBy("user_id").agg(F.max("n").alias("most_in_hour"), F.count_if(F.col("n") > 3).alias("over_limit"))


@BOOK.query("""
SELECT user_id, event_id, event_type, rn AS place, total - 50 AS overflow FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY user_id) AS total FROM events) WHERE rn <= 50""")
def study_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 50 events of each user, and how many more there are."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    last = e.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))).where("place <= 50")
    totals = e.groupBy("user_id").agg((F.count("*") - 50).alias("overflow"))
    return last.join(totals, "user_id").select("user_id", "event_id", "event_type", F.col("place").cast("long").alias("place"), "overflow")


@BOOK.query("""
SELECT user_id, count(*) FILTER (event_type = 'purchase' AND (ts, event_id) > (lt, li)) AS streak,
  count(*) FILTER (event_type = 'purchase' AND (ts, event_id) > (lt, li)) >= 3 AS resolved
FROM events e LEFT JOIN (SELECT user_id AS u, coalesce(max(ts), TIMESTAMP '1970-01-01') AS lt, coalesce(arg_max(event_id, (ts, event_id)), -1) AS li FROM events WHERE event_type = 'error' GROUP BY user_id) l ON l.u = e.user_id
WHERE l.u IS NOT NULL GROUP BY user_id""")
def positive_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correct answers since the last wrong one; three resolve a misconception."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("at"))
    last = e.where("event_type = 'error'").groupBy("user_id").agg(F.max("at").alias("wrong_at"))
    j = e.join(last, "user_id").groupBy("user_id").agg(F.count_if((F.col("event_type") == "purchase") & (F.col("at") > F.col("wrong_at"))).alias("streak"))
    return j.withColumn("resolved", F.col("streak") >= 3)


@BOOK.query("""
WITH n AS (SELECT max(ts) AS now FROM events),
g AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS pattern, count(*) AS n, min(event_id) AS first_id FROM events, n WHERE event_type = 'error' AND ts >= now - INTERVAL 30 DAY GROUP BY ALL HAVING count(*) >= 3)
SELECT user_id, pattern, n, round(least(0.95, 0.55 + 0.05 * n), 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first_id) AS r FROM g) WHERE r = 1""")
def misconceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest group of three or more equal wrong answers of a user in the last 30 days."""
    e = table(spark, sf_dir, "events")
    now = e.agg((F.max("ts") - F.expr("INTERVAL 30 DAY")).alias("since"))
    wrong = e.where("event_type = 'error'").crossJoin(F.broadcast(now)).where(F.col("ts") >= F.col("since"))
    g = wrong.groupBy("user_id", F.get_json_object("props", "$.k").cast("long").alias("pattern")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id")).where("n >= 3")
    best = g.groupBy("user_id").agg(F.max_by(F.struct("pattern", "n"), F.struct(F.col("n"), -F.col("first_id"))).alias("b"))
    return best.select("user_id", "b.pattern", "b.n", F.round(F.least(F.lit(0.95), 0.55 + 0.05 * F.col("b.n")), 6).alias("confidence"))


@BOOK.query("""
WITH n AS (SELECT max(ts) AS now FROM events), d AS (SELECT event_type, ts + to_days(CAST(1 + event_id % 40 AS INT)) AS due, now FROM events, n)
SELECT event_type, count(*) FILTER (due <= now) AS due_now, count(*) FILTER (due <= now + INTERVAL 24 HOUR) AS due_today, count(*) AS total FROM d GROUP BY event_type""")
def queue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is an item that falls due 1 to 40 days later."""
    e = table(spark, sf_dir, "events")
    due = F.col("ts") + F.make_dt_interval((1 + F.col("event_id") % 40).cast("int"))
    e = e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))).withColumn("due", due)
    return e.groupBy("event_type").agg(F.count_if(F.col("due") <= F.col("now")).alias("due_now"), F.count_if(F.col("due") <= F.col("now") + F.expr("INTERVAL 24 HOUR")).alias("due_today"), F.count("*").alias("total"))


@BOOK.query("""
WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
v AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS visit FROM s)
SELECT user_id, min(ts) AS started, count(*) AS n FROM v GROUP BY user_id, visit""")
def study_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits of a user, ended by a gap of 30 minutes."""
    e = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return e.select("user_id", F.col("w.start").alias("started"), "n")


@BOOK.query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def hourly_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.count_distinct("user_id").alias("users"))
    return g.select(F.col("w.start").alias("hour"), "event_type", "n", "total", "users")


@BOOK.query("""
SELECT user_id, event_type, arg_max(value, struct_pack(t := ts, e := event_id)) AS value, max(ts) AS ts FROM events GROUP BY ALL""")
def latest_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert of the later half of events into the table of the earlier half."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "ts", "event_id", F.struct("ts", "event_id").alias("at"))
    old, new = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")
    return tables.upsert_latest(old, new, ["user_id", "event_type"], "at").select("user_id", "event_type", "value", "ts")


@BOOK.query("SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")
def retained_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.keep_last(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], 20)


@BOOK.query("""
SELECT e.event_id, e.user_id, p.value AS last_purchase, p.event_id AS purchase_id FROM (SELECT * FROM events WHERE event_type = 'view') e
ASOF LEFT JOIN (SELECT user_id, ts, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY ALL) p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def last_purchase_before_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    bought = e.where("event_type = 'purchase'").groupBy("user_id", F.col("ts").alias("at")).agg(F.max_by("value", "event_id").alias("last_purchase"), F.max("event_id").alias("purchase_id"))
    seen = e.where("event_type = 'view'").select("event_id", "user_id", "ts")
    return joins.asof_join(seen, bought, "user_id", "ts", "at", ["last_purchase", "purchase_id"]).select("event_id", "user_id", "last_purchase", "purchase_id")


@BOOK.query("""
SELECT a.user_id, count(*) AS n FROM events a WHERE a.event_type = 'error' AND EXISTS (
  SELECT 1 FROM events b WHERE b.event_type = 'click' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 60000000) GROUP BY a.user_id""")
def errors_near_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors with a click of anyone within a minute."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    near = joins.near_any(e.where("event_type = 'error'"), e.where("event_type = 'click'").select(F.col("us").alias("other")), "us", "other", 60_000_000)
    return near.groupBy("user_id").agg(F.count("*").alias("n"))


@BOOK.query("""
SELECT event_type, count(*) AS n, count(*) FILTER (json_valid(props)) AS valid, round(avg(CAST(json_extract_string(props, '$.k') AS BIGINT)), 6) AS mean_k, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS max_k FROM events GROUP BY event_type""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    valid = F.from_json("props", "map<string,string>").isNotNull()
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(valid).alias("valid"), F.round(F.avg(k), 6).alias("mean_k"), F.max(k).alias("max_k"))


@BOOK.query("""
WITH n AS (SELECT max(ts) AS now FROM events),
o AS (SELECT user_id, epoch_us(now) / 1e6 - epoch_us(ts) / 1e6 AS age, least(1, greatest(0, value / 100)) AS q, CASE WHEN event_type = 'click' THEN 1.0 ELSE 1.2 END AS facet FROM events, n),
w AS (SELECT *, (1 + greatest(0, 1 - age / (30 * 86400.0))) * facet AS w FROM o)
SELECT user_id, round(sum(q * w) / sum(w) * exp(-0.05 * min(age) / 86400.0), 6) AS mastery,
  CASE WHEN round(sum(q * w) / sum(w) * exp(-0.05 * min(age) / 86400.0), 6) >= 0.8 THEN 'strong' WHEN round(sum(q * w) / sum(w) * exp(-0.05 * min(age) / 86400.0), 6) >= 0.6 THEN 'good'
  WHEN round(sum(q * w) / sum(w) * exp(-0.05 * min(age) / 86400.0), 6) >= 0.3 THEN 'fair' ELSE 'weak' END AS label FROM w GROUP BY user_id""")
def concept_mastery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean quality by age and facet, decayed since the last observation."""
    e = _events(spark, sf_dir)
    e = e.crossJoin(F.broadcast(e.agg(F.max("sec").alias("now")))).withColumn("age", F.col("now") - F.col("sec"))
    w = (1 + F.greatest(F.lit(0.0), 1 - F.col("age") / (30 * 86400.0))) * F.when(F.col("event_type") == "click", 1.0).otherwise(1.2)
    e = e.select("user_id", "age", N.c01(F.col("value") / 100).alias("q"), w.alias("w"))
    g = e.groupBy("user_id").agg(F.round(F.sum(F.col("q") * F.col("w")) / F.sum("w") * F.exp(-0.05 * F.min("age") / 86400.0), 6).alias("mastery"))
    return g.withColumn("label", N.mastery_label(F.col("mastery")))


@BOOK.query("""
WITH b AS (SELECT user_id, least(0.99, greatest(0.01, round(avg(value) / 100, 6))) AS p FROM events GROUP BY user_id)
SELECT count(*) AS n, round(sum(CASE WHEN p > 0.01 AND p < 0.99 THEN -(p * log2(p) + (1 - p) * log2(1 - p)) ELSE 0 END), 4) AS entropy FROM b""")
def belief_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "events").groupBy("user_id").agg(N.clamp(F.round(F.avg("value") / 100, 6), 0.01, 0.99).alias("p"))
    return b.agg(F.count("*").alias("n"), F.round(F.sum(N.belief_entropy(F.col("p"))), 4).alias("entropy"))


@BOOK.query("""
SELECT user_id, round(median(value), 6) AS median_value, CASE WHEN count(*) >= 3 THEN round(avg(value) / 100, 6) END AS comprehension,
  CAST(least(1000, greatest(150, 300 + CASE WHEN avg(value) / 100 >= 0.75 THEN 25 WHEN avg(value) / 100 < 0.5 THEN -25 ELSE 0 END)) AS BIGINT) AS wpm FROM events GROUP BY user_id""")
def reading_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.median("value").alias("m"), F.avg("value").alias("a"), F.count("*").alias("n"))
    return g.select("user_id", F.round("m", 6).alias("median_value"), F.when(F.col("n") >= 3, F.round(F.col("a") / 100, 6)).alias("comprehension"), N.wpm_step(F.lit(300), F.col("a") / 100).cast("long").alias("wpm"))

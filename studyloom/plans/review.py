"""Queries of the review loop: queues, due items, outcomes, mastery and what is logged.

Orders stand for review items (due on their date, urgent ones as gap fillers, their number
as position), customers for owners; events stand for observations of an entry (user_id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studyloom.functions import outcomes as O
from studyloom.operators import review, tables
from studyloom.operators.ranking import global_rank
from studyloom.plans.registry import Book
from studyloom.session import table

BOOK = Book()


@BOOK.query("""
WITH i AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS due, o_orderpriority = '1-URGENT' AS gap FROM orders),
s AS (SELECT *, sum(gap::INT) OVER (PARTITION BY o_custkey ORDER BY due NULLS FIRST, gap, o_orderkey ROWS UNBOUNDED PRECEDING) AS seen FROM i)
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY due NULLS FIRST, gap, o_orderkey) AS place FROM s WHERE NOT gap OR seen <= 3""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each owner's queue: due date, gap fillers last on ties, three of them at most."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate")).alias("due"), "o_orderpriority")
    return review.review_queue(o, "o_custkey", "due", F.col("o_orderpriority") == "1-URGENT", "o_orderkey").select("o_custkey", "o_orderkey", "place")


@BOOK.query("""
WITH n AS (SELECT date_trunc('day', max(o_orderdate)) + INTERVAL 1 DAY AS stop FROM orders)
SELECT o_orderpriority AS pool, count(*) AS items, count(*) FILTER (o_orderstatus = 'P' OR o_orderdate + to_days((o_orderkey % 30)::INT) < stop) AS due FROM orders, n GROUP BY ALL""")
def due_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that are due by the end of the last day, or have no date (status P)."""
    o = table(spark, sf_dir, "orders")
    due = F.when(F.col("o_orderstatus") != "P", F.expr("timestampadd(DAY, cast(o_orderkey % 30 as int), o_orderdate)"))
    now = o.agg(review.end_of_day(F.max("o_orderdate")).alias("stop"))
    return o.crossJoin(F.broadcast(now)).groupBy(F.col("o_orderpriority").alias("pool")).agg(F.count("*").alias("items"), F.count_if(review.is_due(due, F.col("stop"))).alias("due"))


@BOOK.query("""
WITH f AS (SELECT o_custkey, o_orderpriority AS facet, CASE WHEN count(*) > 1 THEN strftime(max(o_orderdate), '%Y-%m-%d') ELSE '' END AS due FROM orders GROUP BY ALL)
SELECT o_custkey, facet, due FROM f WHERE due <= '2000-06-30'""")
def due_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets of each concept that are due on a day, or have no date yet; days compare as text."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("facet")).agg(F.when(F.count("*") > 1, F.date_format(F.max("o_orderdate"), "yyyy-MM-dd")).otherwise("").alias("due"))
    concepts = o.groupBy("o_custkey").agg(F.collect_list(F.struct("facet", "due")).alias("facets"))
    return concepts.select("o_custkey", F.explode(F.filter("facets", lambda f: (f["due"] == "") | (f["due"] <= "2000-06-30"))).alias("f")).select("o_custkey", "f.facet", "f.due")


@BOOK.query("""
WITH q AS (SELECT CASE WHEN l_returnflag = 'A' THEN 2 WHEN l_linestatus <> 'F' THEN 1 WHEN l_tax > 0.04 THEN 3 WHEN l_linenumber > 1 THEN 4 ELSE 5 END AS mcq,
  CASE l_linenumber WHEN 1 THEN 5 WHEN 2 THEN 4 WHEN 3 THEN 3 WHEN 4 THEN 1 ELSE 3 END AS cloze,
  CASE l_linenumber WHEN 1 THEN 5 WHEN 2 THEN 4 WHEN 3 THEN 2 ELSE 1 END AS recall FROM lineitem)
SELECT mcq, cloze, recall, CASE WHEN mcq >= 4 THEN 1.0::DOUBLE WHEN mcq = 3 THEN 0.3 ELSE -0.5 END AS signal, count(*) AS n FROM q GROUP BY ALL""")
def outcome_qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Qualities of answers, and what a review of that quality adds to mastery."""
    li, k = table(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    mcq = O.mcq_quality(F.col("l_linestatus") == "F", k <= 1, F.col("l_tax") > 0.04, F.col("l_returnflag") == "A")
    named = lambda names: F.when(k.between(1, len(names)), F.get(F.array(*map(F.lit, names)), k - 1)).otherwise("")
    q = li.select(mcq.alias("mcq"), O.cloze_quality(named(["easy", "MEDIUM", "Hard", "FAIL"])).alias("cloze"), O.recall_quality(named(["strong", "adequate", "partial", "insufficient"])).alias("recall"))
    return q.groupBy("mcq", "cloze", "recall", O.review_signal(F.col("mcq")).alias("signal")).agg(F.count("*").alias("n"))


@BOOK.query("""
WITH f AS (SELECT o_custkey AS concept, o_orderpriority AS facet, min(o_orderdate) AS due FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL),
g AS (SELECT concept, facet, due, 0 AS legacy FROM f UNION ALL SELECT c_custkey, c_mktsegment, NULL, 1 FROM customer WHERE c_acctbal < 0)
SELECT concept, facet, row_number() OVER (ORDER BY due NULLS FIRST, legacy, concept, facet) AS place FROM g""")
def global_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Due facets, each once, and items of the old kind, in one queue over all owners."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    f = o.where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("concept"), F.col("o_orderpriority").alias("facet")).agg(F.min("o_orderdate").alias("due")).withColumn("legacy", F.lit(0))
    old = c.where("c_acctbal < 0").select(F.col("c_custkey").alias("concept"), F.col("c_mktsegment").alias("facet"), F.lit(None).cast("timestamp").alias("due"), F.lit(1).alias("legacy"))
    return global_rank(f.unionByName(old), [F.asc_nulls_first("due"), F.asc("legacy"), F.asc("concept"), F.asc("facet")], "place").select("concept", "facet", "place")


@BOOK.query("""
WITH due AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '2-HIGH'), g AS (SELECT count(*) AS n FROM customer WHERE c_acctbal < -1e9)
SELECT o_custkey AS owner, o_orderkey AS item FROM due, g WHERE n = 0 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def review_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The global queue or, where it's empty, the due items, of the owners in scope."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    queue = c.where("c_acctbal < -1e9").select(F.col("c_custkey").alias("owner"), F.lit(None).cast("long").alias("item"))
    due = o.where("o_orderstatus = 'O' and o_orderpriority = '2-HIGH'").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("item"))
    size = queue.agg(F.count("*").alias("n"))
    fallback = due.crossJoin(F.broadcast(size)).where("n = 0").drop("n")
    scope = c.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("owner"))
    return queue.unionByName(fallback).join(scope, "owner", "left_semi")


@BOOK.query("""
WITH kept AS (SELECT o_orderkey AS item, 'item' AS source, 0 AS part, o_totalprice AS rank FROM orders WHERE o_orderpriority <> '5-LOW'),
v AS (SELECT p_partkey AS item, 'vault' AS source, 1 AS part, round(greatest(0, 0.5 - p_size / 50.0) * (1 + (p_retailprice % 100) / 10), 6) AS rank FROM part WHERE p_size < 25)
SELECT source, part, count(*) AS n, round(sum(rank), 4) AS total FROM (SELECT * FROM kept UNION ALL SELECT * FROM v) GROUP BY ALL""")
def pool_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool whose vault items are replaced by new ones with their priority; the others stay in front."""
    pool = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), F.when(F.col("o_orderpriority") == "5-LOW", "vault").otherwise("item").alias("source"), F.col("o_totalprice").alias("rank"))
    p = table(spark, sf_dir, "part").where("p_size < 25")
    gap = F.greatest(F.lit(0), 0.5 - F.col("p_size") / 50.0)
    fresh = p.select(F.col("p_partkey").alias("item"), F.lit("vault").alias("source"), F.round(gap * (1 + (F.col("p_retailprice") % 100) / 10), 6).alias("rank"))
    return review.replace_pool(pool, fresh, F.col("source") == "vault").groupBy("source", "part").agg(F.count("*").alias("n"), F.round(F.sum("rank"), 4).alias("total"))


@BOOK.query("""
WITH n AS (SELECT max(epoch_us(ts)) / 1e6 AS now FROM events),
d AS (SELECT user_id, avg(least(1, value / 100)) FILTER (event_type = 'view') AS decl, avg(least(1, value / 100)) FILTER (event_type = 'click') AS proc, avg(least(1, value / 100)) AS one, count(*) FILTER (event_type = 'error') AS e, max(epoch_us(ts)) / 1e6 AS last FROM events GROUP BY user_id),
m AS (SELECT user_id, least(1, greatest(0, (CASE WHEN decl IS NOT NULL AND proc IS NOT NULL AND e % 2 = 0 THEN 0.4 * decl + 0.6 * proc ELSE one END) * exp(-0.05 * (now - last) / 86400))) AS m FROM d, n),
c AS (SELECT user_id, m, CASE WHEN m <= 0.5 THEN [floor(239 + 12 * m * 2 + 0.5), floor(68 + 123 * m * 2 + 0.5), floor(68 - 32 * m * 2 + 0.5)] ELSE [floor(251 - 217 * (m - 0.5) * 2 + 0.5), floor(191 + 6 * (m - 0.5) * 2 + 0.5), floor(36 + 58 * (m - 0.5) * 2 + 0.5)] END AS rgb FROM m)
SELECT user_id, round(m, 6) AS mastery, 'rgb(' || array_to_string(list_transform(rgb, lambda x: x::INT), ',') || ')' AS fill, 'rgb(' || array_to_string(list_transform(rgb, lambda x: floor(x * 0.72 + 0.5)::INT), ',') || ')' AS border FROM c""")
def current_mastery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mastery now, from two dimensions or one, decayed; with the colours of its node."""
    e = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    now = e.agg(F.max("at").alias("now"))
    share = F.least(F.lit(1.0), F.col("value") / 100)
    of = lambda kind: F.avg(F.when(F.col("event_type") == kind, share))
    d = e.groupBy("user_id").agg(of("view").alias("decl"), of("click").alias("proc"), F.avg(share).alias("one"), F.count_if(F.col("event_type") == "error").alias("e"), F.max("at").alias("last"))
    both = F.when(F.col("e") % 2 == 0, F.col("proc"))
    m = O.combined_mastery(F.col("decl"), both, F.col("one")) * F.exp(-0.05 * (F.col("now") - F.col("last")) / 86400)
    d = d.crossJoin(F.broadcast(now)).select("user_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), m)).alias("m"))
    fill, border = O.mastery_colours(F.col("m"))
    return d.select("user_id", F.round("m", 6).alias("mastery"), fill.alias("fill"), border.alias("border"))


@BOOK.query("""
SELECT CASE WHEN l_linenumber = 1 THEN 'procedural' WHEN l_returnflag = 'A' AND l_linenumber = 2 THEN 'procedural' WHEN l_returnflag = 'A' AND l_linenumber = 3 THEN 'declarative' WHEN l_linestatus = 'F' THEN 'procedural' ELSE 'declarative' END AS kind, count(*) AS n FROM lineitem GROUP BY ALL""")
def task_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations routed to the declarative or the procedural side."""
    k = F.col("l_linenumber")
    question = F.when((F.col("l_returnflag") == "A") & (k == 2), "Application").when((F.col("l_returnflag") == "A") & (k == 3), "definition")
    kind = F.when(F.col("l_linestatus") == "F", "socratic_passed").otherwise("mcq_wrong")
    return table(spark, sf_dir, "lineitem").groupBy(O.task_kind(F.when(k == 1, " Procedural "), question, kind).alias("kind")).agg(F.count("*").alias("n"))


@BOOK.query("""
WITH RECURSIVE s AS (SELECT user_id, epoch_us(ts) / 1e6 AS ts, CASE event_type WHEN 'purchase' THEN 0.6 WHEN 'view' THEN 0.3 ELSE -0.3 END::DOUBLE AS signal, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type IN ('purchase', 'view', 'error')),
r(user_id, k, m, last, p) AS (SELECT DISTINCT user_id, 0::BIGINT, 0.0::DOUBLE, NULL::DOUBLE, 0.3::DOUBLE FROM s UNION ALL
  SELECT s.user_id, s.k, least(1, greatest(0, least(1, greatest(0, m * exp(-0.05 * greatest(0, coalesce(ts - last, 0) / 86400)))) + 0.3 * signal)), ts,
    CASE WHEN signal > 0 THEN p * 0.9 / (p * 0.9 + (1 - p) * 0.2) + (1 - p * 0.9 / (p * 0.9 + (1 - p) * 0.2)) * 0.2 ELSE p * 0.1 / (p * 0.1 + (1 - p) * 0.8) + (1 - p * 0.1 / (p * 0.1 + (1 - p) * 0.8)) * 0.2 END
  FROM r JOIN s ON s.user_id = r.user_id AND s.k = r.k + 1)
SELECT user_id, k AS n, k >= 15 AS traced, round(CASE WHEN k >= 15 THEN p ELSE m END, 6) AS mastery FROM r WHERE k > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1""")
def traced_mastery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decayed mastery that gives way to knowledge tracing from the fifteenth observation on, in list order."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "view", "error"))
    signal = F.when(F.col("event_type") == "purchase", 0.6).when(F.col("event_type") == "view", 0.3).otherwise(-0.3)
    return review.traced_mastery(e.select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), signal.alias("signal"), "event_id"), "user_id", ["event_id"])


@BOOK.query("""
WITH a AS (SELECT p_partkey, l_orderkey, l_linenumber, l_shipdate, CASE WHEN l_returnflag = 'A' THEN 'synthesis' WHEN l_returnflag = 'N' THEN 'relational' ELSE 'recognition' END AS facet, (l_quantity % 5)::INT AS quality FROM lineitem JOIN part ON p_partkey = l_partkey),
g AS (SELECT p_partkey, bool_or(facet IN ('synthesis', 'relational', 'argumentative') AND quality >= 2) AS green, count(*) AS blocks, max(l_shipdate) AS last FROM a GROUP BY ALL)
SELECT CASE WHEN green THEN 'green' ELSE 'yellow' END AS maturity, CASE WHEN green THEN 0.85 ELSE 0.55 END::DOUBLE AS prior, count(*) AS concepts, sum(blocks - 1)::BIGINT AS superseded FROM g GROUP BY ALL""")
def promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts that a deep answer turned green, and content blocks that a later one supersedes."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi")
    facet = F.when(F.col("l_returnflag") == "A", "synthesis").when(F.col("l_returnflag") == "N", "relational").otherwise("recognition")
    g = li.groupBy("l_partkey").agg(F.bool_or(O.is_deep(facet, (F.col("l_quantity") % 5).cast("int"))).alias("green"), (F.count("*") - 1).alias("old"))
    maturity = F.when(F.col("green"), "green").otherwise("yellow")
    return g.groupBy(maturity.alias("maturity"), O.prior_belief(maturity).alias("prior")).agg(F.count("*").alias("concepts"), F.sum("old").alias("superseded"))


@BOOK.query("""
WITH v AS (SELECT user_id, max(ts) - INTERVAL 5 DAY AS since FROM events GROUP BY user_id),
p AS (SELECT DISTINCT e.user_id, (value % 10)::INT AS concept FROM events e JOIN v ON v.user_id = e.user_id AND e.ts >= v.since WHERE event_type = 'purchase'),
k AS (SELECT DISTINCT e.user_id, (value % 10)::INT AS concept FROM events e JOIN v ON v.user_id = e.user_id AND e.ts < v.since)
SELECT user_id, count(*) FILTER (k.concept IS NULL) AS added, count(*) FILTER (k.concept IS NOT NULL) AS reinforced FROM p LEFT JOIN k USING (user_id, concept) GROUP BY user_id""")
def visit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct concepts that a visit added, and those that it reinforced."""
    e = table(spark, sf_dir, "events").withColumn("concept", F.rint(F.col("value") % 10).cast("int"))
    since = e.groupBy("user_id").agg((F.max("ts") - F.expr("INTERVAL 5 DAYS")).alias("since"))
    e = e.join(since, "user_id")
    c = e.groupBy("user_id", "concept").agg(F.bool_or((F.col("ts") >= F.col("since")) & (F.col("event_type") == "purchase")).alias("now"), F.bool_or(F.col("ts") < F.col("since")).alias("before"))
    return c.where("now").groupBy("user_id").agg(F.count_if(~F.col("before")).alias("added"), F.count_if("before").alias("reinforced"))


@BOOK.query("""
WITH n AS (SELECT max(o_orderdate) AS now FROM orders), d AS (SELECT date_diff('second', o_orderdate, now) AS s, date_diff('second', o_orderdate, now) // 86400 AS days FROM orders, n)
SELECT CASE WHEN s < 60 THEN 'just now' WHEN s < 86400 THEN (s // 3600)::VARCHAR || ' hours ago' WHEN days = 1 THEN 'yesterday' WHEN days < 7 THEN days || ' days ago' WHEN days < 35 THEN (days // 7) || ' week' || CASE WHEN days // 7 = 1 THEN '' ELSE 's' END || ' ago'
  WHEN days < 360 THEN (days // 30) || ' month' || CASE WHEN days // 30 = 1 THEN '' ELSE 's' END || ' ago' ELSE (days // 365) || ' year' || CASE WHEN days // 365 = 1 THEN '' ELSE 's' END || ' ago' END AS label, count(*) AS n FROM d GROUP BY ALL""")
def relative_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long ago in words, counted."""
    o = table(spark, sf_dir, "orders")
    now = o.agg(F.unix_timestamp(F.max("o_orderdate")).alias("now"))
    return o.crossJoin(F.broadcast(now)).groupBy(O.ago(F.col("now") - F.unix_timestamp("o_orderdate")).alias("label")).agg(F.count("*").alias("n"))


@BOOK.query("""
WITH n AS (SELECT max(ts) AS now FROM events),
m AS (SELECT user_id, max(ts) AS miss FROM events WHERE event_type = 'error' GROUP BY user_id), b AS (SELECT user_id, avg(value) AS belief FROM events WHERE event_type = 'view' GROUP BY user_id), d AS (SELECT user_id, max(ts) + INTERVAL 3 DAY AS due FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT u.user_id, CASE WHEN now - miss <= INTERVAL 12 HOUR THEN 'recent miss' WHEN belief < 75 THEN 'linked to what you missed' WHEN due <= now + INTERVAL 1 DAY THEN 'due soon' ELSE 'next in your plan' END AS why
FROM (SELECT DISTINCT user_id, now FROM events, n) u LEFT JOIN m USING (user_id) LEFT JOIN b USING (user_id) LEFT JOIN d USING (user_id)""")
def why_this(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why an item comes now: a recent miss, a belief that was passed on, a date, or the plan."""
    e = table(spark, sf_dir, "events")
    of = lambda kind, x: F.max(F.when(F.col("event_type") == kind, x))
    u = e.groupBy("user_id").agg(of("error", F.col("ts")).alias("miss"), F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("belief"), of("purchase", F.col("ts")).alias("bought"))
    u = u.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now"))))
    why = F.when(F.col("miss") >= F.col("now") - F.expr("INTERVAL 12 HOURS"), "recent miss").when(F.col("belief") < 75, "linked to what you missed")
    why = why.when(F.col("bought") + F.expr("INTERVAL 3 DAYS") <= F.col("now") + F.expr("INTERVAL 1 DAY"), "due soon").otherwise("next in your plan")
    return u.select("user_id", why.alias("why"))


@BOOK.query("""
SELECT user_id, event_type AS annotation, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1)""")
def flashcards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One card for each annotation, the first that came, in the order of adding."""
    first = review.first_by_key(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["event_id"])
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return first.select("user_id", F.col("event_type").alias("annotation"), "event_id", place.alias("place"))


@BOOK.query("""
WITH b AS (SELECT user_id, event_type, greatest(max(value) FILTER (event_id % 2 = 0), max(value) FILTER (event_id % 2 = 1)) AS belief FROM events GROUP BY ALL) SELECT user_id, event_type, belief FROM b""")
def belief_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beliefs of two batches, the greater one of each key."""
    e = table(spark, sf_dir, "events")
    return tables.merge_greatest(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], "value").withColumnRenamed("value", "belief")


@BOOK.query("""
WITH old AS (SELECT doc_id, text FROM documents WHERE doc_id % 3 = 0), new AS (SELECT doc_id, text FROM documents),
k AS (SELECT sha256(text) AS key, min(doc_id) AS doc_id FROM new WHERE sha256(text) NOT IN (SELECT sha256(text) FROM old) GROUP BY 1)
SELECT key, doc_id FROM k UNION ALL SELECT sha256(text), doc_id FROM old""")
def cached_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache keyed by the hash of the text: what is there stays, a new text is added once."""
    d = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("key"), "doc_id")
    return tables.insert_ignore(d.where("doc_id % 3 = 0"), d, ["key"])


@BOOK.query("""
WITH s AS (SELECT o_orderkey AS id, o_custkey AS src, o_totalprice AS price FROM orders WHERE o_orderkey % 2 = 0), n AS (SELECT CASE WHEN o_orderkey % 4 = 1 THEN o_orderkey + 1 END AS id, o_custkey AS src, o_totalprice AS price, o_orderkey AS seq FROM orders WHERE o_orderkey % 2 = 1),
f AS (SELECT src, min(id) AS id FROM s GROUP BY src),
m AS (SELECT coalesce(s.id, f.id) AS id, n.price, n.seq FROM n LEFT JOIN s ON s.id = n.id LEFT JOIN f ON f.src = n.src),
l AS (SELECT id, arg_max(price, seq) AS price FROM m WHERE id IS NOT NULL GROUP BY id)
SELECT s.id, coalesce(l.price, s.price) AS price FROM s LEFT JOIN l ON l.id = s.id""")
def item_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming rows update the stored item of their id or, failing that, the first of their source; the last one wins."""
    o = table(spark, sf_dir, "orders")
    s = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("src"), F.col("o_totalprice").alias("price"))
    n = o.where("o_orderkey % 2 = 1").select(F.when(F.col("o_orderkey") % 4 == 1, F.col("o_orderkey") + 1).alias("id"), F.col("o_custkey").alias("src"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("seq"))
    return tables.upsert_matched(s, n, "id", "src", "price", "seq")


@BOOK.query("SELECT date_trunc('day', ts) AS day, event_type AS kind, count(*) AS rows, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append-only log by day and kind; nothing is merged or dropped."""
    e = table(spark, sf_dir, "events")
    log = tables.append_log(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"))
    return log.groupBy(F.date_trunc("day", "ts").alias("day"), F.col("event_type").alias("kind")).agg(F.count("*").alias("rows"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))


@BOOK.query("SELECT event_id, ts, event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE user_id = 7 ORDER BY ts DESC")
def own_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one user may see, with the payload opened."""
    e = tables.for_user(table(spark, sf_dir, "events"), 7)
    return e.select("event_id", "ts", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).orderBy(F.desc("ts"))

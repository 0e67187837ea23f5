"""Queries on the star schema and on embeddings: joins, graphs, ranking, sets, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studyloom.functions import numeric as N
from studyloom.operators import graph, joins, ranking
from studyloom.plans.registry import Book
from studyloom.session import spread, table

BOOK = Book()


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


KNN_SQL = """
WITH q AS (SELECT vec_id, embedding, label FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, q.label = e.label AS same, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS similarity FROM q JOIN embeddings e ON q.vec_id <> e.vec_id)
"""


@BOOK.query(KNN_SQL + "SELECT query_id, id, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, id) AS rank FROM s QUALIFY rank <= 5")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every query vector, those whose id divides by 100."""
    v = _vectors(spark, sf_dir)
    out = joins.nearest_neighbours(v.where(F.col("id") % 100 == 0), v, 5)
    return out.select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@BOOK.query(KNN_SQL + "SELECT query_id, id, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, id) AS rank FROM s WHERE same QUALIFY rank <= 3")
def nearest_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest with the same label."""
    v = _vectors(spark, sf_dir)
    out = joins.nearest_neighbours(v.where(F.col("id") % 100 == 0), v, 3, same="label")
    return out.select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@BOOK.query(KNN_SQL.replace(" WHERE vec_id % 100 = 0", "") + """, m AS (SELECT query_id, max(similarity) AS top FROM s GROUP BY query_id)
SELECT query_id, round(least(1, greatest(0, 1 - top)), 6) AS novelty, CASE WHEN top >= 0.45 THEN 'auto' WHEN top >= 0.40 THEN 'review' ELSE 'distinct' END AS triage FROM m""")
def novelty_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Novelty of every vector against the most similar vector, and triage at test thresholds of 0.45 and 0.40."""
    v = _vectors(spark, sf_dir)
    top = joins.nearest_neighbours(v, v, 1)
    return top.select("query_id", F.round(N.novelty(F.col("similarity")), 6).alias("novelty"), N.triage(F.col("similarity"), 0.45, 0.40).alias("triage"))


@BOOK.query("""
WITH p AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem)
SELECT a.p AS a, b.p AS b, count(*) AS n FROM p a JOIN p b ON a.o = b.o AND a.p < b.p GROUP BY ALL HAVING count(*) > 1""")
def co_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that are in two or more orders together."""
    p = spread(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")), "o").distinct()
    pairs = p.select("o", F.col("p").alias("a")).join(p.select("o", F.col("p").alias("b")), "o").where("a < b")
    pairs = spread(pairs.select("a", "b"), "a", "b", rows=joins.pair_count(p.groupBy("o").count(), "count"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1")


TREE_SQL = """
WITH RECURSIVE e AS (SELECT 'r' || r_regionkey AS src, 'n' || n_nationkey AS dst FROM region JOIN nation ON n_regionkey = r_regionkey
  UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
"""


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r, n, s = (table(spark, sf_dir, x) for x in ("region", "nation", "supplier"))
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = n.select(key("r", "n_regionkey").alias("src"), key("n", "n_nationkey").alias("dst")).unionByName(s.select(key("n", "s_nationkey").alias("src"), key("s", "s_suppkey").alias("dst")))
    nodes = r.select(key("r", "r_regionkey").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    return nodes, edges


@BOOK.query(TREE_SQL + """
d(node, depth) AS (SELECT 'r' || r_regionkey, 0 FROM region UNION ALL SELECT e.dst, d.depth + 1 FROM d JOIN e ON e.src = d.node)
SELECT node, depth FROM d""")
def tree_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _tree(spark, sf_dir)
    return graph.layers(nodes, edges)


@BOOK.query(TREE_SQL + """
d(root, node, depth) AS (SELECT n, n, 0 FROM (SELECT DISTINCT src AS n FROM e) UNION ALL SELECT d.root, e.dst, d.depth + 1 FROM d JOIN e ON e.src = d.node)
SELECT root, count(*) AS reached, max(depth) AS deepest FROM d GROUP BY root""")
def tree_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = _tree(spark, sf_dir)
    reach = graph.descendants(edges, edges.select(F.col("src").alias("node")).distinct())
    return reach.groupBy("root").agg(F.count("*").alias("reached"), F.max("depth").alias("deepest"))


ORDERED_SQL = """WITH e AS (SELECT l_partkey AS src, l_suppkey AS dst, CASE l_returnflag WHEN 'A' THEN 'part_of' WHEN 'R' THEN 'exemplifies' ELSE 'mentions' END AS type FROM lineitem) """


@BOOK.query(ORDERED_SQL + """SELECT src AS node, count(DISTINCT dst) AS dependents, round(least(1, sum(CASE type WHEN 'part_of' THEN 0.9 WHEN 'exemplifies' THEN 0.7 ELSE 0.1 END)) * 0.3, 6) AS bonus FROM e GROUP BY src""")
def node_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by the suppliers that depend on them, and their structural bonus."""
    kind = F.when(F.col("l_returnflag") == "A", "part_of").when(F.col("l_returnflag") == "R", "exemplifies").otherwise("mentions")
    e = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("dst"), kind.alias("type"))
    both = graph.dependents(e).join(graph.structural_bonus(e), "node")
    return both.select(F.substring("node", 2, 20).cast("long").alias("node"), "dependents", "bonus")


@BOOK.query("""
WITH w AS (SELECT n_nationkey, n_name, count(c_custkey) AS w FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL),
f AS (SELECT *, CAST(floor(1000 * w / sum(w) OVER ()) AS BIGINT) AS base, row_number() OVER (ORDER BY n_nationkey) AS r FROM w)
SELECT n_name, base + CASE WHEN r <= 1000 - sum(base) OVER () THEN 1 ELSE 0 END AS share FROM f""")
def budget_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1000 questions over nations by their customers; what rounding leaves goes to the first ones."""
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    w = n.join(c, n["n_nationkey"] == c["c_nationkey"], "left").groupBy("n_nationkey", "n_name").agg(F.count("c_custkey").alias("w"))
    return ranking.distribute(w, "w", 1000, [F.col("n_nationkey")]).select("n_name", "share")


@BOOK.query("""
SELECT p_partkey, p_brand, r AS place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part) WHERE r <= greatest(1, ceil(0.12 * n))""")
def threshold_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dearest 12 % of each brand, one at least."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    return ranking.top_fraction(p, "p_brand", [F.desc("p_retailprice"), F.col("p_partkey")], 0.12, name="place").select("p_partkey", "p_brand", "place")


@BOOK.query("""
SELECT p_brand, p_partkey FROM (SELECT *, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS run, sum(p_size) OVER (PARTITION BY p_brand) AS total FROM part) WHERE run <= 0.1 * total""")
def merge_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in order until a tenth of their brand's size is used up."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size")
    p = p.join(p.groupBy("p_brand").agg((0.1 * F.sum("p_size")).alias("budget")), "p_brand")
    return ranking.prefix_within_budget(p, "p_brand", [F.col("p_partkey")], "p_size", F.col("budget")).select("p_brand", "p_partkey")


@BOOK.query("SELECT p_partkey, (row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1) % 7 AS batch FROM part")
def round_robin_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ranking.global_rank(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), [F.desc("p_retailprice"), F.col("p_partkey")])
    return ranked.select("p_partkey", F.pmod(F.col("rank") - 1, F.lit(7)).alias("batch"))


@BOOK.query("""
WITH r AS (SELECT p_partkey, p_brand, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
s AS (SELECT *, r <= ceil(0.7 * n) AS fresh FROM r)
SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN fresh THEN r ELSE r - ceil(0.7 * n) END, CASE WHEN fresh THEN 0 ELSE 1 END) AS place FROM s""")
def novelty_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 70 % most novel of a brand zipped with the familiar rest."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    n = p.groupBy("p_brand").agg(F.ceil(0.7 * F.count("*")).alias("most"), F.count("*").alias("n"))
    r = ranking.rank_in_key(p, "p_brand", [F.desc("p_retailprice"), F.col("p_partkey")], "r").join(n, "p_brand")
    # in each turn a novel one, then a familiar one, as long as there are any
    turn = F.col("r") - F.col("most")
    place = F.when(F.col("r") <= F.col("most"), F.col("r") + F.least(F.col("r") - 1, F.col("n") - F.col("most"))).otherwise(turn + F.least(turn, F.col("most")))
    return r.select("p_partkey", "p_brand", place.cast("long").alias("place"))


@BOOK.query("SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 80")
def topic_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice", F.row_number().over(w).alias("r")).where("r <= 80").drop("r")


@BOOK.query("""
SELECT 'customers only' AS kind, count(*) AS n FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'both', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'either', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)""")
def nation_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).distinct()
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")).distinct()
    kinds = {"customers only": c.subtract(s), "both": c.intersect(s), "either": c.union(s).distinct()}
    out = None
    for name, df in kinds.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@BOOK.query("""
SELECT c_mktsegment, count(*) AS n, count(*) FILTER (NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS without_orders,
  count(*) FILTER (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)) AS large FROM customer GROUP BY c_mktsegment""")
def customer_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi and anti joins of customers with orders, as counts by segment."""
    c, o = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), table(spark, sf_dir, "orders")
    key = c["c_custkey"] == o["o_custkey"]
    parts = {"n": c, "without_orders": c.join(o.select("o_custkey"), key, "left_anti"), "large": c.join(o.where("o_totalprice > 300000").select("o_custkey"), key, "left_semi")}
    tagged = [df.select("c_mktsegment", *(F.lit(int(k == name)).alias(k) for k in parts)) for name, df in parts.items()]
    all_ = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    return all_.groupBy("c_mktsegment").agg(*(F.sum(k).alias(k) for k in parts))


@BOOK.query("""
WITH r AS (SELECT CAST(event_id AS BIGINT) AS region_id, epoch(ts) AS r_start, epoch(ts) + 7200 AS r_end FROM events WHERE event_type = 'signup'),
o AS (SELECT event_id, epoch(ts) AS s, epoch(ts) + 600 AS e FROM events WHERE event_type = 'purchase')
SELECT region_id, count(*) AS n FROM r JOIN o ON s < r_end AND e > r_start GROUP BY region_id""")
def purchases_during_onboarding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-minute purchases that overlap the two hours after each signup."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    bought = e.where("event_type = 'purchase'").select(F.col("at").alias("start"), (F.col("at") + 600).alias("end"))
    regions = e.where("event_type = 'signup'").select(F.col("event_id").alias("region_id"), F.col("at").alias("r_start"), (F.col("at") + 7200).alias("r_end"))
    return joins.overlap_join(bought, regions, 7200.0).groupBy("region_id").agg(F.count("*").alias("n"))


@BOOK.query("""
SELECT l_orderkey, l_linenumber, coalesce(s_name, n_name, 'unknown') AS owner FROM lineitem LEFT JOIN supplier ON s_suppkey = l_partkey LEFT JOIN nation ON n_nationkey = l_suppkey""")
def owner_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup by one key, else by another: suppliers by part number, else nations by supplier number."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    by_id = joins.fallback_join(l, s, [("l_partkey", "s_suppkey")], "s_name", "first")
    both = joins.fallback_join(by_id, n, [("l_suppkey", "n_nationkey")], "n_name", "second")
    return both.select("l_orderkey", "l_linenumber", F.coalesce("first", "second", F.lit("unknown")).alias("owner"))


@BOOK.query("""
SELECT CASE WHEN grouping(l_returnflag) = 1 THEN '*' ELSE l_returnflag END AS flag, CASE WHEN grouping(l_linestatus) = 1 THEN '*' ELSE l_linestatus END AS status,
  round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY CUBE (l_returnflag, l_linestatus)""")
def pricing_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    g = l.cube("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"), F.grouping("l_returnflag").alias("gf"), F.grouping("l_linestatus").alias("gs"))
    star = lambda g, c: F.when(F.col(g) == 1, "*").otherwise(F.col(c))
    return g.select(star("gf", "l_returnflag").alias("flag"), star("gs", "l_linestatus").alias("status"), "qty", "revenue", "n")


@BOOK.query("""
WITH b AS (SELECT s_suppkey AS node, s_acctbal / 10000 AS belief FROM supplier),
e AS (SELECT DISTINCT l_suppkey AS src, (l_suppkey + l_linenumber) AS dst FROM lineitem WHERE (l_suppkey + l_linenumber) IN (SELECT node FROM b)),
ready AS (SELECT dst, bool_and(coalesce(b.belief >= 0.5, false)) AS ok FROM e LEFT JOIN b ON b.node = e.src GROUP BY dst)
SELECT node, 'outer' AS fringe FROM b LEFT JOIN ready ON dst = node WHERE belief < 0.5 AND coalesce(ok, true)
UNION ALL SELECT node, 'inner' FROM b WHERE belief >= 0.5 AND node NOT IN (SELECT e.src FROM e JOIN b k ON k.node = e.dst AND k.belief >= 0.5)""")
def knowledge_fringes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as concepts, each a prerequisite of some that follow it."""
    beliefs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), (F.col("s_acctbal") / 10000).alias("belief"))
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_suppkey") + F.col("l_linenumber")).alias("dst")).distinct()
    edges = edges.join(beliefs.select(F.col("node").alias("dst")), "dst", "left_semi")
    outer, inner = graph.fringes(beliefs, edges, 0.5)
    return outer.select("node", F.lit("outer").alias("fringe")).unionByName(inner.select("node", F.lit("inner").alias("fringe")))


@BOOK.query("""
SELECT c_custkey, round(gap * (1 + n / 10), 4) AS priority FROM (
  SELECT c_custkey, greatest(0.5 - least(1, greatest(0, c_acctbal / 10000)), CASE WHEN min(o_totalprice) < 5000 THEN 0.05 ELSE 0 END) AS gap, coalesce(min(o_totalprice) < 5000, false) AS wrong, count(o_orderkey) AS n
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_acctbal) WHERE gap > 0 OR wrong""")
def review_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review priority: the balance as mastery, a cheap order as a misconception, orders as importance."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    g = c.join(o, c["c_custkey"] == o["o_custkey"], "left").groupBy("c_custkey", "c_acctbal").agg(F.min("o_totalprice").alias("least"), F.count("o_orderkey").alias("n"))
    p = N.review_priority(N.c01(F.col("c_acctbal") / 10000), F.coalesce(F.col("least") < 5000, F.lit(False)), F.col("n"))
    return g.select("c_custkey", F.round(p, 4).alias("priority")).where("priority is not null")

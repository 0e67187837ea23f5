"""Queries on concept graphs: builds, safe edits, beliefs and probes.

A customer is a document with its graph: the steps from line to line of its orders, those
with flag N as prerequisites. Beliefs come of the sizes of parts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studyloom.functions import outcomes as O
from studyloom.operators import beliefs as B
from studyloom.operators import graph, joins
from studyloom.operators.review import union_all
from studyloom.plans.identity import EDGES_SQL, sequence_edges
from studyloom.plans.registry import Book
from studyloom.session import spread, table

BOOK = Book()
GRAPH_SQL = """li AS (SELECT o_custkey AS doc, l_orderkey AS o, l_partkey AS id, l_returnflag AS f, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nxt FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
ed AS (SELECT DISTINCT doc, id AS src, nxt AS dst FROM li WHERE f = 'N' AND nxt IS NOT NULL AND nxt <> id),
be AS (SELECT DISTINCT doc, id AS node, 0.02 + p_size / 55.0 AS belief FROM li JOIN part ON p_partkey = id),
pr AS (SELECT doc, min(node) AS probe, CASE doc % 3 WHEN 0 THEN CASE doc % 2 WHEN 0 THEN 'knew' ELSE 'missed' END ELSE 'partial' END AS response FROM be GROUP BY doc)"""


def _damp(current: str, target: str, factor: str) -> str:
    c = f"greatest(0.01, least(0.99, {current}))"
    return f"greatest(0.01, least(0.99, {c} + ({target} - {c}) * {factor}))"


def _chain_sql() -> str:
    own = "CASE WHEN own THEN " + _damp("belief", "CASE response WHEN 'knew' THEN 0.88 WHEN 'partial' THEN 0.55 ELSE 0.15 END", "0.85") + " ELSE belief END"
    steps, before = [f"c0 AS (SELECT *, {own} AS b0 FROM fl)"], "b0"
    for i, (side, hop) in enumerate((("up", 1), ("up", 2), ("down", 1), ("down", 2)), 1):
        target = "CASE response WHEN 'knew' THEN 0.72 ELSE 0.58 END" if side == "up" else "CASE response WHEN 'knew' THEN 0.68 WHEN 'partial' THEN 0.55 ELSE 0.04 END"
        factor = "CASE response WHEN 'knew' THEN 0.33 ELSE 0.21 END" if side == "up" else "CASE response WHEN 'knew' THEN 0.27 WHEN 'partial' THEN 0.18 ELSE 0.8 END"
        steps.append(f"c{i} AS (SELECT *, CASE WHEN {side}{hop} THEN {_damp(before, target, f'{factor} * {1 if hop == 1 else 0.8}')} ELSE {before} END AS b{i} FROM c{i - 1})")
        before = f"b{i}"
    return ", ".join(steps)


REACH_SQL = """u1 AS (SELECT DISTINCT pr.*, src AS node FROM pr JOIN ed ON ed.doc = pr.doc AND dst = probe WHERE response <> 'missed'), u2 AS (SELECT DISTINCT u1.doc, probe, response, src AS node FROM u1 JOIN ed ON ed.doc = u1.doc AND dst = node),
d1 AS (SELECT DISTINCT pr.*, dst AS node FROM pr JOIN ed ON ed.doc = pr.doc AND src = probe), d2 AS (SELECT DISTINCT d1.doc, probe, response, dst AS node FROM d1 JOIN ed ON ed.doc = d1.doc AND src = node),
al AS (SELECT doc, probe, response, probe AS node, 'own' AS s FROM pr UNION ALL SELECT *, 'u1' FROM u1 UNION ALL SELECT *, 'u2' FROM u2 UNION ALL SELECT *, 'd1' FROM d1 UNION ALL SELECT *, 'd2' FROM d2),
fl AS (SELECT al.doc, probe, response, al.node, any_value(belief) AS belief, bool_or(s = 'own') AS own, bool_or(s = 'u1') AS up1, bool_or(s = 'u2') AS up2, bool_or(s = 'd1') AS down1, bool_or(s = 'd2') AS down2 FROM al JOIN be ON be.doc = al.doc AND be.node = al.node GROUP BY ALL)"""


def _graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """edges (doc, src, dst), beliefs (doc, node, belief) and one probe of each document."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("doc"))
    e = sequence_edges(spark, sf_dir).where("kind = 'N'").join(o, F.col("line") == F.col("o_orderkey")).select("doc", "src", "dst").distinct()
    li = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("doc", F.col("l_partkey").alias("node")).distinct()
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), (0.02 + F.col("p_size") / 55.0).alias("belief"))
    b = li.join(p, "node").select("doc", "node", "belief")
    k = F.col("doc")
    answer = F.when(k % 3 != 0, "partial").when(k % 2 == 0, "knew").otherwise("missed")
    return e, b, b.groupBy("doc").agg(F.min("node").alias("probe")).withColumn("response", answer)


@BOOK.query(f"WITH {GRAPH_SQL}, {REACH_SQL}, {_chain_sql()} SELECT doc, node, round(belief, 6) AS before, round(b4, 6) AS after FROM c4")
def propagated_beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one answer in each graph tells of its concept and of those within two hops."""
    e, b, probes = _graphs(spark, sf_dir)
    out = B.propagate(probes, e, b)
    return out.select("doc", "node", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"))


H_SQL = "CASE WHEN {0} > 0.01 AND {0} < 0.99 THEN -({0} * log2({0}) + (1 - {0}) * log2(1 - {0})) ELSE 0 END"


@BOOK.query(f"""WITH {GRAPH_SQL.replace('pr AS (SELECT doc, min(node) AS probe, CASE doc % 3', 'px AS (SELECT doc, min(node) AS probe, CASE doc % 3')},
pr AS (SELECT be.doc, be.node AS probe, r AS response FROM be JOIN px ON px.doc = be.doc AND px.probe <> be.node, unnest(['knew', 'missed']) AS t(r) WHERE belief > 0.1 AND belief < 0.8), {REACH_SQL}, {_chain_sql()},
f AS (SELECT doc, probe, response, sum({H_SQL.format('belief')} - {H_SQL.format('b4')}) AS fall FROM c4 GROUP BY ALL),
g AS (SELECT f.doc, probe, round(sum(CASE WHEN response = 'knew' THEN belief ELSE 1 - belief END * fall), 9) AS gain FROM f JOIN be ON be.doc = f.doc AND be.node = probe GROUP BY ALL)
SELECT doc, arg_min(probe, (-gain, probe)) AS node, round(max(gain), 5) AS gain FROM g GROUP BY doc HAVING max(gain) > 0""")
def next_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The concept of each graph that is most worth asking for; the one asked before is left out."""
    e, b, probes = _graphs(spark, sf_dir)
    out = B.next_probes(e, b, probes.select("doc", F.col("probe").alias("node")))
    return out.select("doc", "node", F.round("gain", 5).alias("gain"))


def _round_sql(k: int) -> str:
    """Gains, pick and beliefs after it of the k-th round, from the tables be{k} and gone{k}."""
    own = lambda sql: re.sub(r"\b(u1|u2|d1|d2|al|fl|c0|c1|c2|c3|c4|be|pr)\b", rf"\1_{k}", sql)
    told = own(f"{REACH_SQL}, {_chain_sql()}")
    knew = re.sub(r"\b(u1|u2|d1|d2|al|fl|c0|c1|c2|c3|c4|pr)_(\d)\b", r"\1_\2k", told)
    return f"""be_{k} AS (SELECT * FROM be{k}),
pr_{k} AS (SELECT b.doc, b.node AS probe, r AS response FROM be{k} b, unnest(['knew', 'missed']) AS t(r) WHERE belief > 0.1 AND belief < 0.8 AND NOT EXISTS (SELECT 1 FROM gone{k} x WHERE x.doc = b.doc AND x.node = b.node)), {told},
fall{k} AS (SELECT doc, probe, response, sum({H_SQL.format('belief')} - {H_SQL.format('b4')}) AS fall FROM c4_{k} GROUP BY ALL),
gain{k} AS (SELECT f.doc, probe, round(sum(CASE WHEN response = 'knew' THEN belief ELSE 1 - belief END * fall), 9) AS gain FROM fall{k} f JOIN be{k} b ON b.doc = f.doc AND b.node = probe GROUP BY ALL),
pick{k} AS (SELECT doc, arg_min(probe, (-gain, probe)) AS node, max(gain) AS gain FROM gain{k} GROUP BY doc HAVING max(gain) > 0),
pr_{k}k AS (SELECT doc, node AS probe, 'knew' AS response FROM pick{k}), {knew},
kin{k} AS (SELECT y.doc, y.node FROM pick{k} p JOIN kin x ON x.doc = p.doc AND x.node = p.node JOIN kin y ON y.doc = x.doc AND y.kin = x.kin AND y.node <> x.node),
be{k + 1} AS (SELECT doc, node, CASE WHEN EXISTS (SELECT 1 FROM kin{k} x WHERE x.doc = m.doc AND x.node = m.node) AND belief < 0.8 THEN least(0.99, belief + 0.72) ELSE belief END AS belief
  FROM (SELECT b.doc, b.node, coalesce(c.b4, b.belief) AS belief FROM be{k} b JOIN pick{k} p ON p.doc = b.doc LEFT JOIN c4_{k}k c ON c.doc = b.doc AND c.node = b.node) m),
gone{k + 1} AS (SELECT * FROM gone{k} UNION ALL SELECT doc, node FROM pick{k})"""


@BOOK.query(f"""WITH {GRAPH_SQL}, kin AS (SELECT doc, dst AS node, list_sort(list(src)) AS kin FROM ed GROUP BY doc, dst), be1 AS (SELECT * FROM be), gone1 AS (SELECT doc, probe AS node FROM pr), {', '.join(_round_sql(k) for k in (1, 2, 3))}
SELECT doc, 1 AS place, node, round(gain, 5) AS gain FROM pick1 UNION ALL SELECT doc, 2, node, round(gain, 5) FROM pick2 UNION ALL SELECT doc, 3, node, round(gain, 5) FROM pick3""")
def probe_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three concepts of each graph to ask for, each chosen as if those before were known."""
    e, b, probes = _graphs(spark, sf_dir)
    out = B.next_probe_batch(e, b, probes.select("doc", F.col("probe").alias("node")), 3)
    return out.withColumn("gain", F.round("gain", 5))


@BOOK.query(f"WITH {GRAPH_SQL} SELECT doc, round(avg({H_SQL.format('belief')}), 6) AS entropy, avg({H_SQL.format('belief')}) < 0.85 AS stop FROM be GROUP BY doc")
def early_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the beliefs of a graph are sure enough to stop asking (0.85 here)."""
    _, b, _ = _graphs(spark, sf_dir)
    g = b.groupBy("doc").agg(F.avg(O.binary_entropy(F.col("belief"))).alias("h"))
    return g.select("doc", F.round("h", 6).alias("entropy"), (F.col("h") < 0.85).alias("stop"))


@BOOK.query(f"""
WITH {EDGES_SQL}, pre AS (SELECT src, dst FROM e JOIN lineitem ON l_orderkey = o AND l_partkey = src WHERE l_returnflag = 'N' AND src <> dst)
SELECT kind, count(*) AS edges, count(DISTINCT src) AS sources FROM (SELECT DISTINCT 'prerequisite' AS kind, l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_returnflag = 'N' AND l_partkey <> l_suppkey
 UNION ALL SELECT DISTINCT 'together', least(l_partkey, l_suppkey), greatest(l_partkey, l_suppkey) FROM lineitem WHERE l_returnflag = 'A' AND l_partkey <> l_suppkey
 UNION ALL SELECT DISTINCT 'influence', l_partkey, l_suppkey FROM lineitem WHERE l_tax > 0.07 AND l_partkey <> l_suppkey) GROUP BY kind""")
def vault_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of three kinds, each once; those between equals without a direction."""
    g = graph.typed_edges(_kinds(spark, sf_dir), undirected=("together",))
    return g.groupBy("kind").agg(F.count("*").alias("edges"), F.count_distinct("src").alias("sources"))


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), "l_returnflag", "l_tax")
    kind = lambda cond, name: li.where(cond).select(F.lit(name).alias("kind"), "src", "dst")
    return union_all(kind("l_returnflag = 'N'", "prerequisite"), kind("l_returnflag = 'A'", "together"), kind("l_tax > 0.07", "influence"))


@BOOK.query("""
WITH b AS (SELECT o_custkey AS doc, o_orderkey AS block, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders),
x AS (SELECT DISTINCT 'covers' AS kind, 'block:' || l_orderkey AS src, 'concept:' || l_partkey AS dst FROM lineitem UNION ALL SELECT DISTINCT 'mentions', 'block:' || l_orderkey, 'term:' || l_shipdate::DATE FROM lineitem WHERE l_tax > 0.05
 UNION ALL SELECT 'sequence', 'block:' || before, 'block:' || block FROM b WHERE before IS NOT NULL UNION ALL SELECT DISTINCT 'requires', 'concept:' || l_partkey, 'concept:' || l_suppkey FROM lineitem WHERE l_returnflag = 'N')
SELECT kind, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM x GROUP BY kind""")
def material_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of blocks, concepts and terms: what covers, mentions, follows and requires what."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    node = lambda layer, c: F.concat(F.lit(f"{layer}:"), F.col(c).cast("string"))
    edge = lambda df, kind, a, b: df.select(F.lit(kind).alias("kind"), a.alias("src"), b.alias("dst"))
    order = o.withColumn("before", F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).where("before is not null")
    dated = li.where("l_tax > 0.05").withColumn("day", F.to_date("l_shipdate"))
    every = union_all(
        edge(li, "covers", node("block", "l_orderkey"), node("concept", "l_partkey")),
        edge(dated, "mentions", node("block", "l_orderkey"), node("term", "day")),
        edge(order, "sequence", node("block", "before"), node("block", "o_orderkey")),
        edge(li.where("l_returnflag = 'N'"), "requires", node("concept", "l_partkey"), node("concept", "l_suppkey")),
    )
    rows = 3 * li.count() + o.count()
    e = graph.typed_edges(every, loops=True, rows=rows)
    ends = e.select("kind", F.inline(F.array(F.struct(F.lit(True).alias("begins"), F.col("src").alias("node")), F.struct(F.lit(False).alias("begins"), F.col("dst").alias("node")))))
    ends = spread(ends, "kind", "begins", "node", rows=2 * rows).distinct().where("node is not null")
    n = ends.groupBy("kind").agg(F.count_if("begins").alias("sources"), F.count_if(~F.col("begins")).alias("targets"))
    counted = e.groupBy("kind").agg(F.count("*").alias("edges")).join(n, "kind", "left")
    return counted.select("kind", "edges", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("sources", "targets")))


@BOOK.query("""
WITH r AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_returnflag = 'N' AND l_partkey <> l_suppkey), c AS (SELECT DISTINCT least(x.l_partkey, y.l_partkey) AS a, greatest(x.l_partkey, y.l_partkey) AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey),
k AS (SELECT least(a, b) AS a, greatest(a, b) AS b FROM r)
SELECT 'registry' AS origin, count(*) AS edges FROM r UNION ALL SELECT 'together', count(*) FROM c WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.a = c.a AND k.b = c.b)""")
def global_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections of the registry, and concepts that stand in one document without one; an order has a handful of lines."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("s"), "l_returnflag")
    r = spread(li.where("l_returnflag = 'N' and a <> s").select("a", F.col("s").alias("b")), "a", "b", rows=li.count()).distinct()
    parts = spread(li.select("l_orderkey", "a"), "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("a")).alias("ps"))
    pairs = parts.select(F.explode(F.flatten(F.transform("ps", lambda x: F.transform(F.filter("ps", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p")).select("p.a", "p.b")
    n = joins.pair_count(parts.select(F.size("ps").alias("n")), "n")
    pairs = spread(pairs, "a", "b", rows=n).distinct()
    known = spread(r.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "a", "b", rows=n).distinct()
    together = pairs.join(known, ["a", "b"], "left_anti")
    return r.agg(F.count("*").alias("edges")).select(F.lit("registry").alias("origin"), "edges").unionByName(together.agg(F.count("*").alias("edges")).select(F.lit("together").alias("origin"), "edges"))


@BOOK.query(f"WITH {EDGES_SQL} SELECT k AS node, count(DISTINCT n) AS neighbours FROM (SELECT src AS k, dst AS n FROM e WHERE src <> dst UNION ALL SELECT dst, src FROM e WHERE src <> dst UNION ALL SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A' AND l_partkey <> l_suppkey) GROUP BY k")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many concepts are next to each one: above, below and beside it."""
    e = sequence_edges(spark, sf_dir).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    beside = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).where("a <> b")
    n = spread(graph.both_ways(e).unionByName(beside), "a", "b", rows=3 * table(spark, sf_dir, "lineitem").count())
    return n.distinct().groupBy(F.col("a").alias("node")).agg(F.count("*").alias("neighbours"))


@BOOK.query("""
WITH RECURSIVE t AS (SELECT p_partkey AS node, p_partkey // 2 AS parent FROM part WHERE p_partkey > 0), c AS (SELECT p_partkey AS a, (p_partkey * 7) % 101 AS b FROM part WHERE p_partkey > 0),
up(a, b, x) AS (SELECT a, b, b FROM c UNION ALL SELECT a, b, parent FROM up JOIN t ON node = x WHERE parent > 0)
SELECT c.a, c.b, CASE WHEN c.a = c.b THEN 'same' WHEN bool_or(up.x = c.a) THEN 'together' ELSE 'prerequisite' END AS kind FROM c JOIN up ON up.a = c.a AND up.b = c.b WHERE c.b > 0 GROUP BY c.a, c.b""")
def safe_prerequisites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New prerequisites b of a: where b already needs a, the two become a pair without direction."""
    p = table(spark, sf_dir, "part").where("p_partkey > 0")
    tree = p.select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).alias("dst")).where("dst > 0")
    c = p.select(F.col("p_partkey").alias("a"), ((F.col("p_partkey") * 7) % 101).alias("b")).where("b > 0")
    return graph.safe_inserts(tree, c)


@BOOK.query("""
WITH RECURSIVE t AS (SELECT p_partkey AS node, p_partkey // 2 AS parent FROM part WHERE p_partkey > 0), m AS (SELECT p_partkey AS node, (p_partkey * 3) % 100 + 1 AS target FROM part WHERE p_partkey > 0),
up(node, target, x) AS (SELECT node, target, target FROM m UNION ALL SELECT up.node, target, parent FROM up JOIN t ON t.node = x WHERE parent > 0)
SELECT m.node, m.target, NOT bool_or(x = m.node) AS allowed, (SELECT count(*) FROM t WHERE t.parent = m.node) = 0 AND m.node <> 1 AS deletable FROM m JOIN up ON up.node = m.node GROUP BY m.node, m.target""")
def project_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves in a project tree that make no cycle, and projects that may be deleted: not the first, and empty."""
    p = table(spark, sf_dir, "part").where("p_partkey > 0")
    tree = p.select(F.col("p_partkey").alias("node"), F.floor(F.col("p_partkey") / 2).alias("parent"))
    moves = p.select(F.col("p_partkey").alias("node"), ((F.col("p_partkey") * 3) % 100 + 1).alias("target"))
    up = graph.descendants(tree.where("parent > 0").select(F.col("node").alias("src"), F.col("parent").alias("dst")), moves.select(F.col("target").alias("node")).distinct())
    bad = up.select(F.col("root").alias("target"), "node").distinct().withColumn("below", F.lit(True))
    kids = tree.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n"))
    j = moves.join(bad, ["node", "target"], "left").join(kids, "node", "left")
    return j.select("node", "target", F.col("below").isNull().alias("allowed"), (F.col("n").isNull() & (F.col("node") != 1)).alias("deletable"))


@BOOK.query("""
WITH RECURSIVE n AS (SELECT p_partkey, p_brand || ' ' || p_type AS node, p_size FROM part), e AS (SELECT DISTINCT a.node AS src, b.node AS dst FROM n a JOIN n b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_size >= 46 AND a.node <> b.node),
r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst)
SELECT e.src, e.dst FROM e JOIN r ON r.src = e.dst AND r.dst = e.src""")
def cycle_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that lie on a cycle, and not those on a way between two; from a large part's kind to the next part's."""
    n = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_type").alias("src"), "p_size")
    after = n.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("src").alias("dst"))
    return graph.on_cycles(n.where("p_size >= 46").join(after, "p_partkey").select("src", "dst"))


@BOOK.query("""
WITH RECURSIVE n AS (SELECT p_partkey, p_brand || ' ' || p_type AS node, round(0.4 + p_size / 100.0, 2) AS w FROM part), e AS (SELECT a.node AS src, b.node AS dst, min(a.w) AS w FROM n a JOIN n b ON b.p_partkey = a.p_partkey + 1 GROUP BY ALL),
o AS (SELECT *, row_number() OVER (ORDER BY w DESC, src DESC, dst DESC) AS r FROM e),
reach(r, src, node) AS (SELECT r, src, dst FROM o UNION SELECT x.r, x.src, o.dst FROM reach x JOIN o ON o.src = x.node AND o.r < x.r WHERE x.node <> x.src)
SELECT o.src, o.dst, o.w AS weight, coalesce(bool_or(x.node = o.src), false) AS dropped FROM o JOIN reach x ON x.r = o.r GROUP BY ALL""")
def acyclic_prerequisites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prerequisites between the kinds of parts that follow each other, without the lightest edge of every cycle."""
    n = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_type").alias("src"), F.round(0.4 + F.col("p_size") / 100.0, 2).alias("weight"))
    after = n.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("src").alias("dst"))
    return graph.probe_graph(n.select(F.col("src").alias("node")).distinct(), n.join(after, "p_partkey").select("src", "dst", "weight"))


@BOOK.query("""
WITH m AS (SELECT p_partkey AS id, p_partkey * 10 AS vault FROM part WHERE p_size < 40)
SELECT DISTINCT a.vault AS dependent, b.vault AS prerequisite FROM lineitem JOIN m a ON a.id = l_partkey JOIN m b ON b.id = l_suppkey WHERE l_returnflag = 'N' AND l_partkey <> l_suppkey""")
def elevated_prerequisites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prerequisites of a document with both ends mapped to the vault, each once."""
    m = table(spark, sf_dir, "part").where("p_size < 40").select("p_partkey", (F.col("p_partkey") * 10).alias("vault"))
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'N' and l_partkey <> l_suppkey").select("l_partkey", "l_suppkey")
    a = li.join(m.select(F.col("p_partkey").alias("l_partkey"), F.col("vault").alias("dependent")), "l_partkey")
    return a.join(m.select(F.col("p_partkey").alias("l_suppkey"), F.col("vault").alias("prerequisite")), "l_suppkey").select("dependent", "prerequisite").distinct()


@BOOK.query("""
WITH n AS (SELECT item_id AS b, lower(regexp_extract_all(text, '[A-Za-z]+')[1] || ' ' || regexp_extract_all(text, '[A-Za-z]+')[2]) AS name FROM benchmark),
w AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda x: lower(x)) AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws), 1)), lambda i: ws[i] || ' ' || ws[i + 1])) AS name FROM w)
SELECT doc_id, b FROM g JOIN n USING (name)""")
def explicit_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that name a concept: its two words stand in them next to each other."""
    words = F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), F.lower)
    names = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("b"), F.concat_ws(" ", F.get(words, F.lit(0)), F.get(words, F.lit(1))).alias("name"))
    d = table(spark, sf_dir, "documents").select("doc_id", words.alias("ws"))
    pairs = F.array_distinct(F.zip_with(F.slice("ws", 1, F.greatest(F.size("ws") - 1, F.lit(0))), F.slice("ws", 2, F.size("ws")), lambda x, y: F.concat_ws(" ", x, y)))
    return d.select("doc_id", F.explode(pairs).alias("name")).join(names, "name").select("doc_id", "b")

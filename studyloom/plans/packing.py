"""Queries of block planning. A customer stands for a document, the parts bought for its
concepts (in the order of the first purchase, p_type as module, p_size as importance), the
steps from line to line of an order for relations, orders for blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.functions.text import word_count
from studyloom.operators import packing as P
from studyloom.operators.ranking import rank_in_key
from studyloom.operators.review import first_by_key
from studyloom.operators.tables import keep_last
from studyloom.plans.identity import sequence_edges
from studyloom.plans.registry import Book
from studyloom.session import table

BOOK = Book()
DOCS_SQL = """li AS (SELECT o_custkey AS doc, l_orderkey AS o, l_linenumber AS n, l_partkey AS id, l_suppkey AS s, l_returnflag AS f, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nxt FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
inv AS (SELECT doc, list(id ORDER BY pos, id) AS ids FROM (SELECT doc, id, min(o * 10 + n) AS pos FROM li GROUP BY ALL) GROUP BY doc),
ed AS (SELECT doc, id AS a, nxt AS b, CASE f WHEN 'A' THEN 0.9 WHEN 'R' THEN 0.7 ELSE 0.3 END AS w, f, o, n FROM li WHERE nxt IS NOT NULL AND nxt <> id)"""
AFFINITY_SQL = f"""{DOCS_SQL},
am AS (SELECT doc, map_from_entries(list((k, w))) AS m FROM (SELECT doc, least(a, b) || '|' || greatest(a, b) AS k, max(w)::DOUBLE AS w FROM ed WHERE w >= 0.5 GROUP BY ALL) GROUP BY doc),
g(doc, m, placed, rest) AS (SELECT inv.doc, coalesce(m, MAP([]::VARCHAR[], []::DOUBLE[])), [ids[1]], ids[2:] FROM inv LEFT JOIN am USING (doc) UNION ALL
  SELECT doc, m, list_append(placed, x), list_filter(rest, lambda y: y <> x) FROM (
    SELECT *, list_sort(list_transform(rest, lambda y, i: {{'w': -coalesce(m[least(placed[-1], y) || '|' || greatest(placed[-1], y)], 0), 'i': i, 'y': y}}))[1].y AS x FROM g WHERE len(rest) > 0)),
ao AS (SELECT doc, placed FROM g WHERE len(rest) = 0)"""


def _inventories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, ids) of every customer."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("doc"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    li = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    first = li.groupBy("doc", F.col("l_partkey").alias("id")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return first.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"))


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, src, dst, kind) of every step of a customer's orders."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("doc"))
    return sequence_edges(spark, sf_dir).join(o, F.col("line") == F.col("o_orderkey")).select("doc", "src", "dst", "kind")


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, ids) in the order of affinity."""
    weight = F.when(F.col("kind") == "A", 0.9).when(F.col("kind") == "R", 0.7).otherwise(0.3)
    e = _steps(spark, sf_dir).withColumn("w", weight)
    strong = e.where(F.col("w") >= P.STRONG).groupBy("doc", P.pair_key(F.col("src"), F.col("dst")).alias("k")).agg(F.max("w").alias("w"))
    maps = strong.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("k", "w"))).alias("affinity"))
    d = _inventories(spark, sf_dir).join(maps, "doc", "left").withColumn("affinity", F.coalesce("affinity", F.create_map().cast("map<string,double>")))
    return d.select("doc", P.affinity_order(F.col("ids"), F.col("affinity")).alias("ids"))


def _joined(c: str) -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@BOOK.query(f"WITH RECURSIVE {AFFINITY_SQL} SELECT doc, array_to_string(placed, ',') AS ids FROM ao")
def affinity_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's concepts, one followed by the one it is tied to most."""
    return _ordered(spark, sf_dir).select("doc", _joined("ids").alias("ids"))


@BOOK.query(f"""WITH RECURSIVE {DOCS_SQL},
es AS (SELECT doc, list_sort(list(DISTINCT {{'a': a, 'b': b}})) AS es FROM ed WHERE f = 'N' GROUP BY doc),
r(doc, es, k, l) AS (SELECT inv.doc, coalesce(es, []), len(ids) + 2, ids FROM inv LEFT JOIN es USING (doc) UNION ALL
  SELECT doc, es, k - 1, l[1:ib - 1] || [l[ia]] || l[ib:ia - 1] || l[ia + 1:] FROM (SELECT *, list_position(l, x.a) AS ia, list_position(l, x.b) AS ib FROM (SELECT *, list_filter(es, lambda e: list_position(l, e.b) > 0 AND list_position(l, e.a) > list_position(l, e.b))[1] AS x FROM r WHERE k > 0) WHERE x IS NOT NULL))
SELECT doc, array_to_string(arg_min(l, k), ',') AS ids FROM r GROUP BY doc""")
def repaired_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of one concept each, with prerequisites moved in front of what depends on them."""
    before = _steps(spark, sf_dir).where("kind = 'N'").groupBy("doc").agg(F.array_sort(F.collect_set(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")))).alias("edges"))
    d = _inventories(spark, sf_dir).join(before, "doc", "left")
    d = d.select("doc", F.transform("ids", lambda x: F.array(x)).alias("blocks"), F.coalesce("edges", F.array().cast("array<struct<a:bigint,b:bigint>>")).alias("edges"))
    d = d.withColumn("out", F.flatten(P.repair_order(F.col("blocks"), F.col("edges"))))
    return d.select("doc", _joined("out").alias("ids"))


PACK_SQL = f"""{AFFINITY_SQL},
c AS (SELECT doc, id, pos, p_type AS module, p_size AS w FROM (SELECT doc, unnest(placed) AS id, generate_subscripts(placed, 1) AS pos FROM ao) JOIN part ON p_partkey = id),
md AS (SELECT doc, module, count(*) AS k, min(pos) AS pos, arg_max(id, (w, -pos)) AS best FROM c GROUP BY ALL), mn AS (SELECT doc, count(*) AS modules FROM md GROUP BY doc),
vt AS (SELECT doc, best AS id, row_number() OVER (PARTITION BY doc ORDER BY pos) AS v FROM md JOIN mn USING (doc) WHERE k >= 4 AND modules <= 10 - 2),
vn AS (SELECT doc, count(*) AS nv FROM vt GROUP BY doc),
rs AS (SELECT c.doc, c.id, row_number() OVER (PARTITION BY c.doc ORDER BY c.pos) - 1 AS r, count(*) OVER (PARTITION BY c.doc) AS n, 10 - 1 - coalesce(nv, 0) AS slots, coalesce(nv, 0) AS nv FROM c LEFT JOIN vt ON vt.doc = c.doc AND vt.id = c.id LEFT JOIN vn ON vn.doc = c.doc WHERE vt.id IS NULL),
bl AS (SELECT doc, 1 AS block, 'overview' AS kind, '' AS ids FROM ao UNION ALL SELECT doc, 1 + v, 'key terms', id::VARCHAR FROM vt
  UNION ALL SELECT doc, 2 + nv + r // ceil(n / slots)::INT, 'group', string_agg(id::VARCHAR, ',' ORDER BY r) FROM rs GROUP BY doc, 2 + nv + r // ceil(n / slots)::INT)"""


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _ordered(spark, sf_dir).select("doc", F.posexplode("ids").alias("pos", "id"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("module"), F.col("p_size").alias("importance"))
    d = d.join(p, "id").groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id", "module", "importance"))), lambda x: F.struct(x["id"].alias("id"), x["module"].alias("module"), x["importance"].alias("importance"))).alias("inv"))
    return d.select("doc", F.size("inv").alias("concepts"), F.posexplode(P.pack_blocks(F.col("inv"), F.lit(10))).alias("at", "b"))


@BOOK.query(f"WITH RECURSIVE {PACK_SQL} SELECT doc, block::INT AS block, kind, ids FROM bl")
def packed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten blocks for each document: an overview, key terms of large modules, then even groups."""
    return _packed(spark, sf_dir).select("doc", (F.col("at") + 1).alias("block"), "b.kind", _joined("b.ids").alias("ids"))


@BOOK.query(f"""WITH RECURSIVE {PACK_SQL}
SELECT doc, count(*) <= 10 AS within, sum(CASE WHEN ids = '' THEN 0 ELSE len(string_split(ids, ',')) END)::BIGINT = len(any_value(inv.ids)) AS whole, count(*) AS blocks FROM bl JOIN inv USING (doc) GROUP BY doc""".replace("bl JOIN inv", "bl JOIN (SELECT doc, ids AS all_ids FROM inv) inv").replace("any_value(inv.ids)", "any_value(all_ids)"))
def pack_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a pack has no more blocks than asked for, and every concept once."""
    g = _packed(spark, sf_dir).groupBy("doc").agg(F.count("*").alias("blocks"), F.sum(F.size("b.ids")).alias("placed"), F.first("concepts").alias("concepts"))
    return g.select("doc", (F.col("blocks") <= 10).alias("within"), (F.col("placed") == F.col("concepts")).alias("whole"), "blocks")


@BOOK.query("""
WITH RECURSIVE b AS (SELECT o_custkey AS doc, o_orderkey AS id, any_value(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE '' END) AS title, list(DISTINCT l_suppkey % 20) AS terms, list(DISTINCT l_partkey % 50) AS concepts FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
p AS (SELECT x.doc, x.id AS a, y.id AS b, CASE WHEN x.title <> '' AND x.title = y.title THEN 'title' WHEN len(list_intersect(x.terms, y.terms)) >= 3 THEN 'terms' WHEN len(list_intersect(x.terms, y.terms)) >= 2 AND list_has_any(x.concepts, y.concepts) THEN 'concept and terms' END AS reason FROM b x JOIN b y ON x.doc = y.doc AND x.id < y.id),
i AS (SELECT b.doc, b.id, row_number() OVER (PARTITION BY b.doc ORDER BY b.id) AS k, coalesce(ps, []) AS ps FROM b LEFT JOIN (SELECT doc, a, list({'b': b, 'reason': reason} ORDER BY b) AS ps FROM p WHERE reason IS NOT NULL GROUP BY doc, a) q ON q.doc = b.doc AND q.a = b.id),
r(doc, k, gone, a, hit) AS (SELECT DISTINCT doc, 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::STRUCT(b BIGINT, reason VARCHAR) FROM i UNION ALL
  SELECT doc, k, CASE WHEN h IS NULL THEN gone ELSE list_append(gone, h.b) END, id, h FROM (SELECT i.doc, i.k, i.id, r.gone, CASE WHEN list_contains(r.gone, i.id) THEN NULL ELSE list_filter(i.ps, lambda x: NOT list_contains(r.gone, x.b))[1] END AS h FROM r JOIN i ON i.doc = r.doc AND i.k = r.k + 1))
SELECT doc, a AS keep, hit.b AS absorb, hit.reason AS reason FROM r WHERE hit IS NOT NULL""")
def duplicate_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which blocks take in which, by title, by terms, or by concepts and terms."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise("").alias("title"))
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_suppkey") % 20).alias("terms"), F.collect_set(F.col("l_partkey") % 50).alias("concepts"))
    b = o.join(li, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("doc")).agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), "title", "terms", "concepts"))).alias("blocks"))
    return b.select("doc", F.explode(P.duplicate_plan(F.col("blocks"))).alias("p")).select("doc", "p.keep", "p.absorb", "p.reason")


@BOOK.query("""
WITH a AS (SELECT l_partkey, bool_or(l_returnflag = 'R') AS correct FROM lineitem WHERE l_quantity > 25 GROUP BY l_partkey)
SELECT CASE WHEN a.l_partkey IS NULL THEN 0.5 WHEN correct THEN 0.2 ELSE 0.9 END::DOUBLE AS weight, count(*) AS concepts, count(*) FILTER (correct) AS known FROM part LEFT JOIN a ON l_partkey = p_partkey GROUP BY 1""")
def mastery_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much a pack should dwell on each concept, by what an assessment told."""
    a = table(spark, sf_dir, "lineitem").where("l_quantity > 25").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("correct"))
    p = table(spark, sf_dir, "part").select("p_partkey").join(a, "p_partkey", "left")
    return p.groupBy(P.mastery_weight(F.col("correct").isNotNull(), F.col("correct")).alias("weight")).agg(F.count("*").alias("concepts"), F.count_if(F.coalesce("correct", F.lit(False))).alias("known"))


@BOOK.query("""
WITH s AS (SELECT p_brand AS block, list(p_name ORDER BY p_partkey) FILTER (p_size > 45) AS found, list(p_type ORDER BY p_partkey) FILTER (p_size < 3 AND p_partkey % 2 = 0) AS edited, count(*) FILTER (p_size = 1) > 2 AS was FROM part GROUP BY p_brand)
SELECT block, array_to_string(list_filter(coalesce(CASE WHEN was THEN edited ELSE found END, []), lambda x: length(x) BETWEEN 3 AND 80)[1:8], ';') AS gaps FROM s""")
def gap_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps found for each block, replaced where a user edited them."""
    p, k = table(spark, sf_dir, "part"), F.col("p_size")
    of = lambda cond, c: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("p_partkey", c)))), lambda x: x[c])
    g = p.groupBy(F.col("p_brand").alias("block")).agg(of(k > 45, "p_name").alias("found"), of((k < 3) & (F.col("p_partkey") % 2 == 0), "p_type").alias("edited"), (F.count_if(k == 1) > 2).alias("was"))
    return g.select("block", F.array_join(P.merged_gaps(F.col("found"), F.col("edited"), F.col("was")), ";").alias("gaps"))


@BOOK.query("""
WITH q AS (SELECT l_linenumber * 2 AS t, (l_quantity % 9)::INT AS s, (l_quantity % 31)::INT AS g, (l_returnflag = 'A')::INT AS r FROM lineitem),
x AS (SELECT *, g <= greatest(0, t + s - r) AS ok, least(23, g + r) AS total, least(15, greatest(t, ceil(least(23, g + r) * 0.6)::INT)) AS f FROM q)
SELECT t, s, g, r, (CASE WHEN ok THEN t WHEN total - f > 8 THEN total - 8 WHEN total < f THEN total ELSE f END)::INT AS test, (CASE WHEN ok THEN s ELSE least(8, greatest(0, total - f)) END)::INT AS socratic, count(*) AS n FROM x GROUP BY ALL""")
def question_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question counts raised to cover the gaps of a block."""
    q = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") * 2).alias("t"), F.rint(F.col("l_quantity") % 9).cast("int").alias("s"), F.rint(F.col("l_quantity") % 31).cast("int").alias("g"), (F.col("l_returnflag") == "A").cast("int").alias("r"))
    test, socratic = P.question_budget(F.col("t"), F.col("s"), F.col("g"), F.col("r"))
    return q.groupBy("t", "s", "g", "r", test.alias("test"), socratic.alias("socratic")).agg(F.count("*").alias("n"))


@BOOK.query("""
SELECT l_orderkey, l_linenumber, l_suppkey, chr(65 + (l_quantity::INT % 4)) AS letter, chr(65 + (l_partkey % 4)::INT) AS correct FROM lineitem WHERE l_returnflag <> 'N' AND l_quantity::INT % 4 <> l_partkey % 4""")
def missed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answered questions whose letter isn't the right one, over all blocks."""
    letter = lambda x: F.char(F.lit(65) + x)
    li = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").select("l_orderkey", "l_linenumber", "l_suppkey", letter(F.col("l_quantity").cast("int") % 4).alias("letter"), letter(F.col("l_partkey") % 4).alias("correct"))
    return li.where("letter <> correct")


@BOOK.query("""
WITH v AS (SELECT l_orderkey AS doc, l_linenumber AS id, l_quantity >= 2 AS ok, l_partkey AS title, l_quantity AS q FROM lineitem)
SELECT doc, bool_and(ok) AS strict_ok, count(*) FILTER (ok) AS lenient, array_to_string(list(title ORDER BY id, title) FILTER (ok), ',') AS titles, CASE WHEN count(*) FILTER (ok) >= 3 THEN 3 END AS coerced FROM v GROUP BY doc""")
def normalised_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block lists checked: one bad row rejects a list in strict mode and is dropped in lenient mode; cut to three."""
    ok = F.col("l_quantity") >= 2
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.bool_and(ok).alias("strict_ok"), F.count_if(ok).alias("lenient"), F.array_sort(F.collect_list(F.when(ok, F.struct("l_linenumber", "l_partkey")))).alias("rows"))
    titles = F.array_join(F.transform("rows", lambda r: r["l_partkey"].cast("string")), ",")
    return g.select("doc", "strict_ok", "lenient", F.nullif(titles, F.lit("")).alias("titles"), F.when(F.col("lenient") >= 3, 3).alias("coerced"))


@BOOK.query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
SELECT doc_id, pos::BIGINT AS pos, regexp_extract(line, '^\\s*(?:[0-9]+[.)]|[-*])?\\s*(.{1,40}?)\\s*(?:[:–—]|\\. )', 1) AS title FROM l WHERE regexp_extract(line, '^\\s*(?:[0-9]+[.)]|[-*])?\\s*(.{1,40}?)\\s*(?:[:–—]|\\. )', 1) <> ''""")
def planned_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles in a block plan written as lines, numbered or not: what stands before a colon, dash or full stop."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    title = F.regexp_extract("line", "^\\s*(?:[0-9]+[.)]|[-*])?\\s*(.{1,40}?)\\s*(?:[:–—]|\\. )", 1)
    return lines.select("doc_id", (F.col("at") + 1).cast("long").alias("pos"), title.alias("title")).where("title <> ''")


@BOOK.query("""
WITH n AS (SELECT max(o_orderdate) AS now FROM orders)
SELECT o_orderstatus = 'F' AND o_totalprice > 1000 AS valid, o_totalprice >= 100000 AS enough, o_orderstatus = 'O' AND o_orderdate < now - INTERVAL 10 DAY AS stuck, count(*) AS n FROM orders, n GROUP BY ALL""")
def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventories that are valid and large enough, and runs that hang."""
    o = table(spark, sf_dir, "orders")
    o = o.crossJoin(F.broadcast(o.agg((F.max("o_orderdate") - F.expr("INTERVAL 10 DAY")).alias("since"))))
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    return o.groupBy(((status == "F") & (price > 1000)).alias("valid"), (price >= 100000).alias("enough"), ((status == "O") & (F.col("o_orderdate") < F.col("since"))).alias("stuck")).agg(F.count("*").alias("n"))


@BOOK.query("""
SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 4 = 0 THEN o_custkey END, CASE WHEN o_orderkey % 4 = 1 THEN c.c_nationkey END, CASE WHEN o_orderkey % 4 = 2 THEN b.p END, -1)::BIGINT AS concept
FROM orders LEFT JOIN customer c ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS p FROM lineitem GROUP BY l_orderkey) b ON l_orderkey = o_orderkey""")
def item_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The concept of a review item: its own, by its source, or by its block; -1 for none."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 4
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_partkey").alias("p"))
    j = o.join(c, "o_custkey", "left").join(b, "o_orderkey", "left")
    return j.select("o_orderkey", F.coalesce(F.when(k == 0, F.col("o_custkey")), F.when(k == 1, F.col("c_nationkey")), F.when(k == 2, F.col("p")), F.lit(-1)).cast("long").alias("concept"))


@BOOK.query("""
SELECT p_partkey, lower(p_name) AS label, p_size > 30 AS seen FROM part WHERE contains(lower(p_name), 'ring') AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) ORDER BY p_size <= 30, lower(p_name), p_partkey LIMIT 12""")
def concept_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve best hits of a search box: not attached yet, seen ones first, then by name."""
    p = table(spark, sf_dir, "part").where(F.contains(F.lower("p_name"), F.lit("ring")))
    attached = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    rows = p.join(attached, "p_partkey", "left_anti").select("p_partkey", F.lower("p_name").alias("label"), (F.col("p_size") > 30).alias("seen"))
    return rows.orderBy(F.desc("seen"), "label", "p_partkey").limit(12)


@BOOK.query("""
WITH t AS (SELECT lower(p_name) AS term, p_partkey AS id, 0 AS rank FROM part WHERE p_size > 40 UNION ALL SELECT lower(p_name), p_partkey, 1 FROM part WHERE p_size < 10)
SELECT term, arg_min(id, (rank, id)) AS id, min(rank)::INT AS rank FROM t GROUP BY term""")
def term_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms by name in any case: those of the session before those of the first phase."""
    p = table(spark, sf_dir, "part")
    side = lambda cond, r: p.where(cond).select(F.lower("p_name").alias("term"), F.col("p_partkey").alias("id"), F.lit(r).alias("rank"))
    return first_by_key(side("p_size > 40", 0).unionByName(side("p_size < 10", 1)), ["term"], ["rank", "id"])


@BOOK.query("""
SELECT CASE WHEN p_size % 3 = 0 THEN 'brief_deep' WHEN p_size % 3 = 1 THEN 'relational_compressed' END AS profile, sum(CASE WHEN p_size % 3 < 2 THEN 1 ELSE 0 END)::BIGINT AS focused, count(*) AS blocks FROM part GROUP BY 1""")
def block_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learning goals as explanation profiles, and how many blocks get a focus from them."""
    k = F.col("p_size") % 3
    goal = F.when(k == 0, "prerequisite_review").when(k == 1, "relational").otherwise("new")
    profile = F.when(F.lit(False), "")
    for name, value in P.PROFILES.items():
        profile = profile.when(goal == name, value)
    return table(spark, sf_dir, "part").groupBy(profile.alias("profile")).agg(F.sum(F.when(profile.isNotNull(), 1).otherwise(0)).alias("focused"), F.count("*").alias("blocks"))


@BOOK.query("""
WITH f AS (SELECT doc_id, concat_ws('|', source, lang, n_chars, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+'))) AS print FROM documents)
SELECT a.doc_id, a.print AS fingerprint, b.doc_id IS NOT NULL AS valid FROM f a LEFT JOIN f b ON b.doc_id = a.doc_id - 1 AND b.print = a.print""")
def split_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cached split depends on, and whether the cache of the document before is still valid."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("|", "source", "lang", F.col("n_chars").cast("string"), word_count(F.col("text")).cast("string")).alias("fingerprint"))
    b = d.select((F.col("doc_id") + 1).alias("next"), F.col("fingerprint").alias("cached"))
    j = d.join(b, (d["doc_id"] == b["next"]) & (d["fingerprint"] == b["cached"]), "left")
    return j.select("doc_id", "fingerprint", F.col("next").isNotNull().alias("valid"))


@BOOK.query("""
WITH v AS (SELECT p_partkey AS id, p_name AS label, 0 AS slot FROM part WHERE p_size < 20 UNION ALL SELECT l_partkey, l_returnflag, 1 FROM lineitem WHERE l_quantity > 48 UNION ALL SELECT s_suppkey, s_name, 2 FROM supplier)
SELECT id, arg_min(label, (slot, label)) AS label, count(DISTINCT slot) AS slots FROM v GROUP BY id""")
def legacy_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts of an old layout gathered from its slots, the first slot's label kept."""
    p, li, s = (table(spark, sf_dir, x) for x in ("part", "lineitem", "supplier"))
    row = lambda df, i, label, slot: df.select(F.col(i).alias("id"), F.col(label).alias("label"), F.lit(slot).alias("slot"))
    v = row(p.where("p_size < 20"), "p_partkey", "p_name", 0).unionByName(row(li.where("l_quantity > 48"), "l_partkey", "l_returnflag", 1)).unionByName(row(s, "s_suppkey", "s_name", 2))
    return v.groupBy("id").agg(F.min_by("label", F.struct("slot", "label")).alias("label"), F.count_distinct("slot").alias("slots"))


@BOOK.query("""
SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size <= 40, p_partkey) AS place FROM part""")
def threshold_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks renumbered with those of threshold concepts in front, the order kept otherwise."""
    return rank_in_key(table(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.col("p_size") <= 40).alias("late")), "p_brand", [F.col("late"), F.col("p_partkey")], "place").select("p_brand", "p_partkey", "place")


@BOOK.query("""
WITH o AS (SELECT o_custkey, list(o_orderpriority IN ('1-URGENT', '5-LOW') ORDER BY o_orderkey) AS skip FROM orders GROUP BY o_custkey)
SELECT o_custkey, coalesce(list_min(list_filter(range(2, len(skip)), lambda i: NOT skip[i + 1])), greatest(len(skip), 2))::INT AS next FROM o""")
def next_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block to study after the second one, passing over those out of sequence."""
    skip = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"].isin("1-URGENT", "5-LOW"))
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(skip.alias("skip"))
    return o.select("o_custkey", P.next_block(F.lit(1), F.col("skip")).alias("next"))


@BOOK.query("""
WITH d AS (SELECT user_id, list(DISTINCT event_type) FILTER (value > 60) AS done FROM events GROUP BY user_id), f AS (SELECT ['signup', 'view', 'click', 'purchase', 'error'] AS flow)
SELECT user_id, coalesce(list_min(list_filter(range(5), lambda i: NOT list_contains(coalesce(done, []), flow[i + 1]))), 5)::INT AS step FROM d, f""")
def flow_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first step of the flow that a user hasn't completed."""
    flow = F.array(*(F.lit(x) for x in "signup view click purchase error".split()))
    d = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 60, F.col("event_type"))).alias("done"))
    return d.select("user_id", P.first_open(flow, F.col("done")).alias("step"))


@BOOK.query("SELECT user_id, event_id FROM events WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 20")
def coverage_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last twenty entries of each coverage list."""
    return keep_last(table(spark, sf_dir, "events").where("event_type = 'view'").select("user_id", "event_id"), ["user_id"], ["event_id"], 20)


@BOOK.query("""
WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS pages FROM documents)
SELECT doc_id, block, (block * len(pages) // 3)::BIGINT AS first_page, array_to_string(pages[block * len(pages) // 3 + 1:greatest((block + 1) * len(pages) // 3, block * len(pages) // 3 + 1)], chr(10)) AS slice FROM p, unnest(range(3)) AS b(block)""")
def page_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each block's pages, in proportion; a line stands for a page."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("pages"), F.explode(F.array(*(F.lit(k).cast("long") for k in range(3)))).alias("block"))
    at = lambda k: F.floor(k * F.size("pages") / 3)
    lo = at(F.col("block"))
    n = F.greatest(at(F.col("block") + 1) - lo, F.lit(1))
    return d.select("doc_id", "block", lo.cast("long").alias("first_page"), F.array_join(F.slice("pages", (lo + 1).cast("int"), n.cast("int")), "\n").alias("slice"))

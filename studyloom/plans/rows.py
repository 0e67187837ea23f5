"""Queries that bring rows of foreign origin into one form, filter them, and read damaged JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studyloom.operators import normalise as N
from studyloom.operators import tables
from studyloom.operators.identity import substring_pairs
from studyloom.operators.review import first_by_key
from studyloom.plans.identity import EDGES_SQL, sequence_edges
from studyloom.plans.registry import Book
from studyloom.session import table

BOOK = Book()


@BOOK.query("""
WITH r AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'cloze_item' END AS given, CASE l_linenumber % 4 WHEN 1 THEN 'rsvp' WHEN 2 THEN 'vault' WHEN 3 THEN 'gap_fill' END AS legacy, CASE WHEN l_quantity > 5 THEN l_suppkey::VARCHAR END AS doc, l_partkey, l_discount FROM lineitem),
s AS (SELECT *, CASE WHEN given IS NOT NULL THEN given WHEN legacy = 'rsvp' THEN 'rsvp_block' WHEN legacy = 'vault' THEN 'vault_concept' END AS type, CASE legacy WHEN 'vault' THEN 'vault_curation' WHEN 'gap_fill' THEN 'gap_fill' ELSE 'document' END AS provenance, greatest(1.3, least(5, l_discount * 40)) AS ease FROM r)
SELECT type, provenance, count(*) AS n, round(sum(ease), 4) AS ease, count(DISTINCT type || ':' || l_partkey) AS ids FROM s WHERE type IS NOT NULL AND doc IS NOT NULL GROUP BY ALL""")
def normal_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review items of old and new versions in one form; those without a source or a document go."""
    k = F.col("l_linenumber") % 4
    given, legacy = F.when(k == 0, "cloze_item"), F.when(k == 1, "rsvp").when(k == 2, " vault ").when(k == 3, "gap_fill")
    r = table(spark, sf_dir, "lineitem").select(N.source_type(given, legacy).alias("type"), N.provenance(F.lit(None).cast("string"), legacy).alias("provenance"), N.text_of(F.when(F.col("l_quantity") > 5, F.col("l_suppkey"))).alias("doc"), N.clamped(F.col("l_discount") * 40, 1.3, 5.0, 2.5).alias("ease"), "l_partkey")
    kept = r.where("type is not null and doc is not null").withColumn("id", F.concat_ws(":", "type", "l_partkey"))
    return kept.groupBy("type", "provenance").agg(F.count("*").alias("n"), F.round(F.sum("ease"), 4).alias("ease"), F.count_distinct("id").alias("ids"))


@BOOK.query("""
WITH r AS (SELECT l_partkey % 50 AS s, l_suppkey % 50 AS t, greatest(0.05, least(1, CASE WHEN l_tax > 0 THEN l_discount * 15 ELSE 0.3 END)) AS w, l_orderkey * 10 + l_linenumber AS o, l_quantity FROM lineitem)
SELECT s::VARCHAR AS source, t::VARCHAR AS target, round(arg_min(w, o * 100000 + l_quantity), 6) AS weight FROM r WHERE s <> t GROUP BY ALL""")
def normal_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections with clamped weights, the first of each ordered pair, without loops."""
    r = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("s"), (F.col("l_suppkey") % 50).alias("t"), F.when(F.col("l_tax") > 0, F.col("l_discount") * 15).alias("w"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_quantity")).alias("o"))
    return N.normal_connections(r, "s", "t", "w", "o").withColumn("weight", F.round("weight", 6))


@BOOK.query("""
WITH n AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i, CASE WHEN p_size % 7 = 0 THEN '' ELSE p_name END AS text, CASE WHEN p_type IN ('PROMO', 'LARGE') THEN p_type ELSE 'CONCEPT' END AS type, greatest(1, least(5, p_size // 8)) AS importance FROM part)
SELECT p_brand, 'node_' || lpad(i::VARCHAR, 3, '0') AS id, text, type, importance::INT AS importance, importance >= 3 AS candidate FROM n WHERE text <> ''""")
def normal_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with ids by place, known types, importance from 1 to 5; those without a text go, important ones are candidates."""
    p = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name", "p_type", "p_size"))).alias("ns"))
    n = p.select("p_brand", F.posexplode("ns").alias("i", "n"))
    importance = N.clamped(F.floor(F.col("n.p_size") / 8), 1.0, 5.0, 3.0).cast("int")
    kind = F.when(F.col("n.p_type").isin("PROMO", "LARGE"), F.col("n.p_type")).otherwise("CONCEPT")
    text = N.text_of(F.when(F.col("n.p_size") % 7 == 0, "  ").otherwise(F.col("n.p_name")))
    out = n.select("p_brand", F.concat(F.lit("node_"), F.lpad((F.col("i") + 1).cast("string"), 3, "0")).alias("id"), text.alias("text"), kind.alias("type"), importance.alias("importance"))
    return out.where("text is not null").withColumn("candidate", F.col("importance") >= 3)


@BOOK.query("""
WITH o AS (SELECT l_orderkey, list(l_returnflag = 'R' ORDER BY l_linenumber, l_partkey, l_suppkey)[1:4] AS right_, count(*) AS n, max(l_quantity) > 20 AS blank FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, blank AND n >= 4 AND len(list_filter(right_, lambda x: x)) = 1 AS valid FROM o""")
def cloze_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cloze items that can be asked: a blank, four options, one of them right."""
    rows = F.slice(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", (F.col("l_returnflag") == "R").alias("right")))), F.lit(1), F.lit(4))
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(rows.alias("options"), (F.max("l_quantity") > 20).alias("blank"))
    valid = F.col("blank") & (F.size("options") == 4) & (F.size(F.filter("options", lambda x: x["right"])) == 1)
    return o.select("l_orderkey", valid.alias("valid"))


@BOOK.query(f"WITH {EDGES_SQL}, n AS (SELECT p_partkey AS k FROM part WHERE p_size > 15) SELECT src, count(*) AS kept FROM e WHERE src <> dst AND src IN (SELECT k FROM n) AND dst IN (SELECT k FROM n) GROUP BY src")
def inner_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations whose ends are both in the inventory, counted."""
    nodes = table(spark, sf_dir, "part").where("p_size > 15").select(F.col("p_partkey").alias("node"))
    return N.with_both_ends(sequence_edges(spark, sf_dir), nodes).groupBy("src").agg(F.count("*").alias("kept"))


@BOOK.query("""
WITH t AS (SELECT l_partkey AS id FROM lineitem WHERE l_quantity > 45 UNION SELECT l_suppkey FROM lineitem WHERE l_tax > 0.07 UNION SELECT p_partkey FROM part WHERE p_size = 50 UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT id FROM t)""")
def studied_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts touched in one of four places: blocks, signals, items, questions."""
    p, li, o = (table(spark, sf_dir, x) for x in ("part", "lineitem", "orders"))
    ids = li.where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")).unionByName(li.where("l_tax > 0.07").select(F.col("l_suppkey").alias("p_partkey")))
    ids = ids.unionByName(p.where("p_size = 50").select("p_partkey")).unionByName(o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("p_partkey")))
    return p.select("p_partkey", "p_name").join(ids.distinct(), "p_partkey", "left_semi")


@BOOK.query("SELECT l_orderkey, l_partkey FROM lineitem l WHERE l_returnflag = 'N' AND NOT EXISTS (SELECT 1 FROM lineitem s WHERE s.l_returnflag = 'A' AND s.l_suppkey = l.l_suppkey AND s.l_partkey = l.l_partkey)")
def unsourced_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts that the vault doesn't have from this document yet."""
    li = table(spark, sf_dir, "lineitem")
    known = li.where("l_returnflag = 'A'").select("l_suppkey", "l_partkey")
    return li.where("l_returnflag = 'N'").join(known, ["l_suppkey", "l_partkey"], "left_anti").select("l_orderkey", "l_partkey")


@BOOK.query("""
WITH t AS (SELECT DISTINCT lower(p_type) AS t FROM part UNION SELECT 'ring'), n AS (SELECT p_name, count(*) AS n FROM part GROUP BY p_name)
SELECT t AS topic, count(*) AS names, sum(n)::BIGINT AS parts FROM t JOIN n ON contains(lower(p_name), t) OR contains(t, lower(p_name)) GROUP BY t""")
def topic_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that hold a topic or stand in one, in any case; the topics are as few as the kinds of parts."""
    p = table(spark, sf_dir, "part")
    topics = p.select(F.lower("p_type").alias("t")).unionByName(p.select(F.lit("ring").alias("t"))).distinct()
    names = p.groupBy("p_name").agg(F.count("*").alias("n"))
    held = substring_pairs(topics.select(F.col("t").alias("a"), F.col("t").alias("part")), names.select(F.col("p_name").alias("b"), F.lower("p_name").alias("whole")))
    holding = substring_pairs(names.select(F.col("p_name").alias("a"), F.lower("p_name").alias("part")), topics.select(F.col("t").alias("b"), F.col("t").alias("whole"))).select(F.col("b").alias("a"), F.col("a").alias("b"))
    pairs = held.unionByName(holding).distinct().join(names, F.col("b") == F.col("p_name"))
    return pairs.groupBy(F.col("a").alias("topic")).agg(F.count("*").alias("names"), F.sum("n").alias("parts"))


@BOOK.query("""
WITH e AS (SELECT l_partkey, list(DISTINCT CASE WHEN l_suppkey % 4 = 0 THEN 'misc' ELSE 'project' || l_suppkey % 10 END) AS projects FROM lineitem GROUP BY l_partkey)
SELECT p_brand, count(*) AS entries FROM e JOIN part ON p_partkey = l_partkey WHERE list_has_any(projects, ['project1', 'project7']) AND p_type IN ('PROMO', 'ECONOMY') GROUP BY p_brand""")
def project_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a topic that belong to one of the chosen projects."""
    project = F.when(F.col("l_suppkey") % 4 == 0, "misc").otherwise(F.concat(F.lit("project"), (F.col("l_suppkey") % 10).cast("string")))
    e = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.collect_set(project).alias("projects"))
    chosen = e.where(F.arrays_overlap("projects", F.array(F.lit("project1"), F.lit("project7"))))
    return chosen.join(table(spark, sf_dir, "part").where(F.col("p_type").isin("PROMO", "ECONOMY")), "p_partkey").groupBy("p_brand").agg(F.count("*").alias("entries"))


@BOOK.query("""
WITH i AS (SELECT l_orderkey, bool_and(l_returnflag <> 'R' OR l_quantity > 10) AS may FROM lineitem GROUP BY l_orderkey)
SELECT may, count(*) AS items FROM i GROUP BY may""")
def comprehension_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that may be scheduled: none of their conceptual concepts is unconfirmed."""
    i = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_and((F.col("l_returnflag") != "R") | (F.col("l_quantity") > 10)).alias("may"))
    return i.groupBy("may").agg(F.count("*").alias("items"))


@BOOK.query(f"WITH {EDGES_SQL}, x AS (SELECT src AS k FROM e WHERE src <> dst AND w > 0.09 UNION SELECT dst FROM e WHERE src <> dst AND w > 0.09) SELECT p_partkey AS node, p_type AS layer FROM part WHERE p_partkey IN (SELECT k FROM x) OR p_type = 'PROMO'")
def pruned_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with an edge, and those of the user's own layer."""
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_type").alias("layer"))
    return N.without_orphans(nodes, sequence_edges(spark, sf_dir).where("weight > 0.09"), F.col("layer") == "PROMO")


@BOOK.query("SELECT c_custkey, c_acctbal / 100 AS lat, c_nationkey * 5.0::DOUBLE AS lng FROM customer WHERE c_mktsegment = 'BUILDING' AND abs(c_acctbal / 100) <= 90")
def map_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with a resolved place on the globe."""
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", (F.col("c_acctbal") / 100).alias("lat"), (F.col("c_nationkey") * 5.0).alias("lng"))
    return c.where(F.abs("lat") <= 90)


@BOOK.query("SELECT r_name AS role, count(*) AS modes, min(n_name) AS first FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def modes_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small dimension table looked up by role."""
    j = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy(F.col("r_name").alias("role")).agg(F.count("*").alias("modes"), F.min("n_name").alias("first"))


@BOOK.query("""
WITH d AS (SELECT doc_id, length(text) AS n FROM documents), c AS (SELECT doc_id, n, [{'s': n // 5, 'e': 2 * n // 5}, {'s': n // 2, 'e': 3 * n // 4}] AS cs FROM d),
g AS (SELECT doc_id, 0::BIGINT AS s, n // 5 AS e FROM c UNION ALL SELECT doc_id, 2 * n // 5, n // 2 FROM c UNION ALL SELECT doc_id, 3 * n // 4, n FROM c)
SELECT g.doc_id, count(*) AS spans, sum(e - s)::BIGINT AS chars, md5(string_agg(text[s + 1:e], chr(10) || chr(10) ORDER BY s)) AS scoped FROM g JOIN documents USING (doc_id) WHERE e > s GROUP BY g.doc_id""")
def own_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of a section that its children don't hold, sliced and joined."""
    n = F.length("text").cast("long")
    part = lambda a, b: F.floor(n * a / F.lit(b)).cast("long")
    child = lambda s, e: F.struct(s.alias("start"), e.alias("end"))
    spans = N.own_spans(F.array(child(part(1, 2), part(3, 4)), child(part(1, 5), part(2, 5))), F.lit(0).cast("long"), n)
    d = table(spark, sf_dir, "documents").select("doc_id", "text", spans.alias("ss")).where(F.size("ss") > 0)
    slices = F.transform("ss", lambda s: F.substring("text", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    chars = F.aggregate("ss", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return d.select("doc_id", F.size("ss").cast("long").alias("spans"), chars.alias("chars"), F.md5(F.array_join(slices, "\n\n")).alias("scoped"))


@BOOK.query("SELECT l_orderkey, max(l_linenumber) - min(l_linenumber) + 1 = count(DISTINCT l_linenumber) AS contiguous FROM lineitem WHERE l_quantity > 10 GROUP BY l_orderkey")
def contiguous_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the selected sections follow each other without a gap."""
    g = table(spark, sf_dir, "lineitem").where("l_quantity > 10").groupBy("l_orderkey")
    return g.agg(((F.max("l_linenumber") - F.min("l_linenumber") + 1) == F.count_distinct("l_linenumber")).alias("contiguous"))


@BOOK.query(f"""
WITH {EDGES_SQL}, n AS (SELECT p_partkey AS k, CASE WHEN p_partkey = 5 THEN 'renamed' ELSE p_name END AS title FROM part WHERE p_size < 40 UNION ALL SELECT -1, 'added'),
x AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst AND NOT (src = 5 AND dst % 2 = 0) UNION SELECT -1, 5)
SELECT count(*) FILTER (src IN (SELECT k FROM n) AND dst IN (SELECT k FROM n)) AS kept, count(*) FILTER (NOT (src IN (SELECT k FROM n) AND dst IN (SELECT k FROM n))) AS dangling, (SELECT count(*) FROM n) AS concepts, (SELECT count(*) FROM n WHERE title = 'renamed') AS renamed FROM x""")
def edited_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot after a rename, an addition, deletions and edits of edges, with the check for dangling ends."""
    p = table(spark, sf_dir, "part")
    nodes = p.where("p_size < 40").select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") == 5, "renamed").otherwise(F.col("p_name")).alias("title"))
    nodes = nodes.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("node"), F.lit("added").alias("title")))
    e = sequence_edges(spark, sf_dir).where("not (src = 5 and dst % 2 = 0)").select("src", "dst").unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("src"), F.lit(5).cast("long").alias("dst"))).distinct()
    kept, gone = N.with_both_ends(e, nodes).agg(F.count("*").alias("kept")), N.dangling(e, nodes).agg(F.count("*").alias("dangling"))
    counted = nodes.agg(F.count("*").alias("concepts"), F.count_if(F.col("title") == "renamed").alias("renamed"))
    return kept.crossJoin(gone).crossJoin(counted)


@BOOK.query("""
WITH r AS (SELECT l_linenumber % 6 AS form, l_partkey % 4 AS k FROM lineitem)
SELECT form, k, CASE form WHEN 0 THEN chr(65 + k::INT) WHEN 1 THEN chr(65 + k::INT) WHEN 2 THEN 'D' WHEN 3 THEN chr(65 + k::INT) WHEN 4 THEN 'E' ELSE 'neither' END AS letter, count(*) AS n FROM r GROUP BY ALL""")
def option_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in many forms as letters: a letter, a number from 0, 4, the text of an option, or neither."""
    options = F.array(*(F.lit(x) for x in ("Red", "green ", "Blue", "none")))
    form, k = F.col("l_linenumber") % 6, F.col("l_partkey") % 4
    answer = F.when(form == 0, F.lower(F.char(65 + k))).when(form == 1, k.cast("string")).when(form == 2, "4").when(form == 3, F.upper(F.get(options, k.cast("int")))).when(form == 4, "E").otherwise(" neither ")
    r = table(spark, sf_dir, "lineitem").select(form.alias("form"), k.alias("k"), N.option_letter(answer, options).alias("letter"))
    return r.groupBy("form", "k", "letter").agg(F.count("*").alias("n"))


@BOOK.query("""
WITH o AS (SELECT o_orderkey, o_orderkey % 4 AS r FROM orders) SELECT o_orderkey, array_to_string(list_transform([0, 1, 2, 3], lambda i: chr(65 + ((i + 4 - r) % 4)::INT)), '') AS letters FROM o""")
def shuffled_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of the letters when options were moved round by a number that the row decides."""
    before = F.array(*(F.lit(x) for x in "wxyz"))
    r = (F.col("o_orderkey") % 4).cast("int")
    after = F.concat(F.slice(before, r + 1, 4 - r), F.slice(before, F.lit(1), r))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(N.letter_map(before, after), "").alias("letters"))


@BOOK.query("""
WITH t AS (SELECT p_partkey, p_size % 4 AS form, p_size // 10 AS k FROM part)
SELECT p_partkey, form = 3 AND 24 + 27 * k + 200 > 200 AS truncated, CASE WHEN form = 2 THEN 0 ELSE k END::BIGINT AS objects, CASE WHEN form = 0 THEN k END::BIGINT AS unwrapped FROM t""")
def damaged_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as JSON, whole, fenced or broken off: whether it was cut, the whole objects, and the array in it."""
    k = F.floor(F.col("p_size") / 10).cast("int")
    body = F.array_join(F.array_repeat(F.lit('{"id": 1, "t": "a}\\"b{"}'), k), ", ")
    form = F.col("p_size") % 4
    whole = F.concat(F.lit('{"concepts": ['), body, F.lit('], "data": ['), body, F.lit("]}"))
    text = F.when(form == 0, whole).when(form == 1, F.concat(F.lit("```json\n"), F.replace(whole, F.lit('"data"'), F.lit('"other"')), F.lit("\n```"))).when(form == 2, "no answer")
    text = text.otherwise(F.concat(F.lit('{"concepts": ['), body, F.when(k > 0, ", ").otherwise(""), F.lit('{"id": 2, "t": "'), F.expr("repeat('x', 210)")))
    d = N.recovered_objects(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "text", "concepts")
    array = F.when(F.col("text").startswith("{"), N.unwrapped(F.col("text")))
    return d.select("p_partkey", N.is_truncated_json(F.col("text")).alias("truncated"), F.size("objects").cast("long").alias("objects"), F.json_array_length(array).cast("long").alias("unwrapped"))


@BOOK.query("""
WITH p AS (SELECT p_brand, p_type, list(p_name ORDER BY p_partkey) AS cs FROM part GROUP BY ALL), q AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_type) - 1 AS i FROM p),
u AS (SELECT p_brand, i, unnest(cs) AS label, generate_subscripts(cs, 1) - 1 AS j FROM q)
SELECT p_brand, 'p' || i || 'c' || j AS id, label FROM u""")
def flattened_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial inventories as rows with ids made of the partial's and the concept's place."""
    p = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"]).alias("cs"))
    q = p.groupBy("p_brand").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_type", "cs"))), lambda x: x["cs"]).alias("ps"))
    u = q.select("p_brand", F.posexplode("ps").alias("i", "cs")).select("p_brand", "i", F.posexplode("cs").alias("j", "label"))
    return u.select("p_brand", F.format_string("p%dc%d", "i", "j").alias("id"), "label")


@BOOK.query("""
WITH s AS (SELECT l_orderkey, l_linenumber * 10 AS s, l_linenumber * 10 + (l_quantity % 14)::INT AS e FROM lineitem), o AS (SELECT *, lag(e) OVER (PARTITION BY l_orderkey ORDER BY s, e) AS before FROM s)
SELECT l_orderkey, bool_and(e > s AND (before IS NULL OR s >= before)) AS ordered, min(s) <= 10 AND max(e) >= 60 AS covers, count(*) AS sections FROM o GROUP BY l_orderkey""")
def tree_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sibling sections checked: none empty, none overlapping, and whether they cover the text."""
    start = F.col("l_linenumber") * 10
    s = table(spark, sf_dir, "lineitem").select("l_orderkey", start.alias("s"), (start + F.rint(F.col("l_quantity") % 14).cast("int")).alias("e"))
    o = s.withColumn("before", F.lag("e").over(Window.partitionBy("l_orderkey").orderBy("s", "e")))
    good = (F.col("e") > F.col("s")) & (F.col("before").isNull() | (F.col("s") >= F.col("before")))
    return o.groupBy("l_orderkey").agg(F.bool_and(good).alias("ordered"), ((F.min("s") <= 10) & (F.max("e") >= 60)).alias("covers"), F.count("*").alias("sections"))


@BOOK.query("""
SELECT p_partkey, sha256(p_name || CASE WHEN p_size % 5 = 0 THEN '' ELSE '. ' || p_type || ' ' || p_brand END) AS embed_key, p_name || ' (' || p_brand || ')' AS shown FROM part""")
def embed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands for a concept in an embedding: its label and, where there is one, its definition."""
    definition = F.when(F.col("p_size") % 5 != 0, F.concat_ws(" ", "p_type", "p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", F.sha2(F.concat_ws(". ", "p_name", definition), 256).alias("embed_key"), F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")")).alias("shown"))


@BOOK.query("""
WITH q AS (SELECT l_orderkey AS block, l_linenumber AS q, l_partkey AS concept, l_returnflag, l_quantity, l_shipdate FROM lineitem WHERE l_linestatus = 'F')
SELECT concept, count(*) FILTER (l_returnflag = 'R') AS wrong, count(*) FILTER (l_returnflag <> 'R') AS correct, max(l_shipdate) AS last FROM q GROUP BY concept""")
def extracted_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of concepts out of nested blocks with their questions and answers."""
    question = F.struct(F.col("l_partkey").alias("concept"), (F.col("l_returnflag") != "R").alias("ok"), F.col("l_shipdate").alias("at"), (F.col("l_linestatus") == "F").alias("answered"))
    blocks = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(question).alias("questions"))
    q = blocks.select(F.explode(F.filter("questions", lambda x: x["answered"])).alias("q")).select("q.*")
    return q.groupBy("concept").agg(F.count_if(~F.col("ok")).alias("wrong"), F.count_if("ok").alias("correct"), F.max("at").alias("last"))


@BOOK.query("""
SELECT source, count(*) AS n, round(sum(signal)::DOUBLE, 4) AS total FROM (
  SELECT 'mcq' AS source, CASE WHEN event_type = 'purchase' THEN 0.6 ELSE -0.3 END AS signal FROM events WHERE event_type IN ('purchase', 'error')
  UNION ALL SELECT 'review', CASE WHEN value > 100 THEN 1.0 WHEN value > 50 THEN 0.3 ELSE -0.5 END FROM events WHERE event_type = 'view'
  UNION ALL SELECT 'cloze', CASE WHEN l_returnflag = 'R' THEN -0.5 ELSE 1.0 END FROM lineitem WHERE l_tax > 0.06 UNION ALL SELECT 'socratic', CASE WHEN length(text) > 300 THEN 0.85 ELSE 0.2 END FROM conversations WHERE role = 'user') GROUP BY source""")
def collected_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations from four places in one table, each with what it adds to mastery."""
    e, li, c = (table(spark, sf_dir, x) for x in ("events", "lineitem", "conversations"))
    row = lambda df, name, signal: df.select(F.lit(name).alias("source"), signal.alias("signal"))
    kind, value = F.col("event_type"), F.col("value")
    every = row(e.where(kind.isin("purchase", "error")), "mcq", F.when(kind == "purchase", 0.6).otherwise(-0.3))
    every = every.unionByName(row(e.where(kind == "view"), "review", F.when(value > 100, 1.0).when(value > 50, 0.3).otherwise(-0.5)))
    every = every.unionByName(row(li.where("l_tax > 0.06"), "cloze", F.when(F.col("l_returnflag") == "R", -0.5).otherwise(1.0)))
    every = every.unionByName(row(c.where("role = 'user'"), "socratic", F.when(F.length("text") > 300, 0.85).otherwise(0.2)))
    return every.groupBy("source").agg(F.count("*").alias("n"), F.round(F.sum("signal"), 4).alias("total"))


@BOOK.query("""
WITH q AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ids FROM lineitem WHERE l_partkey % 3 > 0 GROUP BY l_orderkey)
SELECT l_orderkey, array_to_string(ids[1:3], ',') AS concepts FROM q""")
def recall_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with their first three valid concepts."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("cs"))
    kept = F.slice(F.filter(F.transform("cs", lambda c: c["l_partkey"]), lambda x: x % 3 > 0), F.lit(1), F.lit(3))
    return g.select("l_orderkey", F.array_join(F.transform(kept, lambda x: x.cast("string")), ",").alias("concepts")).where("concepts <> ''")


@BOOK.query("""
WITH t AS (SELECT l_partkey AS k, bool_or(l_returnflag = 'R') AS ok FROM lineitem WHERE l_quantity > 40 GROUP BY 1)
SELECT CASE WHEN t.k IS NOT NULL THEN 'tested' WHEN p_size > 45 THEN 'presumed known' ELSE 'inferred' END AS status, count(*) AS concepts, count(*) FILTER (ok) AS correct, count(*) FILTER (NOT ok) AS missed FROM part LEFT JOIN t ON k = p_partkey GROUP BY 1""")
def knowledge_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of each concept: tested before presumed before inferred, with the counts of a profile."""
    t = table(spark, sf_dir, "lineitem").where("l_quantity > 40").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("ok"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size").join(t, "p_partkey", "left")
    status = F.when(F.col("ok").isNotNull(), "tested").when(F.col("p_size") > 45, "presumed known").otherwise("inferred")
    return p.groupBy(status.alias("status")).agg(F.count("*").alias("concepts"), F.count_if(F.coalesce("ok", F.lit(False))).alias("correct"), F.count_if(~F.coalesce("ok", F.lit(True))).alias("missed"))


@BOOK.query("""
WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 20) QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) = 1)
SELECT l_partkey AS concept, l_orderkey, l_linenumber FROM q WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_orderkey < 100)""")
def coverage_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first test question of each concept of the inventory that isn't covered yet."""
    li = table(spark, sf_dir, "lineitem")
    inventory = table(spark, sf_dir, "part").where("p_size > 20").select(F.col("p_partkey").alias("concept"))
    q = li.select(F.col("l_partkey").alias("concept"), "l_orderkey", "l_linenumber", "l_suppkey").join(inventory, "concept", "left_semi")
    covered = li.where("l_orderkey < 100").select(F.col("l_partkey").alias("concept"))
    return first_by_key(q, ["concept"], ["l_orderkey", "l_linenumber", "l_suppkey"]).join(covered, "concept", "left_anti").select("concept", "l_orderkey", "l_linenumber")


@BOOK.query("""
SELECT c, count(*) AS responses, count(*) FILTER (right_) AS correct FROM (SELECT unnest([l_partkey, p_partkey + 1, l_suppkey]) AS c, l_returnflag <> 'R' AS right_ FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_tax > 0.05) GROUP BY c""")
def scored_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers joined with their items, fanned out to the concept and both ends of its edge."""
    li = table(spark, sf_dir, "lineitem").where("l_tax > 0.05").join(table(spark, sf_dir, "part").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    each = li.select(F.explode(F.array(F.col("l_partkey"), F.col("p_partkey") + 1, F.col("l_suppkey"))).alias("c"), (F.col("l_returnflag") != "R").alias("ok"))
    return each.groupBy("c").agg(F.count("*").alias("responses"), F.count_if("ok").alias("correct"))


@BOOK.query("SELECT coalesce(CASE WHEN p_size > 40 THEN 'factual' WHEN p_size > 20 THEN 'conceptual' END, 'conceptual') AS class, count(*) AS questions FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 5) p ON p_partkey = l_partkey GROUP BY 1")
def question_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each question by its concept; conceptual where the concept isn't known."""
    p = table(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_size") > 40, "factual").when(F.col("p_size") > 20, "conceptual").alias("class"))
    j = table(spark, sf_dir, "lineitem").select("l_partkey").join(p, "l_partkey", "left")
    return j.groupBy(F.coalesce("class", F.lit("conceptual")).alias("class")).agg(F.count("*").alias("questions"))


@BOOK.query("""
WITH c AS (SELECT conv_id, turn, role, trim(text) AS q, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '')[1:4] AS ws FROM conversations)
SELECT conv_id, CAST(place AS INT) AS place, CASE WHEN turn % 2 = 0 THEN 't' || turn ELSE 'item_' || place END AS item_id, array_to_string(ws, '|') AS options, coalesce(ws[1], '') AS correct, md5(q) AS question,
  CASE WHEN q = '' THEN 'no question' WHEN role = 'system' THEN 'type' WHEN len(ws) < 2 THEN 'options' WHEN role = 'assistant' AND turn % 3 = 0 THEN 'edge' END AS fault FROM c""")
def normal_assessment_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as assessment items in JSON, their first words as options; those of the system have another type, some of the assistant an edge with one end."""
    ws = F.slice(F.filter(F.split("text", "[ \\t\\n\\r\\f\\x0B]+"), lambda x: x != ""), 1, 4)
    edge = F.when((F.col("role") == "assistant") & (F.col("turn") % 3 == 0), F.struct(F.col("role").alias("from"), F.lit(" ").alias("to")))
    item = F.struct("turn", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("t"), F.col("turn").cast("string"))).alias("id"), F.concat(F.lit(" "), "text").alias("question"), F.when(F.col("role") == "system", "essay").when(F.col("role") == "user", " MCQ").alias("type"), ws.alias("options"), F.get(ws, F.lit(0)).alias("answer"), edge.alias("edge"))
    raw = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", item.alias("item")))).alias("t")).select("conv_id", F.to_json(F.struct(F.transform("t", lambda x: x["item"]).alias("items"))).alias("raw"))
    out = N.assessment_items(raw, "conv_id", "raw")
    return out.select("conv_id", "place", "item_id", F.array_join("options", "|").alias("options"), "correct", F.md5("question").alias("question"), "fault")


@BOOK.query("""
SELECT c_custkey, o.o_orderkey AS id, o.o_totalprice AS price FROM customer JOIN orders o ON 'P' || o.o_orderkey = 'P' || (c_custkey * 3) WHERE o.o_orderstatus = 'F'""")
def published_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs that customers ask for by code: orders, published when they are done."""
    packs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("code"), F.when(F.col("o_orderstatus") == "F", "published").otherwise("draft").alias("status"), F.col("o_totalprice").alias("price"))
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit(" P"), (F.col("c_custkey") * 3).cast("string"), F.lit(" ")).alias("code"))
    return tables.published_by_code(packs, asked).select("c_custkey", "id", "price")


@BOOK.query("""
SELECT user_id, arg_max(event_id, struct_pack(t := ts, e := event_id)) AS event_id FROM events WHERE user_id IN (SELECT o_custkey FROM orders) GROUP BY user_id""")
def cache_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest cached row for each key that orders ask for."""
    cache = table(spark, sf_dir, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("at"))
    keys = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"))
    return tables.cached_by_key(cache, keys, "user_id", "at").select("user_id", "event_id")


@BOOK.query("""
SELECT o_custkey, '[' || string_agg('{"o_orderkey":' || o_orderkey || ',"status":"' || o_orderstatus || '"}', ',' ORDER BY o_orderkey) || ']' AS json FROM orders GROUP BY o_custkey""")
def vault_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's store as JSON."""
    return tables.exported_json(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("status")), "o_custkey", "o_orderkey")


@BOOK.query("""
WITH c AS (SELECT p_partkey, trim(p_name) AS canonical, list_sort(list_distinct(list_filter([trim(' ' || p_name || ' '), trim(p_brand), '', trim(p_name), lower(p_type)], lambda x: x <> ''))) AS aliases,
  CASE WHEN p_size > 40 THEN 'green' WHEN p_size > 20 THEN 'yellow' WHEN p_size > 10 THEN 'red' END AS m, CASE WHEN p_partkey % 7 > 0 THEN p_retailprice / 1000 - 0.5 END AS v FROM part)
SELECT p_partkey, canonical, array_to_string(aliases, '|') AS aliases, CASE WHEN m = 'green' THEN m ELSE 'yellow' END AS maturity, round(greatest(0, least(1, coalesce(v, 0))), 6)::DOUBLE AS mastery FROM c""")
def normal_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts as the registry keeps them: aliases trimmed and each once, one of two maturities, mastery between 0 and 1."""
    p = table(spark, sf_dir, "part")
    aliases = F.array(F.concat(F.lit(" "), "p_name", F.lit(" ")), "p_brand", F.lit(" "), "p_name", F.lower("p_type"), F.lit(None))
    maturity = F.when(F.col("p_size") > 40, "green").when(F.col("p_size") > 20, "yellow").when(F.col("p_size") > 10, "red")
    mastery = F.when(F.col("p_partkey") % 7 > 0, F.col("p_retailprice") / 1000 - 0.5).cast("double")
    kept = F.when(maturity == "green", maturity).otherwise("yellow")
    return p.select("p_partkey", F.trim("p_name").alias("canonical"), F.array_join(F.array_sort(N.clean_array(aliases)), "|").alias("aliases"), kept.alias("maturity"), F.round(N.clamped(mastery, 0.0, 1.0, 0.0), 6).alias("mastery"))

"""Queries that resolve names to concepts, merge what is known of them, and relink.

Parts stand for concepts: p_name is a name, p_brand a topic, those with an even key the
registry, those with an odd one what comes in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studyloom.operators import graph, identity, joins
from studyloom.plans.registry import Book
from studyloom.session import spread, table

BOOK = Book()
NAMES_SQL = """reg AS (SELECT p_name AS canonical, min(p_partkey) AS id, list_sort(list(DISTINCT lower(p_type) || ' ' || p_name)) AS aliases FROM part WHERE p_partkey % 2 = 0 GROUP BY p_name),
inc AS (SELECT name, min(description) AS description FROM (SELECT CASE WHEN p_partkey % 4 = 1 THEN lower(p_type) || ' ' || p_name WHEN p_partkey % 4 = 3 AND p_size > 25 THEN p_name || ' ' || p_size ELSE upper(p_name) END AS name, p_type AS description FROM part WHERE p_partkey % 2 = 1) GROUP BY name),
p AS (SELECT name, description, id, canonical, aliases, string_split(lower(canonical), ' ') AS wc, string_split(lower(name), ' ') AS wn, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS sn, regexp_replace(regexp_replace(lower(canonical), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS sc FROM inc, reg),
q AS (SELECT *, len(list_filter(wc, lambda w: list_contains(wn, w))) / greatest(len(wc), len(wn)) AS overlap, list_contains(list_transform(aliases, lambda x: lower(x)), lower(name)) AS is_alias FROM p),
c AS (SELECT *, CASE WHEN sn = sc THEN 1.0::DOUBLE WHEN is_alias THEN 0.95 ELSE round(overlap, 9) END AS score FROM q WHERE sn = sc OR is_alias OR contains(lower(canonical), lower(description)[1:20]) OR
  CASE WHEN contains(lower(name), lower(canonical)) OR contains(lower(canonical), lower(name)) THEN least(length(name), length(canonical)) / greatest(length(name), length(canonical)) ELSE overlap END >= 0.6)"""


def _names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part")
    registry = p.where("p_partkey % 2 = 0").groupBy(F.col("p_name").alias("canonical")).agg(F.min("p_partkey").alias("id"), F.array_sort(F.collect_set(F.concat_ws(" ", F.lower("p_type"), "p_name"))).alias("aliases"))
    k = F.col("p_partkey") % 4
    name = F.when(k == 1, F.concat_ws(" ", F.lower("p_type"), "p_name")).when((k == 3) & (F.col("p_size") > 25), F.concat_ws(" ", "p_name", "p_size")).otherwise(F.upper("p_name"))
    return p.where("p_partkey % 2 = 1").select(name.alias("name"), F.col("p_type").alias("description")), registry


@BOOK.query(f"WITH {NAMES_SQL} SELECT name, count(*) AS candidates, min(id) AS least_id FROM c GROUP BY name")
def concept_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts that an incoming name could mean, by slug, alias, description or likeness."""
    names, registry = _names(spark, sf_dir)
    names = names.groupBy("name").agg(F.min("description").alias("description"))
    return identity.candidates(names, registry).groupBy("name").agg(F.count("*").alias("candidates"), F.min("id").alias("least_id"))


@BOOK.query(f"""WITH {NAMES_SQL},
b AS (SELECT name, arg_min(id, (-score, id)) AS id, max(score) AS score, count(*) FILTER (score >= 0.6 AND score < 0.85) AS hints FROM c GROUP BY name)
SELECT name, CASE WHEN score = 1 THEN 'slug' WHEN score >= 0.85 THEN 'match' ELSE 'new' END AS outcome, CASE WHEN score >= 0.85 THEN id END AS id, coalesce(score, 0) AS score, CASE WHEN score = 1 THEN 0 ELSE coalesce(hints, 0) END AS hints FROM inc LEFT JOIN b USING (name)""")
def resolved_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming names resolved against the registry, or found to be new, with related hints."""
    return identity.resolve(*_names(spark, sf_dir))


ORDER_SQL = f"""{NAMES_SQL},
o AS (SELECT name, arg_min(inc.description, p_partkey) AS description, min(p_partkey) AS pos FROM (SELECT p_partkey, CASE WHEN p_partkey % 4 = 1 THEN lower(p_type) || ' ' || p_name WHEN p_partkey % 4 = 3 AND p_size > 25 THEN p_name || ' ' || p_size ELSE upper(p_name) END AS name, p_type AS description FROM part WHERE p_partkey % 2 = 1) inc GROUP BY name),
k AS (SELECT name, arg_min(struct_pack(score := score, id := id), (-score, id)) AS best, count(*) FILTER (score >= 0.6 AND score < 0.85) AS hints FROM c GROUP BY name),
nn AS (SELECT x.pos, x.name, y.pos AS j, string_split(lower(y.name), ' ') AS wc, string_split(lower(x.name), ' ') AS wn, lower(x.name) AS lx, lower(y.name) AS ly,
  regexp_replace(regexp_replace(lower(x.name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') = regexp_replace(regexp_replace(lower(y.name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, contains(lower(y.name), lower(x.description)[1:20]) AS told FROM o x JOIN o y ON y.pos < x.pos),
nm AS (SELECT *, len(list_filter(wc, lambda w: list_contains(wn, w))) / greatest(len(wc), len(wn)) AS overlap FROM nn),
ns AS (SELECT pos, j, CASE WHEN slug THEN 1.0::DOUBLE ELSE round(overlap, 9) END AS score, lx = ly AS same FROM nm WHERE slug OR told OR CASE WHEN contains(lx, ly) OR contains(ly, lx) THEN least(length(lx), length(ly)) / greatest(length(lx), length(ly)) ELSE overlap END >= 0.6),
nl AS (SELECT pos, list(struct_pack(j := j, score := score, same := same)) AS l FROM ns GROUP BY pos),
st AS MATERIALIZED (SELECT o.pos, o.name, row_number() OVER (ORDER BY o.pos) AS i, k.best, coalesce(k.hints, 0) AS hints, coalesce(nl.l, []) AS l FROM o LEFT JOIN k USING (name) LEFT JOIN nl ON nl.pos = o.pos),
r(i, news, aka, name, pos, score, id, fat, hints) AS (SELECT 0::BIGINT, []::BIGINT[], []::STRUCT(j BIGINT, id BIGINT, fat BIGINT)[], ''::VARCHAR, 0::BIGINT, 0.0::DOUBLE, NULL::BIGINT, NULL::BIGINT, 0::BIGINT UNION ALL
  SELECT i, CASE WHEN b.score >= 0.85 THEN news ELSE list_append(news, pos) END, CASE WHEN b.score >= 0.85 THEN list_append(aka, struct_pack(j := pos, id := b.id, fat := b.fat)) ELSE aka END, name, pos, b.score, CASE WHEN b.score >= 0.85 THEN b.id END, CASE WHEN b.score >= 0.85 THEN b.fat END,
    hints + len(list_filter(l, lambda x: list_contains(news, x.j) AND x.score >= 0.6 AND x.score < 0.85))
  FROM (SELECT *, list_sort([struct_pack(low := -coalesce(s.best.score, 0.0::DOUBLE), own := 0, id := CAST(s.best.id AS BIGINT), fat := NULL::BIGINT, score := coalesce(s.best.score, 0.0::DOUBLE))]
      || list_transform(list_filter(s.l, lambda x: list_contains(r.news, x.j)), lambda x: struct_pack(low := -x.score, own := 1, id := NULL::BIGINT, fat := CAST(x.j AS BIGINT), score := x.score))
      || list_transform(list_filter(r.aka, lambda y: list_contains(list_transform(list_filter(s.l, lambda x: x.same), lambda x: x.j), y.j)), lambda y: struct_pack(low := -0.95::DOUBLE, own := CASE WHEN y.id IS NULL THEN 1 ELSE 0 END, id := y.id, fat := y.fat, score := 0.95::DOUBLE)))[1] AS b
    FROM (SELECT s.*, r.news, r.aka, r, s FROM r JOIN st s ON s.i = r.i + 1)))"""


@BOOK.query(f"""WITH RECURSIVE {ORDER_SQL}
SELECT r.name, CASE WHEN r.score = 1 THEN 'slug' WHEN r.score >= 0.85 THEN 'match' ELSE 'new' END AS outcome, r.id, f.name AS "of", r.score, CASE WHEN r.score = 1 THEN 0 ELSE r.hints END AS hints FROM r LEFT JOIN o f ON f.pos = r.fat WHERE r.i > 0""")
def concepts_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming names resolved one after another, each new one a concept for those behind it."""
    p = table(spark, sf_dir, "part")
    names, registry = _names(spark, sf_dir)
    k = F.col("p_partkey") % 4
    name = F.when(k == 1, F.concat_ws(" ", F.lower("p_type"), "p_name")).when((k == 3) & (F.col("p_size") > 25), F.concat_ws(" ", "p_name", "p_size")).otherwise(F.upper("p_name"))
    names = p.where("p_partkey % 2 = 1").select(name.alias("name"), F.col("p_type").alias("description"), F.col("p_partkey").alias("at"))
    return identity.resolve_in_order(names, registry)


@BOOK.query("""
WITH k AS (SELECT lower(trim(p_name)) AS key, p_partkey AS pos, p_type || repeat('x', p_size) AS phrase, p_brand AS module, p_retailprice AS price FROM part)
SELECT key, min(pos) AS pos, count(*) AS merged, arg_max(phrase, (length(phrase), -pos)) AS phrase, array_to_string(list_sort(list(DISTINCT module)), ',') AS modules, max(price) AS price, arg_min(module, pos) AS module FROM k GROUP BY key""")
def merged_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inventory merged by normalised title: the longest phrase, the first module, all modules, the greatest price."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), "p_name", F.concat("p_type", F.expr("repeat('x', p_size)")).alias("phrase"), F.array("p_brand").alias("modules"), F.col("p_retailprice").alias("price"), F.col("p_brand").alias("module"))
    m = identity.merge_by_key(p, F.lower(F.trim("p_name")), "pos", ["phrase"], ["modules"], ["price"], ["module"])
    return m.withColumn("modules", F.array_join("modules", ","))


@BOOK.query("""
WITH m AS (SELECT l_partkey AS id, min(l_orderkey * 10 + l_linenumber) AS pos, arg_min(l_returnflag, (l_orderkey * 10 + l_linenumber, l_returnflag)) AS label, max(length(l_returnflag || l_linestatus)) AS n, array_to_string(list_sort(list(DISTINCT l_linestatus)), ',') AS found FROM lineitem GROUP BY l_partkey)
SELECT id, label, n::INT AS n, found FROM m""")
def inventory_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts upserted by id: the first label, the longest definition, the union of who found it."""
    li = table(spark, sf_dir, "lineitem")
    at = F.struct(F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.col("l_returnflag"))
    definition = F.concat("l_returnflag", "l_linestatus")
    g = li.groupBy(F.col("l_partkey").alias("id")).agg(F.min_by("l_returnflag", at).alias("label"), F.max_by(definition, F.length(definition)).alias("definition"), F.array_sort(F.collect_set("l_linestatus")).alias("found"))
    return g.select("id", "label", F.length("definition").alias("n"), F.array_join("found", ",").alias("found"))


@BOOK.query("""
WITH e AS (SELECT o_custkey AS id, list_sort(list(DISTINCT o_orderpriority)) AS tags, count(*) AS n, max(o_totalprice) AS mastery, max(o_orderdate) AS seen FROM orders GROUP BY o_custkey), m AS (SELECT id, CASE WHEN id % 10 IN (1, 2) THEN id - id % 10 ELSE id END AS survivor, tags, n, mastery, seen FROM e)
SELECT survivor, count(*) AS entries, array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') AS tags, sum(n)::BIGINT AS observations, max(mastery) AS mastery, max(seen) AS seen FROM m GROUP BY survivor""")
def merged_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries merged into their survivors: tags united, observations joined, the greatest mastery, the last sight."""
    o = table(spark, sf_dir, "orders")
    e = o.groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set("o_orderpriority").alias("tags"), F.count("*").alias("n"), F.max("o_totalprice").alias("mastery"), F.max("o_orderdate").alias("seen"))
    survivor = F.when((F.col("id") % 10).isin(1, 2), F.col("id") - F.col("id") % 10).otherwise(F.col("id"))
    g = e.groupBy(survivor.alias("survivor")).agg(F.count("*").alias("entries"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"), F.sum("n").alias("observations"), F.max("mastery").alias("mastery"), F.max("seen").alias("seen"))
    return g.withColumn("tags", F.array_join("tags", ","))


@BOOK.query("""
WITH r AS (SELECT l_orderkey, CASE WHEN l_partkey % 5 = 3 THEN l_partkey - 3 ELSE l_partkey END AS p FROM lineitem)
SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT p)), ',') AS parts FROM r GROUP BY l_orderkey""")
def relinked_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of ids after a cascade of merges, each id once."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    merges = p.where("p_partkey % 5 = 3").select(F.col("p_partkey").alias("source"), (F.col("p_partkey") - 3).alias("target"))
    rows = li.groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("parts"))
    out = identity.relink_arrays(rows, merges, "l_orderkey", "parts")
    return out.select("l_orderkey", F.array_join(F.transform("parts", lambda x: x.cast("string")), ",").alias("parts"))


@BOOK.query("""
SELECT 'lineitem' AS place, count(*) AS references FROM lineitem WHERE l_partkey % 5 = 3 UNION ALL SELECT 'part', count(*) FROM part WHERE p_partkey % 5 = 3
UNION ALL SELECT 'orders', count(DISTINCT l_orderkey) FROM lineitem WHERE l_partkey % 5 = 3""")
def relink_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many references a merge would rewrite, by place."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    gone = p.where("p_partkey % 5 = 3").select(F.col("p_partkey").alias("l_partkey"))
    hit = li.join(gone, "l_partkey", "left_semi")
    row = lambda name, df, n: df.agg(n.alias("references")).select(F.lit(name).alias("place"), "references")
    return row("lineitem", hit, F.count("*")).unionByName(row("part", gone, F.count("*"))).unionByName(row("orders", hit, F.count_distinct("l_orderkey")))


@BOOK.query("""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN p_partkey IS NULL THEN l_partkey ELSE p_partkey * 1000 + p_size END AS global_id, p_partkey IS NOT NULL AS mapped, l_suppkey FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON p_partkey = l_partkey""")
def mapped_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local ids mapped to global ones; ids without a mapping pass through."""
    m = table(spark, sf_dir, "part").where("p_size > 10").select("p_partkey", (F.col("p_partkey") * 1000 + F.col("p_size")).alias("g"))
    li = table(spark, sf_dir, "lineitem").join(m, F.col("l_partkey") == F.col("p_partkey"), "left")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce("g", "l_partkey").alias("global_id"), F.col("g").isNotNull().alias("mapped"), "l_suppkey")


@BOOK.query("""
WITH n AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS similarity, CASE WHEN list_cosine_similarity(a.e, b.e) >= 0.91 THEN 'auto' WHEN list_cosine_similarity(a.e, b.e) >= 0.78 THEN 'review' ELSE 'distinct' END AS triage FROM n a JOIN n b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.3""")
def similar_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of vectors from a floor on (0.3, as few of these are alike), sorted into automatic, review and distinct.

    Copies are told by one representative in `identity.similar_pairs`; here their pairs are
    written out, as the table has few.
    """
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    pairs, members = identity.similar_pairs(v, 0.3)
    copies = members.where("id <> representative").select(F.col("representative").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    s = F.col("similarity")
    return pairs.unionByName(copies).select("a", "b", F.round(s, 6).alias("similarity"), F.when(s >= 0.91, "auto").when(s >= 0.78, "review").otherwise("distinct").alias("triage"))


@BOOK.query("""
WITH s AS (SELECT vec_id AS section, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 10 = 0), c AS (SELECT vec_id AS concept, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 10 <> 0),
b AS (SELECT concept, section, round(list_cosine_similarity(c.e, s.e), 9) AS x FROM c, s QUALIFY row_number() OVER (PARTITION BY concept ORDER BY round(list_cosine_similarity(c.e, s.e), 9) DESC, section) = 1)
SELECT concept, CASE WHEN x >= 0.35 THEN section ELSE concept - concept % 10 END AS section, x >= 0.35 AS anchored FROM b""")
def concept_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best section of each concept from 0.35 on; else the one in proportion to its place."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return joins.nearest_or(v.where("id % 10 <> 0"), v.where("id % 10 = 0"), 0.35, F.col("query_id") - F.col("query_id") % 10).select(F.col("query_id").alias("concept"), F.col("id").alias("section"), F.col("found").alias("anchored"))


@BOOK.query("""
WITH d AS (SELECT vec_id, label, CAST(embedding[1:len(embedding)//2] AS DOUBLE[]) AS t, CAST(embedding[len(embedding)//2+1:] AS DOUBLE[]) AS c FROM embeddings),
s AS (SELECT a.vec_id AS doc, b.vec_id AS peer, 0.5 * list_cosine_similarity(a.t, b.t) + 0.5 * list_cosine_similarity(a.c, b.c) AS score FROM d a JOIN d b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT doc, peer, round(score, 6) AS score, CASE WHEN score >= 0.64 THEN 'duplicate' WHEN score >= 0.55 THEN 'related' ELSE 'other' END AS kind FROM s""")
def project_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the query set against their project's peers: half the title's likeness, half the concepts'."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    half = (F.size("embedding") / 2).cast("int")
    d = e.select("vec_id", "label", F.slice("embedding", F.lit(1), half).alias("t"), F.slice("embedding", half + 1, F.size("embedding")).alias("c"))
    s = joins.two_part_scores(d.where("vec_id % 100 = 0"), d, "vec_id", "label", "t", "c")
    return s.select(F.col("query_id").alias("doc"), F.col("id").alias("peer"), F.round("score", 6).alias("score"), F.when(F.col("score") >= 0.64, "duplicate").when(F.col("score") >= 0.55, "related").otherwise("other").alias("kind"))


EDGES_SQL = "e AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst, l_discount AS w, l_orderkey AS o FROM lineitem)"


@BOOK.query(f"""
WITH {EDGES_SQL}, u AS (SELECT src, dst, min(o) AS o FROM e WHERE dst IS NOT NULL AND src <> dst GROUP BY ALL), a AS (SELECT p_partkey AS src, p_partkey + 1 AS dst FROM part WHERE p_size < 10)
SELECT coalesce(a.src, u.src) AS src, coalesce(a.dst, u.dst) AS dst, CASE WHEN a.src IS NOT NULL THEN 'array' ELSE 'graph' END AS origin FROM a FULL JOIN u ON a.src = u.src AND a.dst = u.dst""")
def inventory_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from prerequisite arrays and from the graph; an ordered pair is told by the first."""
    e = sequence_edges(spark, sf_dir).select("src", "dst").withColumn("rank", F.lit(1))
    a = table(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + 1).alias("dst"), F.lit(0).alias("rank"))
    g = a.unionByName(e).groupBy("src", "dst").agg(F.min("rank").alias("rank"))
    return g.select("src", "dst", F.when(F.col("rank") == 0, "array").otherwise("graph").alias("origin"))


@BOOK.query(f"""
WITH {EDGES_SQL} SELECT src, dst, min(w) AS weight FROM (SELECT src, dst, w FROM e WHERE dst IS NOT NULL AND src <> dst UNION ALL SELECT p_partkey, p_partkey + 1, 0.05 FROM part WHERE p_size < 10) GROUP BY ALL""")
def prerequisite_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of edges, the least weight of each."""
    e = sequence_edges(spark, sf_dir).select("src", "dst", "weight")
    a = table(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + 1).alias("dst"), F.lit(0.05).alias("weight"))
    return e.unionByName(a).groupBy("src", "dst").agg(F.min("weight").alias("weight"))


def sequence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, weight, kind, line): from each line of an order to the next one, without loops."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_returnflag"), "l_orderkey")
    li = lines.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"), F.col("l_discount").alias("weight"), F.col("l_returnflag").alias("kind"), F.col("l_orderkey").alias("line"))
    return li.where("dst is not null and src <> dst")


@BOOK.query("SELECT l_partkey AS entry, array_to_string(list_sort(list(DISTINCT l_returnflag)), '') AS facets, 3 - count(DISTINCT l_returnflag) AS missing FROM lineitem GROUP BY l_partkey")
def covered_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets that an entry has, and how many it lacks."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("entry")).agg(F.array_sort(F.collect_set("l_returnflag")).alias("f"))
    return g.select("entry", F.array_join("f", "").alias("facets"), (3 - F.size("f")).cast("long").alias("missing"))


@BOOK.query(f"WITH {EDGES_SQL} SELECT a, count(*) AS related FROM (SELECT src AS a, dst AS b FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst) GROUP BY a")
def related_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links made to hold in both directions, counted."""
    e = sequence_edges(spark, sf_dir).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return graph.related_closure(e, table(spark, sf_dir, "lineitem").count()).groupBy("a").agg(F.count("*").alias("related"))


@BOOK.query("SELECT p_brand AS topic, count(DISTINCT l_orderkey) AS docs, count(DISTINCT p_type) AS areas FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_brand")
def topic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct documents and areas of each topic."""
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy(F.col("p_brand").alias("topic")).agg(F.count_distinct("l_orderkey").alias("docs"), F.count_distinct("p_type").alias("areas"))


@BOOK.query(f"WITH {EDGES_SQL} SELECT p_partkey AS node, count(DISTINCT x.dst) AS dependents FROM part LEFT JOIN (SELECT DISTINCT src, dst FROM e WHERE src <> dst AND dst IN (SELECT p_partkey FROM part WHERE p_size > 5)) x ON x.src = p_partkey WHERE p_size > 5 GROUP BY p_partkey")
def dependent_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many concepts of the inventory depend on each of them, 0 where none."""
    inventory = table(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("node"))
    e = sequence_edges(spark, sf_dir).join(inventory.select(F.col("node").alias("dst")), "dst", "left_semi")
    d = graph.dependents(e)
    return inventory.join(d, "node", "left").select("node", F.coalesce("dependents", F.lit(0)).alias("dependents"))


@BOOK.query("""
WITH c AS (SELECT o_custkey, o_orderkey, o_orderpriority FROM orders), x AS (SELECT c_custkey AS id, c_name AS label, c_mktsegment AS topic FROM customer)
SELECT o_orderkey, coalesce(a.id, b.id, d.id) AS found, CASE WHEN a.id IS NOT NULL THEN 'id' WHEN b.id IS NOT NULL THEN 'label and topic' WHEN d.id IS NOT NULL THEN 'label' END AS by
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS k, CASE WHEN o_orderkey % 3 > 0 THEN 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') END AS label, CASE WHEN o_orderkey % 3 = 1 THEN 'BUILDING' END AS topic FROM orders) q
LEFT JOIN x a ON a.id = q.k LEFT JOIN x b ON b.label = q.label AND b.topic = q.topic LEFT JOIN x d ON d.label = q.label""")
def prerequisite_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of prerequisites resolved by id, by label within a topic, or by label."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"), F.col("c_mktsegment").alias("topic"))
    k = F.col("o_orderkey") % 3
    name = F.when(k > 0, F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")))
    q = o.select("o_orderkey", F.when(k == 0, F.col("o_custkey")).alias("k"), name.alias("q_label"), F.when(k == 1, F.concat_ws("|", name, F.lit("BUILDING"))).alias("q_both"))
    c = c.withColumn("both", F.concat_ws("|", "label", "topic"))
    out = q
    for i, (a, b) in enumerate((("k", "id"), ("q_both", "both"), ("q_label", "label"))):
        side = c.select(F.col(b).alias(f"key{i}"), F.col("id").alias(f"id{i}"))
        out = out.join(side, F.col(a) == F.col(f"key{i}"), "left")
    by = F.when(F.col("id0").isNotNull(), "id").when(F.col("id1").isNotNull(), "label and topic").when(F.col("id2").isNotNull(), "label")
    return out.select("o_orderkey", F.coalesce("id0", "id1", "id2").alias("found"), by.alias("by"))


@BOOK.query("""
SELECT doc_id, t AS term FROM (SELECT doc_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) >= 9))) AS t FROM documents) WHERE t NOT IN (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) FROM benchmark)""")
def new_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of documents that the store doesn't have yet."""
    found = lambda df, c: df.select("*", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)))).alias("term"))
    d = found(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").where(F.length("term") >= 9)
    old = found(table(spark, sf_dir, "benchmark").select("text"), "text").select("term").distinct()
    return d.select("doc_id", "term").join(old, "term", "left_anti").select("doc_id", "term")


@BOOK.query("""
WITH r AS (SELECT DISTINCT least(l_partkey, l_suppkey) AS lo, greatest(l_partkey, l_suppkey) AS hi FROM lineitem WHERE l_returnflag = 'R' AND l_partkey <> l_suppkey)
SELECT l_returnflag, count(*) AS kept FROM lineitem WHERE l_returnflag <> 'R' AND (least(l_partkey, l_suppkey), greatest(l_partkey, l_suppkey)) NOT IN (SELECT (lo, hi) FROM r) GROUP BY l_returnflag""")
def unrejected_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals left after those that were rejected before, in either order."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    kept = joins.anti_unordered(li.where("l_returnflag <> 'R'"), li.where("l_returnflag = 'R'"), "l_partkey", "l_suppkey")
    return kept.groupBy("l_returnflag").agg(F.count("*").alias("kept"))


@BOOK.query("SELECT l_partkey AS a, l_suppkey AS b, l_orderkey FROM lineitem WHERE (l_partkey = 17 OR l_suppkey = 17) AND l_partkey <> l_suppkey GROUP BY ALL")
def pairs_of_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs that one id is in, on either side."""
    li = table(spark, sf_dir, "lineitem").where("(l_partkey = 17 or l_suppkey = 17) and l_partkey <> l_suppkey")
    return li.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), "l_orderkey").distinct()

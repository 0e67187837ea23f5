"""Queries of what comes in and goes out: files, tables, JSON, exports, caches; and the numbers around a study session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studyloom.functions import text as T
from studyloom.operators import exports as X
from studyloom.operators import glyphs, identity
from studyloom.operators import packs as P
from studyloom.plans.registry import Book
from studyloom.session import table
from studyloom.sources import readers

BOOK = Book()
LINES_SQL = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"
BOUNDARY_SQL = "^(CONTENTS|TABLE OF CONTENTS|(Letter|Chapter|CHAPTER)\\s+[0-9IVXLC]+.*|[0-9]+(\\.[0-9]+)*\\.?\\s+[A-Z].{0,80}|[A-Z][A-Z0-9 ,.''\\-]{3,80})$"


@BOOK.query(f"""
WITH {LINES_SQL}, n AS (SELECT *, regexp_matches(trim(line), '{BOUNDARY_SQL}') AS head FROM l WHERE trim(line) <> ''),
o AS (SELECT *, head OR coalesce(lag(head) OVER (PARTITION BY doc_id ORDER BY pos), true) AS opens FROM n), b AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS block FROM o)
SELECT doc_id, block::INT AS block, min(pos)::INT AS start_line, md5(string_agg(line, chr(10) ORDER BY pos)) AS text FROM b GROUP BY doc_id, block""")
def plain_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain texts as blocks that begin at heading-like lines."""
    return readers.plain_blocks(table(spark, sf_dir, "documents")).withColumn("text", F.md5("text"))


@BOOK.query("""
WITH f AS (SELECT 'book' || p_partkey || CASE p_size % 8 WHEN 0 THEN '.PDF' WHEN 1 THEN '.htm' WHEN 2 THEN '.md' WHEN 3 THEN '.txt' WHEN 4 THEN '.csv' WHEN 5 THEN '.json' WHEN 6 THEN '' ELSE '.tar.gz' END AS name FROM part)
SELECT CASE regexp_extract(lower(name), '\\.([a-z0-9]+)$', 1) WHEN 'pdf' THEN 'pdf' WHEN 'html' THEN 'html' WHEN 'htm' THEN 'html' WHEN 'md' THEN 'markdown' WHEN 'markdown' THEN 'markdown' WHEN 'csv' THEN 'csv' WHEN 'json' THEN 'json' ELSE 'text' END AS format, count(*) AS files FROM f GROUP BY 1""")
def file_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats by the endings of file names."""
    ends = F.array(*(F.lit(x) for x in (".PDF", ".htm", ".md", ".txt", ".csv", ".json", "", ".tar.gz")))
    name = F.concat(F.lit("book"), F.col("p_partkey").cast("string"), F.get(ends, F.col("p_size") % 8))
    return table(spark, sf_dir, "part").groupBy(readers.format_of(name).alias("format")).agg(F.count("*").alias("files"))


@BOOK.query("SELECT p_name AS canonical_title, p_brand AS topic, count(*) AS n, round(sum(p_size / 50.0), 4) AS mastery FROM part GROUP BY ALL")
def json_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts imported from JSON texts, bare arrays and objects with entries, with either name of a field."""
    p = table(spark, sf_dir, "part")
    even = F.col("p_partkey") % 2 == 0
    bare = F.to_json(F.array(F.struct(F.col("p_name").alias("title"), F.col("p_brand").alias("topic"), (F.col("p_size") / 50.0).alias("masteryScore"))))
    held = F.concat(F.lit('{"entries": '), F.to_json(F.array(F.struct(F.col("p_name").alias("canonicalTitle"), F.col("p_brand").alias("topic"), (F.col("p_size") / 50.0).alias("mastery")))), F.lit("}"))
    c = readers.concepts_from_json(p.select(F.when(even, bare).otherwise(held).alias("text")))
    return c.groupBy("canonical_title", "topic").agg(F.count("*").alias("n"), F.round(F.sum("mastery"), 4).alias("mastery"))


@BOOK.query("SELECT p_brand AS section, p_partkey, p_name AS name, p_size AS risk FROM part")
def inventory_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Process inventories written as Markdown tables under headings, read back with types."""
    p = table(spark, sf_dir, "part")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("p_partkey").cast("string"), "p_name", F.col("p_size").cast("string")), F.lit(" |"))
    rows = p.groupBy("p_brand", F.floor(F.col("p_partkey") / 50).alias("doc")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("rows"))
    docs = rows.select(F.concat_ws("/", "p_brand", F.col("doc").cast("string")).alias("doc_id"), F.concat(F.lit("## "), "p_brand", F.lit("\n\n| id | name | risk |\n|---|---|---|\n"), "rows").alias("text"))
    cells = readers.pipe_table(docs).where(F.col("cells")[0] != "id")
    return cells.select("section", F.col("cells")[0].cast("long").alias("p_partkey"), F.col("cells")[1].alias("name"), F.col("cells")[2].cast("int").alias("risk"))


@BOOK.query("SELECT p_partkey, CASE p_size % 4 WHEN 3 THEN NULL ELSE p_size END AS size FROM part")
def repaired_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a model read as JSON: fenced, with words around it, with a trailing comma, or beyond repair."""
    k, size = F.col("p_size") % 4, F.col("p_size").cast("string")
    text = F.when(k == 0, F.concat(F.lit('```json\n{"size": '), size, F.lit("}\n```"))).when(k == 1, F.concat(F.lit('Here it is: {"size": '), size, F.lit(",} as asked"))).when(k == 2, F.concat(F.lit("{“size”: "), size, F.lit("}"))).otherwise(F.concat(F.lit('{"size": '), size, F.lit(", ")))
    return table(spark, sf_dir, "part").select("p_partkey", F.get_json_object(readers.repaired_json(text), "$.size").cast("int").alias("size"))


@BOOK.query("""
WITH g AS (SELECT l_orderkey AS page, floor(l_linenumber / 2) * 14.0 AS y, ((l_partkey % 50) * 10)::DOUBLE AS x, l_partkey AS t, l_suppkey AS s FROM lineitem),
r AS (SELECT page, y, string_agg(t::VARCHAR, ' ' ORDER BY x, t, s) AS text, min(x) AS x FROM g GROUP BY page, y)
SELECT page, row_number() OVER (PARTITION BY page ORDER BY y) AS line, x, text FROM r""")
def glyph_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glyphs with places on a page gathered into lines, from top to bottom, each from left to right."""
    g = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), (F.floor(F.col("l_linenumber") / 2) * 14.0 + (F.col("l_suppkey") % 3) * 0.5).alias("y"), ((F.col("l_partkey") % 50) * 10.0).alias("x"), F.col("l_partkey").cast("string").alias("text"), "l_partkey", "l_suppkey")
    return glyphs.lines(g, "page", "x", "y", "text", ["l_partkey", "l_suppkey"], height=14.0).select("page", "line", "x", "text")


@BOOK.query("""
WITH g AS (SELECT l_orderkey AS page, l_linenumber AS line, (l_partkey % 4) * 100 AS a FROM lineitem), n AS (SELECT page, count(DISTINCT line) AS lines FROM g GROUP BY page), h AS (SELECT page, a, count(DISTINCT line) AS hits FROM g GROUP BY ALL),
k AS (SELECT h.page, count(*) AS columns FROM h JOIN n USING (page) WHERE hits >= greatest(2, least(3, lines)) GROUP BY h.page)
SELECT n.page, lines, coalesce(columns, 0) AS columns, coalesce(columns, 0) >= 3 AND lines >= 3 AS is_grid FROM n LEFT JOIN k USING (page)""")
def table_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that cells of several lines share within eight points, and whether they make a table."""
    x = (F.col("l_partkey") % 4) * 100.0 + (F.col("l_suppkey") % 5)
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line"), x.alias("x"))
    return glyphs.grids(c, "page", "line", "x", tolerance=8.0)


@BOOK.query("""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '') AS ws FROM documents)
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN ceil(len(ws) / 6) ELSE ceil(len(ws) / 12) END::BIGINT AS lines, doc_id % 2 = 0 AND len(ws) > 6 AS two_columns, md5(array_to_string(ws, ' ')) AS text FROM w WHERE len(ws) > 0""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of words, even documents set in two columns of six words, odd ones in lines of twelve: read back, all words are in order."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.words(F.col("text")).alias("ws"))
    w = d.select("doc_id", F.size("ws").alias("n"), F.posexplode("ws").alias("i", "word"))
    two = F.col("doc_id") % 2 == 0
    rows = F.ceil(F.col("n") / 6).cast("int")
    left, line = F.ceil(rows / 2).cast("int"), F.floor(F.col("i") / F.when(two, 6).otherwise(12)).cast("int")
    right = two & (line >= left)
    x = F.when(right, 330.0).otherwise(20.0) + F.when(two, F.col("i") % 6).otherwise(F.col("i") % 12) * 45.0
    y = F.when(right, line - left).otherwise(line) * 14.0 + (F.col("i") % 3) * 0.5
    lines = glyphs.reading_lines(w.select("doc_id", "i", "word", x.alias("x"), y.alias("y")), "doc_id", "x", "y", "word", ["i"], height=14.0, width=612.0)
    whole = lines.groupBy("doc_id").agg(F.count("*").alias("lines"), (F.max("column") == 1).alias("two_columns"), F.array_sort(F.collect_list(F.struct("place", "text"))).alias("t"))
    return whole.select("doc_id", "lines", "two_columns", F.md5(F.array_join(F.transform("t", lambda s: s["text"]), " ")).alias("text"))


@BOOK.query("""
WITH g AS (SELECT l_orderkey // 4 AS page, l_linenumber AS line, (l_partkey % 4) * 150 AS a, (l_partkey % 4) * 150 + l_suppkey % 5 AS x, CASE WHEN l_partkey % 9 = 0 THEN 0 ELSE 1 + l_orderkey % 11 END AS words FROM lineitem),
n AS (SELECT page, count(DISTINCT line) AS lines FROM g GROUP BY page), h AS (SELECT page, a, count(DISTINCT line) AS hits, count(DISTINCT line) FILTER (words > 0) AS full_, min(x) AS at_, max(words) AS words FROM g GROUP BY page, a),
k AS (SELECT h.page, count(*) AS columns, sum(full_) AS full_, max(at_) - min(at_) AS span, max(words) AS words FROM h JOIN n USING (page) WHERE hits >= greatest(2, least(3, lines)) GROUP BY h.page)
SELECT n.page, lines, coalesce(columns, 0) AS columns, round(CASE WHEN columns > 0 THEN full_ / (lines * columns) ELSE 0 END, 6) AS fill, coalesce(columns >= 3 AND lines >= 3 AND full_ / (lines * columns) >= 0.45 AND span <= 0.92 * 480 AND words <= 8, false) AS is_table FROM n LEFT JOIN k USING (page)""")
def filled_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids that are filled, narrow and short enough to be tables."""
    x = (F.col("l_partkey") % 4) * 150.0 + (F.col("l_suppkey") % 5)
    text = F.when(F.col("l_partkey") % 9 == 0, " ").otherwise(F.expr("repeat('word ', CAST(1 + l_orderkey % 11 AS INT))"))
    c = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 4).alias("page"), F.col("l_linenumber").alias("line"), x.alias("x"), text.alias("text"))
    return glyphs.filled_grids(c, "page", "line", "x", "text", tolerance=8.0, width=480.0).withColumn("fill", F.round("fill", 6))


@BOOK.query("""
SELECT doc_id, md5('---' || chr(10) || 'title: "' || replace(replace(string_split(text, chr(10))[1][1:40], '\\', '\\\\'), '"', '\\"') || '"' || chr(10) || 'source: "' || source || '"' || chr(10) || '---' || chr(10) || chr(10) || text) AS markdown FROM documents""")
def session_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions as Markdown with their fields in front."""
    t = F.substring(F.split("text", "\n")[0], 1, 40)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.front_matter({"title": t, "source": F.col("source")}, F.col("text"))).alias("markdown"))


@BOOK.query("SELECT count(*) AS rows, count(*) FILTER (octet_length(encode(text)) > 5000) AS stored, sum(CASE WHEN octet_length(encode(text)) > 5000 THEN octet_length(encode(text)) ELSE 0 END)::BIGINT AS stored_bytes FROM documents")
def large_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose payload is too large to stay in them (5000 bytes here), and what is stored apart."""
    rows, large = X.split_payload(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", 5000)
    a = rows.agg(F.count("*").alias("rows"), F.count_if("stored").alias("stored"))
    return a.crossJoin(large.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long").alias("stored_bytes")))


@BOOK.query("SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE p_size > 5")
def pack_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pack as others get it: without the fields that hold source material."""
    p = table(spark, sf_dir, "part").where("p_size > 5")
    return p.select(*X.without_source(p.columns, ("p_retailprice", "p_size")))


@BOOK.query("""
WITH o AS (SELECT p_partkey AS k, p_size AS v, 0 AS ver, p_type = 'PROMO' AS frozen FROM part), n AS (SELECT p_partkey AS k, p_size + (p_partkey % 2)::INT AS v FROM part WHERE p_partkey % 3 > 0)
SELECT o.k AS id, CASE WHEN NOT frozen AND n.k IS NOT NULL AND n.v <> o.v THEN n.v ELSE o.v END AS value, CASE WHEN NOT frozen AND n.k IS NOT NULL AND n.v <> o.v THEN 1 ELSE 0 END AS version, NOT frozen AND n.k IS NOT NULL AND n.v <> o.v AS changed FROM o LEFT JOIN n ON n.k = o.k""")
def touched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates that move a row's version only where its value changed; published rows stay as they are."""
    p = table(spark, sf_dir, "part")
    old = p.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("value"), F.lit(0).alias("version"), "p_type")
    new = p.where("p_partkey % 3 > 0").select(F.col("p_partkey").alias("id"), (F.col("p_size") + (F.col("p_partkey") % 2).cast("int")).alias("value"), F.lit(1).alias("version"))
    return X.touched(old, new, "id", "value", "version", F.col("p_type") == "PROMO")


@BOOK.query("""
WITH c AS (SELECT source AS k, max(text) AS t FROM documents WHERE doc_id % 2 = 0 GROUP BY source), r AS (SELECT source AS k, max(text) AS t FROM documents WHERE doc_id % 2 = 1 GROUP BY source),
f AS (SELECT * FROM r WHERE octet_length(encode(t)) <= 3000) SELECT k, md5(t) AS payload FROM f UNION ALL SELECT k, md5(t) FROM c WHERE k NOT IN (SELECT k FROM f)""")
def shared_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shared cache that turns away what is larger than its cap (3000 bytes here)."""
    d = table(spark, sf_dir, "documents")
    side = lambda k: d.where(f"doc_id % 2 = {k}").groupBy(F.col("source").alias("k")).agg(F.max("text").alias("t"))
    return X.capped_upsert(side(0), side(1), "k", "t", 3000).select("k", F.md5("t").alias("payload"))


@BOOK.query("""
WITH m AS (SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')) AS w FROM documents)
SELECT doc_id, greatest(1, ceil(w / 400))::BIGINT AS rsvp, greatest(1, ceil(w / 350))::BIGINT AS read, greatest(1, ceil(w / 120))::BIGINT AS slow, greatest(1, ceil(w / 600))::BIGINT AS recall, greatest(1, ceil(w / 800))::BIGINT AS questions,
  greatest(1, ceil(greatest(5, ceil(w / 200)) * 0.5))::BIGINT AS cloze, greatest(1, ceil(greatest(5, ceil(w / 200)) * 0.3))::BIGINT AS review FROM m""")
def step_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many minutes each study mode takes for a text."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).alias("w"))
    at_least = lambda c: F.greatest(F.lit(1), F.ceil(c)).cast("long")
    items = F.greatest(F.lit(5), F.ceil(F.col("w") / 200))
    return d.select("doc_id", *(at_least(F.col("w") / per).alias(mode) for mode, per in MINUTES.items()), at_least(items * 0.5).alias("cloze"), at_least(items * 0.3).alias("review"))


#: Words a minute of each mode.
MINUTES = {"rsvp": 400, "read": 350, "slow": 120, "recall": 600, "questions": 800}


@BOOK.query("""
WITH m AS (SELECT doc_id, (doc_id % 5 + 1)::INT AS density, length(text) - length(replace(text, chr(10), '')) AS breaks, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')) AS w FROM documents)
SELECT doc_id, density >= 3 AS fillable_map, w > 0 AND breaks * 1000.0 / w >= 20 AS checkpoints, density >= 4 AS critical FROM m""")
def reading_modifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What slow reading adds for a text: a map to fill in, checkpoints, critical questions; its id stands for the density."""
    t = F.col("text")
    density = F.col("doc_id") % 5 + 1
    breaks = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    w = T.word_count(t)
    return table(spark, sf_dir, "documents").select("doc_id", (density >= 3).alias("fillable_map"), F.when(w > 0, breaks * 1000.0 / w >= 20).otherwise(False).alias("checkpoints"), (density >= 4).alias("critical"))


@BOOK.query("""
WITH o AS (SELECT o_custkey, CASE WHEN count(*) > 12 THEN 'deep' WHEN bool_or(o_orderpriority = '1-URGENT') AND max(o_totalprice) > 200000 THEN 'exam' WHEN count(*) < 4 THEN 'quick' ELSE 'steady' END AS plan FROM orders GROUP BY o_custkey) SELECT plan, count(*) AS users FROM o GROUP BY plan""")
def onboarding_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow that fits what users told at the start."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.max("o_totalprice").alias("most"))
    plan = F.when(F.col("n") > 12, "deep").when(F.col("urgent") & (F.col("most") > 200000), "exam").when(F.col("n") < 4, "quick").otherwise("steady")
    return o.groupBy(plan.alias("plan")).agg(F.count("*").alias("users"))


def _words(c: str) -> Column:
    return T.token_set_b(F.col(c))


@BOOK.query("""
WITH t AS (SELECT b.item_id, b.text AS claim, d.text AS chunk, d.doc_id FROM benchmark b JOIN documents d ON d.doc_id = b.item_id),
s AS (SELECT *, list_distinct(list_filter(regexp_extract_all(strip_accents(lower(claim)), '[a-z0-9]+'), lambda x: length(x) >= 4)) AS a, list_distinct(list_filter(regexp_extract_all(strip_accents(lower(chunk)), '[a-z0-9]+'), lambda x: length(x) >= 4)) AS b FROM t),
r AS (SELECT item_id, len(list_intersect(a, b)) AS shared, len(list_distinct(a || b)) AS either, len(a) AS n FROM s)
SELECT item_id, round(CASE WHEN either > 0 THEN shared / either ELSE 0 END, 6) AS jaccard, round(CASE WHEN n > 0 THEN shared / n ELSE 1 END, 6) AS coverage, CASE WHEN n > 0 AND shared / n < 0.4 AND shared / either < 0.12 THEN 'retry' WHEN n > 0 AND shared / n < 0.5 THEN 'warn' ELSE 'accept' END AS action FROM r""")
def fidelity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a text is covered by the one it should come from: Jaccard, share of its terms, and what to do."""
    j = table(spark, sf_dir, "benchmark").select("item_id", _words("text").alias("a")).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), _words("text").alias("b")), "item_id")
    both, either, n = F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b")), F.size("a")
    share, jaccard = F.when(n > 0, both / n).otherwise(1.0), F.when(either > 0, both / either).otherwise(0.0)
    action = F.when((n > 0) & (share < 0.4) & (jaccard < 0.12), "retry").when((n > 0) & (share < 0.5), "warn").otherwise("accept")
    return j.select("item_id", F.round(jaccard, 6).alias("jaccard"), F.round(share, 6).alias("coverage"), action.alias("action"))


@BOOK.query("""
WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(string_split(regexp_replace(lower(text), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'), ' '), lambda x: x <> '')) AS ws, lead(list_distinct(list_filter(string_split(regexp_replace(lower(text), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'), ' '), lambda x: x <> ''))) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM conversations)
SELECT conv_id, turn, round(len(list_intersect(ws, nx)) / greatest(1, len(list_distinct(ws || nx))), 6) AS score, len(list_intersect(ws, nx)) / greatest(1, len(list_distinct(ws || nx))) >= 0.1 AS grounded FROM t WHERE nx IS NOT NULL""")
def grounding_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far an answer's words are those of the turn before it, and whether that is enough."""
    ws = F.array_distinct(T.words(F.lower("text")))
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", ws.alias("ws")).withColumn("nx", F.lead("ws").over(Window.partitionBy("conv_id").orderBy("turn"))).where("nx is not null")
    score = F.size(F.array_intersect("ws", "nx")) / F.greatest(F.lit(1), F.size(F.array_union("ws", "nx")))
    return t.select("conv_id", "turn", F.round(score, 6).alias("score"), (score >= 0.1).alias("grounded"))


@BOOK.query("""
WITH b AS (SELECT o_custkey, list(o_orderkey || ':' || (o_orderkey % 3) || '+' || (o_orderkey % 2) || ':0' ORDER BY o_orderkey) AS ps, sum(o_orderkey % 3)::BIGINT AS t, sum(o_orderkey % 2)::BIGINT AS s FROM orders GROUP BY o_custkey)
SELECT o_custkey, 'v1|' || array_to_string(ps, '|') || '|' || t || '+' || s AS hash FROM b""")
def plan_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A string for each plan that changes with any of its batches."""
    k = F.col("o_orderkey")
    part = F.concat(k.cast("string"), F.lit(":"), (k % 3).cast("string"), F.lit("+"), (k % 2).cast("string"), F.lit(":0"))
    b = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", part.alias("p")))), lambda x: x["p"]).alias("ps"), F.sum(k % 3).alias("t"), F.sum(k % 2).alias("s"))
    return b.select("o_custkey", F.concat(F.lit("v1|"), F.array_join("ps", "|"), F.lit("|"), F.col("t").cast("string"), F.lit("+"), F.col("s").cast("string")).alias("hash"))


@BOOK.query("""
WITH p AS (SELECT p_brand AS section, count(*) AS records, min(p_size) AS critical, min(p_retailprice) AS risk, max(p_size) > 49 AS flagged FROM part GROUP BY p_brand),
h AS (SELECT p_brand AS section, count(DISTINCT p_type) FILTER (p_size > 40) AS hubs FROM part GROUP BY p_brand) SELECT section, records, critical, risk, flagged, hubs FROM p JOIN h USING (section)""")
def flow_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records gathered by section with their priority, hubs and flags."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("section")).agg(F.count("*").alias("records"), F.min("p_size").alias("critical"), F.min("p_retailprice").alias("risk"), (F.max("p_size") > 49).alias("flagged"), F.count_distinct(F.when(F.col("p_size") > 40, F.col("p_type"))).alias("hubs"))


@BOOK.query("""
WITH s AS (SELECT o_custkey, year(min(o_orderdate)) AS first, year(max(o_orderdate)) AS last FROM orders GROUP BY o_custkey) SELECT CASE WHEN first = last THEN 'point' ELSE 'span' END AS kind, min(first)::INT AS first, max(last)::INT AS last, count(*) AS entries FROM s GROUP BY 1""")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries in time: points and spans, and the years that they reach."""
    s = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.year(F.min("o_orderdate")).alias("first"), F.year(F.max("o_orderdate")).alias("last"))
    return s.groupBy(F.when(F.col("first") == F.col("last"), "point").otherwise("span").alias("kind")).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count("*").alias("entries"))


@BOOK.query("""
WITH a AS (SELECT user_id, CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'click' THEN 2 ELSE 1 END * CASE WHEN event_type IN ('error', 'signup') AND user_id % 2 = 0 THEN 1.25 ELSE 1 END - CASE WHEN event_type = 'view' AND value < 20 THEN 1 ELSE 0 END AS p, value < 20 AS bare FROM events)
SELECT user_id, round(greatest(0, sum(p))::DOUBLE, 4) AS depth, round(count(*) FILTER (NOT bare) / count(*), 6) AS own_words FROM a GROUP BY user_id""")
def annotation_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How deep annotations go: points by kind, more for critical ones, less for empty ones."""
    kind, bare = F.col("event_type"), F.col("value") < 20
    points = F.when(kind == "error", 3).when(kind.isin("purchase", "click"), 2).otherwise(1)
    critical = F.when(kind.isin("error", "signup") & (F.col("user_id") % 2 == 0), 1.25).otherwise(1.0)
    p = points * critical - F.when((kind == "view") & bare, 1).otherwise(0)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.greatest(F.lit(0.0), F.sum(p)), 4).alias("depth"), F.round(F.count_if(~bare) / F.count("*"), 6).alias("own_words"))


@BOOK.query("SELECT source, count(*) AS documents, count(*) FILTER (text = '' OR text IS NULL) AS empty, count(*) FILTER (n_chars <> length(text)) AS stale, count(*) FILTER (lang NOT IN ('en', 'de', 'fr', 'es')) AS unknown FROM documents GROUP BY source")
def store_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of what is wrong with stored documents."""
    bad = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.coalesce(F.col("text"), F.lit("")) == "").alias("empty"), bad(F.col("n_chars") != F.length("text")).alias("stale"), bad(~F.col("lang").isin("en", "de", "fr", "es")).alias("unknown"))


@BOOK.query("""
WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), s AS (SELECT doc_id, ls, len(ls) // 2 AS block, ls[len(ls) // 2 + 1][1:30] AS snippet FROM a),
m AS (SELECT doc_id, block, snippet, list_concat(['inserted'], ls) AS ns FROM s WHERE snippet <> '')
SELECT doc_id, CASE WHEN contains(ns[block + 1], snippet) THEN block ELSE list_min(list_filter(range(len(ns)), lambda i: contains(ns[i + 1], snippet))) END AS block, contains(ns[block + 1], snippet) AS same_block FROM m""")
def reanchored_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes found again after a line was put in front: in their block, else in the first one with their words."""
    ls = F.split("text", "\n")
    d = table(spark, sf_dir, "documents").select("doc_id", ls.alias("ls"), F.floor(F.size(ls) / 2).cast("int").alias("block"))
    d = d.withColumn("snippet", F.substring(F.get("ls", F.col("block")), 1, 30)).where("snippet <> ''").withColumn("ns", F.concat(F.array(F.lit("inserted")), "ls"))
    same = F.contains(F.get("ns", F.col("block")), F.col("snippet"))
    first = F.array_position(F.transform("ns", lambda x: F.contains(x, F.col("snippet"))), True) - 1
    return d.select("doc_id", F.when(same, F.col("block")).otherwise(first).cast("long").alias("block"), same.alias("same_block"))


@BOOK.query("""
WITH e AS (SELECT o_orderkey AS doc, list(l_partkey % 7 ORDER BY l_linenumber, l_partkey, l_suppkey) AS ids FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)
SELECT doc, array_to_string(ids[1:10], ' ') AS names, CASE WHEN len(ids) > 5 THEN 'broad' WHEN len(ids) > 2 THEN 'usual' ELSE 'narrow' END AS scope FROM e""")
def summary_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands for a document in an embedding or a prompt: its first ten concepts, and how broad it is."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("cs"))
    li = li.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc")), "doc", "left_semi")
    names = F.transform(F.slice("cs", F.lit(1), F.lit(10)), lambda c: (c["l_partkey"] % 7).cast("string"))
    return li.select("doc", F.array_join(names, " ").alias("names"), F.when(F.size("cs") > 5, "broad").when(F.size("cs") > 2, "usual").otherwise("narrow").alias("scope"))


@BOOK.query("SELECT CAST(round(100 * avg(p_size / 50.0)) AS BIGINT) AS novelty, p_brand FROM part WHERE p_size < 50 GROUP BY p_brand")
def average_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean novelty in percent; scores that are no numbers don't count."""
    score = F.when(F.col("p_size") < 50, F.col("p_size") / 50.0)
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(F.avg(score) * 100).cast("long").alias("novelty")).where("novelty is not null")


@BOOK.query("SELECT count(*) FILTER (l_partkey % 5 = 3) AS changed FROM lineitem")
def relinked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows a relinking changed."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_partkey").alias("before"))
    merges = table(spark, sf_dir, "part").where("p_partkey % 5 = 3").select(F.col("p_partkey").alias("source"), (F.col("p_partkey") - 3).alias("target"))
    return identity.relink(li, merges, ["l_partkey"]).agg(F.count_if(F.col("l_partkey") != F.col("before")).alias("changed"))


PACKS_SQL = """o AS (SELECT o_custkey AS target, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS at_ FROM orders),
i AS (SELECT target, at_, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos, 'c' || (l_partkey % 20) AS id, 'part ' || l_partkey AS text, l_orderkey FROM lineitem JOIN o ON o_orderkey = l_orderkey)"""


def _packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as packs: lines are cards, each tied to the next. They go through Markdown and back."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("ls"))
    card = lambda x: F.concat(F.lit("c"), (x["l_partkey"] % 20).cast("string"))
    items = F.transform("ls", lambda x: F.struct(card(x).alias("id"), F.concat(F.lit("part "), x["l_partkey"].cast("string")).alias("text"), x["l_suppkey"].cast("string").alias("answer")))
    ids = F.transform("ls", card)
    nodes = F.transform(F.array_distinct(ids), lambda x: F.struct(x.alias("id"), F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("label")))
    edges = F.zip_with(F.slice(ids, 1, F.size(ids) - 1), F.slice(ids, 2, F.size(ids)), lambda a, b: F.struct(F.concat_ws("-", a, b).alias("id"), a.alias("src"), b.alias("dst"), F.lit("next").alias("type")))
    pack = F.struct(F.lit("English").alias("language"), items.alias("items"), ids.alias("study_order"), nodes.alias("nodes"), edges.alias("edges"))
    o = table(spark, sf_dir, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    files = o.select(F.col("o_custkey").alias("target"), F.col("o_orderkey").alias("at"), P.pack_markdown(pack, F.lit("Pack")).alias("text"))
    return P.read_packs(files).where("status = 'ok'").select("target", "at", "pack")


@BOOK.query(f"WITH {PACKS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY target, id ORDER BY l_orderkey, pos) AS r FROM i) SELECT target, l_orderkey AS pack, CAST(pos AS INT) AS pos, CASE WHEN r = 1 THEN id ELSE id || '_' || r END AS id, text FROM r")
def merged_pack_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of packs merged for each customer, ids made unique by suffixes."""
    items = P.merge_packs(_packs(spark, sf_dir), parts=["items"])["items"]
    return items.select("target", F.col("at").alias("pack"), "pos", F.col("new_id").alias("id"), "text")


@BOOK.query(f"""WITH {PACKS_SQL}, e AS (SELECT target, l_orderkey, id AS src, lead(id) OVER (PARTITION BY l_orderkey ORDER BY pos) AS dst FROM i)
SELECT target, src, dst, min(l_orderkey) AS pack, src || '-' || dst AS id FROM e WHERE dst IS NOT NULL GROUP BY target, src, dst""")
def merged_pack_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ties of packs merged for each customer, each once."""
    e = P.merge_packs(_packs(spark, sf_dir), parts=["edges"])["edges"]
    return e.select("target", "src", "dst", F.col("at").alias("pack"), F.col("new_id").alias("id"))

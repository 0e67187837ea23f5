"""Queries of the study operators: chunking, budgets, merges, scopes, pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studyloom.functions import text as T
from studyloom.operators import folds, joins
from studyloom.plans.registry import Book
from studyloom.session import table

BOOK = Book()
LINES_SQL = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)"


@BOOK.query(f"""
WITH RECURSIVE {LINES_SQL},
r(doc_id, pos, chunk, used) AS (SELECT doc_id, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM documents
  UNION ALL
  SELECT l.doc_id, l.pos, CASE WHEN used = 0 OR used + 1 + length(line) <= 2000 THEN chunk ELSE chunk + 1 END,
    CASE WHEN used > 0 AND used + 1 + length(line) <= 2000 THEN used + 1 + length(line) ELSE greatest(length(line), 1) END
  FROM r JOIN l ON l.doc_id = r.doc_id AND l.pos = r.pos + 1)
SELECT doc_id, chunk, count(*) AS n_lines, max(used) AS chars FROM r WHERE pos > 0 GROUP BY ALL""")
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines packed in order into chunks of 2000 characters."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", "\n"), lambda x: F.length(x)).alias("ns"))
    d = d.select("doc_id", F.explode(F.arrays_zip(folds.chunk_numbers(F.col("ns"), 2000).alias("chunk"), F.col("ns").alias("n"))).alias("c"))
    g = d.groupBy("doc_id", F.col("c.chunk").cast("long").alias("chunk")).agg(F.count("*").alias("n_lines"), F.sum("c.n").alias("s"))
    return g.select("doc_id", "chunk", "n_lines", F.greatest(F.col("s") + F.col("n_lines") - 1, F.lit(1)).cast("long").alias("chars"))


@BOOK.query(f"""
WITH RECURSIVE {LINES_SQL}, q AS (SELECT doc_id, pos, unnest(list_transform(range(0, greatest(1, (length(line) + 299) // 300)), lambda i: line[i * 300 + 1:i * 300 + 300])) AS piece, generate_subscripts(list_transform(range(0, greatest(1, (length(line) + 299) // 300)), lambda i: i), 1) AS j FROM l),
p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, j) AS pos, length(piece) AS n FROM q),
r(doc_id, pos, chunk, used) AS (SELECT doc_id, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM documents UNION ALL
  SELECT p.doc_id, p.pos, CASE WHEN used = 0 OR used + 1 + n <= 300 THEN chunk ELSE chunk + 1 END, CASE WHEN used > 0 AND used + 1 + n <= 300 THEN used + 1 + n ELSE greatest(n, 1) END FROM r JOIN p ON p.doc_id = r.doc_id AND p.pos = r.pos + 1)
SELECT doc_id, chunk, count(*) AS pieces, max(used) AS chars FROM r WHERE pos > 0 GROUP BY ALL""")
def split_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines packed into chunks of 300 characters, longer ones cut first, so that no chunk is larger."""
    pieces = lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((n - 1) / 300).cast("int"))), lambda i: F.least(F.lit(300), n - i * 300))
    d = table(spark, sf_dir, "documents").select("doc_id", F.flatten(F.transform(F.split("text", "\n"), lambda x: pieces(F.length(x)))).alias("ns"))
    d = d.select("doc_id", F.explode(F.arrays_zip(folds.chunk_numbers(F.col("ns"), 300).alias("chunk"), F.col("ns").alias("n"))).alias("c"))
    g = d.groupBy("doc_id", F.col("c.chunk").cast("long").alias("chunk")).agg(F.count("*").alias("pieces"), F.sum("c.n").alias("s"))
    return g.select("doc_id", "chunk", "pieces", F.greatest(F.col("s") + F.col("pieces") - 1, F.lit(1)).cast("long").alias("chars"))


@BOOK.query(f"""
WITH RECURSIVE {LINES_SQL},
h AS (SELECT doc_id, len(regexp_extract_all(line, '[^ \\t\\n\\r\\f\\x0B]+')) AS level, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM l WHERE len(regexp_extract_all(line, '[^ \\t\\n\\r\\f\\x0B]+')) BETWEEN 1 AND 6),
r(doc_id, k, level) AS (SELECT DISTINCT doc_id, 0::BIGINT, 0::BIGINT FROM h UNION ALL SELECT h.doc_id, h.k, least(h.level, r.level + 1) FROM r JOIN h ON h.doc_id = r.doc_id AND h.k = r.k + 1)
SELECT doc_id, count(*) AS headings, CAST(sum(level) AS BIGINT) AS levels, max(level) AS deepest FROM r WHERE k > 0 GROUP BY doc_id""")
def smoothed_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of heading-like lines without jumps of more than one."""
    levels = F.filter(F.transform(F.split("text", "\n"), lambda x: T.word_count(x).cast("int")), lambda k: k.between(1, 6))
    d = table(spark, sf_dir, "documents").select("doc_id", folds.smooth_levels(levels).alias("ls")).where(F.size("ls") > 0)
    total = F.aggregate("ls", F.lit(0).cast("long"), lambda a, x: a + x)
    return d.select("doc_id", F.size("ls").cast("long").alias("headings"), total.alias("levels"), F.array_max("ls").cast("long").alias("deepest"))


@BOOK.query("""
WITH RECURSIVE o AS (SELECT p_brand, p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part),
r(p_brand, k, p_partkey, used, taken) AS (SELECT DISTINCT p_brand, 0::BIGINT, 0::BIGINT, 0::BIGINT, false FROM o
  UNION ALL SELECT o.p_brand, o.k, o.p_partkey, CASE WHEN used + p_size <= 150 THEN used + p_size ELSE used END, used + p_size <= 150 FROM r JOIN o ON o.p_brand = r.p_brand AND o.k = r.k + 1)
SELECT p_brand, p_partkey FROM r WHERE taken""")
def highlight_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dearest parts of a brand first, under a budget of 150 in size, passing over those that overflow."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size", (-F.col("p_retailprice")).alias("dear"))
    return folds.greedy_budget(p, "p_brand", ["dear", "p_partkey"], "p_size", 150).select("p_brand", "p_partkey")


@BOOK.query("""
WITH n AS (SELECT max(o_orderdate) AS now FROM orders),
w AS (SELECT o_custkey, least(1.0, 0.30 + 0.15 * (count(*) - 1)) AS w, max(o_orderdate) AS last FROM orders GROUP BY o_custkey)
SELECT o_custkey, round(CASE WHEN now - last >= INTERVAL 30 DAY THEN greatest(0.05, w - 0.10) ELSE w END, 6) AS weight FROM w, n""")
def connection_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0.30 at first, 0.15 more for each further order, 0.10 less after 30 idle days."""
    o = table(spark, sf_dir, "orders")
    now = o.agg((F.max("o_orderdate") - F.expr("INTERVAL 30 DAY")).alias("since"))
    w = o.groupBy("o_custkey").agg(F.least(F.lit(1.0), 0.30 + 0.15 * (F.count("*") - 1)).alias("w"), F.max("o_orderdate").alias("last"))
    idle = F.col("last") <= F.col("since")
    return w.crossJoin(F.broadcast(now)).select("o_custkey", F.round(F.when(idle, F.greatest(F.lit(0.05), F.col("w") - 0.10)).otherwise(F.col("w")), 6).alias("weight"))


@BOOK.query("""
WITH m AS (SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')) AS w FROM documents)
SELECT doc_id, block, block * w // 5 AS first_word, (block + 1) * w // 5 AS end_word FROM m, unnest(range(5)) AS b(block)""")
def block_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five study blocks for each document, in proportion to its words."""
    m = table(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).alias("w"), F.explode(F.sequence(F.lit(0), F.lit(4)).cast("array<bigint>")).alias("block"))
    at = lambda k: F.floor(k * F.col("w") / F.lit(5)).cast("long")
    return m.select("doc_id", "block", at(F.col("block")).alias("first_word"), at(F.col("block") + 1).alias("end_word"))


@BOOK.query("""
SELECT conv_id, min(turn) FILTER (role = 'user' AND coalesce(nxt, '') <> 'assistant') AS resume_at, count(*) FILTER (role = 'user' AND nxt = 'assistant') AS answered, count(*) FILTER (role = 'user') AS total
FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) GROUP BY conv_id""")
def resume_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first question of each conversation without an answer, and the progress."""
    c = table(spark, sf_dir, "conversations").withColumn("next", F.coalesce(F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("")))
    asked, answered = F.col("role") == "user", F.col("next") == "assistant"
    return c.groupBy("conv_id").agg(F.min(F.when(asked & ~answered, F.col("turn"))).alias("resume_at"), F.count_if(asked & answered).alias("answered"), F.count_if(asked).alias("total"))


@BOOK.query("""
WITH q AS (SELECT vec_id, embedding FROM embeddings),
s AS (SELECT q.vec_id AS a, e.vec_id AS b, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS c FROM q JOIN embeddings e ON q.vec_id <> e.vec_id),
k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(c, 9) DESC, b) <= 10)
SELECT least(a, b) AS lo, greatest(a, b) AS hi, round(max(c), 6) AS similarity, count(*) AS proposals FROM k GROUP BY ALL""")
def merge_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector as unordered pairs, the higher similarity kept."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    k = joins.nearest_neighbours(v, v, 10)
    return k.groupBy(F.least("query_id", "id").alias("lo"), F.greatest("query_id", "id").alias("hi")).agg(F.round(F.max("similarity"), 6).alias("similarity"), F.count("*").alias("proposals"))


@BOOK.query("""
WITH a AS (SELECT user_id, arg_max(value, event_id) AS v, max(event_id) AS e, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY user_id),
b AS (SELECT user_id, arg_max(value, event_id) AS v, max(event_id) AS e, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY user_id)
SELECT user_id, CASE WHEN a.e IS NULL OR b.e > a.e THEN b.v ELSE a.v END AS value, greatest(coalesce(a.n, 0), coalesce(b.n, 0)) AS longest FROM a FULL JOIN b USING (user_id)""")
def merged_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a user's row merged field by field: the later value, the longer list."""
    e = table(spark, sf_dir, "events")
    side = lambda kind, p: e.where(F.col("event_type") == kind).groupBy("user_id").agg(F.max_by("value", "event_id").alias(f"{p}v"), F.max("event_id").alias(f"{p}e"), F.count("*").alias(f"{p}n"))
    j = side("view", "a").join(side("error", "b"), "user_id", "full")
    later = F.when(F.col("ae").isNull() | (F.col("be") > F.col("ae")), F.col("bv")).otherwise(F.col("av"))
    return j.select("user_id", later.alias("value"), F.greatest(F.coalesce("an", F.lit(0)), F.coalesce("bn", F.lit(0))).alias("longest"))


@BOOK.query("""
WITH s AS (SELECT n_regionkey, n_nationkey, count(*) AS k, count(*) FILTER (s_acctbal > 0) AS on_ FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL),
n AS (SELECT n_regionkey, n_nationkey, CASE WHEN on_ = k THEN 'checked' WHEN on_ = 0 THEN 'unchecked' ELSE 'indeterminate' END AS st FROM s)
SELECT r_name AS name, CASE WHEN min(st) = max(st) THEN min(st) ELSE 'indeterminate' END AS state FROM n JOIN region ON r_regionkey = n_regionkey GROUP BY r_name
UNION ALL SELECT n_name, st FROM n JOIN nation USING (n_nationkey)""")
def scope_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tri-state boxes from the leaves up: suppliers with a balance, nations, regions."""
    r, n, s = (table(spark, sf_dir, x) for x in ("region", "nation", "supplier"))
    g = s.join(n, s["s_nationkey"] == n["n_nationkey"]).groupBy("n_regionkey", "n_name").agg(F.count("*").alias("k"), F.count_if(F.col("s_acctbal") > 0).alias("on"))
    nations = g.select("n_regionkey", F.col("n_name").alias("name"), F.when(F.col("on") == F.col("k"), "checked").when(F.col("on") == 0, "unchecked").otherwise("indeterminate").alias("state"))
    up = nations.groupBy("n_regionkey").agg(F.when(F.min("state") == F.max("state"), F.min("state")).otherwise("indeterminate").alias("state"))
    regions = up.join(r, up["n_regionkey"] == r["r_regionkey"]).select(F.col("r_name").alias("name"), "state")
    return regions.unionByName(nations.select("name", "state"))


@BOOK.query(f"""
WITH {LINES_SQL}, d AS (SELECT source, count(*) AS docs FROM documents GROUP BY source),
g AS (SELECT source, lower(trim(line)) AS header, count(DISTINCT doc_id) AS n FROM l JOIN documents USING (doc_id) WHERE trim(line) <> '' GROUP BY ALL)
SELECT source, header, n FROM g JOIN d USING (source) WHERE n >= greatest(2, ceil(0.05 * docs))""")
def running_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a source repeats in a twentieth of its documents, two at least."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    least = d.groupBy("source").agg(F.greatest(F.lit(2), F.ceil(0.05 * F.count("*"))).alias("least"))
    lines = d.select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.trim("line") != "")
    g = lines.groupBy("source", F.lower(F.trim("line")).alias("header")).agg(F.count_distinct("doc_id").alias("n"))
    return g.join(least, "source").where("n >= least").select("source", "header", "n")


@BOOK.query("SELECT p_partkey, p_brand, least(6, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC)) AS level FROM part")
def size_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes as heading levels, the largest first, six at most."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    # ranked are the distinct sizes of a brand, not its parts
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_size")))
    sizes = p.select("p_brand", "p_size").distinct().withColumn("level", F.least(F.lit(6), rank).cast("long"))
    return p.join(sizes, ["p_brand", "p_size"]).select("p_partkey", "p_brand", "level")


@BOOK.query("""
WITH n AS (SELECT max(ts) AS now FROM events), p AS (
  SELECT 'facet' AS pool, user_id, min(ts) + INTERVAL 7 DAY AS due FROM events WHERE event_type = 'signup' GROUP BY user_id
  UNION ALL SELECT 'item', user_id, max(ts) + INTERVAL 1 DAY FROM events WHERE event_type = 'purchase' GROUP BY user_id
  UNION ALL SELECT 'vault', user_id, max(ts) FROM events WHERE event_type = 'error' GROUP BY user_id)
SELECT pool, count(*) AS items, count(*) FILTER (due <= now) AS due FROM p, n GROUP BY pool""")
def review_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Due counts over three pools of review items."""
    e = table(spark, sf_dir, "events")
    pool = lambda name, kind, due: e.where(F.col("event_type") == kind).groupBy("user_id").agg(due.alias("due")).select(F.lit(name).alias("pool"), "user_id", "due")
    p = pool("facet", "signup", F.min("ts") + F.expr("INTERVAL 7 DAY")).unionByName(pool("item", "purchase", F.max("ts") + F.expr("INTERVAL 1 DAY"))).unionByName(pool("vault", "error", F.max("ts")))
    p = p.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now"))))
    return p.groupBy("pool").agg(F.count("*").alias("items"), F.count_if(F.col("due") <= F.col("now")).alias("due"))


@BOOK.query("""
WITH q AS (SELECT vec_id, embedding, label FROM embeddings),
s AS (SELECT q.vec_id AS a, e.vec_id AS b, q.label = e.label AS same, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS c FROM q JOIN embeddings e ON q.vec_id <> e.vec_id),
k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(c, 9) DESC, b) <= 20)
SELECT a, b, CASE WHEN NOT same THEN 'language' WHEN c < 0.25 THEN 'similarity' WHEN (a + b) % 7 = 0 THEN 'rejected before' END AS failed_gate,
  CASE WHEN NOT same OR c < 0.25 OR (a + b) % 7 = 0 THEN 'rejected' WHEN c >= 0.30 THEN 'proposal' ELSE 'suggestion' END AS outcome FROM k""")
def dedup_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates over the 20 nearest of every vector: same label, similarity 0.25, no earlier rejection (test data: ids that sum to a multiple of 7)."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    k = joins.nearest_neighbours(v, v, 20).select(F.col("query_id").alias("a"), F.col("id").alias("b"), "similarity")
    label = lambda x: v.select(F.col("id").alias(x), F.col("label").alias(f"{x}_label"))
    k = k.join(label("a"), "a").join(label("b"), "b")
    failed = F.when(F.col("a_label") != F.col("b_label"), "language").when(F.col("similarity") < 0.25, "similarity").when((F.col("a") + F.col("b")) % 7 == 0, "rejected before")
    outcome = F.when(failed.isNotNull(), "rejected").when(F.col("similarity") >= 0.30, "proposal").otherwise("suggestion")
    return k.select("a", "b", failed.alias("failed_gate"), outcome.alias("outcome"))


@BOOK.query("""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM documents),
t AS (SELECT doc_id, ws, ws[1:3] AS terms, unnest(range(0, greatest(1, len(ws)), 20)) AS start FROM w),
h AS (SELECT doc_id, start, len(list_filter(ws[start + 1:start + 80], lambda x: list_contains(terms, x))) AS hits FROM t)
SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(hits AS BIGINT) AS hits FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, start) = 1""")
def anchor_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window of 80 words, of those at every 20th, with most hits of a document's first three words."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}\\p{N}]+"), F.lit(0)).alias("ws"))
    # a hit counts for the windows that hold its place: at most four
    hit = F.filter(F.transform("ws", lambda w, i: F.when(F.array_contains(F.slice("ws", 1, 3), w), i)), lambda i: i.isNotNull())
    first = F.greatest(F.lit(0), F.floor((F.col("i") - 79 + 19) / 20)).cast("int")
    hits = d.select("doc_id", F.explode(hit).alias("i")).select("doc_id", F.explode(F.sequence(first, F.floor(F.col("i") / 20).cast("int"))).alias("k"))
    h = hits.groupBy("doc_id", (F.col("k") * 20).cast("long").alias("start")).agg(F.count("*").alias("hits"))
    best = h.groupBy("doc_id").agg(F.max_by(F.struct("start", "hits"), F.struct(F.col("hits"), -F.col("start"))).alias("b"))
    zero = F.lit(0).cast("long")
    return d.select("doc_id").join(best, "doc_id", "left").select("doc_id", F.coalesce("b.start", zero).alias("start"), F.coalesce("b.hits", zero).alias("hits"))

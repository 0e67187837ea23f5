"""Queries on documents, labels, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studyloom.functions import numeric as N
from studyloom.functions import text as T
from studyloom.operators import joins
from studyloom.plans.registry import Book
from studyloom.session import table

BOOK = Book()
FIRST_PERSON_SQL = ", ".join(f"'{w}'" for w in T.FIRST_PERSON)


@BOOK.query(f"""
WITH m AS (SELECT doc_id, length(text) AS chars, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')) AS n_words,
  len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda t: t IN ({FIRST_PERSON_SQL}))) AS first_person,
  len(string_split(text, chr(10))) AS n_lines FROM documents)
SELECT doc_id, chars, n_words, CAST(ceil(n_words / 200.0) AS BIGINT) AS minutes, first_person, n_lines,
  round(CASE WHEN n_words > 0 THEN first_person / n_words ELSE 0 END, 6) AS first_person_ratio,
  CASE WHEN chars < 2000 THEN 'tiny' WHEN chars < 8000 THEN 'short' WHEN chars < 30000 THEN 'medium' WHEN chars < 80000 THEN 'long' ELSE 'very_long' END AS size
FROM m""")
def text_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    m = table(spark, sf_dir, "documents").select("doc_id", F.length(t).cast("long").alias("chars"), T.word_count(t).alias("n_words"), T.first_person_count(t).alias("first_person"), F.size(F.split(t, "\n")).cast("long").alias("n_lines"))
    ratio = F.when(F.col("n_words") > 0, F.col("first_person") / F.col("n_words")).otherwise(0.0)
    return m.select("doc_id", "chars", "n_words", T.read_minutes(F.col("n_words")).alias("minutes"), "first_person", "n_lines", F.round(ratio, 6).alias("first_person_ratio"), T.size_category(F.col("chars")).alias("size"))


@BOOK.query("""
SELECT doc_id,
  len(list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda t: length(t) >= 3))) AS tokens_a,
  len(list_distinct(list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^a-z0-9]+'), lambda t: length(t) >= 4))) AS tokens_b,
  len(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^A-Za-z0-9_]+'), lambda t: length(t) >= 4))) AS tokens_c
FROM documents""")
def token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    sets = {"tokens_a": T.token_set_a(t), "tokens_b": T.token_set_b(t), "tokens_c": T.token_set_c(t)}
    return table(spark, sf_dir, "documents").select("doc_id", *(F.size(c).cast("long").alias(k) for k, c in sets.items()))


@BOOK.query("""
SELECT doc_id, substr(sha1(trim(regexp_replace(text, '\\r\\n?', chr(10), 'g'))), 1, 12) AS sha1_12, sha256(text) AS sha256,
  lpad(lower(to_hex(list_reduce(list_transform(string_split(text, ''), lambda c: CAST(ord(c) AS BIGINT)), lambda h, c: xor((h * 33) & 4294967295, c), CAST(5381 AS BIGINT)))), 8, '0') AS djb2
FROM documents""")
def doc_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", N.doc_hash(t).alias("sha1_12"), F.sha2(t, 256).alias("sha256"), N.djb2(t).alias("djb2"))


@BOOK.query("""
SELECT doc_id, trim(regexp_replace(substr(trim(regexp_replace(lower(string_split(text, chr(10))[1]), '[^a-z0-9]+', '-', 'g'), '-'), 1, 80), '-+$', '')) AS slug
FROM documents""")
def title_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.slug(F.split("text", "\n")[0]).alias("slug"))


@BOOK.query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
SELECT doc_id, CAST(pos AS BIGINT) AS pos, length(line) AS chars,
  CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
FROM l""")
def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return lines.select("doc_id", F.col("pos").cast("long").alias("pos"), F.length("line").cast("long").alias("chars"), F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("long").alias("start"))


HEADINGS_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
w AS (SELECT doc_id, pos, len(regexp_extract_all(line, '[^ \\t\\n\\r\\f\\x0B]+')) AS level FROM l),
h AS (SELECT doc_id, CAST(pos AS BIGINT) AS pos, level FROM w WHERE level BETWEEN 1 AND 6)
"""


@BOOK.query(
    HEADINGS_SQL
    + """
SELECT a.doc_id, a.pos, CAST(a.level AS BIGINT) AS level,
  (SELECT min(b.pos) FROM h b WHERE b.doc_id = a.doc_id AND b.pos > a.pos AND b.level <= a.level) AS span_end,
  (SELECT max(b.pos) FROM h b WHERE b.doc_id = a.doc_id AND b.pos < a.pos AND b.level < a.level) AS parent
FROM h a"""
)
def heading_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines stand in for headings, their words for levels 1 to 6; spans end at the next of no deeper level."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    h = lines.select("doc_id", F.col("pos").cast("long").alias("pos"), T.word_count(F.col("line")).alias("level")).where("level between 1 and 6")
    ordered = Window.partitionBy("doc_id").orderBy("pos")
    after, before = ordered.rowsBetween(1, Window.unboundedFollowing), ordered.rowsBetween(Window.unboundedPreceding, -1)
    at = lambda k: F.when(F.col("level") == k, F.col("pos"))
    h = h.select("*", *(F.min(at(k)).over(after).alias(f"n{k}") for k in range(1, 7)), *(F.max(at(k)).over(before).alias(f"p{k}") for k in range(1, 7)))
    end = F.least(*(F.when(F.col("level") >= k, F.col(f"n{k}")) for k in range(1, 7)))
    parent = F.greatest(*(F.when(F.col("level") > k, F.col(f"p{k}")) for k in range(1, 7)))
    return h.select("doc_id", "pos", "level", end.alias("span_end"), parent.alias("parent"))


@BOOK.query("""
WITH m AS (SELECT doc_id, length(text) AS chars, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')) AS w, len(string_split(text, chr(10))) AS sections FROM documents),
c AS (SELECT *, greatest(1, w // 100) AS concepts FROM m)
SELECT doc_id, CAST(least(60, greatest(5, floor(CASE WHEN chars < 2000 THEN least(8, n) ELSE n END * 1.0 + 0.5))) AS BIGINT) AS blocks,
  CAST(least(120, greatest(30, floor(w / 300.0 + 0.5) * 2)) AS BIGINT) AS concept_target,
  CAST(greatest(5, chars // 5000) AS BIGINT) AS viable_minimum,
  CAST(least(50, greatest(least(40, greatest(4, ceil(concepts / 2))) + least(12, greatest(0, CASE WHEN sections >= 4 THEN greatest(2, ceil(0.35 * sections)) ELSE least(2, sections) END)),
    CASE WHEN concepts < 12 THEN least(8, greatest(3, concepts)) ELSE 8 END)) AS BIGINT) AS questions
FROM (SELECT *, greatest(ceil(concepts / 3.5), ceil(w / 2200.0), sections) AS n FROM c)""")
def study_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block count, concept target and question budget; a concept for each 100 words, a section for each line, load 3."""
    t = F.col("text")
    m = table(spark, sf_dir, "documents").select("doc_id", F.length(t).cast("long").alias("chars"), T.word_count(t).alias("w"), F.size(F.split(t, "\n")).cast("long").alias("sections"))
    m = m.withColumn("concepts", F.greatest(F.lit(1), F.floor(F.col("w") / 100)))
    c = F.col
    blocks = N.block_count(c("concepts"), c("w"), c("sections"), F.lit(3), F.lit(1.0), c("chars") < 2000)
    return m.select("doc_id", blocks.alias("blocks"), N.concept_target(c("w")).alias("concept_target"), N.viable_minimum(c("chars")).alias("viable_minimum"), N.assessment_budget(c("concepts"), c("sections")).alias("questions"))


@BOOK.query("""
SELECT lang, tier, count(*) AS n, CAST(sum(n_reasons) AS BIGINT) AS reasons FROM (
  SELECT d.lang, (length(text) < 500)::INT + (quality = 0 AND quality IS NOT NULL)::INT + (toxic = 1 AND toxic IS NOT NULL)::INT + (quality IS NULL)::INT AS n_reasons,
    CASE WHEN length(text) < 500 OR coalesce(quality, 1) = 0 THEN 'poor' WHEN coalesce(toxic, 0) = 1 OR quality IS NULL THEN 'degraded' ELSE 'good' END AS tier
  FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY ALL""")
def quality_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").alias("chars")).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    reasons = F.array_compact(F.array(F.when(F.col("chars") < 500, "short"), F.when(F.col("quality") == 0, "low quality"), F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality").isNull(), "unlabelled")))
    j = j.withColumn("reasons", reasons)
    poor = F.exists("reasons", lambda r: r.isin("short", "low quality"))
    tier = F.when(poor, "poor").when(F.size("reasons") > 0, "degraded").otherwise("good")
    return j.groupBy("lang", tier.alias("tier")).agg(F.count("*").alias("n"), F.sum(F.size("reasons")).alias("reasons"))


NEAR_SQL = """
WITH RECURSIVE t AS (SELECT doc_id, length(text) AS chars, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^A-Za-z0-9_]+'), lambda t: length(t) >= 4)) AS ts FROM documents),
x AS (SELECT doc_id, unnest(ts) AS tok FROM t),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM x a JOIN x b ON a.tok = b.tok AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN t ta ON ta.doc_id = p.a JOIN t tb ON tb.doc_id = p.b WHERE common / (len(ta.ts) + len(tb.ts) - common) >= 0.85),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT s.b, r.root FROM r JOIN s ON s.a = r.id),
c AS (SELECT id AS doc_id, min(root) AS class_id FROM r GROUP BY id)
SELECT class_id, count(*) AS n_docs, arg_min(c.doc_id, struct_pack(a := -chars, b := c.doc_id)) AS survivor, max(chars) AS chars
FROM c JOIN t USING (doc_id) GROUP BY class_id"""


@BOOK.query(NEAR_SQL)
def near_duplicate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with token Jaccard 0.85 or more, as classes; the longest text survives, then the lowest id."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    classes = joins.set_similarity_classes(docs.select("id", T.token_hashes_c(F.col("text")).alias("members")), 0.85)
    j = classes.join(docs.select("id", F.length("text").cast("long").alias("chars")), "id")
    best = F.max_by("id", F.struct(F.col("chars"), -F.col("id")))
    return j.groupBy("class_id").agg(F.count("*").alias("n_docs"), best.alias("survivor"), F.max("chars").alias("chars"))


@BOOK.query("""
SELECT page_id, regexp_extract(html, '<h1[^>]*>([^<]*)', 1) AS h1, len(regexp_extract_all(html, '<p[ >]')) AS paragraphs, len(regexp_extract_all(html, '<a ')) AS links,
  length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|<nav.*?</nav>|<footer.*', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))) AS text_chars
FROM pages""")
def page_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading, paragraph and link counts, and the text left once menus, scripts and footers are cut by pattern."""
    h = F.col("html")
    bare = F.regexp_replace(h, "(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|<nav.*?</nav>|<footer.*", " ")
    bare = F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", " "), "[ \\t\\n\\r]+", " "))
    count = lambda p: F.regexp_count(h, F.lit(p)).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(h, "<h1[^>]*>([^<]*)", 1).alias("h1"), count("<p[ >]").alias("paragraphs"), count("<a ").alias("links"), F.length(bare).cast("long").alias("text_chars"))


@BOOK.query("""
SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS asked, count(*) FILTER (role = 'user' AND nxt = 'assistant') AS answered, CAST(sum(length(text)) AS BIGINT) AS chars
FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) GROUP BY conv_id""")
def answered_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("next", F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    user = F.col("role") == "user"
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(user).alias("asked"), F.count_if(user & (F.col("next") == "assistant")).alias("answered"), F.sum(F.length("text")).alias("chars"))


@BOOK.query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.col("role"), F.lit(": "), F.col("text"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("ls"))
    return rows.select("conv_id", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("transcript"))


@BOOK.query("""
SELECT lang, grouping(source) AS is_total, CASE WHEN grouping(source) = 1 THEN 'all' ELSE source END AS source, count(*) AS n, round(avg(length(text)), 4) AS mean_chars, count(DISTINCT text) AS texts
FROM documents GROUP BY GROUPING SETS ((lang, source), (lang))""")
def source_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("lang", "source", F.length("text").alias("chars"), F.sha2("text", 256).alias("h"))
    g = d.groupingSets([["lang", "source"], ["lang"]], "lang", "source").agg(F.grouping("source").cast("long").alias("is_total"), F.count("*").alias("n"), F.round(F.avg("chars"), 4).alias("mean_chars"), F.count_distinct("h").alias("texts"))
    return g.select("lang", "is_total", F.when(F.col("is_total") == 1, "all").otherwise(F.col("source")).alias("source"), "n", "mean_chars", "texts")

"""Queries on the structure of texts: labels, headings, sections, chunks, tables, sources.

Lines of documents stand for blocks; where a label of a certain form is wanted, it is made
of a part's columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studyloom.functions import structure as S
from studyloom.functions import text as T
from studyloom.operators import distractors as D
from studyloom.operators import hierarchy as H
from studyloom.plans.registry import Book
from studyloom.session import table
from studyloom.sources import readers

BOOK = Book()
LINES_SQL = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)"
WORDS = "[^ \\t\\n\\r\\f\\x0B]+"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return d.select("doc_id", (F.col("at") + 1).cast("long").alias("pos"), "line")


@BOOK.query("""
SELECT doc_id, md5(strip_accents(lower(text))) AS folded, len(list_filter(regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]+'), lambda x: length(x) >= 4)) AS tokens FROM documents""")
def folded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in lower case without accents, and their tokens of four letters or more."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(T.fold_accents(F.col("text"))).alias("folded"), F.size(T.token_list_d(F.col("text"))).cast("long").alias("tokens"))


@BOOK.query("""
WITH p AS (SELECT a.p_partkey, a.p_name AS x, b.p_name AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
q AS (SELECT *, string_split(x, ' ') AS wx, string_split(y, ' ') AS wy, greatest(length(x), length(y)) AS n FROM p)
SELECT p_partkey, round(len(list_filter(wx, lambda w: list_contains(wy, w))) / greatest(len(wx), len(wy)), 6) AS overlap, round(len(list_filter(range(1, n + 1), lambda i: i <= length(x) AND i <= length(y) AND x[i] = y[i])) / n, 6) AS positional FROM q""")
def name_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two measures of how alike a name and the next one are: shared words, and equal characters in place."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("x"))
    q = p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("x").alias("y")), "p_partkey")
    return q.select("p_partkey", F.round(T.overlap_ratio(F.split("x", " "), F.split("y", " ")), 6).alias("overlap"), F.round(T.positional_similarity(F.col("x"), F.col("y")), 6).alias("positional"))


LABEL_SQL = "x AS (SELECT p_partkey, p_brand, (p_size % 4) || CASE WHEN p_partkey % 3 > 0 THEN '.' || (p_partkey % 7) ELSE '' END AS num, '  “' || p_name || '” – ' || p_type || ' ' AS title FROM part)"


@BOOK.query(f"""
WITH {LABEL_SQL} SELECT p_partkey, num || ' "' || string_split(title, '“')[2].string_split('”')[1] || '" - ' || trim(string_split(title, '–')[2]) AS label, num AS number, len(string_split(num, '.')) AS depth FROM x""")
def heading_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with plain quotes and dashes, and the section number that they begin with."""
    p = _labels(spark, sf_dir)
    number = T.section_number(F.col("label"))
    return p.select("p_partkey", "label", F.array_join(F.transform(number, lambda x: x.cast("string")), ".").alias("number"), F.size(number).cast("long").alias("depth"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    number = F.concat((F.col("p_size") % 4).cast("string"), F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("."), (F.col("p_partkey") % 7).cast("string"))).otherwise(""))
    return p.select("p_partkey", "p_brand", "p_name", T.heading_label(F.concat(number, F.lit("  “"), "p_name", F.lit("” – "), "p_type", F.lit(" "))).alias("label"))


@BOOK.query("""
WITH x AS (SELECT p_partkey, p_brand, p_size = 7 AS abstract, CASE WHEN p_size % 5 > 0 THEN [p_size % 5, (p_partkey % 7)::INT] END AS num, lower(p_name) AS label FROM part)
SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY NOT abstract, num IS NULL, num[1], num[2], label, p_partkey) AS place FROM x""")
def heading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The abstract first, then numbered sections by their numbers, then the others by name."""
    number = F.when(F.col("p_size") % 5 > 0, F.array(F.col("p_size") % 5, (F.col("p_partkey") % 7).cast("int")))
    w = Window.partitionBy("p_brand").orderBy((F.col("p_size") != 7), number.isNull(), number, F.lower("p_name"), "p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.row_number().over(w).cast("long").alias("place"))


@BOOK.query(f"""
WITH {LINES_SQL}, t AS (SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(13)) AS t FROM l),
g AS (SELECT *, length(t) AS n, length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(t, '[\\p{{L}}\\p{{N}}\\s.,;:''"?!()\\-/–—]', '', 'g')) AS odd FROM t)
SELECT doc_id, pos::BIGINT AS pos, t = '' OR regexp_matches(t, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]|\\x{{FFFD}}') OR regexp_matches(t, '(?i)&#\\d+;|&[a-z]+;') OR (n >= 6 AND letters > 0 AND odd > 0.22 * n) OR (n >= 8 AND letters < 0.35 * n) OR (n >= 20 AND NOT regexp_matches(t, '\\s') AND regexp_matches(t, '[A-Za-z]{{12,}}')) AS garbage FROM g""")
def garbage_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that no heading can be: control characters, entities, few letters, glued words."""
    return _lines(spark, sf_dir).select("doc_id", "pos", S.is_garbage(F.btrim(F.col("line"), F.lit(" \t\r"))).alias("garbage"))


@BOOK.query(f"""
WITH {LINES_SQL}, t AS (SELECT doc_id, pos, trim(line) AS t FROM l),
g AS (SELECT *, length(t) AS n, length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(t, '\\D', '', 'g')) AS digits, length(regexp_replace(t, '[\\p{{L}}\\p{{N}}\\s.,;:''"?!()\\-/–—]', '', 'g')) AS odd FROM t)
SELECT doc_id, pos::BIGINT AS pos, CASE
  WHEN t = '' OR regexp_matches(t, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]|\\x{{FFFD}}') OR regexp_matches(t, '(?i)&#\\d+;|&[a-z]+;') OR (n >= 6 AND letters > 0 AND odd > 0.22 * n) OR (n >= 8 AND letters < 0.35 * n) OR (n >= 20 AND NOT regexp_matches(t, '\\s') AND regexp_matches(t, '[A-Za-z]{{12,}}')) THEN 'garbage'
  WHEN regexp_matches(t, '\\S@\\S+\\.\\S') OR regexp_matches(t, '(?i)\\b(https?://|www\\.)\\S') OR (digits >= 8 AND digits > letters) THEN 'contact'
  WHEN regexp_matches(lower(t), '^({"|".join(S.CAPTION_WORDS)})\\.?\\s+\\d') THEN 'caption'
  WHEN regexp_matches(t, '^([*†‡§]+|\\[\\d{{1,3}}\\]|[¹²³⁰-⁹]+)\\s*\\S') AND regexp_matches(t, '[.!?]$') THEN 'note'
  WHEN regexp_matches(t, '^\\p{{Lu}}[\\p{{Lu}}\\p{{N}} ]+:\\s*\\S') THEN 'label'
  WHEN regexp_matches(t, '^[\\p{{Ll}}(]') AND regexp_matches(t, '[.!?]$') THEN 'fragment' END AS why FROM g""")
def heading_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each line can't be a heading, null where it could."""
    return _lines(spark, sf_dir).select("doc_id", "pos", S.not_heading(F.col("line")).alias("why"))


@BOOK.query(f"""
WITH {LINES_SQL}, t AS (SELECT doc_id, pos, trim(line) AS t, 10 + (pos % 4) * 2 AS size, pos % 5 = 0 AS bold, pos = 1 AS edge, len(regexp_extract_all(line, '{WORDS}')) AS w FROM l)
SELECT doc_id, pos::BIGINT AS pos, round(CASE WHEN regexp_matches(t, '^#{{1,6}}\\s') THEN 100 ELSE CASE WHEN size >= 1.15 * 10 THEN least(30, round((size / 10 - 1) * 100, 6)) ELSE 0 END + CASE WHEN bold THEN 15 ELSE 0 END + CASE WHEN w <= 12 THEN 10 ELSE 0 END + CASE WHEN regexp_matches(t, '[.,;]$') THEN 0 ELSE 10 END
  + CASE WHEN regexp_matches(t, '^\\d+(\\.\\d+)*[.)]?\\s') THEN 20 ELSE 0 END + CASE WHEN t = upper(t) AND regexp_matches(t, '[A-Z]') THEN 10 ELSE 0 END - CASE WHEN edge THEN 50 ELSE 0 END END, 6)::DOUBLE AS score FROM t""")
def heading_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much each line looks like a heading, by size, weight, length, marks and place."""
    pos = F.col("pos")
    return _lines(spark, sf_dir).select("doc_id", "pos", S.heading_score(F.trim("line"), (10 + (pos % 4) * 2).cast("double"), F.lit(10.0), pos % 5 == 0, pos == 1).alias("score"))


@BOOK.query("""
WITH h AS (SELECT doc_id, len(string_split(text, chr(10))) AS k, length(text) AS n, doc_id % 17 = 0 AS outline FROM documents)
SELECT doc_id, CASE WHEN outline OR least(k - 1, 5) - 2 >= 3 THEN 'high' WHEN least(k - 1, 5) > 0 THEN 'medium' ELSE 'low' END AS confidence FROM h""")
def heading_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sure the headings of a document are: its first breaks stand for headings, those from the third on are strong."""
    d = table(spark, sf_dir, "documents")
    k = F.least(F.size(F.split("text", "\n")) - 1, F.lit(5))
    scores = F.when(k > 0, F.transform(F.sequence(F.lit(1), k), lambda i: F.when(i > 2, 60).otherwise(40))).otherwise(F.array().cast("array<int>"))
    return d.select("doc_id", S.confidence(F.col("doc_id") % 17 == 0, scores, F.length("text")).alias("confidence"))


@BOOK.query("""
WITH t AS (SELECT CASE p_size % 5 WHEN 0 THEN 'Key terms: ' WHEN 1 THEN 'OVERVIEW: ' WHEN 2 THEN 'An Excursus on ' WHEN 3 THEN 'course map: ' ELSE '' END || p_name AS title FROM part)
SELECT CASE WHEN lower(title) LIKE 'key terms:%' THEN 'key_terms' WHEN lower(title) LIKE 'overview:%' OR lower(title) LIKE 'course map:%' THEN 'overview' WHEN lower(title) LIKE '%excursus%' THEN 'excursus' ELSE 'development' END AS type, count(*) AS n FROM t GROUP BY 1""")
def block_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of blocks by their titles."""
    k = F.col("p_size") % 5
    lead = F.when(k == 0, "Key terms: ").when(k == 1, "OVERVIEW: ").when(k == 2, "An Excursus on ").when(k == 3, "course map: ").otherwise("")
    return table(spark, sf_dir, "part").groupBy(S.block_type(F.concat(lead, "p_name")).alias("type")).agg(F.count("*").alias("n"))


@BOOK.query("""
WITH m AS (SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda x: x IN ('i', 'me', 'my', 'mine', 'we', 'us', 'our', 'ours', 'yo', 'mi', 'mis', 'nosotros', 'nuestro', 'nuestra'))) / greatest(1, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+'))) AS fp, source LIKE '%1%' AS bib, contains(text, '=') AS math, regexp_matches(text, '(^|\\n)#') AS heads, contains(text, ':') AS defs, (doc_id % 10) / 100.0 AS vocab, (doc_id % 3) / 3.0 AS long FROM documents),
g AS (SELECT doc_id, CASE WHEN fp > 0.03 THEN 'lecture_notes' WHEN bib AND math THEN 'scientific_empirical' WHEN vocab > 0.05 AND long > 0.25 THEN 'philosophical' WHEN bib THEN 'scientific_theoretical' WHEN heads AND defs THEN 'textbook_chapter' WHEN fp > 0.01 THEN 'essay' ELSE 'unknown' END AS genre FROM m)
SELECT doc_id, genre, CASE WHEN genre IN ('philosophical', 'essay') THEN 'understand_argument' WHEN genre IN ('lecture_notes', 'textbook_chapter') THEN 'memorize_facts' ELSE 'survey_field' END AS goal FROM g""")
def genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The genre of each document and what to learn from it; its id stands for the measures that the texts lack."""
    t, k = F.col("text"), F.col("doc_id")
    share = T.first_person_count(t) / F.greatest(F.lit(1), T.word_count(t))
    g = S.genre(share, F.contains("source", F.lit("1")), F.contains(t, F.lit("=")), (k % 10) / 100.0, (k % 3) / 3.0, t.rlike("(^|\n)#"), F.contains(t, F.lit(":")))
    return table(spark, sf_dir, "documents").select("doc_id", g.alias("genre")).withColumn("goal", S.learning_goal(F.col("genre")))


@BOOK.query("""
WITH x AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents WHERE length(text) >= 2000), y AS (SELECT *, length(t) AS n, length(t) // 2 AS mid FROM x),
z AS (SELECT *, CASE WHEN contains(t[1:mid + 2], chr(10) || chr(10)) THEN length(t[1:mid + 2]) - (instr(reverse(t[1:mid + 2]), chr(10) || chr(10)) - 1) - 2 ELSE -1 END AS b FROM y),
w AS (SELECT *, CASE WHEN b < 0.25 * n THEN CASE WHEN instr(t[mid + 1:], chr(10) || chr(10)) > 0 THEN mid + instr(t[mid + 1:], chr(10) || chr(10)) - 1 ELSE -1 END ELSE b END AS c FROM z),
h AS (SELECT doc_id, trim(t[1:CASE WHEN c < 0 THEN mid ELSE c END], ' ' || chr(9) || chr(10) || chr(13)) AS l, trim(t[CASE WHEN c < 0 THEN mid ELSE c END + 1:], ' ' || chr(9) || chr(10) || chr(13)) AS r FROM w)
SELECT doc_id, length(l) AS left_chars, length(r) AS right_chars, md5(l) AS left_md5 FROM h WHERE l <> '' AND r <> ''""")
def bisected_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long texts cut in two at the blank line nearest the middle."""
    t = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    d = table(spark, sf_dir, "documents").where(F.length("text") >= 2000).select("doc_id", S.bisected(t).alias("h")).where("h is not null")
    return d.select("doc_id", F.length(F.col("h")[0]).cast("long").alias("left_chars"), F.length(F.col("h")[1]).cast("long").alias("right_chars"), F.md5(F.col("h")[0]).alias("left_md5"))


@BOOK.query("""
WITH RECURSIVE x AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents WHERE text <> ''),
r(doc_id, t, k, s, e) AS (SELECT doc_id, t, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM x UNION ALL
  SELECT doc_id, t, k + 1, e, CASE WHEN stop < length(t) AND contains(t[e + 1:stop], chr(10) || chr(10)) AND (stop - e) - (instr(reverse(t[e + 1:stop]), chr(10) || chr(10)) - 1) - 2 > 2500 THEN stop - (instr(reverse(t[e + 1:stop]), chr(10) || chr(10)) - 1) - 2 ELSE stop END FROM (SELECT *, least(e + 5000, length(t)) AS stop FROM r) WHERE e < length(t))
SELECT doc_id, k AS section, s AS first_char, e AS end_char FROM r WHERE k > 0""")
def equal_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of 5000 characters for texts without headings, cut at blank lines."""
    d = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("t"))
    d = d.select("doc_id", F.posexplode(S.equal_sections(F.col("t"))).alias("k", "s"))
    return d.select("doc_id", (F.col("k") + 1).cast("long").alias("section"), F.col("s.start").cast("long").alias("first_char"), F.col("s.end").cast("long").alias("end_char"))


@BOOK.query(f"""
WITH RECURSIVE {LINES_SQL}, w AS (SELECT doc_id, pos, len(regexp_extract_all(line, '{WORDS}')) AS n FROM l),
r(doc_id, pos, chunk, used, alone) AS (SELECT DISTINCT doc_id, 0::BIGINT, -1, 0::BIGINT, true FROM w UNION ALL
  SELECT w.doc_id, w.pos, CASE WHEN n > 100 OR alone OR (used + n > 50 AND used > 0) THEN chunk + 1 ELSE chunk END, CASE WHEN n > 100 OR alone OR (used + n > 50 AND used > 0) THEN n ELSE used + n END, n > 100 FROM r JOIN w ON w.doc_id = r.doc_id AND w.pos = r.pos + 1)
SELECT doc_id, chunk, count(*) AS sections, max(used) AS words FROM r WHERE pos > 0 GROUP BY ALL""")
def inventory_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections (lines here) merged to about 50 words; one of more than 100 stands alone."""
    words = F.transform(F.split("text", "\n"), T.word_count)
    d = table(spark, sf_dir, "documents").select("doc_id", words.alias("ws"))
    d = d.select("doc_id", F.explode(F.arrays_zip(S.merged_sections(F.col("ws"), 50).alias("chunk"), F.col("ws").alias("n"))).alias("c"))
    return d.groupBy("doc_id", F.col("c.chunk").alias("chunk")).agg(F.count("*").alias("sections"), F.sum("c.n").alias("words"))


@BOOK.query("""
WITH x AS (SELECT doc_id, text AS t, least(length(text), 500) AS p FROM documents WHERE length(text) > 0), y AS (SELECT *, greatest(p - 200, 0) AS lo FROM x), z AS (SELECT *, t[lo + 1:p + 1] AS near FROM y),
c AS (SELECT *, list_filter(range(1, length(near)), lambda i: near[i:i + 1] = chr(10) || chr(10) OR (near[i] IN ('.', '!', '?') AND near[i + 1] IN (' ', chr(10), chr(9), chr(13)) AND regexp_matches(coalesce(near[i + 2], ''), '^\\p{Lu}'))) AS ends FROM z)
SELECT doc_id, CASE WHEN len(ends) > 0 THEN lo + list_max(ends) + 1 ELSE p END AS snapped FROM c""")
def snapped_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An offset of 500 moved back to the beginning of a sentence, within 200 characters."""
    d = table(spark, sf_dir, "documents").where(F.length("text") > 0)
    return d.select("doc_id", S.sentence_start(F.col("text"), F.least(F.length("text"), F.lit(500))).cast("long").alias("snapped"))


@BOOK.query("""
WITH g AS (SELECT p_brand, '| ' || coalesce(nullif(replace(replace(list(p_name ORDER BY p_partkey)[1], '|', '\\|'), '  ', ' '), ''), '') AS x FROM part GROUP BY p_brand),
r AS (SELECT p_brand, p_type, list(CASE WHEN p_size > 40 THEN '' WHEN p_size > 30 THEN p_name || '|' || p_size ELSE p_name END ORDER BY p_partkey)[1:4] AS cells FROM part GROUP BY ALL), w AS (SELECT p_brand, max(len(cells)) AS width FROM r GROUP BY p_brand),
l AS (SELECT p_brand, p_type, '| ' || array_to_string(list_transform(range(1, width + 1), lambda i: CASE WHEN coalesce(cells[i], '') = '' THEN chr(8204) ELSE replace(cells[i], '|', '\\|') END), ' | ') || ' |' AS line, width FROM r JOIN w USING (p_brand))
SELECT p_brand, list(line ORDER BY p_type)[1] || chr(10) || '| ' || array_to_string(list_transform(range(any_value(width)), lambda i: '---'), ' | ') || ' |' || chr(10) || array_to_string(list(line ORDER BY p_type)[2:], chr(10)) AS markdown FROM l GROUP BY p_brand""")
def grid_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids of cells as Markdown tables: pipes escaped, short rows filled, empty cells marked."""
    p = table(spark, sf_dir, "part")
    cell = F.when(F.col("p_size") > 40, "").when(F.col("p_size") > 30, F.concat_ws("|", "p_name", "p_size")).otherwise(F.col("p_name"))
    r = p.groupBy("p_brand", "p_type").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", cell.alias("cell")))), lambda x: x["cell"]), F.lit(1), F.lit(4)).alias("cells"))
    g = r.groupBy("p_brand").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_type", "cells"))), lambda x: x["cells"]).alias("grid"))
    return g.select("p_brand", S.grid_table(F.col("grid")).alias("markdown"))


@BOOK.query("""
WITH l AS (SELECT p_partkey, p_name || CASE WHEN p_size % 3 = 0 THEN repeat('.', 3 + p_size % 5) WHEN p_size % 3 = 1 THEN chr(9) ELSE ' ' END || p_partkey % 10000 AS line FROM part)
SELECT p_partkey, p_name AS title, (p_partkey % 10000)::INT AS page FROM l JOIN part USING (p_partkey) WHERE p_size % 3 < 2""")
def toc_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and pages of contents lines with dot leaders or tabs."""
    p, k = table(spark, sf_dir, "part"), F.col("p_size") % 3
    gap = F.when(k == 0, F.expr("repeat('.', 3 + p_size % 5)")).when(k == 1, "\t").otherwise(" ")
    return p.select("p_partkey", T.toc_entry(F.concat("p_name", gap, (F.col("p_partkey") % 10000).cast("string"))).alias("e")).where("e is not null").select("p_partkey", "e.title", "e.page")


@BOOK.query("""
WITH x AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'Page ' || (o_orderkey % 900) WHEN 1 THEN (o_orderkey % 90) || ' of 90' WHEN 2 THEN ' ' || (o_orderkey % 9999) || ' ' WHEN 3 THEN (o_orderkey % 90) || '/90' WHEN 4 THEN 'Page one' ELSE 'see 12' END AS line FROM orders)
SELECT o_orderkey % 6 AS form, count(*) FILTER (regexp_matches(trim(line), '^(?i)(page\\s+)?\\d{1,4}(\\s*(/|of)\\s*\\d{1,4})?$')) AS numbers, count(*) AS lines FROM x GROUP BY 1""")
def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are nothing but a page number."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    text = lambda c: c.cast("string")
    line = F.when(k % 6 == 0, F.concat(F.lit("Page "), text(k % 900))).when(k % 6 == 1, F.concat(text(k % 90), F.lit(" of 90"))).when(k % 6 == 2, F.concat(F.lit(" "), text(k % 9999), F.lit(" ")))
    line = line.when(k % 6 == 3, F.concat(text(k % 90), F.lit("/90"))).when(k % 6 == 4, "Page one").otherwise("see 12")
    return o.groupBy((k % 6).alias("form")).agg(F.count_if(T.is_page_number(line)).alias("numbers"), F.count("*").alias("lines"))


@BOOK.query("""
SELECT doc_id, md5(regexp_replace(replace(text, 'an ', 'a-' || chr(10) || 'n '), '([A-Za-z0-9_])-\\n([a-z])', '\\1\\2', 'g')) AS joined, md5(CASE WHEN length(text) > 60 THEN rtrim(text[1:59]) || '…' ELSE text END) AS short FROM documents""")
def joined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words joined again where a line broke them, and labels cut with an ellipsis."""
    broken = F.replace("text", F.lit("an "), F.lit("a-\nn "))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.dehyphenate(broken)).alias("joined"), F.md5(T.truncated(F.col("text"), 60)).alias("short"))


@BOOK.query("""
WITH x AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '+---+' || chr(10) || '| a | b' || chr(10) || '| c |' WHEN p_size % 4 = 1 THEN '+--+' || chr(10) || '| one' WHEN p_size % 4 = 2 THEN ' 0 1 2 3' || chr(10) || ' +==+' ELSE '| ' || p_name || ' |' END AS t FROM part)
SELECT p_partkey, p_size % 4 IN (0, 2) AS art, CASE WHEN p_size % 4 = 0 THEN '+---+' || chr(10) || '\\| a \\| b' || chr(10) || '\\| c \\|' ELSE t END AS text FROM x JOIN part USING (p_partkey)""")
def ascii_drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawings told from tables, with their pipes escaped."""
    k = F.col("p_size") % 4
    t = F.when(k == 0, "+---+\n| a | b\n| c |").when(k == 1, "+--+\n| one").when(k == 2, " 0 1 2 3\n +==+").otherwise(F.concat(F.lit("| "), "p_name", F.lit(" |")))
    return table(spark, sf_dir, "part").select("p_partkey", T.is_ascii_art(t).alias("art"), T.neutral_pipes(t).alias("text"))


@BOOK.query("""
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber % 4 WHEN 0 THEN '(' || chr(97 + (l_partkey % 4)::INT) || ') is right' WHEN 1 THEN 'Answer: ' || chr(65 + (l_partkey % 4)::INT) WHEN 2 THEN 'none' ELSE 'Cab' END AS answer FROM lineitem)
SELECT CASE WHEN l_linenumber % 4 < 2 THEN chr(65 + (l_partkey % 4)::INT) END AS letter, count(*) AS n FROM x GROUP BY 1""")
def answer_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters found in free answers."""
    k, letter = F.col("l_linenumber") % 4, F.col("l_partkey") % 4
    a = F.when(k == 0, F.concat(F.lit("("), F.char(97 + letter), F.lit(") is right"))).when(k == 1, F.concat(F.lit("Answer: "), F.char(65 + letter))).when(k == 2, "none").otherwise("Cab")
    return table(spark, sf_dir, "lineitem").groupBy(T.answer_letter(a).alias("letter")).agg(F.count("*").alias("n"))


@BOOK.query("""
SELECT p_partkey, replace(trim(regexp_replace(lower(p_name || ' (' || p_type || ')'), '[^a-z0-9 ]', '', 'g')), ' ', '_') || '__' || replace(lower(p_brand), '#', '') AS key, lower(trim('  ' || p_type || ' ')) AS place FROM part""")
def book_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache keys of titles and authors, and names of places in one form."""
    title = F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))
    return table(spark, sf_dir, "part").select("p_partkey", T.book_key(title, F.col("p_brand")).alias("key"), F.lower(F.trim(F.concat(F.lit("  "), "p_type", F.lit(" ")))).alias("place"))


@BOOK.query("""
WITH s AS (SELECT item_id, unnest(regexp_split_to_array(text, '\\n')) AS line FROM benchmark UNION ALL SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'It was founded in 1912 by the famous Ada Lovelace.' WHEN 1 THEN 'The mast is 40 metres high because of the wind.' WHEN 2 THEN 'Latency means delay, measured in 20 seconds.' WHEN 3 THEN 'The second theory argues otherwise.' WHEN 4 THEN 'She met young Grace Hopper in Paris.' ELSE 'Nothing to see.' END FROM part)
SELECT CASE WHEN contains(line, '1912') THEN 0.85 WHEN contains(line, '40 metres') THEN -0.05 WHEN contains(line, 'Latency') THEN 0.55 WHEN contains(line, 'second theory') THEN -0.15 WHEN contains(line, 'Grace') THEN 0.2 ELSE 0 END::DOUBLE AS score, contains(line, '1912') OR contains(line, 'Latency') AS factual, count(*) AS n FROM s GROUP BY ALL""")
def factual_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements told apart as factual or conceptual."""
    k = F.col("p_size") % 6
    made = F.when(k == 0, "It was founded in 1912 by the famous Ada Lovelace.").when(k == 1, "The mast is 40 metres high because of the wind.").when(k == 2, "Latency means delay, measured in 20 seconds.")
    made = made.when(k == 3, "The second theory argues otherwise.").when(k == 4, "She met young Grace Hopper in Paris.").otherwise("Nothing to see.")
    s = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "\n")).alias("line")).unionByName(table(spark, sf_dir, "part").select(made.alias("line")))
    return s.groupBy(T.factual_score(F.col("line")).alias("score"), T.is_factual(F.col("line")).alias("factual")).agg(F.count("*").alias("n"))


@BOOK.query("""
WITH x AS (SELECT doc_id, regexp_replace(text, '\\n+$', '') AS t FROM documents), l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS b, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM x)
SELECT doc_id, pos::BIGINT AS block, CAST(coalesce(sum(length(b) + 2) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset, length(b) AS chars FROM l""")
def emitted_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks joined by blank lines into Markdown, with where each one begins; all within a document's row."""
    blocks = F.split(F.regexp_replace("text", "\\n+\\z", ""), "\n")
    d = table(spark, sf_dir, "documents").select("doc_id", blocks.alias("bs"))
    starts = readers.running_starts(F.transform("bs", lambda b: F.length(b) + 2))
    d = d.select("doc_id", F.posexplode(F.arrays_zip(F.col("bs").alias("b"), starts.alias("s"))).alias("k", "x"))
    return d.select("doc_id", (F.col("k") + 1).cast("long").alias("block"), F.col("x.s").cast("long").alias("offset"), F.length("x.b").cast("long").alias("chars"))


@BOOK.query("""
WITH d AS (SELECT doc_id // 5 AS bundle, doc_id, length('<<<file:' || doc_id || '>>>' || chr(10)) AS m, length(regexp_replace(text, '\\n+$', '')) AS n FROM documents),
r AS (SELECT bundle, doc_id::VARCHAR AS file, CAST(sum(m + n + 1) OVER (PARTITION BY bundle ORDER BY doc_id) - n - 1 AS BIGINT) AS first_char, n AS chars FROM d) SELECT * FROM r WHERE chars > 0""")
def source_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles of five files joined with a sentinel line before each, and the regions found again by the sentinels."""
    d = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 5).alias("bundle"), "doc_id", F.regexp_replace("text", "\\n+\\z", "").alias("text"))
    joined = readers.joined_files(d, "bundle", "doc_id", "text")
    return readers.file_regions(joined, "bundle", "text").select("bundle", "file", F.col("start").cast("long").alias("first_char"), (F.col("end") - F.col("start")).cast("long").alias("chars"))


@BOOK.query("""
WITH x AS (SELECT doc_id, regexp_replace(text, ' (the|la|den|de) ', ' ![image:' || (doc_id % 7) || '] ', 'g') AS t FROM documents)
SELECT doc_id, len(regexp_extract_all(t, '!\\[image:[^\\]]+\\]')) AS tokens, md5(regexp_replace(t, '!\\[image:([^\\]]+)\\]', '![](http://img/\\1)', 'g')) AS replaced FROM x""")
def image_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image tokens counted and replaced by links."""
    d = table(spark, sf_dir, "documents")
    t = F.regexp_replace("text", F.lit(" (the|la|den|de) "), F.concat(F.lit(" ![image:"), (F.col("doc_id") % 7).cast("string"), F.lit("] ")))
    return d.select("doc_id", T.image_ids(t).alias("ids"), T.linked_images(t, "http://img/").alias("out")).select("doc_id", F.size("ids").cast("long").alias("tokens"), F.md5("out").alias("replaced"))


@BOOK.query("""
WITH d AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?is)<!--.*?-->', ' ', 'g'), '(?is)<[^>]*>', ' ', 'g') AS t FROM pages)
SELECT page_id, md5(trim(regexp_replace(t, '\\s+', ' ', 'g'))) AS plain FROM d""")
def plain_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as plain text: scripts, styles, comments and tags gone, white space single."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.html_to_text(F.col("html"))).alias("plain"))


@BOOK.query("""
WITH b AS (SELECT l_orderkey, round(l_discount * 100 + 8, 1) AS size, l_quantity AS chars FROM lineitem), s AS (SELECT l_orderkey, size, sum(chars) AS chars FROM b WHERE chars >= 10 GROUP BY ALL),
m AS (SELECT l_orderkey, arg_max(size, (chars, -size)) AS size FROM s GROUP BY l_orderkey), f AS (SELECT l_orderkey, list_sort(list(size))[len(list(size)) // 2 + 1] AS mid FROM b GROUP BY l_orderkey)
SELECT l_orderkey, coalesce(m.size, f.mid) AS body FROM f LEFT JOIN m USING (l_orderkey)""")
def body_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The font size of the body: the one with most text, or the middle one where all blocks are short."""
    b = table(spark, sf_dir, "lineitem").select("l_orderkey", F.round(F.col("l_discount") * 100 + 8, 1).alias("size"), F.col("l_quantity").alias("chars"))
    s = b.groupBy("l_orderkey", "size").agg(F.sum(F.when(F.col("chars") >= 10, F.col("chars"))).alias("chars"), F.count("*").alias("n"))
    g = s.groupBy("l_orderkey").agg(F.max_by("size", F.when(F.col("chars").isNotNull(), F.struct("chars", -F.col("size")))).alias("most"), F.array_sort(F.flatten(F.collect_list(F.array_repeat("size", F.col("n").cast("int"))))).alias("all"))
    return g.select("l_orderkey", F.coalesce("most", F.get("all", F.floor(F.size("all") / 2).cast("int"))).alias("body"))


@BOOK.query("""
WITH p AS (SELECT *, p_name || ' of ' || p_brand || ' weighs ' || p_size || ' kg and was made in ' || (1950 + p_size * 7 % 61) AS src FROM part),
f AS (SELECT p_partkey AS id, p_type AS t, CASE p_partkey % 3 WHEN 0 THEN 'date' WHEN 1 THEN 'number:' || p_type ELSE 'name:' || p_type END AS kind, CASE p_partkey % 3 WHEN 0 THEN (1950 + p_size * 7 % 61)::VARCHAR WHEN 1 THEN p_size || ' kg' ELSE p_name END AS value,
  CASE p_partkey % 3 WHEN 0 THEN 1950 + p_size * 7 % 61 WHEN 1 THEN p_size END AS m FROM p),
v AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY m, length(low), low) AS r FROM (SELECT kind, lower(value) AS low, min(value) AS value, min(m) AS m FROM f GROUP BY ALL)),
c AS (SELECT f.id, o.value, row_number() OVER (PARTITION BY f.id ORDER BY CASE WHEN f.kind = 'date' THEN -1 ELSE 1 END * coalesce(abs(a.m - o.m), abs(a.r - o.r)), o.r) AS place FROM f JOIN v a ON a.kind = f.kind AND a.low = lower(f.value) JOIN v o ON o.kind = a.kind AND o.r <> a.r),
b AS (SELECT id, value, false AS ok FROM c WHERE place <= 3 UNION ALL SELECT id, value, true FROM f)
SELECT id, string_agg(value, ' | ' ORDER BY md5(id || ':' || value)) AS options, CAST(list_position(list(ok ORDER BY md5(id || ':' || value)), true) AS INT) AS answer, count(*) AS n FROM b GROUP BY id""")
def fact_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question of fact for each part: its year, weight or name, as found and verified in a sentence on it, among three of the same kind."""
    p = table(spark, sf_dir, "part")
    year = 1950 + F.col("p_size") * 7 % 61
    p = p.withColumn("src", F.concat(F.col("p_name"), F.lit(" of "), F.col("p_brand"), F.lit(" weighs "), F.col("p_size").cast("string"), F.lit(" kg and was made in "), year.cast("string")))
    k, kind = F.col("p_partkey") % 3, F.concat_ws(":", F.when(F.col("p_partkey") % 3 == 1, "number").otherwise("name"), "p_type")
    found = F.when(k == 0, D.fact_behind(F.col("src"), F.col("p_brand"), D.YEAR)).when(k == 1, D.fact_behind(F.col("src"), F.lit("weighs"), D.NUMBER)).otherwise(F.col("p_name"))
    facts = p.select(F.col("p_partkey").alias("id"), F.when(k == 0, "date").otherwise(kind).alias("kind"), found.alias("value"), "src", (k == 0).alias("far"))
    facts = facts.where(D.in_source(F.col("value"), F.col("src")))
    number = F.when(F.col("kind").startswith("name"), None).otherwise(F.regexp_extract("value", "\\d+", 0)).cast("double")
    out = D.options(facts.select("id", "kind", "value", number.alias("measure"), "far"))
    return out.select("id", F.array_join("options", " | ").alias("options"), "answer", F.size("options").cast("long").alias("n"))


@BOOK.query(f"""
WITH {LINES_SQL}, r AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM l),
k AS (SELECT *, len(regexp_extract_all(line, '{WORDS}')) % 3 <> 0 AND length(line) > 0 AS kept FROM r)
SELECT doc_id, pos::BIGINT AS pos, CAST(coalesce(sum(length(line) + 2) FILTER (kept) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS start, md5(line) AS section FROM k QUALIFY kept""")
def scoped_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as sections, those with a number of words that three divides left out: the text at each new offset is the old section."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.split("text", "\n").alias("lines"))
    d = d.withColumn("starts", readers.running_starts(F.transform("lines", lambda x: F.length(x) + 1)))
    section = F.zip_with("lines", "starts", lambda x, s: F.struct(s.cast("int").alias("start"), (s + F.length(x)).cast("int").alias("end"), ((T.word_count(x) % 3 != 0) & (x != "")).alias("keep")))
    d = d.withColumn("nodes", F.transform(section, lambda x, i: F.struct((i + 1).cast("long").alias("node"), x["start"].alias("start"), x["end"].alias("end"), x["keep"].alias("keep"))))
    d = d.withColumn("kept", H.kept_ranges(F.filter("nodes", lambda x: x["keep"])))
    d = d.select("doc_id", H.scoped_text(F.col("text"), F.col("kept")).alias("scoped"), H.scoped_nodes(F.filter("nodes", lambda x: x["keep"]), F.col("kept")).alias("nodes"))
    # cut within the row, so that no line takes the whole text along
    cut = F.transform("nodes", lambda n: F.struct(n["node"].alias("pos"), n["start"].alias("start"), F.md5(F.substring(F.col("scoped"), n["start"] + 1, n["end"] - n["start"])).alias("section")))
    return d.select("doc_id", F.inline(cut))


@BOOK.query("""
WITH o AS (SELECT o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_orderkey FROM orders), li AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) AS j FROM lineitem)
SELECT c AS tree, 1 AS level, i::VARCHAR AS path, NULL AS parent, 'order ' || o_orderkey AS title FROM o UNION ALL SELECT c, 2, i || '.' || j, i::VARCHAR, 'part ' || l_partkey FROM o JOIN li ON l_orderkey = o_orderkey""")
def flat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as a tree in JSON, their parts below them, as rows with level and path."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_linenumber"))).alias("ls"))
    parts = F.transform(F.coalesce("ls", F.array().cast("array<struct<l_partkey:bigint,l_suppkey:bigint,l_linenumber:int>>")), lambda x: F.struct(F.concat(F.lit("part "), x["l_partkey"].cast("string")).alias("title")))
    o = table(spark, sf_dir, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    one = F.struct("o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"), parts.alias("children"))
    trees = o.groupBy(F.col("o_custkey").alias("tree")).agg(F.array_sort(F.collect_list(one)).alias("t")).select("tree", F.to_json("t").alias("json"))
    return H.flat_tree(trees, "tree", "json").select("tree", "level", "path", "parent", F.get_json_object("node", "$.title").alias("title"))

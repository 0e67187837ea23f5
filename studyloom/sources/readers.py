"""Sources: text and Markdown blocks, CSV and JSON imports, pipe tables, file scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from studyloom.operators.ranking import global_rank

#: The format of each file ending.
FORMATS = {"pdf": "pdf", "html": "html", "htm": "html", "md": "markdown", "markdown": "markdown", "txt": "text", "csv": "csv", "json": "json"}


def format_of(name: Column) -> Column:
    """The format by a file name's ending; text where it isn't known."""
    ending = F.lower(F.regexp_extract(name, "\\.([A-Za-z0-9]+)$", 1))
    out = F.lit("text")
    for end, kind in FORMATS.items():
        out = F.when(ending == end, kind).otherwise(out)
    return out


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file_id, path, format, text) of whole text files, f1, f2, ... by path; a file named twice has one number."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    # only the paths are ranked; the texts stay where they were read
    numbers = global_rank(files.select("path").distinct(), [F.col("path")], "number")
    return files.join(numbers, "path").select(F.concat(F.lit("f"), "number").alias("file_id"), "path", format_of(F.col("path")).alias("format"), "text")


BOUNDARY = "^(CONTENTS|TABLE OF CONTENTS|(Letter|Chapter|CHAPTER)\\s+[0-9IVXLC]+.*|[0-9]+(\\.[0-9]+)*\\.?\\s+[A-Z].{0,80}|[A-Z][A-Z0-9 ,.'\\-]{3,80})$"


def plain_blocks(docs: DataFrame, drop_blank: bool = True) -> DataFrame:
    """(doc_id, block, start_line, text): lines joined into blocks that begin at heading-like lines.

    Line ends are made plain; blank lines go, or split blocks too when drop_blank is off.
    """
    lines = docs.select("doc_id", F.posexplode(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\\r\\n?", "\n"), "\n")).alias("pos", "line"))
    blank = F.trim("line") == ""
    ordered = Window.partitionBy("doc_id").orderBy("pos")
    head = F.trim("line").rlike(BOUNDARY)
    if drop_blank:
        lines = lines.where(~blank)
        opens = head | F.coalesce(F.lag(head).over(ordered), F.lit(True))
    else:
        opens = head | F.coalesce(F.lag(head | blank).over(ordered), F.lit(True))
    lines = lines.withColumn("block", F.sum(opens.cast("int")).over(ordered) - 1).where(~blank)
    blocks = lines.groupBy("doc_id", "block").agg(F.min("pos").alias("start_line"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("ls"))
    return blocks.select("doc_id", F.col("block").cast("int").alias("block"), "start_line", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("text"))


def markdown_headings(docs: DataFrame, respect_fences: bool = False) -> DataFrame:
    """(doc_id, line, level, title) of # headings; those in fenced code count unless respect_fences."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "t"))
    if respect_fences:
        fences = F.sum(F.when(F.col("t").rlike("^\\s*(```|~~~)"), 1).otherwise(0)).over(Window.partitionBy("doc_id").orderBy("line"))
        lines = lines.withColumn("open", fences % 2).where("open = 0")
    hashes = F.regexp_extract("t", "^(#{1,6})\\s+\\S", 1)
    return lines.where(hashes != "").select("doc_id", "line", F.length(hashes).alias("level"), F.trim(F.regexp_replace("t", "^#{1,6}\\s+|\\s+#*\\s*$", "")).alias("title"))


def read_concepts_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV import with quotes and a header in any case; canonicalTitle and topic are required."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    named = {c.strip().lstrip("﻿").lower(): c for c in raw.columns}
    missing = [c for c in ("canonicaltitle", "topic") if c not in named]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    out = raw.select(F.trim(F.col(f"`{named['canonicaltitle']}`")).alias("canonical_title"), F.trim(F.col(f"`{named['topic']}`")).alias("topic"), *(F.col(f"`{c}`").alias(k) for k, c in named.items() if k not in ("canonicaltitle", "topic")))
    return out.where("canonical_title <> '' and topic <> ''")


CONCEPT = T.StructType([T.StructField(c, T.StringType()) for c in ("title", "canonicalTitle", "topic")] + [T.StructField("mastery", T.DoubleType()), T.StructField("masteryScore", T.DoubleType())])


def concepts_from_json(texts: DataFrame, column: str = "text") -> DataFrame:
    """Concepts of JSON imports, a bare array or an object with entries; titles and mastery by either name."""
    array = F.from_json(F.col(column), T.ArrayType(CONCEPT))
    wrapped = F.from_json(F.col(column), T.StructType([T.StructField("entries", T.ArrayType(CONCEPT))]))["entries"]
    rows = texts.select(F.explode(F.when(F.trim(column).startswith("["), array).otherwise(wrapped)).alias("c"))
    return rows.select(F.coalesce("c.canonicalTitle", "c.title").alias("canonical_title"), F.col("c.topic").alias("topic"), F.coalesce("c.mastery", "c.masteryScore").alias("mastery")).where("canonical_title is not null")


def pipe_table(docs: DataFrame) -> DataFrame:
    """(doc_id, section, line, cells) of Markdown pipe tables under their last ## heading; separator rows go."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "t"))
    title = F.nullif(F.regexp_extract("t", "^##\\s+(.+?)\\s*$", 1), F.lit(""))
    lines = lines.withColumn("section", F.last(title, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("line")))
    rows = lines.where(F.col("t").rlike("^\\s*\\|.*\\|\\s*$") & ~F.col("t").rlike("^[\\s|:\\-]+$"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("t"), "^\\||\\|$", ""), "(?<!\\\\)\\|"), lambda c: F.trim(c))
    return rows.select("doc_id", "section", "line", cells.alias("cells"))


def repaired_json(text: Column) -> Column:
    """Model output as JSON text: fences and prose around it stripped, trailing commas and curly quotes mended; null if it still fails."""
    bare = F.regexp_replace(F.trim(text), "^```[a-zA-Z]*\\s*|\\s*```$", "")
    inner = F.regexp_extract(bare, "(?s)([\\[{].*[\\]}])", 1)
    plain = F.translate(inner, "“”", '""')
    mended = F.regexp_replace(plain, ",\\s*([\\]}])", "$1")
    tries = [bare, inner, mended]
    return F.coalesce(*(F.when(F.try_parse_json(F.nullif(t, F.lit(""))).isNotNull(), t) for t in tries))


def running_starts(sizes: Column) -> Column:
    """Where each of consecutive pieces begins, from 0; sizes is an array."""
    at = F.sequence(F.lit(1), F.size(sizes))
    step = lambda acc, n: F.struct(F.array_append(acc["out"], acc["sum"]).alias("out"), (acc["sum"] + n).alias("sum"))
    zero = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("sum"))
    return F.when(F.size(sizes) > 0, F.aggregate(sizes, zero, step, lambda acc: acc["out"])).otherwise(F.slice(at, 1, 0))


#: A line that opens a file's part of a joined text.
SENTINEL = "<<<file:([^>]+)>>>"


def joined_files(files: DataFrame, group: str, name: str, text: str) -> DataFrame:
    """(group, text): the few files of each group in order of name, a sentinel line before each."""
    part = F.concat(F.lit("<<<file:"), F.col(name).cast("string"), F.lit(">>>\n"), F.col(text))
    rows = files.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(name).alias("n"), part.alias("p")))).alias("fs"))
    return rows.select(group, F.array_join(F.transform("fs", lambda x: x["p"]), "\n").alias(text))


def file_regions(joined: DataFrame, group: str, text: str) -> DataFrame:
    """(group, file, start, end): the characters of each file in a joined text; text before the first sentinel is file f1's."""
    ids = F.concat(F.array(F.lit("f1")), F.regexp_extract_all(text, F.lit(SENTINEL), F.lit(1)))
    parts = F.split(text, SENTINEL + "\n?", -1)
    gaps = F.concat(F.array(F.lit(0)), F.transform(F.regexp_extract_all(text, F.lit("(" + SENTINEL + "\n?)"), F.lit(1)), lambda m: F.length(m)))
    d = joined.select(group, ids.alias("ids"), parts.alias("ps"), gaps.alias("gs"))
    starts = running_starts(F.zip_with("gs", "ps", lambda g, p: g + F.length(p)))
    d = d.select(group, F.explode(F.arrays_zip(F.col("ids").alias("file"), F.zip_with(starts, "gs", lambda s, g: s + g).alias("start"), F.transform("ps", lambda p: F.length(p)).alias("n"), F.transform("ps", lambda p: p.endswith("\n").cast("int")).alias("tail"))).alias("r"))
    # the line feed before the next sentinel belongs to none
    last = F.col("r.start") + F.col("r.n") - F.col("r.tail")
    return d.select(group, F.col("r.file").alias("file"), F.col("r.start").alias("start"), last.alias("end")).where(F.col("end") > F.col("start"))

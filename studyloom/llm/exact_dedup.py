"""Exact dedup: group by a 128-bit content hash, keep the smallest id, compare bytes.

Texts are equal when they are identical once every run of [\\x20\\x09-\\x0D] is one space;
null counts as empty. Rows are grouped by (md5, text): the hash picks the shuffle
partition and the whole text is compared inside the group, so a collision makes two groups.
Map-side combining ships one row per text and task, however hot a group of copies is.
The members then look their group up by both digests in a table that holds repeated
texts only; two different texts with equal md5 and sha256 stop the job.

Defined cases: a null id is never smaller than another, and a group of null ids keeps
them; rows that repeat both id and text are one document listed twice, so they get the
same answer; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.llm.names import free
from studyloom.session import materialize


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def repeated_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(md5, sha256, keep_id, group_size) of every text held by two or more rows."""
    texts = docs.select(F.col(doc_id).alias("id"), normalised(F.col(text)).alias("t"))
    groups = texts.groupBy(F.unhex(F.md5("t")).alias("md5"), "t").agg(F.count("*").alias("n"), F.min("id").alias("keep_id"))
    digests = groups.select("md5", F.sha2("t", 256).alias("sha256"), "n", "keep_id")
    one = digests.groupBy("md5", "sha256").agg(F.sum("n").alias("group_size"), F.min("keep_id").alias("keep_id"), F.count("*").alias("texts"))
    checked = F.when(F.col("texts") > 1, F.raise_error(F.lit("two different texts share md5 and sha256")).cast("long")).otherwise(F.col("group_size"))
    return one.select("md5", "sha256", "keep_id", checked.alias("group_size")).where("group_size > 1")


def mark_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None, name: str = "copy") -> DataFrame:
    """A struct column (keep_id, group_size, kept, text_sha256) beside the carried ones, under a free name.

    Carry only what is needed: the columns go through one shuffle with their digests.
    """
    carry = docs.columns if carry is None else carry
    groups = materialize(repeated_texts(docs, doc_id, text), "repeated-texts")
    names = [f"c{i}" for i in range(len(carry))]
    rows = docs.select(*(F.col(x).alias(n) for x, n in zip(carry, names)), F.col(doc_id).alias("id"), normalised(F.col(text)).alias("t"))
    rows = rows.select(*names, "id", F.unhex(F.md5("t")).alias("md5"), F.sha2("t", 256).alias("sha256"))
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    copy = F.struct(keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), keep.eqNullSafe(F.col("id")).alias("kept"), F.col("sha256").alias("text_sha256"))
    # groups grow with the corpus, so they are merged and never broadcast; a hot text's rows can be split
    return rows.join(groups.hint("merge"), ["md5", "sha256"], "left").select(*(F.col(n).alias(x) for x, n in zip(carry, names)), copy.alias(name))


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each distinct text, the one with the smallest id."""
    name = free(docs.columns, "copy")
    return mark_copies(docs, doc_id, text, name=name).where(F.col(name)["kept"]).drop(name)


def copies_report(docs: DataFrame) -> DataFrame:
    return mark_copies(docs, carry=["doc_id"]).select("doc_id", "copy.keep_id", "copy.group_size", "copy.kept", "copy.text_sha256")


COPIES_SQL = """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY t)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.t) AS text_sha256
FROM t JOIN g USING (t)
"""

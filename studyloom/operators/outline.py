"""Outlines: the block of a document that each entry of its outline names.

An entry meets the blocks of the pages around it, in a join on the document and a cell of
pages. What a comparison needs of either side is worked out once a row, behind the shuffle;
no keys are made of the words and letters of blocks, of which there are many more than
entries. Scores and tiers are then compared by an aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.functions.text import fold_accents

#: Scores of the kinds of likeness, the least that counts, and the one that ends the search in a tier.
NUMBERED, EQUAL, HELD, PREFIX, WORDS, LEAST, CERTAIN = 100, 95, 80, 60, 60, 50, 95
#: Length from which a text may be held inside words, and of a common beginning; pages that a match, and one without full score, may be away.
HELD_CHARS, PREFIX_CHARS, FAR_PAGES, NEAR_PAGES = 3, 15, 10, 5
#: Words of a block beyond which it must begin with the entry or a number, and beyond which it must be numbered; the score that frees it.
LONG_WORDS, VERY_LONG_WORDS, LONG_SCORE = 6, 12, 80

_NUMBER = "^\\d+(\\.\\d+)*\\.?\\s+"


def comparable(text: Column) -> Column:
    """Lower case without accents, only a-z, 0-9 and _, apart by single spaces."""
    # a search for the characters left out takes five times as long
    return F.array_join(F.regexp_extract_all(fold_accents(text), F.lit("[a-z0-9_]+"), F.lit(0)), " ")


def mended(text: Column) -> Column:
    """Digits that stand inside words for the letters that damaged fonts turn into them."""
    out = F.regexp_replace(text, "(?<=[A-Za-z0-9_])[60](?=[A-Za-z0-9_])", "o")
    out = F.regexp_replace(out, "(?<=[A-Za-z0-9_])1(?=[A-Za-z0-9_])", "i")
    return F.when(text.contains("0") | text.contains("1") | text.contains("6"), out).otherwise(text)


def _marked(words: Column) -> Column:
    """Between spaces, so that words are found as whole ones only."""
    return F.concat(F.lit(" "), words, F.lit(" "))


def likeness(title: Column, text: Column, numbered: Column, bare: Column, a: Column, b: Column, a_words: Column, b_line: Column, by_words: Column, held_chars: int) -> Column:
    """0 to 100, of a title and a text in lower case, whether the text has a number, and the text without it.

    a and b: both as `comparable` gives them; a_words and b_line: the words of a and the
    whole of b between spaces. by_words: whether likeness of words or beginnings counts.
    """
    share = F.floor(F.size(F.filter(a_words, lambda w: F.contains(b_line, w))) / F.size(a_words) * WORDS + 0.5).cast("int")
    holds = F.contains(b, a) & ((F.length(a) >= held_chars) | F.contains(b_line, _marked(a)))
    held = F.contains(a, b) & ((F.length(b) >= held_chars) | F.contains(_marked(a), b_line))
    begins = (F.length(a) >= held_chars) & b.startswith(F.substring(a, 1, PREFIX_CHARS))
    loose = F.when((a == "") | (b == ""), 0).when(a == b, 100).when(holds | held, HELD).when(~by_words, 0).when(begins & (share < LEAST), PREFIX).otherwise(share)
    return F.when(numbered & (bare == title), NUMBERED).when(text == title, EQUAL).otherwise(loose)


def _section(text: Column) -> Column:
    return F.regexp_extract(text, "^(\\d+(\\.\\d+)*)", 1)


def match_outline(outline: DataFrame, blocks: DataFrame, held_chars: int = HELD_CHARS) -> DataFrame:
    """doc, entry, block, score, tier of the entries that have a block.

    outline: doc, entry, page, title. blocks: doc, block, page, text. Tiers are the entry's
    page (0), those beside it (1) and all (2): the first tier with a certain match decides,
    else the best score, of equal ones the nearest tier and the first block. Lines of a table
    of contents (dot leaders) never match, nor do single words under longer titles. Titles
    and blocks of fewer letters than held_chars match whole words only, with 1 any text that
    holds them; blank ones match nothing.
    """
    cell = lambda c: F.floor(F.col(c) / FAR_PAGES).cast("long")
    o = outline.select("doc", "entry", F.col("page").alias("o_page"), F.trim("title").alias("title")).where("title <> ''")
    o = o.withColumn("cell", F.explode(F.array(*(cell("o_page") + k for k in (-1, 0, 1))))).repartition("doc", "cell")
    b = blocks.select("doc", "block", F.col("page").alias("b_page"), F.trim("text").alias("text")).where("text <> ''")
    b = b.where(~F.col("text").rlike("\\.{4,}\\s*\\d*\\s*$")).withColumn("cell", cell("b_page")).repartition("doc", "cell")
    title, text = F.col("title"), F.col("text")
    b = b.join(o.select("doc", "cell").distinct(), ["doc", "cell"], "left_semi")
    o = o.withColumn("a", comparable(title)).select(
        "doc", "cell", "entry", "o_page", "a", F.transform(F.split("a", " "), _marked).alias("a_words"), F.lower(title).alias("low_title"), F.length(title).alias("t_chars"), F.size(F.split(title, "\\s+")).alias("t_words"), _section(title).alias("number"),
    )
    bare = F.regexp_replace(text, _NUMBER, "")
    b = b.withColumn("b", comparable(mended(text))).select(
        "doc", "cell", "block", "b_page", "text", "b", _marked(F.col("b")).alias("b_line"), F.lower(text).alias("low_text"), (bare != text).alias("numbered"), F.lower(bare).alias("low_bare"), F.size(F.split(text, "\\s+", VERY_LONG_WORDS + 2)).alias("n_words"),
        F.when(text.rlike("^\\d+\\.\\s+\\p{Lu}"), _section(text)).alias("top"), text.rlike("^\\d+(\\.\\d+)*\\.?\\s+\\S").alias("labelled"),
    )
    away, number, n_words = F.abs(F.col("b_page") - F.col("o_page")), F.col("number"), F.col("n_words")
    same_number = (number != "") & F.when(F.contains(number, F.lit(".")), text.startswith(F.concat(number, F.lit(" "))) | text.startswith(F.concat(number, F.lit(".")))).otherwise(F.coalesce(F.col("top") == number, F.lit(False)))
    starts = F.col("low_text").startswith(F.col("low_title")) | F.col("numbered")
    alike = likeness(F.col("low_title"), F.col("low_text"), F.col("numbered"), F.col("low_bare"), F.col("a"), F.col("b"), F.col("a_words"), F.col("b_line"), (n_words <= LONG_WORDS) | starts, held_chars)
    met = o.join(b, ["doc", "cell"]).where(away <= FAR_PAGES)
    found = met.withColumn("same_number", same_number).withColumn("score", F.when(same_number, NUMBERED).otherwise(alike)).where(F.col("score") >= LEAST)
    fits = (away <= NEAR_PAGES) | (F.col("score") >= NUMBERED)
    fits &= ~((n_words < 2) & (F.col("t_words") >= 2)) & ~((F.length(text) < 4) & (F.col("t_chars") >= 8))
    fits &= (n_words <= LONG_WORDS) | (F.col("score") >= LONG_SCORE) | starts
    fits &= (n_words <= VERY_LONG_WORDS) | (F.col("score") >= LONG_SCORE) | F.col("labelled")
    tier = F.when(away == 0, 0).when(away == 1, 1).otherwise(2)
    certain, exact = F.col("score") >= CERTAIN, F.col("low_text") == F.col("low_title")
    rank = F.struct(
        F.when(certain, tier).otherwise(3).alias("certain"), (-F.col("score")).alias("low"), tier.alias("tier"), (~F.col("same_number")).alias("plain"),
        F.when(F.col("same_number"), F.when(exact, 0).otherwise(F.length(text))).otherwise(0).alias("length"), F.col("block").alias("block"),
    )
    best = found.where(fits).groupBy("doc", "entry").agg(F.min(rank).alias("r"))
    return best.select("doc", "entry", "r.block", (-F.col("r.low")).alias("score"), "r.tier")


def coverage(outline: DataFrame, matches: DataFrame) -> DataFrame:
    """doc, entries, matched, share of each document with an outline."""
    e = outline.groupBy("doc").agg(F.count("*").alias("entries"))
    m = matches.groupBy("doc").agg(F.count("*").alias("matched"))
    n = F.coalesce("matched", F.lit(0))
    return e.join(m, "doc", "left").select("doc", "entries", n.alias("matched"), (n / F.col("entries")).alias("share"))

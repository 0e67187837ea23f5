"""Text expressions: measures, tokenisers, slugs, predicates. All are Columns of built-in functions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The largest size, in characters, of each category.
SIZES = [(2000, "tiny"), (8000, "short"), (30000, "medium"), (80000, "long")]
#: First-person forms counted by the genre rules.
FIRST_PERSON = "i me my mine we us our ours yo mi mis nosotros nuestro nuestra".split()


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\r\\f\\x0B]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t\\n\\r\\f\\x0B]+")).cast("long")


def read_minutes(n_words: Column, per_minute: int = 200) -> Column:
    return F.ceil(n_words / F.lit(per_minute)).cast("long")


def size_category(n_chars: Column) -> Column:
    out = F.lit("very_long")
    for most, name in reversed(SIZES):
        out = F.when(n_chars < most, name).otherwise(out)
    return out


def first_person_count(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))
    return F.size(F.filter(found, lambda t: t.isin(FIRST_PERSON))).cast("long")


def token_set_a(text: Column, least: int = 3) -> Column:
    """Letters and digits of any script, at least `least` long, distinct."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"[\\p{{L}}\\p{{N}}]{{{least},}}"), F.lit(0)))


@lru_cache(1)
def _accented() -> tuple[str, str]:
    """Letters that decompose into a plain one and marks, and those plain ones, by Unicode's own rule."""
    found = {}
    for code in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(code).lower()) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(code):
            found[chr(code)] = plain
    return "".join(found), "".join(found.values())


def fold_accents(text: Column) -> Column:
    """Lower case without the accents of Latin letters, written with the letter or as marks behind it."""
    return F.translate(F.regexp_replace(F.lower(text), "[\\x{0300}-\\x{036F}]", ""), *_accented())


def token_list_d(text: Column, least: int = 4, stop: list[str] | None = None) -> Column:
    """Accent-folded runs of a-z and 0-9, in order, without stop words."""
    found = F.regexp_extract_all(fold_accents(F.coalesce(text, F.lit(""))), F.lit(f"[a-z0-9]{{{least},}}"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(stop)) if stop else found


def token_set_b(text: Column, least: int = 4, stop: list[str] | None = None) -> Column:
    return F.array_distinct(token_list_d(text, least, stop))


def token_set_c(text: Column, least: int = 4) -> Column:
    """Runs of ASCII letters, digits and underscores, at least `least` long, distinct."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"[A-Za-z0-9_]{{{least},}}"), F.lit(0)))


def token_hashes_c(text: Column, least: int = 4) -> Column:
    """token_set_c as 64-bit hashes, for joins."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"[a-z0-9_]{{{least},}}"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda t: F.xxhash64(t)))


def slug(text: Column, most: int = 80) -> Column:
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, most), "-+$", "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays taken as sets; two empty ones have 0."""
    common = F.size(F.array_intersect(a, b))
    return F.when(F.size(F.array_union(a, b)) > 0, common / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Members of a that b has, repeats counted, over the longer length."""
    longer = F.greatest(F.size(a), F.size(b))
    return F.when(longer > 0, F.size(F.filter(a, lambda w: F.array_contains(b, w))) / longer).otherwise(F.lit(0.0))


def positional_similarity(a: Column, b: Column) -> Column:
    """Share of places with the same character, over the longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda ok: F.coalesce(ok, F.lit(False))))
    return F.when(longest > 0, same / longest).otherwise(F.lit(0.0))


def heading_label(text: Column) -> Column:
    """Curly quotes, no-break spaces and dashes made plain, white space single."""
    plain = F.translate(text, "“”„‘’ –—", "\"\"\"'' --")
    return F.trim(F.regexp_replace(plain, "\\s+", " "))


def section_number(label: Column) -> Column:
    """'1.2.3 Title' to [1, 2, 3]; null without a number."""
    found = F.regexp_extract(label, "^\\s*(\\d+(?:\\.\\d+)*)", 1)
    return F.when(found != "", F.transform(F.split(found, "\\."), lambda x: x.cast("int")))


def dehyphenate(text: Column) -> Column:
    return F.regexp_replace(text, "(\\w)-\\n([a-z])", "$1$2")


def is_page_number(text: Column) -> Column:
    return F.trim(text).rlike("^(?i)(page\\s+)?\\d{1,4}(\\s*(/|of)\\s*\\d{1,4})?$")


def toc_entry(line: Column) -> Column:
    """(title, page) of a table-of-contents line with dot leaders, a tab or wide spaces."""
    pattern = "^\\s*(.+?)\\s*(?:\\.{3,}|\\t+|\\s{3,})\\s*(\\d{1,4})\\s*$"
    return F.when(line.rlike(pattern), F.struct(F.regexp_extract(line, pattern, 1).alias("title"), F.regexp_extract(line, pattern, 2).cast("int").alias("page")))


def is_ascii_art(text: Column) -> Column:
    """A box border with two lines that begin with a pipe, or with a row of bit numbers."""
    box = text.rlike("(?m)^\\s*\\+[-=+]+\\+")
    return box & ((F.regexp_count(text, F.lit("(?m)^[ \\t]*\\|")) >= 2) | text.rlike("(?m)^\\s*0\\s+1\\s+2\\s+3"))


def neutral_pipes(text: Column) -> Column:
    """Lines of a drawing that begin with a pipe get their pipes escaped, so they aren't read as a table."""
    line = lambda x: F.when(x.rlike("^\\s*\\|"), F.replace(x, F.lit("|"), F.lit("\\|"))).otherwise(x)
    return F.when(is_ascii_art(text), F.array_join(F.transform(F.split(text, "\n"), line), "\n")).otherwise(text)


def markdown_to_text(text: Column) -> Column:
    out = F.regexp_replace(text, "(?m)^#{1,6}\\s+", "")
    out = F.regexp_replace(out, "!?\\[([^\\]]*)\\]\\([^)]*\\)", "$1")
    out = F.regexp_replace(out, "(\\*\\*|__|\\*|_|`)(.+?)\\1", "$2")
    return F.regexp_replace(out, "(?m)^\\s*[-*+]\\s+", "")


def html_to_text(html: Column) -> Column:
    """Markup, scripts, styles and comments gone, white space single. For text out of minimal HTML; pages need more."""
    out = F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "(?s)<[^>]*>", " "), "\\s+", " "))


#: An image in running text; its id stands behind the colon.
IMAGE = "!\\[image:([^\\]]+)\\]"


def image_ids(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(IMAGE), F.lit(1))


def linked_images(text: Column, base: str) -> Column:
    """Image tokens as Markdown images below base."""
    return F.regexp_replace(text, IMAGE, f"![]({base}$1)")


def answer_letter(text: Column) -> Column:
    return F.upper(F.nullif(F.regexp_extract(text, "(?i)\\b([ABCD])\\b", 1), F.lit("")))


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…"))).otherwise(text)


def book_key(title: Column, author: Column) -> Column:
    clean = lambda c: F.regexp_replace(F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9 ]", "")), " +", "_")
    return F.concat_ws("__", clean(title), clean(author))


#: What makes a statement one of fact: a name, what it looks for, and its weight.
#: The weights, and the score of 0.45 from which a statement counts as factual.
SIGNALS = {
    "year": ("(?:^|[^0-9])(?:1[0-9]|20)[0-9]{2}(?:$|[^0-9])", 0.35),
    "measure": ("[0-9][ ]?(?:%|percent|(?:kilo|centi|milli)?(?:metres?|meters?|grams?|litres?|liters?)|miles?|tons?|degrees?|hours?|minutes?|seconds?|volts?|watts?|dollars?|euros?)", 0.30),
    "rank": ("(?:^|\\W)(?:first|second|third|last|next|[0-9]+(?:st|nd|rd|th))(?:$|\\W)", 0.20),
    "meaning": ("(?:^|\\W)(?:means|is defined as|is called|is known as|refers to|stands for)(?:$|\\W)", 0.25),
    "event": ("(?:^|\\W)(?:began|ended|was (?:born|built|founded|discovered|invented|signed)|took place|died)(?:$|\\W)", 0.30),
    "reason": ("(?:^|\\W)(?:because|why|therefore|hence|suggests?|argues?|theory|principle|relation)(?:$|\\W)", -0.35),
}
NAME, NAME_WEIGHT, FACTUAL = "[a-z,;] [A-Z][a-z]+ [A-Z][a-z]+", 0.20, 0.45


def factual_score(text: Column) -> Column:
    """The weights of the signals that a statement shows; two capitalised words within it are a name."""
    low = F.lower(text)
    total = F.when(text.rlike(NAME), NAME_WEIGHT).otherwise(0.0)
    for pattern, weight in SIGNALS.values():
        total = total + F.when(low.rlike(pattern), weight).otherwise(0.0)
    return F.round(total, 6)


def is_factual(text: Column) -> Column:
    return factual_score(text) >= FACTUAL

"""Structure of a text: headings, sections, chunks, boundaries and tables, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from studyloom.functions.expr import let, none_of
from studyloom.functions.text import word_count

#: Words of a section, the largest section kept whole, the length of an equal section.
SECTION_WORDS, SECTION_CHARS = 2500, 5000


#: Fixed values, by length of the line: most marks, fewest letters, a word too long to be one.
ODD_SHARE, ODD_FROM, LETTER_SHARE, LETTERS_FROM, GLUED, GLUED_FROM = 0.22, 6, 0.35, 8, 12, 20


def is_garbage(text: Column) -> Column:
    """A line that poor recognition made up, by its shares of characters: nothing, damaged ones, many marks, few letters, or one glued word."""

    def shares(x: Column) -> Column:
        n, letters, marks = x["n"], x["letters"], x["marks"]
        rules = [n == 0, x["damaged"], (n >= ODD_FROM) & (letters > 0) & (marks > ODD_SHARE * n), (n >= LETTERS_FROM) & (letters < LETTER_SHARE * n), (n >= GLUED_FROM) & x["glued"]]
        return F.exists(F.array(*rules), lambda rule: rule)

    def measured(t: Column) -> Column:
        count = lambda kind: F.regexp_count(t, F.lit(kind))
        damaged = count("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFD]") + count("(?i)&(#\\d+|[a-z]+);") > 0
        marks = count("[^\\p{L}\\p{N}\\s.,;:'\"?!()\\-/–—]")
        glued = (count("\\s") == 0) & (count(f"[A-Za-z]{{{GLUED},}}") > 0)
        return F.struct(F.length(t).alias("n"), count("\\p{L}").alias("letters"), marks.alias("marks"), damaged.alias("damaged"), glued.alias("glued"))

    return let(let(F.trim(F.coalesce(text, F.lit(""))), measured), shares)


#: Words before a number that make a line the label of a picture or table.
CAPTION_WORDS = "figure fig table chart map plate exhibit tabla figura abbildung tabelle tableau".split()


def not_heading(text: Column) -> Column:
    """Why a line is no heading: garbage, contact, caption, note, label or fragment; null if it could be one.

    contact: a mail or web address, or more digits than letters with eight at least.
    caption: one of CAPTION_WORDS and a number begin it. note: a footnote's mark begins a
    sentence. label: words in capitals and a colon, and more text on the line. fragment: it
    begins in small letters or within brackets, and ends as a sentence.
    """
    t = F.trim(F.coalesce(text, F.lit("")))
    ends = t.rlike("[.!?]$")
    digits = F.regexp_count(t, F.lit("\\d"))
    contact = t.rlike("\\S@\\S+\\.\\S") | t.rlike("(?i)\\b(https?://|www\\.)\\S") | ((digits >= 8) & (digits > F.regexp_count(t, F.lit("\\p{L}"))))
    caption = F.lower(t).rlike(f"^({'|'.join(CAPTION_WORDS)})\\.?\\s+\\d")
    note = t.rlike("^([*†‡§]+|\\[\\d{1,3}\\]|[¹²³⁰-⁹]+)\\s*\\S") & ends
    label = t.rlike("^\\p{Lu}[\\p{Lu}\\p{N} ]+:\\s*\\S")
    fragment = t.rlike("^[\\p{Ll}(]") & ends
    return F.when(is_garbage(t), "garbage").when(contact, "contact").when(caption, "caption").when(note, "note").when(label, "label").when(fragment, "fragment")


def heading_score(text: Column, size: Column, body: Column, bold: Column, edge: Column) -> Column:
    """How much a block looks like a heading. size and body: font sizes; edge: it stands where headers and footers do."""
    t = F.trim(text)
    score = F.when(size >= 1.15 * body, F.least(F.lit(30.0), F.round((size / body - 1) * 100, 6))).otherwise(0.0)
    score = score + F.when(bold, 15).otherwise(0) + F.when(word_count(t) <= 12, 10).otherwise(0) + F.when(~t.rlike("[.,;]$"), 10).otherwise(0)
    score = score + F.when(t.rlike("^\\d+(\\.\\d+)*[.)]?\\s"), 20).otherwise(0) + F.when((t == F.upper(t)) & t.rlike("[A-Z]"), 10).otherwise(0)
    out = F.when(t.rlike("^#{1,6}\\s"), 100.0).otherwise(score - F.when(edge, 50).otherwise(0))
    return F.round(out, 6)


def confidence(outline: Column, scores: Column, n_chars: Column) -> Column:
    """high with an outline or three strong headings, low without any, else medium."""
    n, strong = F.size(scores), F.size(F.filter(scores, lambda s: s >= 50))
    return F.when(outline | (strong >= 3), "high").when(n > 0, "medium").otherwise("low")


def block_type(title: Column) -> Column:
    t = F.lower(F.trim(title))
    return F.when(t.startswith("key terms:"), "key_terms").when(t.startswith("overview:") | t.startswith("course map:"), "overview").when(F.contains(t, F.lit("excursus")), "excursus").otherwise("development")


def genre(first_person: Column, bibliography: Column, math: Column, vocabulary: Column, long_paragraphs: Column, headings: Column, definitions: Column) -> Column:
    """The first kind whose signs a text shows. The limits and the names."""
    out = F.when(first_person > 0.03, "lecture_notes").when(bibliography & math, "scientific_empirical")
    out = out.when((vocabulary > 0.05) & (long_paragraphs > 0.25), "philosophical").when(bibliography, "scientific_theoretical")
    return out.when(headings & definitions, "textbook_chapter").when(first_person > 0.01, "essay").otherwise("unknown")


def learning_goal(kind: Column) -> Column:
    return F.when(kind.isin("philosophical", "essay"), "understand_argument").when(kind.isin("lecture_notes", "textbook_chapter"), "memorize_facts").otherwise("survey_field")


def last_index(text: Column, mark: str, until: Column) -> Column:
    """Where the last `mark` begins at or before `until`, from 0; -1 for none."""
    head = F.substring(text, F.lit(1), until + len(mark))
    back = F.instr(F.reverse(head), mark[::-1])
    return F.when(back > 0, F.length(head) - (back - 1) - len(mark)).otherwise(-1)


def next_index(text: Column, mark: str, since: Column) -> Column:
    """Where the first `mark` begins at or after `since`, from 0; -1 for none."""
    return F.call_function("locate", F.lit(mark), text, since + 1) - 1


def bisected(text: Column, least: int = 2000) -> Column:
    """[left, right] cut at the blank line nearest before the middle, or after it; null for short texts or empty halves."""
    n = F.length(text)
    mid = F.floor(n / 2).cast("int")

    def cut(before: Column) -> Column:
        at = F.when(before < 0.25 * n, next_index(text, "\n\n", mid)).otherwise(before)
        return F.when(at < 0, mid).otherwise(at)

    blank = " \t\n\r"
    halves = let(let(last_index(text, "\n\n", mid), cut), lambda at: F.array(F.btrim(F.substring(text, F.lit(1), at), F.lit(blank)), F.btrim(F.substring(text, at + 1, n), F.lit(blank))))
    return F.when((n >= least), let(halves, lambda h: F.when((h[0] != "") & (h[1] != ""), h)))


def equal_sections(text: Column, size: int = SECTION_CHARS) -> Column:
    """Structs (start, end): about `size` characters each, cut at the last blank line if that is past the half."""
    n = F.length(text)

    def step(acc: Column, _: Column) -> Column:
        start = F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0))
        end = F.least(start + size, n)

        def cut(at: Column) -> Column:
            stop = F.when((end < n) & (at - start > size * 0.5), at).otherwise(end)
            return F.when(start < n, F.array_append(acc, F.struct(start.alias("start"), stop.cast("int").alias("end")))).otherwise(acc)

        # within the section: the mark has to end in it
        return let(last_index(text, "\n\n", end - 2), cut)

    none = none_of(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")))
    steps = F.sequence(F.lit(1), F.greatest(F.ceil(n / (size * 0.5)).cast("int"), F.lit(1)))
    return F.when(n > 0, F.aggregate(steps, none, step, lambda acc: F.filter(acc, lambda x: x["end"] > x["start"]))).otherwise(none)


def merged_sections(words: Column, target: int = SECTION_WORDS) -> Column:
    """The chunk of each section, from 0: sections join until `target` words; one of more than twice that stands alone."""

    def step(acc: Column, n: Column) -> Column:
        large = n > 2 * target
        fresh = large | acc["alone"] | ((acc["words"] + n > target) & (acc["words"] > 0))
        chunk = acc["chunk"] + F.when(fresh & acc["any"], 1).otherwise(0)
        used = F.when(fresh, n).otherwise(acc["words"] + n)
        return F.struct(F.array_append(acc["out"], chunk).alias("out"), chunk.alias("chunk"), used.alias("words"), large.alias("alone"), F.lit(True).alias("any"))

    zero = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("chunk"), F.lit(0).cast("long").alias("words"), F.lit(False).alias("alone"), F.lit(False).alias("any"))
    return F.aggregate(words, zero, step, lambda acc: acc["out"])


def sentence_start(text: Column, at: Column, window: int = 200) -> Column:
    """`at` moved back to where a paragraph or sentence begins, within `window` characters; else as it was.

    A sentence begins with a capital behind ., ! or ? and white space.
    """
    lo = F.greatest(at - window, F.lit(0))
    near = F.substring(text, lo + 1, at - lo + 1)
    # the last beginning: the longest head that ends in a break
    head = F.regexp_extract(near, "(?s)^(.*(?:\\n\\n|[.!?]\\s(?=\\p{Lu})))", 1)
    return F.when(head != "", lo + F.length(head)).otherwise(at)


def escaped_cell(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|")), "\\s+", " "))


def grid_table(grid: Column) -> Column:
    """A Markdown table of rows of cells: the first row is the header, short rows are filled, empty cells hold U+200C."""
    cells = F.transform(grid, lambda row: F.transform(row, escaped_cell))
    width = F.array_max(F.transform(grid, lambda row: F.size(row)))
    line = lambda row: F.concat(F.lit("| "), F.array_join(row, " | "), F.lit(" |"))
    full = F.transform(cells, lambda row: line(F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.coalesce(F.nullif(F.get(row, i), F.lit("")), F.lit("‌")))))
    rule = line(F.array_repeat(F.lit("---"), width))
    return F.array_join(F.concat(F.slice(full, F.lit(1), F.lit(1)), F.array(rule), F.slice(full, F.lit(2), F.size(full))), "\n")


def table_blocks(lines: Column) -> Column:
    """Whether each line is a row of a pipe table."""
    return F.transform(lines, lambda x: x.rlike("^\\s*\\|.*\\|\\s*$"))

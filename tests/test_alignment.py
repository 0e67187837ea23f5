"""Aligned blocks against a plain sequential version, and outlines on cases of each kind."""

import random
from math import ceil, floor

import duckdb
import pytest
from pyspark.sql import functions as F

from studyloom.operators import alignment, outline
from studyloom.plans import catalogue


def plain(text, blocks, sections):
    """One block after another, by words and sets of used words."""
    words = text.split(" ") if text else []
    n = len(words)
    if not n or not blocks:
        return None
    size = max(50, ceil(n / len(blocks)))
    step = max(50, size // 4)
    used, out = set(), []
    share = lambda lo, hi: len(used & set(range(lo, hi))) / (hi - lo)
    for i, (overview, terms) in enumerate(blocks):
        best = None
        for lo in range(0, n, step):
            hi = min(n, lo + size)
            held = [t for t, _ in terms if t and t in " ".join(words[lo:hi])]
            hits = sum(w for t, w in terms if t in held)
            over = len(used & set(range(lo, hi)))
            score = hits if not over else floor(hits * 0.3) if over / (hi - lo) >= 0.4 else hits - floor(over / size * hits)
            if best is None or score > best[0]:
                best = (score, lo, hi, hits, held)
        if overview:
            found = (0, min(n, size), "strong", 0, [])
        elif best[0] > 0:
            _, lo, hi, hits, held = best
            if sections:
                margin = floor(size * 0.15)
                start, end = lo, hi
                for a, b in sections:
                    start = a if abs(a - lo) <= margin else start
                    end = b if abs(b - hi) <= margin else end
                lo = max(0, min(start, n - 1))
                hi = max(lo + 1, min(end, n))
                if hi - lo < 400:
                    wide = min(n, lo + 400)
                    hi = min(n, next((b for _, b in sections if wide <= b), wide))
            found = (lo, hi, "strong" if hits >= 2 and share(lo, hi) < 0.25 else "weak", hits, held)
        else:
            first = max(0, min(i * n // len(blocks), n - 1))
            ways = [(round(share(lo, min(n, lo + size)), 9), -lo) for lo in [first, *range(0, n, step)]]
            ratio, back = min(ways)
            found = (-back, min(n, -back + size), "weak" if ratio >= 0.25 else "fallback", 0, [])
        used |= set(range(found[0], found[1]))
        out.append(found)
    return out


def test_aligned_blocks(spark):
    rng = random.Random(8)
    vocabulary = [a + b for a in "ka lo mi su".split() for b in "ra ne ti".split()]
    rows = []
    for i in range(40):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 40, 260, 900, 1500])))
        blocks = [(rng.random() < 0.1, [(rng.choice(vocabulary)[: rng.choice([2, 4])], 1) for _ in range(rng.randrange(3))] + [(f"{rng.choice(vocabulary)} {rng.choice(vocabulary)} {rng.choice(vocabulary)}", 2)] * rng.randrange(2)) for _ in range(rng.randrange(7))]
        cuts = sorted(rng.sample(range(1, 1500), 6))
        rows.append((i, text, blocks, list(zip([0, *cuts], [*cuts, 1500])) if i % 2 else []))
    rows.append((99, "ba ba ba " * 30 + "ba", [(False, [("ba ba", 2), ("", 1), ("\\Ex", 1), ("a b", 1)])], []))
    schema = "id int, text string, blocks array<struct<overview:boolean,terms:array<struct<label:string,weight:int>>>>, sections array<struct<lo:int,hi:int>>"
    df = spark.createDataFrame(rows, schema)
    got = {r["id"]: r["x"] for r in df.select("id", alignment.aligned_blocks(F.col("text"), F.col("blocks"), F.col("sections")).alias("x")).collect()}
    for i, text, blocks, sections in rows:
        want = plain(text, blocks, sections)
        assert (got[i] is None) == (want is None)
        if want:
            assert [(r["lo"], r["hi"], r["quality"], r["hits"], list(r["matched"])) for r in got[i]] == want, i


def test_long_text(spark):
    """A text of 20 000 words is laid out like any other."""
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(400)}" for _ in range(20000))
    blocks = [(False, [(f"w{k}", 1), (f"w{k + 1} w", 2)]) for k in range(6)]
    schema = "text string, blocks array<struct<overview:boolean,terms:array<struct<label:string,weight:int>>>>"
    row = spark.createDataFrame([(text, blocks)], schema).select(alignment.aligned_blocks(F.col("text"), F.col("blocks")).alias("x")).first()
    assert [(r["lo"], r["hi"], r["quality"], r["hits"], list(r["matched"])) for r in row["x"]] == plain(text, blocks, [])


BLOCKS = [
    (1, 0, 0, "Introduction ........ 3"),
    (1, 1, 2, "1. Introduction"),
    (1, 2, 2, "Introduction to the whole field"),
    (1, 3, 3, "introduction"),
    (1, 4, 9, "Meth0ds of w6rk"),
    (1, 5, 9, "2.1 Data"),
    (1, 6, 4, "2.1. Data and more of it"),
    (1, 7, 30, "Far away section"),
    (1, 8, 5, "The results of the long and winding experiment that nobody wanted to repeat at all"),
    (2, 1, 2, "1. Introduction"),
    (1, 9, 6, "Closing words on the matter"),
    (1, 10, 6, ""),
]


@pytest.mark.parametrize(
    "page, title, want",
    [
        (2, "Introduction", (1, 100, 0)),  # a number in front, on the page itself
        (3, "Introduction", (3, 95, 0)),  # equal on the page ends the search before a full score elsewhere
        (4, "INTRODUCTION", (3, 95, 1)),
        (9, "Methods of work", (4, 100, 0)),  # digits of damaged fonts
        (8, "2.1 Data", (5, 100, 1)),  # the number, and of the numbered the equal one
        (5, "2.1 Datum", (6, 100, 1)),
        (10, "Far away section", None),  # beyond ten pages
        (25, "Far away section", (7, 95, 2)),
        (20, "Far away", None),  # less than full likeness beyond five pages
        (27, "Far away", (7, 80, 2)),
        (5, "experiment winding results", None),  # likeness of words only, under a long block
        (6, "Closing words of the matter", (9, 60, 0)),  # the beginning is the same
        (6, "words", (9, 80, 0)),
        (6, "on", (9, 80, 0)),
        (6, "or", None),  # two letters inside a word
        (6, " ", None),
    ],
)
def test_outline(spark, page, title, want):
    o = spark.createDataFrame([(1, 5, page, title), (1, 6, page, "Nothing like that"), (3, 5, page, title)], "doc int, entry int, page int, title string")
    b = spark.createDataFrame(BLOCKS, "doc int, block int, page int, text string")
    got = outline.match_outline(o, b).collect()
    assert [(r["doc"], r["entry"], r["block"], r["score"], r["tier"]) for r in got] == ([(1, 5, *want)] if want else [])


def test_outline_of_short_words(spark):
    cases = [("La", "Relaat", None), ("La", "Laat", None), ("La", "Re la.", 80), ("Relaat", "-- la", None), ("La maison rouge", "-- la", 80), ("A b", "Xa b", 80), ("1.2 One", "1.2.3 Other", 100)]
    o = spark.createDataFrame([(k, 0, 0, title) for k, (title, _, _) in enumerate(cases)], "doc long, entry long, page long, title string")
    b = spark.createDataFrame([(k, 7, 0, text) for k, (_, text, _) in enumerate(cases)], "doc long, block long, page long, text string")
    got = {r["doc"]: r["score"] for r in outline.match_outline(o, b).collect()}
    assert got == {k: score for k, (_, _, score) in enumerate(cases) if score}


def test_outline_of_letters_inside_words(spark):
    """One or two letters inside a word count where they are asked for, as they do in both queries and their SQL."""
    cases = [("La", "Relaat", 80), ("Relaat", "-- la", 80), ("Relaat", "Xy", None), ("A b", "Xa b", 80), ("X", "Box of x", 80)]
    o = spark.createDataFrame([(k, 0, 0, title) for k, (title, _, _) in enumerate(cases)], "doc long, entry long, page long, title string")
    b = spark.createDataFrame([(k, 7, 0, text) for k, (_, text, _) in enumerate(cases)], "doc long, block long, page long, text string")
    got = {r["doc"]: r["score"] for r in outline.match_outline(o, b, held_chars=1).collect()}
    assert got == {k: score for k, (_, _, score) in enumerate(cases) if score}


@pytest.mark.parametrize("name", ["outline_matches", "outline_coverage"])
def test_outline_queries_of_letters_inside_words(spark, tmp_path, name):
    lines = ["Zu", "Azur", "q", "Unique and long line of many words that goes on and on", "Zu!", "..", "aq"]
    spark.createDataFrame([(1, "\n".join(lines * 3)), (2, "r\nabr\nzz zz")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = catalogue.QUERIES[name](spark, str(tmp_path))
    names = ", ".join(df.columns)
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, df.collect())) == sorted(duck.sql(f"select {names} from ({catalogue.ORACLES[name]})").fetchall())
    assert "contains(a, b) OR contains(b, a) THEN 80" in catalogue.ORACLES[name]

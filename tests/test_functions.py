"""Expressions and operators on small fixtures."""

import math

from pyspark.sql import functions as F

from studyloom.functions import numeric as N
from studyloom.functions import text as T
from studyloom.operators import graph, joins, ranking, state, tables
from studyloom.operators.components import connected_components
from studyloom.sources import readers


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, T.slug(lit("  Héllo, World! "))) == "h-llo-world"
    assert one(spark, T.section_number(lit("1.2.3 Title"))) == [1, 2, 3]
    assert one(spark, T.section_number(lit("Title"))) is None
    assert one(spark, T.dehyphenate(lit("inter-\nnal"))) == "internal"
    assert one(spark, T.fold_accents(lit("ÉÀñü"))) == "eanu"
    assert one(spark, T.answer_letter(lit("the answer is (c)"))) == "C"
    assert one(spark, T.toc_entry(lit("Intro ..... 12")))["page"] == 12
    assert one(spark, T.is_page_number(lit(" Page 3 of 9 ")))
    assert one(spark, T.book_key(lit("The  Book!"), lit("A. Author"))) == "the_book__a_author"
    assert one(spark, T.factual_score(lit("The lamp was founded in 1920"))) == 0.65
    assert one(spark, T.positional_similarity(lit("abcd"), lit("abxd"))) == 0.75
    assert one(spark, T.jaccard(F.array(lit("a"), lit("b")), F.array(lit("b"), lit("c")))) == 1 / 3
    assert one(spark, T.markdown_to_text(lit("# A\n- **b** [c](d)"))) == "A\nb c"
    assert one(spark, T.truncated(lit("abcdef"), 4)) == "abc…"


def test_numeric_functions(spark):
    lit = F.lit
    v = lambda *xs: F.array(*(lit(float(x)) for x in xs))
    assert one(spark, N.cosine(v(1, 0), v(0, 1))) == 0
    assert one(spark, N.cosine(v(1, 0), v(1, 0, 0))) == 0
    assert one(spark, N.cosine(v(0, 0), v(1, 0))) == 0
    assert one(spark, N.half_up(lit(-0.5))) == 0
    assert one(spark, N.decay(lit(0.8), lit(-3.0))) == 0.8
    assert abs(one(spark, N.decay(lit(0.8), lit(10.0))) - 0.8 * math.exp(-0.5)) < 1e-12
    assert one(spark, N.triage(lit(0.91))) == "auto"
    assert one(spark, N.review_priority(lit(0.9), lit(False), lit(3))) is None
    assert one(spark, N.assessment_weight(lit(1.0), lit(3.0), lit("correct"))) == 0
    assert one(spark, N.assessment_budget(lit(0), lit(0))) == 4
    assert one(spark, N.djb2(lit(""))) == "00001505"


def test_state_steps_match_the_column(spark):
    s = state.sm2_start()
    for ts, q in ((0, 5), (86400, 5), (86400 * 8, 5), (86400 * 9, 5)):
        s = state.sm2_step(s, ts, q)
    assert (s["reps"], s["reviews"]) == (3, 4)  # the last review was early
    assert state.sm2_step(s, 86400 * 60, 1)["interval"] == 1
    answers = [True, False, True, True]
    p = state.BKT["l0"]
    for a in answers:
        p = state.bkt_step(p, a)
    assert abs(one(spark, state.bkt_column(F.array(*map(F.lit, answers)))) - p) < 1e-12


def test_fold_keeps_keys_apart(spark):
    df = spark.createDataFrame([(1, 0.0, 5, 1), (2, 0.0, 1, 2), (1, 86400.0, 4, 3), (None, 0.0, 3, 4)], "k long, ts double, quality int, seq long")
    out = {r["k"]: r for r in state.sm2_fold(df, "k").collect()}
    assert out[1]["reps"] == 2 and out[2]["reps"] == 0 and len(out) == 3
    assert out[None]["reps"] == 1  # rows without a key are a group of their own


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (None, 4), (3, 1)] + [(100, i) for i in range(101, 140)], "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8} | {i: 100 for i in range(100, 140)}


def test_joins(spark):
    a = spark.createDataFrame([(1, 10.0), (2, 100.0)], "id long, at double")
    b = spark.createDataFrame([(19.0,), (21.0,), (-1.0,)], "other double")
    assert {(r["id"], r["other"]) for r in joins.band_join(a, b, "at", "other", 10).collect()} == {(1, 19.0)}
    r = spark.createDataFrame([(0, 10)], "start long, end long")
    g = spark.createDataFrame([(9, 30), (10, 20)], "r_start long, r_end long")
    assert joins.overlap_join(r, g, 4.0).count() == 1
    left = spark.createDataFrame([("k", 5), ("k", 1), ("x", 5)], "k string, t long")
    right = spark.createDataFrame([("k", 2, "two"), ("k", 5, "five")], "k string, u long, v string")
    assert {(x["k"], x["t"], x["v"]) for x in joins.asof_join(left, right, "k", "t", "u", ["v"]).collect()} == {("k", 5, "five"), ("k", 1, None), ("x", 5, None)}
    sets = spark.createDataFrame([(1, ["a", "b", "c", "d", "e"]), (2, ["a", "b", "c", "d"]), (3, ["a", "b", "c", "d", "e"]), (4, []), (5, ["z"])], "id long, members array<string>")
    assert {(x["id"], x["class_id"]) for x in joins.set_similarity_classes(sets, 0.8).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)}


def test_ranking(spark):
    df = spark.range(1000).select(F.xxhash64("id").alias("x"), "id")
    got = ranking.global_rank(df, [F.col("x").desc(), F.col("id")]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 1001))
    assert [r["x"] for r in got] == sorted((r["x"] for r in got), reverse=True)


def test_tables(spark):
    old = spark.createDataFrame([(1, 5, "a"), (2, 5, "b")], "k long, t long, v string")
    new = spark.createDataFrame([(1, 5, "c"), (2, 4, "d"), (3, 1, "e")], "k long, t long, v string")
    assert {(r["k"], r["v"]) for r in tables.upsert_latest(old, new, ["k"], "t").collect()} == {(1, "c"), (2, "b"), (3, "e")}
    assert tables.insert_ignore(old, new, ["k"]).count() == 3
    assert {(r["k"], r["t"]) for r in tables.merge_greatest(old, new, ["k"], "t").collect()} == {(1, 5), (2, 5), (3, 1)}


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (4, 5)], "src long, dst long")
    assert {(r["src"], r["dst"]) for r in graph.on_cycles(edges).collect()} == {(2, 3), (3, 2)}
    assert graph.on_cycles(edges.where("src = 4")).count() == 0


def test_readers(spark):
    docs = spark.createDataFrame([(1, "CONTENTS\r\nfirst\n\nsecond\nChapter 1\nthird"), (2, None)], "doc_id long, text string")
    got = [(r["doc_id"], r["block"], r["text"]) for r in readers.plain_blocks(docs).orderBy("doc_id", "block").collect()]
    assert got == [(1, 0, "CONTENTS"), (1, 1, "first\nsecond"), (1, 2, "Chapter 1"), (1, 3, "third")]
    md = spark.createDataFrame([(1, "# A\n```\n## in code\n```\n### B ##")], "doc_id long, text string")
    assert [r["title"] for r in readers.markdown_headings(md, True).orderBy("line").collect()] == ["A", "B"]
    assert readers.markdown_headings(md).count() == 3
    pipes = spark.createDataFrame([(1, "## S\n| a | b |\n|---|---|\n| 1 | x\\|y |")], "doc_id long, text string")
    assert [(r["section"], r["cells"]) for r in readers.pipe_table(pipes).orderBy("line").collect()] == [("S", ["a", "b"]), ("S", ["1", "x\\|y"])]
    js = spark.createDataFrame([('[{"title": "T", "topic": "x", "masteryScore": 0.5}]',), ('{"entries": [{"canonicalTitle": "U"}]}',)], "text string")
    assert {(r["canonical_title"], r["mastery"]) for r in readers.concepts_from_json(js).collect()} == {("T", 0.5), ("U", None)}
    assert one(spark, readers.repaired_json(F.lit('Sure:\n{"a": [1, 2,],}'))) == '{"a": [1, 2]}'
    assert one(spark, readers.repaired_json(F.lit("no json"))) is None
    assert one(spark, readers.format_of(F.lit("x/Notes.MD"))) == "markdown"


def test_csv_import(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text('CanonicalTitle,Topic,notes\n"A, ""quoted""",t,"two\nlines"\n,t,x\n')
    got = readers.read_concepts_csv(spark, str(path)).collect()
    assert [(r["canonical_title"], r["topic"]) for r in got] == [('A, "quoted"', "t")]


def test_overlaps_just_after_a_border(spark):
    r = spark.createDataFrame([(1, 7000.0, 7200.5), (2, 7199.0, 7200.0), (3, 7200.1, 7200.3), (4, 14400.2, 14500.0)], "id long, start double, end double")
    g = spark.createDataFrame([(1, 7200.2, 14400.2), (2, 7200.0, 7200.6), (3, 100.0, 7200.1), (4, 14399.5, 14400.3)], "region long, r_start double, r_end double")
    want = sorted((x["id"], y["region"]) for x in r.collect() for y in g.collect() if x["start"] < y["r_end"] and x["end"] > y["r_start"])
    assert sorted((x["id"], x["region"]) for x in joins.overlap_join(r, g, 7200.0).collect()) == want


def test_read_files_ranks_paths_alone(spark, tmp_path):
    for name in ("b.md", "a.txt", "c.json"):
        (tmp_path / name).write_text(f"text of {name}\nend")
    files = readers.read_files(spark, [str(tmp_path)])
    got = sorted((r["file_id"], r["path"].rsplit("/", 1)[1], r["format"], r["text"]) for r in files.collect())
    assert got == [(f"f{i}", n, k, f"text of {n}\nend") for i, (n, k) in enumerate((("a.txt", "text"), ("b.md", "markdown"), ("c.json", "json")), 1)]
    plan = files._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Window" in line and "value" in line for line in plan.splitlines()) and "windowspecdefinition(path" not in plan

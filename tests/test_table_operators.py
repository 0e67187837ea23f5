"""Operators on small tables with odd rows: nulls, ties, fractions, cycles, copies."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from studyloom.functions import outcomes, structure, text
from studyloom.operators import beliefs, exports, folds, graph, identity, joins, normalise, packing, ranking, review
from studyloom.plans import catalogue
from studyloom.session import mark, materialize, release


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_accents_and_marks(spark):
    marks = "Dvořák Erdős naïve"
    for t, want in ((marks, "dvorak erdos naive"), ("café ñ", "cafe n"), ("ǺẤữ Ż", "aau z"), ("ø ł đ ß", "ø ł đ ß")):
        assert one(spark, text.fold_accents(F.lit(t))) == want
    assert one(spark, text.token_list_d(F.lit(marks))) == ["dvorak", "erdos", "naive"]
    assert one(spark, text.token_list_d(F.lit(None).cast("string"))) == []


def test_factual_signals(spark):
    cases = {"It was built in 1889.": True, "Speed means distance in 2 hours.": True, "This is so because the theory argues it.": False, "": False, "The code 18895 is long.": False}
    for t, want in cases.items():
        assert one(spark, text.is_factual(F.lit(t))) is want, t
    assert one(spark, text.factual_score(F.lit("then Ada Lovelace spoke"))) == one(spark, text.factual_score(F.lit("we met, Ada Lovelace spoke"))) == 0.2


def test_overlap_of_fractions(spark):
    rng = random.Random(1)
    rows = [(i, s := rng.uniform(0, 50), s + rng.choice([0.0, 0.3, 7.0, 12.5])) for i in range(60)] + [(60, 6600.3, 7200.3)]
    regions = [(i, s := rng.uniform(0, 50), s + rng.uniform(0, 15)) for i in range(60)] + [(60, 7200.1, 14400.1)]
    a, b = spark.createDataFrame(rows, "i int, start double, end double"), spark.createDataFrame(regions, "j int, r_start double, r_end double")
    got = sorted((r["i"], r["j"]) for r in joins.overlap_join(a, b, 7.2).collect())
    assert got == sorted((i, j) for i, s, e in rows for j, rs, re in regions if s < re and e > rs)


@pytest.mark.parametrize("radius", [0, 2.5])
def test_near_rows(spark, radius):
    rng = random.Random(2)
    left, right = [float(rng.randrange(200)) for _ in range(80)], [float(rng.randrange(200)) for _ in range(30)]
    a, b = spark.createDataFrame([(x,) for x in left], "x double"), spark.createDataFrame([(x,) for x in right], "y double")
    want = sorted(x for x in left if any(abs(x - y) <= radius for y in right))
    assert sorted(r["x"] for r in joins.near_any(a, b, "x", "y", radius).collect()) == want
    assert sorted(r["x"] for r in joins.band_join(a, b, "x", "y", radius, "left_semi").collect()) == want


def test_set_similarity_is_exact(spark):
    rng = random.Random(3)
    base = [frozenset(rng.randrange(60) for _ in range(rng.randint(1, 25))) for _ in range(150)]
    sets = [*base, *(s ^ {rng.randrange(60)} for s in base[:60]), base[0], frozenset()]
    df = spark.createDataFrame([(i, [f"t{x}" for x in s]) for i, s in enumerate(sets)], "id long, members array<string>")
    got = {(r["a"], r["b"]) for r in joins.set_similarity_links(df, 0.7).collect()}
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(s, i)
    alone = [(i, s) for s, i in first.items() if s]
    assert got == {(min(i, j), max(i, j)) for i, s in alone for j, t in alone if i < j and len(s & t) >= 0.7 * len(s | t)}


def test_similar_pairs_with_copies(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(60, 4)).round(2).tolist()
    vectors += [vectors[3], vectors[3], [0.0] * 4]
    df = spark.createDataFrame(list(enumerate(vectors)), "id long, vector array<double>")
    pairs, members = identity.similar_pairs(df, 0.8, block=7)
    got = {(r["a"], r["b"]) for r in pairs.collect()}
    v = np.array(vectors[:60])
    s = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60) if s[i, j] >= 0.8}
    assert {r["id"]: r["representative"] for r in members.collect()}[61] == 3


def test_nearest_of_copied_vectors(spark):
    rng = np.random.default_rng(5)
    vectors = np.tile(rng.normal(size=(30, 64)).astype(np.float32), (8, 1))
    rows = spark.createDataFrame([(i, v.tolist(), i % 30 % 3) for i, v in enumerate(vectors)], "id long, vector array<float>, label int")
    unit = vectors / np.linalg.norm(vectors.astype(np.float64), axis=1, keepdims=True)
    s = np.round(unit @ unit.T, 9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for same in (None, "label"):
            found = joins.nearest_neighbours(rows.where("id % 10 = 0"), rows, 5, block=7, slab=20, same=same).collect()
            for a in range(0, 240, 10):
                near = sorted((b for b in range(240) if b != a and (same is None or a % 30 % 3 == b % 30 % 3)), key=lambda b: (-s[a, b], b))[:5]
                assert [r["id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == a] == near
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_nearest_of_many_tiles(spark, monkeypatch):
    """Tiles behind the first are told by single precision; its floor must leave in what ties, and what is nearest by a hair."""
    monkeypatch.setattr(joins, "TILE", 16)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(12, 8))
    vectors = np.concatenate([np.tile(base, (6, 1)), np.tile(base, (6, 1)) + rng.normal(size=(72, 8)) * 1e-6, rng.normal(size=(60, 8))])
    a = pd.DataFrame({"id": rng.permutation(204), "vector": list(vectors), "scope": 0})
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    s, ids = np.floor(unit @ unit.T * 1e9 + 0.5), a["id"].to_numpy()
    for k in (1, 5, 20):
        got = joins._best_of_block(a, a, k).groupby("query_id")["id"].agg(list)
        for x in range(204):
            order = [ids[y] for y in np.lexsort((ids, -s[x])) if y != x]
            assert got[ids[x]] == order[:k]


@pytest.mark.parametrize("name", ["dedup_gates", "merge_proposals", "novelty_scores"])
def test_every_vector_is_a_query(spark, name):
    df = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    asked = {x for c in ("a", "lo", "hi", "query_id") if c in df.columns for (x,) in df.select(c).collect()}
    assert asked == set(range(500))


def test_ranks_within_keys(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.8 else rng.choice(["a", "b", None]), i, rng.randrange(9)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i int, c int")
    got = {(r["k"], r["i"]): r["rank"] for r in ranking.rank_in_key(df, "k", [F.desc("i")]).collect()}
    for k in {r[0] for r in rows}:
        mine = sorted((i for key, i, _ in rows if key == k), reverse=True)
        assert [got[k, i] for i in mine] == list(range(1, len(mine) + 1))
    kept = {(r["k"], r["i"]) for r in ranking.prefix_within_budget(df, "k", [F.col("i")], "c", F.lit(50)).collect()}
    for k in {r[0] for r in rows}:
        run, want = 0, set()
        for i, c in sorted((i, c) for key, i, c in rows if key == k):
            run += c
            want |= {(k, i)} if run <= 50 else set()
        assert {x for x in kept if x[0] == k} == want


def test_edges_on_cycles(spark):
    edges = [(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 4), (6, 1), (7, 7)]
    out = graph.on_cycles(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert sorted((r["src"], r["dst"]) for r in out) == [(1, 2), (2, 1), (4, 5), (5, 4)]
    none = graph.on_cycles(spark.createDataFrame([(1, 2)], "src long, dst long"))
    assert none.count() == 0
    long = graph.layers(spark.createDataFrame([(i,) for i in range(70)], "node long"), spark.createDataFrame([(i, i + 1) for i in range(69)], "src long, dst long"))
    assert long.count() == 70


def test_null_keys_are_a_group(spark):
    df = spark.createDataFrame([(None, 1, 3.0), (None, 2, 3.0), ("a", 1, 9.0), ("a", 2, 2.0)], "k string, i int, c double")
    assert sorted((r["k"] or "", r["i"]) for r in folds.greedy_budget(df, "k", ["i"], "c", 4).collect()) == [("", 1), ("a", 2)]


def test_packing_arrays(spark):
    ids = F.array(*(F.lit(x) for x in (1, 2, 3, 4)))
    affinity = F.create_map(F.lit("1|4"), F.lit(0.9), F.lit("2|4"), F.lit(0.7))
    assert one(spark, packing.affinity_order(ids, affinity)) == [1, 4, 2, 3]
    edge = lambda a, b: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))
    blocks = F.transform(ids, lambda x: F.array(x))
    assert one(spark, packing.repair_order(blocks, F.array(edge(4, 1)))) == [[4], [1], [2], [3]]
    cycle = one(spark, packing.repair_order(blocks, F.array(edge(4, 1), edge(1, 4))))
    assert sorted(x for b in cycle for x in b) == [1, 2, 3, 4]
    inventory = F.transform(F.sequence(F.lit(1), F.lit(11)), lambda i: F.struct(i.alias("id"), F.when(i < 6, "m").otherwise("n").alias("module"), (i % 4).alias("importance")))
    for n in (1, 2, 5, 20):
        packed = one(spark, packing.pack_blocks(inventory, F.lit(n)))
        assert len(packed) <= n and packed[0]["kind"] == "overview"
        if n > 1:
            assert sorted(x for b in packed for x in b["ids"]) == list(range(1, 12))
    assert [b["kind"] for b in one(spark, packing.pack_blocks(inventory, F.lit(5)))][1:3] == ["key terms", "key terms"]
    block = lambda i, t, *terms: F.struct(F.lit(i).alias("id"), F.lit(t).alias("title"), F.array(*map(F.lit, terms)).alias("terms"), F.array(F.lit(7)).alias("concepts"))
    plan = one(spark, packing.duplicate_plan(F.array(block(1, "x", "a", "b"), block(2, "x", "c"), block(3, "x", "a", "b"), block(4, "", "a", "b"))))
    assert [(p["keep"], p["absorb"], p["reason"]) for p in plan] == [(1, 2, "title"), (3, 4, "concept and terms")]


def test_damaged_json(spark):
    whole = '{"concepts": [{"a": "}]"}, {"b": {"c": [1]}}, {bad}, {"d": 1'
    assert normalise.complete_objects(whole, "concepts") == ['{"a": "}]"}', '{"b": {"c": [1]}}']
    assert normalise.complete_objects('{"concepts": [] , "x": [{"e": 1}]}', "concepts") == normalise.complete_objects(None, "concepts") == []
    for t, want in (("", False), ('{"a": 1}', False), ('{"a": "' + "x" * 300, True), ("text" * 100, False), (None, False)):
        assert one(spark, normalise.is_truncated_json(F.lit(t).cast("string"))) is want


def test_structure_of_empty_and_long_texts(spark):
    for t in ("", "x" * 20_001, "a\n\n" * 4000, "word " * 3000):
        spans = one(spark, structure.equal_sections(F.lit(t)))
        assert [s["start"] for s in spans[1:]] == [s["end"] for s in spans[:-1]] and (spans[-1]["end"] if spans else 0) == len(t)
        assert all(s["end"] - s["start"] <= 5000 for s in spans)
    assert one(spark, structure.bisected(F.lit("short"))) is None
    assert one(spark, structure.sentence_start(F.lit("One. Two three"), F.lit(9))) == 5
    lines = {"Results and methods": None, "2.1 Data": None, "write to a.b@c.org today": "contact", "+49 30 1234 5678": "garbage", "telephone: 030 12345678": "contact", "see www.example.org": "contact", "Figure 3 shows it": "caption", "Tabelle 2": "caption", "* Of all rows.": "note", "[12] Of all rows": None, "NOTE: read on": "label", "NOTE:": None, "and so it ends.": "fragment", "(see below).": "fragment", "": "garbage", None: "garbage"}
    for line, why in lines.items():
        assert one(spark, structure.not_heading(F.lit(line).cast("string"))) == why, line
    own = normalise.own_spans(F.array(F.struct(F.lit(4).alias("start"), F.lit(30).alias("end"))), F.lit(2), F.lit(10))
    assert [tuple(x) for x in one(spark, own)] == [(2, 4)]


def test_outcomes(spark):
    assert one(spark, outcomes.mastery_colours(F.lit(0.5))[0]) == "rgb(251,191,36)"
    assert [one(spark, outcomes.ago(F.lit(s))) for s in (5, 60, 7200, 86400, 8 * 86400, 40 * 86400, 800 * 86400)] == ["just now", "1 minute ago", "2 hours ago", "yesterday", "1 week ago", "1 month ago", "2 years ago"]
    assert one(spark, outcomes.binary_entropy(F.lit(0.5))) == 1 and one(spark, outcomes.binary_entropy(F.lit(0.99))) == 0


def test_queue_and_tables(spark):
    items = spark.createDataFrame([("u", i, None if i == 9 else i // 2, i % 2 == 0) for i in range(10)], "k string, i int, due int, gap boolean")
    queue = sorted((r["place"], r["i"]) for r in review.review_queue(items, "k", "due", F.col("gap"), "i").collect())
    assert [i for _, i in queue] == [9, 1, 0, 3, 2, 5, 4, 7]
    rows, large = exports.split_payload(spark.createDataFrame([(1, "x" * 9), (2, "y"), (3, None)], "id int, p string"), "id", "p", 5)
    assert sorted((r["id"], r["stored"], r["p"]) for r in rows.collect()) == [(1, True, None), (2, False, "y"), (3, False, None)]
    assert [r["id"] for r in large.collect()] == [1]


def test_beliefs_come_back_round_a_cycle(spark):
    edges = spark.createDataFrame([("d", 1, 2), ("d", 2, 1)], "doc string, src long, dst long")
    b = spark.createDataFrame([("d", 1, 0.5), ("d", 2, 0.5)], "doc string, node long, belief double")
    probe = spark.createDataFrame([("d", 1, "missed")], "doc string, probe long, response string")
    out = {r["node"]: r["after"] for r in beliefs.propagate(probe, edges, b).collect()}
    damp = lambda c, t, f: min(0.99, max(0.01, c + (t - c) * f))
    assert out[2] == pytest.approx(damp(0.5, 0.04, 0.8))
    assert out[1] == pytest.approx(damp(damp(0.5, 0.15, 0.85), 0.04, 0.64))  # back after two hops


def test_release_keeps_the_last_table(spark):
    before = mark()
    first = materialize(spark.range(3), "first")
    last = materialize(first.where("id > 0"), "last", by="id")
    release(spark, before)
    assert last.count() == 2
    with pytest.raises(Exception):
        spark.read.parquet(first.inputFiles()[0]).count()


def test_distractors(spark):
    """Nearest and farthest values, ties, spellings, and kinds with too few values, against a plain search."""
    from studyloom.operators import distractors

    rng = random.Random(2)
    facts = [(i, rng.choice(["year", "kg", "name", "lone"]), None) for i in range(60)]
    rows = []
    for i, kind, _ in facts:
        m = float(rng.randrange(12)) if kind in ("year", "kg") else None
        value = f"{m:.0f} {kind}" if m is not None else "only" if kind == "lone" else rng.choice(["Ada", "ada", "Bo", "Cyd", "Dora", "El", "Fay"])
        rows.append((i, kind, value, m, kind == "year"))
    rows += [(100, None, "x", 1.0, False), (101, "kg", " ", 1.0, False)]
    got = {}
    for r in distractors.distractors(spark.createDataFrame(rows, "id int, kind string, value string, measure double, far boolean")).collect():
        got.setdefault(r["id"], []).append((r["place"], r["value"]))
    for i, kind, value, m, far in rows[:60]:
        low = {}
        for _, k, v, x, _ in rows[:60]:
            if k == kind:
                low[v.lower()] = min(low.get(v.lower(), (v, x)), (v, x))
        order = sorted(low, key=lambda w: (low[w][1] if low[w][1] is not None else 0, len(w), w))
        own = order.index(value.lower())
        apart = lambda j: abs(m - low[order[j]][1]) if m is not None else abs(j - own)
        best = sorted((j for j in range(len(order)) if j != own), key=lambda j: (-apart(j) if far else apart(j), j))[:3]
        assert sorted(got.get(i, [])) == [(p, low[order[j]][0]) for p, j in enumerate(best, 1)], (i, kind, value)
    assert 100 not in got and 101 not in got


def test_facts_in_sources(spark):
    from studyloom.operators import distractors as D

    text = F.lit("In 1789 it began. Paris fell in 1940, with 12 km to go.")
    assert one(spark, D.fact_behind(text, F.lit("Paris"), D.YEAR)) == "1940" and one(spark, D.fact_behind(text, F.lit("Rome"), D.YEAR)) == "1789"
    assert one(spark, D.fact_behind(text, F.lit("go"), D.NUMBER)) is None
    for answer, span, want in (("PARIS", (None, None), True), ("paris", (0, 4), True), ("rome", (0, 50), False), (" ", (None, None), False), (None, (None, None), False)):
        assert one(spark, D.in_source(F.lit(answer).cast("string"), text, F.lit(span[0]).cast("int"), F.lit(span[1]).cast("int"))) is want


def test_columns_of_pages(spark):
    from studyloom.operators import glyphs

    two = [(1, 20.0 + 40 * (i % 5) + (300 if i >= 20 else 0), 14.0 * (i % 20 // 5), f"w{i}") for i in range(40)]
    one_column = [(2, 20.0 + 45 * (i % 12), 14.0 * (i // 12), f"w{i}") for i in range(30)]
    edge = [(3, 10.0, 0.0, "a"), (3, 600.0, 0.0, "b"), (None, 20.0, 0.0, "c"), (None, 330.0, 0.0, "d"), (None, 20.0, 20.0, "e")]
    g = spark.createDataFrame([*two, *one_column, *edge], "page int, x double, y double, text string")
    got = {}
    for r in sorted(glyphs.reading_lines(g, "page", "x", "y", "text", [], 14.0, 612.0).collect(), key=lambda r: r["place"]):
        got.setdefault(r["page"], []).append(r["text"])
    assert " ".join(got[1]).split() == [f"w{i}" for i in range(40)] and " ".join(got[2]).split() == [f"w{i}" for i in range(30)]
    assert got[3] == ["a", "b"] and got[None] == ["c d", "e"]  # the middle of the last gap lies outside of the zone


def test_assessment_items(spark):
    rows = [
        (1, '{"items": [{"question": " Q? ", "options": [" a ", "", "b"], "answer": "a"}, 7, {"question": "x", "options": ["a"]}, {"id": "k", "question": "", "options": ["a", "b"]}]}'),
        (2, '[{"item_id": "i", "id": "k", "question": "q", "type": "ESSAY"}, {"question": "q", "options": ["a", "b"], "edge": {"from": "u", "to": "v"}, "concept_id": " c "}]'),
        (3, '{"questions": [{"question": "q", "options": ["a", "b"], "edge": {"from": "u"}}]}'),
        (4, "broken"),
        (5, None),
    ]
    out = {(r["id"], r["place"]): r for r in normalise.assessment_items(spark.createDataFrame(rows, "id int, raw string"), "id", "raw").collect()}
    assert {k: (r["item_id"], r["fault"]) for k, r in out.items()} == {(1, 1): ("item_1", None), (1, 2): ("item_2", "not an object"), (1, 3): ("item_3", "options"), (1, 4): ("k", "no question"), (2, 1): ("i", "type"), (2, 2): ("item_2", None), (3, 1): ("item_1", "edge")}
    assert (out[1, 1]["question"], out[1, 1]["options"], out[1, 1]["correct"]) == ("Q?", ["a", "b"], "a")
    assert tuple(out[2, 2]["edge"]) == ("u", "v") and out[2, 2]["concept_id"] == "c"


def test_lookups(spark):
    from studyloom.operators import tables

    packs = spark.createDataFrame([(2, " ab1", "published", "x"), (1, "AB1 ", "published", "y"), (3, "cd", "draft", "z"), (4, " ", "published", "w")], "id int, code string, status string, title string")
    asked = spark.createDataFrame([(7, "ab1"), (8, "CD"), (9, " "), (10, None)], "who int, code string")
    assert [(r["who"], r["id"], r["title"]) for r in tables.published_by_code(packs, asked).collect()] == [(7, 1, "y")]
    cache = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "other")], "k string, at int, v string")
    keys = spark.createDataFrame([("a",), ("a",), ("c",), (None,)], "k string")
    assert [tuple(r) for r in tables.cached_by_key(cache, keys, "k", "at").collect()] == [("a", 2, "new")]

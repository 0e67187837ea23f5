"""What a step holds or sends must not grow faster than its input."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from studyloom import session
from studyloom.functions.outcomes import binary_entropy
from studyloom.operators import beliefs, hierarchy, joins, outline, packing
from studyloom.plans import catalogue


def test_only_links_reach_the_full_sets(spark, monkeypatch):
    """Sets that share their rarest member and nothing else are told apart by their parities, small and large ones."""
    rows = [(i, [10 * i, 10 * i + 1, *(1000 + (i + k) % 90 for k in range(40))]) for i in range(20)]
    rows += [(100 + i, [7, *(10_000 * (i // 2) + k for k in range(100_000, 100_600))]) for i in range(8)]
    rows += [(200 + i, [8, i % 2, *(20_000 + k for k in range(30))]) for i in range(3)]
    sets = spark.createDataFrame(rows, "id long, members array<long>")
    met, write = {}, joins.materialize
    monkeypatch.setattr(joins, "materialize", lambda df, name="step", **more: met.setdefault(f"{name}{len(met)}", write(df, name, **more)))
    got = {(r["a"], r["b"]) for r in joins.set_similarity_links(sets, 0.8).collect()}
    full = {i: set(m) for i, m in rows}
    first = {i: min(j for j in full if full[j] == full[i]) for i in full}
    want = {(a, b) for a in full for b in full if a < b and first[a] == a and first[b] == b and len(full[a] & full[b]) >= 0.8 * len(full[a] | full[b])}
    assert got == want and len(got) > 5
    checked = [df for name, df in met.items() if name.startswith("pairs")][-1]
    assert {(a, b) for a, b in map(sorted, checked.collect()) if b >= 100} == {(a, b) for a, b in want if b >= 100}


def test_orders_of_long_inventories(spark):
    """An order costs what its concepts and ties are, not their product: 20,000 concepts took minutes."""
    n = 20_000
    ids = F.sequence(F.lit(1), F.lit(n)).cast("array<bigint>")
    affinity = F.map_from_entries(F.transform(F.sequence(F.lit(1), F.lit(n // 2 - 1)), lambda i: F.struct(F.concat_ws("|", i, i + n // 2).alias("k"), F.lit(0.9).alias("w"))))
    edges = F.array(*(F.struct(F.lit(b).cast("bigint").alias("a"), F.lit(a).cast("bigint").alias("b")) for a, b in ((5, n), (6, n - 1))))
    began = time.perf_counter()
    row = spark.range(1).select(packing.affinity_order(ids, affinity).alias("x"), packing.repair_order(F.transform(ids, lambda x: F.array(x)), edges).alias("y")).first()
    assert time.perf_counter() - began < 60
    assert row["x"][:5] == [1, 1 + n // 2, 2, 2 + n // 2, 3] and sorted(row["x"]) == list(range(1, n + 1))
    assert [x for b in row["y"][:8] for x in b] == [1, 2, 3, 4, n, 5, n - 1, 6]


def test_orders_as_one_after_another(spark):
    rng = random.Random(9)
    rows = []
    for k in range(60):
        ids = rng.sample(range(100), rng.randint(0, 9))
        ties = {f"{min(a, b)}|{max(a, b)}": rng.choice((0.5, 0.7, 0.9)) for a in ids for b in ids if a < b and rng.random() < 0.3}
        cut = sorted(rng.sample(range(len(ids) + 1), min(2, len(ids))))
        blocks = [ids[i:j] for i, j in zip([0, *cut], [*cut, len(ids)], strict=True)]
        rows.append((k, ids, ties, blocks, [(rng.choice(ids or [1]), rng.randrange(100) if rng.random() < 0.1 else rng.choice(ids or [2])) for _ in range(rng.randint(0, 6))]))
    df = spark.createDataFrame(rows, "k long, ids array<long>, ties map<string,double>, blocks array<array<long>>, edges array<struct<a:long,b:long>>")
    got = {r["k"]: (r["x"], r["y"]) for r in df.select("k", packing.affinity_order(F.col("ids"), F.col("ties")).alias("x"), packing.repair_order(F.col("blocks"), F.col("edges")).alias("y")).collect()}
    for k, ids, ties, blocks, edges in rows:
        out, rest = ids[:1], ids[1:]
        while rest:
            out.append(max(rest, key=lambda x: (ties.get(f"{min(x, out[-1])}|{max(x, out[-1])}", 0), -rest.index(x))))
            rest = [x for x in rest if x != out[-1]]
        at = lambda bs, x: next((i for i, b in enumerate(bs) if x in b), -1)
        bs = list(blocks)
        for _ in range(len(bs) + 2 if len(bs) > 1 else 0):
            wrong = next(((at(bs, a), at(bs, b)) for a, b in edges if 0 <= at(bs, b) < at(bs, a)), None)
            if wrong:
                bs.insert(wrong[1], bs.pop(wrong[0]))
        assert got[k] == (out, bs)


def test_gains_take_one_set_of_pairs(spark, monkeypatch):
    """Both answers are worked out on the same rows, cycles back to the probe included."""
    edges = spark.createDataFrame([(1, a, b) for a, b in ((1, 2), (2, 1), (2, 3), (3, 4), (5, 3))], "doc long, src long, dst long")
    believed = spark.createDataFrame([(1, i, 0.1 + i / 8) for i in range(1, 7)], "doc long, node long, belief double")
    both = believed.select("doc", F.col("node").alias("probe"), F.explode(F.array(F.lit("knew"), F.lit("missed"))).alias("response"))
    each = beliefs.propagate(both, edges, believed).withColumn("fall", binary_entropy(F.col("before")) - binary_entropy(F.col("after")))
    falls = {(r["probe"], r["response"]): r["fall"] for r in each.groupBy("probe", "response").agg(F.sum("fall").alias("fall")).collect()}
    monkeypatch.setattr(beliefs, "propagate", None)
    got = {r["node"]: r["gain"] for r in beliefs.information_gain(believed, beliefs.near_nodes(edges, believed), believed).collect()}
    assert got == pytest.approx({i: (0.1 + i / 8) * falls[i, "knew"] + (0.9 - i / 8) * falls[i, "missed"] for i in range(1, 7)})


def test_trees_are_made_once(spark):
    out = hierarchy.flat_tree(spark.createDataFrame([(1, '[{"children": [{}]}]')], "id int, tree string"), "id", "tree")
    assert sorted(r["path"] for r in out.collect()) == ["1", "1.1"]
    assert out._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1


def test_sections_of_many_lines(spark):
    """Ranges and nodes of a text cost what they are, not their product: 20,000 lines took minutes."""
    n = 20_000
    nodes = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.alias("node"), (i * 3).alias("start"), (i * 3 + 2).alias("end")))
    began = time.perf_counter()
    df = spark.range(1).select(nodes.alias("nodes")).withColumn("kept", hierarchy.kept_ranges(F.col("nodes")))
    row = df.select("kept", hierarchy.scoped_nodes(F.col("nodes"), F.col("kept")).alias("out")).first()
    assert time.perf_counter() - began < 60
    assert [tuple(x) for x in row["kept"]] == [(3 * i, 3 * i + 2, 4 * i) for i in range(n)]
    assert [tuple(x) for x in row["out"]] == [(i, 4 * i, 4 * i + 2) for i in range(n)]


# the greatest number of rows that a step deals, for each line
DEALT = {"neighbours": 3, "co_occurrence": 1.5, "table_grids": 1, "filled_tables": 1, "material_graph": 6, "global_graph": 1.5}


@pytest.mark.parametrize("name", sorted(DEALT))
def test_tasks_grow_with_rows(spark, monkeypatch, name):
    """Rows are dealt to as many tasks as they need; as many as there are shuffle partitions held more and more each."""
    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(session, "TASK_ROWS", 200)
    plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    lines = session.table(spark, sf, "lineitem").count()
    dealt = [int(n) for n in re.findall(r"hashpartitioning\([^\n]*, (\d+)\), REPARTITION_BY_NUM", plan)]
    assert max(dealt, default=0) >= DEALT[name] * lines / 200 and min(dealt) >= lines / 200


def test_glyphs_are_dealt_once(spark):
    """The words of pages were sent three times on their way to lines in reading order."""
    plan = catalogue.QUERIES["reading_order"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(.*\), (\w+)", plan)
    # the rest are the places where glyphs begin, and one border a page, for pages with an id and without
    assert dealt.count("REPARTITION_BY_COL") == 1 and len(dealt) <= 6, plan


def test_outlines_take_blocks_as_they_are(spark):
    """An entry is dealt to three cells of pages; blocks used to be dealt once for each word and three letters of their text."""
    o = spark.createDataFrame([(1, 0, 3, "Methods of work")], "doc long, entry long, page long, title string")
    b = spark.createDataFrame([(1, k, k, "Words of a long block. " * 50 + str(k)) for k in range(40)] + [(1, 40, 7, "Methods of work")], "doc long, block long, page long, text string")
    got = outline.match_outline(o, b)
    assert [tuple(r) for r in got.collect()] == [(1, 0, 40, 95, 2)]
    # the entries, once to choose blocks and once to meet them
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 2


def test_near_copies_cost_their_rows(spark, monkeypatch):
    """A class of 120 near copies took all its 7140 pairs; now each set meets few others, and what joins two groups is found."""
    common = list(range(1000, 1100))
    rows = [(i, [*common, 5000 + i, 6000 + i]) for i in range(120)]
    rows += [(200 + i, [k + 10_000 + 2 * i for k in range(40)]) for i in range(12)]
    sets = spark.createDataFrame(rows, "id long, members array<long>")
    met, write = [], joins.materialize
    monkeypatch.setattr(joins, "materialize", lambda df, name="step", **more: met.append((name, write(df, name, **more))) or met[-1][1])
    got = {r["id"]: r["class_id"] for r in joins.set_similarity_classes(sets, 0.85).collect()}
    assert got == {i: 0 if i < 200 else 200 for i, _ in rows}
    assert sum(df.count() for name, df in met if name == "pairs") < 2000

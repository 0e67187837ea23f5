"""Strong components and broken cycles against plain searches."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from studyloom.operators import graph


def reachable(edges, start):
    seen, open_ = {start}, [start]
    while open_:
        x = open_.pop()
        for a, b, *_ in edges:
            if a == x and b not in seen:
                seen.add(b)
                open_.append(b)
    return seen


def closing(edges):
    """Edges that are the lightest of a cycle: their end reaches their beginning over heavier ones."""
    key = lambda e: (e[2], e[0], e[1])
    return {e[:2] for e in edges if e[0] == e[1] or e[0] in reachable([x for x in edges if key(x) > key(e) and x[0] != x[1]], e[1])}


def graphs():
    rng = random.Random(4)
    for n, m in ((5, 12), (8, 15)):
        yield list({(a, b): (a, b, rng.randrange(4) / 4) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m))}.values())
    yield [(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0)]
    yield [(1, 1, 1.0), (1, 2, 0.5), (2, 1, 0.5)]


@pytest.mark.parametrize("small", [2000, 0])
def test_break_cycles(spark, small):
    """All graphs side by side in one table, so that components of many sizes are solved together."""
    edges = [(100 * i + a, 100 * i + b, w) for i, g in enumerate(graphs()) for a, b, w in g]
    odd = [(None, 1, 1.0), (2, None, 0.3), (edges[0][0], edges[0][1], edges[0][2] + 5)]
    out = graph.break_cycles(spark.createDataFrame(edges + odd, "src long, dst long, weight double"), small).collect()
    assert sorted((r["src"], r["dst"], r["weight"]) for r in out) == sorted(edges)
    assert {(r["src"], r["dst"]) for r in out if r["dropped"]} == closing(edges)
    kept = [(r["src"], r["dst"]) for r in out if not r["dropped"]]
    assert all(a not in reachable(kept, b) for a, b in kept)


def test_dense_graphs_in_a_task(spark, monkeypatch):
    """Some thousand edges between few nodes went through rounds, each of several jobs; edge by edge they take minutes."""
    rng = random.Random(6)
    pairs = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(2000)})
    few = [(a, b, rng.randrange(9) / 9) for a, b in pairs if a != b]
    found = pd.DataFrame([(a, b) for a, b, _ in sorted(few, key=lambda e: (-e[2], -e[0], -e[1]))], columns=["src", "dst"])
    assert set(graph._closing(found.assign(r=range(len(found))))) == closing(few)
    monkeypatch.setattr(graph, "strong_components", None)
    many = [(f"n{a:03}", f"n{b:03}", float(rng.randrange(50))) for a in range(150) for b in range(150) if a != b and rng.random() < 0.9]
    began = time.perf_counter()
    out = graph.break_cycles(spark.createDataFrame(many, "src string, dst string, weight double")).collect()
    assert time.perf_counter() - began < 60 and len(out) == len(many)
    kept = {(r["src"], r["dst"]) for r in out if not r["dropped"]}
    assert len(graph._strong_parts(list(kept))) == len(set(graph._strong_parts(list(kept)).values()))


def test_strong_components(spark):
    edges = [(str(i), f"n{a}", f"n{b}") for i, g in enumerate(graphs()) for a, b, _ in g]
    out = graph.strong_components(spark.createDataFrame(edges, "g string, src string, dst string")).collect()
    got = {(r["g"], r["node"]): r["component"] for r in out}
    for i in {g for g, *_ in edges}:
        mine = [(a, b) for g, a, b in edges if g == i]
        near = {x: reachable(mine, x) for e in mine for x in e}
        for x in near:
            same = {y for y in near[x] if x in near[y]}
            assert got.get((i, x)) == (max(same) if len(same) > 1 else None)


def test_probe_graph(spark):
    edges = spark.createDataFrame([("a", "b", 0.9), ("b", "a", 0.2), ("b", "x", 1.0)], "src string, dst string, weight double")
    nodes = spark.createDataFrame([("a",), ("b",)], "node string")
    out = {(r["src"], r["dst"]): r["dropped"] for r in graph.probe_graph(nodes, edges).collect()}
    assert out == {("a", "b"): False, ("b", "a"): True}
    assert graph.probe_graph(nodes.limit(0), edges).collect() == []
    with pytest.raises(ValueError, match="occurs twice"):
        graph.probe_graph(nodes.unionByName(nodes.where(F.col("node") == "a")), edges)

"""Nested trees as rows, and offsets in texts of which parts are left out."""

import json
import random

from pyspark.sql import functions as F

from studyloom.operators import hierarchy as H


def test_flat_tree(spark):
    tree = [{"t": "a", "children": [{"t": "b", "children": [{"t": "c"}]}, 7, {"t": "d", "children": []}]}, {"t": "e", "children": None}]
    deep = [{"t": "0"}]
    for i in range(1, 9):
        deep = [{"t": str(i), "children": deep}]
    rows = [(1, json.dumps(tree)), (2, "[broken"), (3, None), (4, "[]"), (5, json.dumps(deep))]
    out = H.flat_tree(spark.createDataFrame(rows, "id int, tree string"), "id", "tree").collect()
    got = sorted((r["id"], r["level"], r["path"], r["parent"], json.loads(r["node"])["t"]) for r in out)
    want = [(1, 1, "1", None, "a"), (1, 1, "2", None, "e"), (1, 2, "1.1", "1", "b"), (1, 2, "1.3", "1", "d"), (1, 3, "1.1.1", "1.1", "c")]
    want += [(5, k, ".".join(["1"] * k), ".".join(["1"] * (k - 1)) or None, str(9 - k)) for k in range(1, 7)]
    assert got == sorted(want, key=str) or got == sorted(want, key=lambda x: (x[0], x[1], x[2]))


def test_scoped_nodes(spark):
    """Ranges in any order, overlapping or empty; nodes within, across and outside of them, by a map of characters."""
    rng = random.Random(6)
    text = "".join(chr(97 + i % 26) for i in range(300))
    cases = [([], [(1, 0, 300)]), ([(0, 300)], [(1, 5, 9)]), ([(9, 9)], [(1, 0, 20)])]
    for _ in range(25):
        ranges = [(s := rng.randrange(290), min(300, s + rng.randrange(60))) for _ in range(rng.randrange(6))]
        cases.append((ranges, [(i, s := rng.randrange(290), min(300, s + 1 + rng.randrange(80))) for i in range(8)]))
    df = spark.createDataFrame([(i, text, r, n) for i, (r, n) in enumerate(cases)], "id int, text string, ranges array<struct<start:int,end:int>>, nodes array<struct<node:int,start:int,end:int>>")
    df = df.withColumn("kept", H.kept_ranges(F.col("ranges")))
    out = {r["id"]: r for r in df.select("id", H.scoped_text(F.col("text"), F.col("kept")).alias("scoped"), H.scoped_nodes(F.col("nodes"), F.col("kept")).alias("nodes")).collect()}
    for i, (ranges, nodes) in enumerate(cases):
        inside = sorted({c for s, e in ranges for c in range(s, e)})
        place, scoped, last = {}, "", None
        for c in inside:
            # ranges that touch are one
            scoped += H.DELIMITER if last is not None and c != last + 1 else ""
            place[c], last = len(scoped), c
            scoped += text[c]
        assert out[i]["scoped"] == scoped
        want = []
        for node, s, e in nodes:
            mine = [c for c in inside if s <= c < e]
            if mine:
                want.append((node, place[mine[0]], place[mine[-1]] + 1))
        assert [(n["node"], n["start"], n["end"]) for n in out[i]["nodes"]] == want, i

"""Packs through Markdown and back, and merged as if one after another."""

import base64
import json
import random

from pyspark.sql import functions as F

from studyloom.operators import packs as P
from studyloom.session import mark


def test_written_and_read(spark):
    pack = ("Español", [("a", "¿Qué — es?\n<!-- x -->", "sí"), ("b", None, None)], ["b", "a"], [("n", "N")], [("e", "a", "b", "t")])
    df = spark.createDataFrame([(1, pack), (2, (None, [], None, None, None)), (3, ("x", None, None, None, None))], "id int, p struct<language:string,items:array<struct<id:string,text:string,answer:string>>,study_order:array<string>,nodes:array<struct<id:string,label:string>>,edges:array<struct<id:string,src:string,dst:string,type:string>>>")
    files = df.select("id", "p", P.pack_markdown(F.col("p"), F.lit("T")).alias("text"))
    out = {r["id"]: r for r in P.read_packs(files).collect()}
    assert out[1]["status"] == "ok" and out[1]["pack"] == out[1]["p"]
    assert out[2]["status"] == out[3]["status"] == "no_items" and out[2]["pack"] is None
    broken = [(1, None), (2, "no capsule"), (3, "<!-- study-pack:v1:!!! -->"), (4, "<!-- study-pack:v1:QUJD= -->"), (5, "<!-- study-pack:v1:" + base64.b64encode(b"[1, 2").decode() + " -->"), (6, "<!-- study-pack:v1:" + base64.b64encode(json.dumps({"items": [{"id": "q"}]}).encode()).decode() + "\n-->")]
    got = {r["id"]: r["status"] for r in P.read_packs(spark.createDataFrame(broken, "id int, text string")).collect()}
    assert got == {1: "missing_capsule", 2: "missing_capsule", 3: "missing_capsule", 4: "invalid_capsule", 5: "invalid_capsule", 6: "ok"}


def test_unique_ids(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, None]), i, rng.choice(["x", "x_2", "x_2_2", "x_3", "y", " y ", "", None, "item"])) for i in range(80)]
    out = P.unique_ids(spark.createDataFrame(rows, "g int, at int, id string"), "g", ["at"], "id").collect()
    got, used = {r["at"]: r["new_id"] for r in out}, {}
    for g, at, id_ in rows:
        base, n = (id_ or "").strip() or "item", 1
        name = base
        while name in used.setdefault(g, set()):
            n += 1
            name = f"{base}_{n}"
        used[g].add(name)
        assert got[at] == name, (g, at, id_)


def test_merge(spark):
    """Three packs with clashing ids keep all items and edges; the first label of a node counts."""
    packs = [(1, k, ("en", [("a", f"t{k}", ""), ("b", f"u{k}", "")], ["b", "a"], [("n", f"label {k}"), (f"m{k}", "")], [("e", "n", f"m{k}", "t"), ("f", "n", "n", "t")])) for k in (3, 1, 2)] + [(1, 9, None)]
    schema = "target int, at int, pack struct<language:string,items:array<struct<id:string,text:string,answer:string>>,study_order:array<string>,nodes:array<struct<id:string,label:string>>,edges:array<struct<id:string,src:string,dst:string,type:string>>>"
    out = {k: v.collect() for k, v in P.merge_packs(spark.createDataFrame(packs, schema)).items()}
    assert sorted((r["at"], r["pos"], r["new_id"]) for r in out["items"]) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "a_2"), (2, 1, "b_2"), (3, 0, "a_3"), (3, 1, "b_3")]
    assert [r["new_id"] for r in sorted(out["study_order"], key=lambda r: (r["at"], r["pos"]))] == ["b", "a", "b_2", "a_2", "b_3", "a_3"]
    assert {r["id"]: r["label"] for r in out["nodes"]} == {"n": "label 1", "m1": "", "m2": "", "m3": ""}
    assert sorted((r["src"], r["dst"], r["new_id"]) for r in out["edges"]) == [("n", "m1", "e"), ("n", "m2", "e_2"), ("n", "m3", "e_3"), ("n", "n", "f")]


def test_work_on_packs_is_done_once(spark):
    """A capsule is decoded once, parts that nobody asks for aren't worked out, and ids that can't meet need no rounds."""
    files = spark.createDataFrame([(1, 1, "x")], "target int, at int, text string")
    read = P.read_packs(files).where("status = 'ok' and pack is not null").select("target", "pack", "status")
    assert read._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    rows = spark.createDataFrame([(k % 3, k, f"c{k % 5}") for k in range(90)], "g int, at int, id string")
    before = mark()
    out = P.unique_ids(rows, "g", ["at"], "id")
    assert mark() - before <= 2
    assert out.select("g", "new_id").distinct().count() == 90
    before = mark()
    assert list(P.merge_packs(read.withColumn("at", F.lit(1)), parts=["edges"])) == ["edges"]
    assert mark() - before <= 3

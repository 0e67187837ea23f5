"""Study packs: written as Markdown with a capsule that holds all of them, read back, and merged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.operators.ranking import rank_in_key
from studyloom.session import materialize

#: A pack: items with ids, the order in which they are studied, and a graph.
PACK = "language string, items array<struct<id:string,text:string,answer:string>>, study_order array<string>, nodes array<struct<id:string,label:string>>, edges array<struct<id:string,src:string,dst:string,type:string>>"
_CAPSULE = "(?s)<!--\\s*study-pack:v1:([A-Za-z0-9+/=\\s]+?)-->"


def pack_markdown(pack: Column, title: Column) -> Column:
    """A pack (struct of PACK) as Markdown to read, and its capsule behind it."""
    line = lambda x, i: F.concat(F.lit("### "), (i + 1).cast("string"), F.lit("\n\n"), F.coalesce(x["text"], F.lit("")), F.lit("\n\n- **"), F.coalesce(x["answer"], F.lit("")), F.lit("**\n"))
    shown = F.array_join(F.transform(F.coalesce(pack["items"], F.array().cast("array<struct<id:string,text:string,answer:string>>")), line), "\n")
    capsule = F.regexp_replace(F.base64(F.encode(F.to_json(pack, {"ignoreNullFields": "false"}), "UTF-8")), "\\s", "")
    return F.concat(F.lit("# "), title, F.lit("\n\n"), shown, F.lit("\n<!-- study-pack:v1:"), capsule, F.lit(" -->\n"))


def read_packs(files: DataFrame, text: str = "text") -> DataFrame:
    """files with `pack` (struct of PACK, or null) and `status`: ok, missing_capsule, invalid_capsule or no_items."""
    # exploded, as an expression that filters and several columns read would be worked out for each of them
    once = lambda df, name, value: df.withColumn(name, F.explode(F.array(value)))
    out = once(files, "__held", F.regexp_extract(F.coalesce(text, F.lit("")), _CAPSULE, 1))
    out = once(out, "__json", F.decode(F.call_function("try_to_binary", F.regexp_replace("__held", "\\s", ""), F.lit("base64")), "UTF-8"))
    looks = F.get_json_object("__json", "$.items").isNotNull() | F.col("__json").rlike("^\\s*\\{")
    out = once(out, "pack", F.when(looks, F.from_json("__json", PACK)))
    some = F.size(F.coalesce(F.filter("pack.items", lambda x: x["id"].isNotNull() | x["text"].isNotNull()), F.array().cast("array<struct<id:string,text:string,answer:string>>"))) > 0
    status = F.when(F.col("__held") == "", "missing_capsule").when(F.col("pack").isNull(), "invalid_capsule").when(~some, "no_items").otherwise("ok")
    return out.withColumn("status", status).withColumn("pack", F.when(F.col("status") == "ok", F.col("pack"))).drop("__held", "__json")


def unique_ids(rows: DataFrame, group: str, order: list[str], id_: str, name: str = "new_id") -> DataFrame:
    """rows with an id that is unique in their group: in order, each takes its own id, or the first of id_2, id_3, ... that no earlier row has.

    order is total within a group. The n-th row of an id has n behind it, unless other ids of
    the group end in numbers too (a and a_2): there every row asks for its next free name; the
    earliest that asks has it, and one that loses it asks for the next. That ends as if rows
    had come one after another, and as the n-th row of an id can't have less than n, it ends
    soon. Blank ids are "item".
    """
    kept = rows.columns
    base = F.when(F.trim(F.coalesce(id_, F.lit(""))) == "", "item").otherwise(F.trim(id_))
    r = rows.withColumn("__base", base).withColumn("__key", F.concat_ws("\u0001", F.col(group).cast("string"), "__base"))
    # names meet only where all but the numbers at their ends is equal
    stem = F.regexp_replace("__base", "(_[0-9]+)+$", "")
    numbered = r.where(F.col("__base").rlike("_[0-9]+$")).select(F.col(group).alias("__g"), stem.alias("__s")).distinct()
    numbered = materialize(numbered, "numbered-ids", thin=True)
    ranked = rank_in_key(r, "__key", [F.col(c) for c in order], "__n")
    wanted = F.when(F.col("__n") == 1, F.col("__base")).otherwise(F.concat_ws("_", "__base", F.col("__n").cast("string")))
    if numbered.isEmpty():
        return ranked.select(*kept, wanted.alias(name))
    contested = F.col(group).eqNullSafe(F.col("__g")) & (stem == F.col("__s"))
    free = ranked.join(numbered, contested, "left_anti").select(*kept, wanted.alias(name))
    asked = materialize(ranked.join(numbered, contested, "left_semi"), "asked").withColumn("__place", F.struct(*order))
    while True:
        named = materialize(asked.withColumn("__want", wanted), "named")
        first = named.groupBy(F.col(group).alias("__g"), F.col("__want").alias("__w")).agg(F.min("__place").alias("__first"))
        met = named.join(first, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__want") == F.col("__w")))
        met = materialize(met.withColumn("__lost", F.col("__place") > F.col("__first")), "named")
        if met.where("__lost").isEmpty():
            return free.unionByName(met.select(*kept, F.col("__want").alias(name)))
        asked = met.select(*kept, "__base", (F.col("__n") + F.col("__lost").cast("int")).alias("__n"), "__place")


PARTS = ("items", "study_order", "nodes", "edges")


def merge_packs(packs: DataFrame, group: str = "target", at: str = "at", parts: Sequence[str] = PARTS) -> dict[str, DataFrame]:
    """items, study_order, nodes and edges of packs (group, at, pack) merged into one for each group, packs in the order of `at`.

    Only the parts that are named are worked out.

    Items keep their order and get unique ids; study orders are renamed with the items of
    their pack and follow each other. Of nodes with one id the first counts. Edges are one
    where ends and type are equal; their ids are made unique, so none is lost.
    """
    p = materialize(packs.where("pack is not null").select(F.col(group).alias("target"), F.col(at).alias("at"), "pack"), "packs")
    one = lambda column: p.select("target", "at", F.posexplode(f"pack.{column}").alias("pos", "x"))
    out = {}
    if "items" in parts or "study_order" in parts:
        items = one("items").select("target", "at", "pos", F.col("x.id").alias("id"), "x.text", "x.answer")
        items = unique_ids(items, "target", ["at", "pos"], "id")
        out["items"] = items = materialize(items, "merged-items") if "study_order" in parts else items
        names = items.groupBy("target", "at", "id").agg(F.min_by("new_id", "pos").alias("new_id"))
        orders = p.select("target", "at", F.posexplode("pack.study_order").alias("pos", "id")).join(names, ["target", "at", "id"])
        out["study_order"] = orders.select("target", "at", "pos", "new_id")
    if "nodes" in parts:
        out["nodes"] = one("nodes").where("x.id is not null").groupBy("target", F.col("x.id").alias("id")).agg(F.min_by("x.label", F.struct("at", "pos")).alias("label"))
    if "edges" in parts:
        ends = F.struct("x.src", "x.dst", "x.type")
        edges = one("edges").where("x.src is not null and x.dst is not null").groupBy("target", ends.alias("e")).agg(F.min(F.struct("at", "pos", F.col("x.id").alias("id"))).alias("f"))
        edges = edges.select("target", "f.at", "f.pos", "f.id", "e.src", "e.dst", "e.type")
        out["edges"] = unique_ids(edges, "target", ["at", "pos"], "id")
    return {k: out[k] for k in PARTS if k in parts}

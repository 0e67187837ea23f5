"""Rows of foreign origin brought into one form, and what a damaged answer still holds."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.functions.outcomes import looked_up

#: Kinds of review sources, and what earlier versions called them.
SOURCES = ("rsvp_block", "cloze_item", "slow_flashcard", "vault_concept", "vault_review_item", "global_concept", "recall_question")
LEGACY_SOURCES = {"rsvp": "rsvp_block", "questions": "rsvp_block", "cloze": "cloze_item", "slow": "slow_flashcard", "vault_decay": "vault_concept", "vault": "vault_concept", "vault_review": "vault_review_item"}
PROVENANCES = ("document", "gap_fill", "mnemonic", "vault_curation")
LEGACY_PROVENANCES = {"mnemonic": "mnemonic", "vault_curation": "vault_curation", "vault": "vault_curation", "gap_fill": "gap_fill"}
#: Weights of a connection: least, first, greatest.
LEAST_WEIGHT, FIRST_WEIGHT, MOST_WEIGHT = 0.05, 0.30, 1.0
LETTERS = ("A", "B", "C", "D")


def text_of(c: Column) -> Column:
    """Trimmed text, null where nothing is left."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def source_type(given: Column, legacy: Column) -> Column:
    return F.when(given.isin(*SOURCES), given).otherwise(looked_up(F.trim(legacy), LEGACY_SOURCES, None))


def provenance(given: Column, legacy: Column) -> Column:
    return F.when(F.trim(given).isin(*PROVENANCES), F.trim(given)).otherwise(looked_up(F.trim(legacy), LEGACY_PROVENANCES, "document"))


def clamped(c: Column, low: object, high: object, rest: object) -> Column:
    """c within low and high; rest where it is no number."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(F.nanvl(c.cast("double"), F.lit(None).cast("double")), F.lit(rest))))


def clean_array(a: Column) -> Column:
    """Trimmed members, each once, without empty ones; an empty array for null."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""))


def normal_connections(rows: DataFrame, source: str, target: str, weight: str, order: str) -> DataFrame:
    """(source, target, weight): the first row of each ordered pair, weight clamped; no loops, no missing ends."""
    s, t = text_of(F.col(source)), text_of(F.col(target))
    w = clamped(F.col(weight), LEAST_WEIGHT, MOST_WEIGHT, FIRST_WEIGHT)
    kept = rows.select(s.alias("source"), t.alias("target"), w.alias("weight"), F.col(order).alias("__o")).where(F.col("source") != F.col("target"))
    return kept.groupBy("source", "target").agg(F.min_by("weight", "__o").alias("weight"))


def with_both_ends(edges: DataFrame, nodes: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """The edges whose ends are both nodes."""
    ids = nodes.select(F.col("node").alias("__n"))
    return edges.join(ids, F.col(src) == F.col("__n"), "left_semi").join(ids, F.col(dst) == F.col("__n"), "left_semi")


def dangling(edges: DataFrame, nodes: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """The edges with an end that is no node."""
    ids = nodes.select(F.col("node").alias("__n"))
    gone = edges.join(ids, F.col(src) == F.col("__n"), "left_anti")
    return gone.unionByName(edges.join(ids, F.col(src) == F.col("__n"), "left_semi").join(ids, F.col(dst) == F.col("__n"), "left_anti"))


def without_orphans(nodes: DataFrame, edges: DataFrame, always: Column) -> DataFrame:
    """The nodes that have an edge, and those that are always kept."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("__end", F.lit(True))
    return nodes.join(ends, "node", "left").where(F.col("__end").isNotNull() | always).drop("__end")


def option_letter(answer: Column, options: Column) -> Column:
    """A to D from a letter, a number (0 to 3, or 4 for D) or the text of one of four options; else the answer."""
    raw = F.trim(answer)
    at = F.array_position(F.transform(options, lambda o: F.lower(F.trim(o))), F.lower(raw)).cast("int")
    number = raw.try_cast("int")
    by = F.when(F.upper(raw).isin(*LETTERS), F.upper(raw)).when(number.between(0, 3), F.char(65 + number)).when(number == 4, "D")
    return by.when(at > 0, F.char(64 + at)).otherwise(raw)


def letter_map(before: Column, after: Column) -> Column:
    """What each letter of the options before has become, in the order A to D."""
    return F.transform(before, lambda o: F.char(64 + F.array_position(after, o).cast("int")))


def is_truncated_json(text: Column) -> Column:
    """It begins as JSON, can't be read, and is longer than 200 characters."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), "^```[a-zA-Z]*\\s*", ""), "\\s*```$", ""))
    return F.coalesce(t.rlike("^[{\\[]") & F.try_parse_json(t).isNull() & (F.length(t) > 200), F.lit(False))


def unwrapped(text: Column, keys: tuple[str, ...] = ("blocks", "block_index", "items", "data")) -> Column:
    """The array in a JSON text: the text itself, or what the first of keys that is there holds."""
    return F.when(F.trim(text).startswith("["), text).otherwise(F.coalesce(*(F.get_json_object(text, f"$.{k}") for k in keys)))


_MARKS = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\Z)|[{}\]]', re.S)


def complete_objects(text: str | None, key: str) -> list[str]:
    """The whole objects of the array under key in a text that may break off; broken ones are left out."""
    opened = re.search(rf'"{re.escape(key)}"\s*:\s*\[', text or "")
    if not opened:
        return []
    found, depth, begin = [], 0, 0
    for m in _MARKS.finditer(text, opened.end()):
        if m[0] == "{":
            begin = m.start() if depth == 0 else begin
            depth += 1
        elif m[0] == "]" and depth == 0:
            break
        elif m[0] == "}" and depth:
            depth -= 1
            if depth == 0:
                try:
                    json.loads(text[begin : m.end()])
                    found.append(text[begin : m.end()])
                except ValueError:
                    continue
    return found


def recovered_objects(df: DataFrame, text: str, key: str, name: str = "objects") -> DataFrame:
    """df with an array of the whole objects in each text."""
    kept = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{name: [complete_objects(t, key) for t in batch[text]]})

    fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return df.select(*kept).mapInPandas(run, f"{fields}, {name} array<string>")


def own_spans(children: Column, start: Column, end: Column) -> Column:
    """Structs (start, end) of a section's text that none of its children, structs (start, end), holds."""

    def step(acc: Column, c: Column) -> Column:
        stop = F.least(c["start"], end)
        gap = F.when(stop > acc["at"], F.array(F.struct(acc["at"].alias("start"), stop.alias("end")))).otherwise(F.filter(F.array(F.struct(start.alias("start"), end.alias("end"))), lambda x: F.lit(False)))
        return F.struct(F.concat(acc["out"], gap).alias("out"), F.greatest(acc["at"], F.least(c["end"], end)).alias("at"))

    none = F.filter(F.array(F.struct(start.alias("start"), end.alias("end"))), lambda x: F.lit(False))
    done = lambda acc: F.when(acc["at"] < end, F.array_append(acc["out"], F.struct(acc["at"].alias("start"), end.alias("end")))).otherwise(acc["out"])
    return F.aggregate(F.array_sort(children), F.struct(none.alias("out"), start.alias("at")), step, done)


_ITEM = "struct<item_id:string,id:string,concept_id:string,question:string,type:string,options:array<string>,correct:string,answer:string,edge:struct<from:string,to:string>>"


def assessment_items(df: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, place, item_id, concept_id, edge, question, options, correct, fault) of JSON arrays of assessment items.

    The array stands alone or under items or questions. fault says why an item isn't one:
    not an object, no question, another type than mcq, fewer than two options, an edge
    without both ends; it is null for good items. Texts are trimmed, blank options go, an
    item without an id is called after its place. Arrays that can't be read have no rows.
    """
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    whole = F.coalesce(F.get_json_object(raw, "$.items"), F.get_json_object(raw, "$.questions"), F.col(raw))
    each = df.select(key, F.posexplode(F.from_json(whole, "array<string>")).alias("i", "json"))
    each = each.select(key, (F.col("i") + 1).alias("place"), F.col("json").rlike("^\\s*\\{").alias("object"), F.from_json("json", _ITEM).alias("x"))
    named = F.when(text(F.col("x.item_id")) != "", text(F.col("x.item_id"))).when(text(F.col("x.id")) != "", text(F.col("x.id"))).otherwise(F.concat(F.lit("item_"), F.col("place").cast("string")))
    options = F.filter(F.transform(F.coalesce("x.options", F.array().cast("array<string>")), text), lambda o: o != "")
    kind = F.lower(F.when(text(F.col("x.type")) == "", "mcq").otherwise(text(F.col("x.type"))))
    edge = F.col("x.edge").isNotNull()
    ends = (text(F.col("x.edge.from")) != "") & (text(F.col("x.edge.to")) != "")
    fault = F.when(~F.coalesce("object", F.lit(False)), "not an object").when(text(F.col("x.question")) == "", "no question").when(kind != "mcq", "type").when(F.size(options) < 2, "options").when(edge & ~ends, "edge")
    tied = F.when(edge & ends, F.struct(text(F.col("x.edge.from")).alias("from"), text(F.col("x.edge.to")).alias("to")))
    right = F.when(text(F.col("x.correct")) != "", text(F.col("x.correct"))).otherwise(text(F.col("x.answer")))
    return each.select(key, "place", named.alias("item_id"), F.nullif(text(F.col("x.concept_id")), F.lit("")).alias("concept_id"), tied.alias("edge"), text(F.col("x.question")).alias("question"), options.alias("options"), right.alias("correct"), fault.alias("fault"))

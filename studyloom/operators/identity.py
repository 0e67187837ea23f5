"""Which concept a name means, merging what is known of it, and relinking references."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.functions import text as T
from studyloom.session import materialize

#: A score from SURE on is the same concept, from HINT on a related one.
SURE, HINT = 0.85, 0.6
#: Fixed value: the score of an alias.
ALIAS = 0.95
GRAM = 3


def _grams(text: Column, size: int) -> Column:
    """Distinct substrings of a length; none where the text is shorter."""
    at = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(size))))


def substring_pairs(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """(a, b): rows of parts (a, part) whose part, not empty, stands in a row of wholes (b, whole).

    A part is looked up by one of its three-letter substrings, that of the least hash, so a
    substring that all have in common is hardly ever the key. Shorter parts go by themselves.
    """
    p = parts.where(F.length("part") > 0)
    own = F.when(F.length("part") < GRAM, F.col("part")).otherwise(F.array_min(F.transform(_grams(F.col("part"), GRAM), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g"))))["g"])
    w = wholes.withColumn("key", F.explode(F.concat(*(_grams(F.col("whole"), k) for k in range(1, GRAM + 1)))))
    p = p.withColumn("key", own)
    return p.join(w, "key").where(F.contains("whole", "part")).select("a", "b")


def token_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b): rows of left (a, words) and right (b, words) that may share `least` of the longer one's words.

    Prefix filtering: of a name's distinct words only as many are keys, from the rarest, as
    it could do without; a name with a word twice has all its words as keys.
    """
    both = left.select(F.explode(F.array_distinct("words")).alias("w")).unionByName(right.select(F.explode(F.array_distinct("words")).alias("w")))
    often = materialize(both.groupBy("w").agg(F.count("*").alias("df")), "name-words")
    twice = F.size("words") > F.size(F.array_distinct("words"))
    every = lambda rows, name: rows.select(name, F.explode(F.array_distinct("words")).alias("w"))

    def keys(rows: DataFrame, name: str) -> DataFrame:
        n, distinct = F.size("words"), F.size(F.array_distinct("words"))
        take = F.when(n == distinct, n - F.ceil(F.lit(least) * n - 1e-9).cast("int") + 1).otherwise(distinct)
        each = rows.select(name, take.alias("take"), F.explode(F.array_distinct("words")).alias("w")).join(often, "w")
        kept = each.groupBy(name).agg(F.slice(F.array_sort(F.collect_list(F.struct("df", "w"))), F.lit(1), F.first("take")).alias("ks"))
        return kept.select(name, F.explode("ks").alias("k")).select(name, F.col("k.w").alias("w"))

    pairs = keys(left, "a").join(keys(right, "b"), "w")
    # one word may make up the share of a name that repeats it, whatever the other name's first keys are
    for x, y in ((every(left.where(twice), "a"), every(right, "b")), (every(right.where(twice), "b"), every(left, "a"))):
        pairs = pairs.unionByName(x.join(y, "w"))
    return pairs.select("a", "b").distinct()


def candidates(names: DataFrame, registry: DataFrame) -> DataFrame:
    """(name, id) of the concepts that a name could mean.

    names: name, description. registry: id, canonical, aliases. A candidate has the same
    slug, an alias equal to the name, a canonical name that holds the first 20 characters
    of the description, or one that is alike by HINT or more: by length where one holds the
    other, else by shared words.
    """
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    n = names.select(F.col("name").alias("a"), low(F.col("name")).alias("low"), T.slug(low(F.col("name"))).alias("slug"), F.substring(low(F.col("description")), 1, 20).alias("part"))
    r = registry.select(F.col("id").alias("b"), F.lower("canonical").alias("whole"), T.slug(F.lower(F.trim("canonical"))).alias("slug"), "aliases")
    by_slug = n.join(r, "slug").select("a", "b")
    by_alias = n.join(r.select("b", F.explode("aliases").alias("alias")), F.col("low") == F.lower("alias")).select("a", "b")
    by_text = substring_pairs(n.select("a", "part"), r.select("b", "whole"))
    inside = substring_pairs(n.select("a", F.col("low").alias("part")), r.select("b", "whole"))
    around = substring_pairs(r.select(F.col("b").alias("a"), F.col("whole").alias("part")), n.select(F.col("a").alias("b"), F.col("low").alias("whole"))).select(F.col("b").alias("a"), F.col("a").alias("b"))
    shared = token_pairs(n.select("a", T.words(F.col("low")).alias("words")), r.select("b", T.words(F.col("whole")).alias("words")), HINT)
    fuzzy = inside.unionByName(around).unionByName(shared).distinct().join(n.select("a", "low"), "a").join(r.select("b", "whole"), "b")
    shorter, longer = F.least(F.length("low"), F.length("whole")), F.greatest(F.length("low"), F.length("whole"))
    holds = F.contains("low", "whole") | F.contains("whole", "low")
    ratio = F.when(holds, shorter / longer).otherwise(T.overlap_ratio(T.words(F.col("whole")), T.words(F.col("low"))))
    fuzzy = fuzzy.where(ratio >= HINT).select("a", "b")
    found = by_slug.unionByName(by_alias).unionByName(by_text).unionByName(fuzzy).distinct()
    return found.select(F.col("a").alias("name"), F.col("b").alias("id"))


def resolve(names: DataFrame, registry: DataFrame) -> DataFrame:
    """(name, outcome, id, score, hints) of every distinct name.

    outcome: slug for the concept of the same slug, match for the best candidate from SURE
    on (the least id on ties), else new with a null id. hints: how many candidates lie
    between HINT and SURE. All names meet the registry as it was given.
    """
    names = names.groupBy("name").agg(F.min("description").alias("description"))
    low = F.lower(F.trim("name"))
    found = candidates(names, registry).join(registry, "id")
    slug = lambda c: T.slug(F.lower(F.trim(c)))
    score = F.when(slug(F.col("canonical")) == slug(F.col("name")), 1.0).when(F.exists("aliases", lambda x: F.lower(x) == low), 0.95).otherwise(T.overlap_ratio(T.words(F.lower("canonical")), T.words(low)))
    found = found.withColumn("score", F.round(score, 9))
    best = found.groupBy("name").agg(F.min_by("id", F.struct(-F.col("score"), "id")).alias("id"), F.max("score").alias("score"), F.count_if((F.col("score") >= HINT) & (F.col("score") < SURE)).alias("hints"))
    out = names.select("name").join(best, "name", "left")
    sure = F.coalesce(F.col("score") >= SURE, F.lit(False))
    outcome = F.when(F.col("score") == 1.0, "slug").when(sure, "match").otherwise("new")
    return out.select("name", outcome.alias("outcome"), F.when(sure, F.col("id")).alias("id"), F.coalesce("score", F.lit(0.0)).alias("score"), F.when(F.col("score") == 1.0, 0).otherwise(F.coalesce("hints", F.lit(0))).cast("long").alias("hints"))


def _with_scores(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """(name, id, score, slug) of candidates: 1 for the same slug, 0.95 for an alias, else the shared words."""
    low = F.lower(F.trim("name"))
    of = lambda c: T.slug(F.lower(F.trim(c)))
    slug = of(F.col("canonical")) == of(F.col("name"))
    score = F.when(slug, 1.0).when(F.exists("aliases", lambda x: F.lower(x) == low), ALIAS).otherwise(T.overlap_ratio(T.words(F.lower("canonical")), T.words(low)))
    return pairs.join(named, "id").select("name", "id", F.round(score, 9).alias("score"), slug.alias("slug"))


def resolve_in_order(names: DataFrame, registry: DataFrame) -> DataFrame:
    """(name, outcome, id, of, score, hints) when names join the registry one after another.

    names: name, description, at (distinct, the order); a name counts where it first occurs.
    A name that is new is a concept for all that follow; one that matches becomes another
    name of its concept, which scores as an alias does. outcome: slug, match or new; id: the
    concept of the registry as it was given, of: else the name that founded the concept. Of
    equal scores the registry as given wins by the least id, then the concept that was
    founded first. hints: concepts between HINT and SURE at that time.

    What could be alike is found once by keys. Rounds of joins then settle every name that
    no unsettled earlier one could win with a better score, nor is the same but for
    capitals. The first unsettled name always can be settled, and one that some concept
    suits best needn't wait, so rounds are few.
    """
    n = names.groupBy("name").agg(F.min("at").alias("at"), F.min_by("description", "at").alias("description"))
    n = materialize(n, "names")
    place, low = n.select("name", "at"), F.lower(F.trim("name"))
    kind = dict(registry.dtypes)["id"]
    known = materialize(_with_scores(candidates(n, registry), registry).join(place, "name").select("at", "id", "score", "slug"), "known-names")
    own = n.select(F.col("at").alias("id"), F.col("name").alias("canonical"), F.array().cast("array<string>").alias("aliases"))
    met = _with_scores(candidates(n, own), own).join(place, "name").where("id < at").join(n.select(F.col("at").alias("id"), low.alias("__low")), "id")
    pairs = materialize(met.select("at", F.col("id").alias("before"), "score", "slug", (low == F.col("__low")).alias("same")), "name-pairs")
    strong = pairs.where((F.col("score") >= SURE) | F.col("same"))
    target = lambda own, id_, at: F.struct(F.lit(own).alias("own"), id_.cast(kind).alias("id"), at.cast("long").alias("at")).alias("target")
    none = F.lit(None)
    offers = materialize(known.where(F.col("score") >= SURE).select("at", target(0, F.col("id"), none), "score", "slug"), "offers")
    aka = offers.select("at", "target").limit(0)
    same_as = lambda df: df.select(F.col("at").alias("__at"), F.col("target").alias("__target"), F.lit(True).alias("aka")).distinct()
    on = (F.col("at") == F.col("__at")) & F.col("target").eqNullSafe(F.col("__target"))
    open_, settled = materialize(n.select("at"), "open"), []
    while not open_.isEmpty():
        scored = offers.join(same_as(aka), on, "left")
        counts = F.when(F.col("slug"), 1.0).when(F.col("aka"), ALIAS).otherwise(F.col("score"))
        best = scored.groupBy("at").agg(F.min(F.struct((-counts).alias("low"), "target")).alias("best"))
        state = materialize(open_.join(best, "at", "left"), "settling")
        could = F.struct((-F.col("score")).alias("low"), target(1, none, F.col("before")))
        waits = strong.join(open_.select(F.col("at").alias("before")), "before").join(state, "at")
        blocked = waits.where(F.col("same") | F.col("best").isNull() | (could < F.col("best"))).select("at").distinct()
        fresh = materialize(state.join(blocked, "at", "left_anti"), "settled")
        settled.append(fresh)
        open_ = materialize(open_.join(fresh, "at", "left_anti"), "open")
        told = strong.join(fresh.select(F.col("at").alias("before"), "best"), "before").join(open_, "at")
        founded = told.where("best is null").select("at", target(1, none, F.col("before")), "score", "slug")
        alias = told.where("best is not null and same").select("at", F.col("best.target").alias("target"), F.lit(ALIAS).alias("score"), F.lit(False).alias("slug"))
        aka = materialize(aka.unionByName(alias.select("at", "target")), "other-names")
        offers = materialize(offers.join(open_, "at", "left_semi").unionByName(founded).unionByName(alias), "offers")
    done = reduce(DataFrame.unionByName, settled) if settled else n.select("at", F.lit(None).cast(f"struct<low:double,target:struct<own:int,id:{kind},at:bigint>>").alias("best"))
    done = materialize(done, "settled")
    founders = done.where("best is null").select(F.col("at").alias("before"))
    alike = known.select("at", target(0, F.col("id"), none), "score").unionByName(pairs.join(founders, "before").select("at", target(1, none, F.col("before")), "score"))
    alike = alike.join(same_as(aka), on, "left").where("aka is null")
    between = F.count_if((F.col("score") >= HINT) & (F.col("score") < SURE))
    hints = alike.groupBy("at").agg(between.alias("hints"), F.max("score").alias("other"))
    founder = n.select(F.col("at").alias("__at"), F.col("name").alias("of"))
    out = place.join(done, "at").join(hints, "at", "left").join(founder, F.col("best.target.at") == F.col("__at"), "left")
    sure, score = F.col("best").isNotNull(), F.coalesce(-F.col("best.low"), "other", F.lit(0.0))
    outcome = F.when(sure & (score == 1.0), "slug").when(sure, "match").otherwise("new")
    counted = F.when(outcome == "slug", 0).otherwise(F.coalesce("hints", F.lit(0))).cast("long")
    return out.select("name", outcome.alias("outcome"), F.col("best.target.id").alias("id"), F.when(sure, F.col("of")).alias("of"), score.alias("score"), counted.alias("hints"))


def merge_by_key(rows: DataFrame, key: Column, order: str, longest: list[str], union: list[str], greatest: list[str], first: list[str]) -> DataFrame:
    """One row for each key: the longest text (the first on ties), unions of arrays, greatest and first values."""
    union_of = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    at = lambda c: F.struct(F.length(c), -F.col(order))
    parts = [F.max_by(c, at(c)).alias(c) for c in longest] + [union_of(c).alias(c) for c in union] + [F.max(c).alias(c) for c in greatest] + [F.min_by(c, order).alias(c) for c in first]
    return rows.groupBy(key.alias("key")).agg(F.min(order).alias(order), F.count("*").alias("merged"), *parts)


def relink(df: DataFrame, merges: DataFrame, columns: list[str]) -> DataFrame:
    """df with ids in columns replaced by what they were merged into; merges has source and target, each source once."""
    for c in columns:
        m = merges.select(F.col("source").alias("__s"), F.col("target").alias("__t"))
        df = df.join(m, df[c] == m["__s"], "left").withColumn(c, F.coalesce("__t", c)).drop("__s", "__t")
    return df


def relink_arrays(df: DataFrame, merges: DataFrame, key: str, column: str) -> DataFrame:
    """(key, column) with the ids of an array column replaced, each once, in order of value; keys are unique."""
    each = relink(df.select(key, F.explode_outer(column).alias("__id")), merges, ["__id"])
    return each.groupBy(key).agg(F.array_sort(F.collect_set("__id")).alias(column))


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack(vectors.to_numpy()).astype(np.float64)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def similar_pairs(vectors: DataFrame, floor: float, block: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, similarity) with a < b and cosine >= floor, and (id, representative) of every row.

    vectors has id and vector, all of one length. Rows of equal vectors are one
    representative, that of the least id; a pair of rows is alike if their representatives
    are a pair, or are one and the vector isn't zero. Exact: representatives fall into
    blocks, and each two blocks meet in one product of matrices.
    """
    kind = vectors.schema["id"].dataType.simpleString()
    firsts = materialize(vectors.groupBy("vector").agg(F.min("id").alias("representative")), "vectors")
    members = vectors.join(firsts, "vector").select("id", "representative")
    n = max(1, -(-firsts.count() // block))
    rows = firsts.select(F.col("representative").alias("id"), "vector", F.pmod(F.xxhash64("representative"), F.lit(n)).alias("own"))
    others = F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")
    rows = rows.select("id", "vector", "own", F.explode(others).alias("other"))
    left = rows.where("own <= other").select("id", "vector", F.col("own").alias("i"), F.col("other").alias("j"))
    right = rows.where("own >= other").select(F.col("id").alias("b"), F.col("vector").alias("w"), F.col("other").alias("i"), F.col("own").alias("j"))

    def alike(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"a": a["id"][:0], "b": a["id"][:0], "similarity": np.zeros(0)})
        s = _unit(a["vector"]) @ _unit(b["w"]).T
        x, y = a["id"].to_numpy(), b["b"].to_numpy()
        hit = s >= floor - 1e-12
        hit &= (x[:, None] < y[None, :]) if a["i"].iloc[0] == a["j"].iloc[0] else (x[:, None] != y[None, :])
        i, j = np.nonzero(hit)
        return pd.DataFrame({"a": np.minimum(x[i], y[j]), "b": np.maximum(x[i], y[j]), "similarity": s[i, j]})

    pairs = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(alike, f"a {kind}, b {kind}, similarity double")
    return pairs, members

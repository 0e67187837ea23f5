"""Outcome maps: what an answer, a level or an observation counts as. All are Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Quality of a cloze result, of a recall verdict.
CLOZE = {"EASY": 5, "MEDIUM": 4, "HARD": 3, "FAIL": 1}
RECALL = {"strong": 5, "adequate": 4, "partial": 2, "insufficient": 1}
#: Belief before any probe, by maturity.
PRIORS = {"green": 0.85, "yellow": 0.55}
#: Facets that show more than recognition.
DEEP_FACETS = ("synthesis", "relational", "argumentative")


def looked_up(value: Column, table: dict, rest: object) -> Column:
    out = F.lit(rest)
    for k, v in table.items():
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def mcq_quality(correct: Column, first_try: Column, hint: Column, skipped: Column) -> Column:
    return F.when(skipped, 2).when(~correct, 1).when(hint, 3).when(~first_try, 4).otherwise(5)


def cloze_quality(result: Column) -> Column:
    return looked_up(F.upper(result), CLOZE, 3)


def recall_quality(verdict: Column) -> Column:
    return looked_up(F.lower(verdict), RECALL, 1)


def review_signal(quality: Column) -> Column:
    """What a review of this quality adds to mastery."""
    return F.when(quality >= 4, 1.0).when(quality == 3, 0.3).otherwise(-0.5)


def is_deep(facet: Column, quality: Column) -> Column:
    """Whether an answer promotes its concept."""
    return facet.isin(*DEEP_FACETS) & (quality >= 2)


def prior_belief(maturity: Column) -> Column:
    return looked_up(maturity, PRIORS, 0.25)


def combined_mastery(declarative: Column, procedural: Column, single: Column) -> Column:
    """0.4 and 0.6 of the two dimensions where both are known, else the single value."""
    return F.when(declarative.isNotNull() & procedural.isNotNull(), 0.4 * declarative + 0.6 * procedural).otherwise(single)


#: Red, yellow and green of mastery 0, 0.5 and 1, and the shade of a border.
COLOURS, SHADE = [(239, 68, 68), (251, 191, 36), (34, 197, 94)], 0.72


def mastery_colours(mastery: Column) -> tuple[Column, Column]:
    """(fill, border) as 'rgb(r,g,b)', between the two nearest colours."""
    m = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(mastery, F.lit(0.0))))
    rounded = lambda x: F.floor(x + 0.5)
    mixed = [rounded(F.when(m <= 0.5, a + (b - a) * m * 2).otherwise(b + (c - b) * (m - 0.5) * 2)) for a, b, c in zip(*COLOURS)]
    shown = lambda parts: F.concat(F.lit("rgb("), F.concat_ws(",", *(x.cast("string") for x in parts)), F.lit(")"))
    return shown(mixed), shown([rounded(x * SHADE) for x in mixed])


def ago(seconds: Column) -> Column:
    """How long ago, in words: minutes, hours, days, weeks below five, months below twelve, years."""
    days = F.floor(seconds / 86400)
    many = lambda n, name: F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    out = F.when(seconds < 60, "just now").when(seconds < 3600, many(F.floor(seconds / 60), "minute")).when(seconds < 86400, many(F.floor(seconds / 3600), "hour"))
    out = out.when(days == 1, "yesterday").when(days < 7, many(days, "day")).when(days < 35, many(F.floor(days / 7), "week"))
    return out.when(days < 360, many(F.floor(days / 30), "month")).otherwise(many(F.floor(days / 365), "year"))


def task_kind(given: Column, question: Column, kind: Column) -> Column:
    """declarative or procedural: as given, else by the kind of question, else by the kind of observation."""
    named = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    out = F.when(named(given).isin("declarative", "procedural"), named(given))
    out = out.when(named(question).isin("application", "calculation", "procedural"), "procedural").when(named(question).isin("declarative", "definition"), "declarative")
    return out.when(named(kind).startswith("socratic_"), "procedural").otherwise("declarative")


def binary_entropy(p: Column) -> Column:
    """In bits; 0 at and beyond the clamp of 0.01 and 0.99."""
    h = -(p * F.log2(p) + (1 - p) * F.log2(1 - p))
    return F.when((p > 0.01) & (p < 0.99), h).otherwise(F.lit(0.0))

"""Numeric, hash and vector expressions of the learning models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), x))


def c01(x: Column) -> Column:
    return clamp(x, 0.0, 1.0)


def half_up(x: Column) -> Column:
    """Rounds halves towards positive infinity."""
    return F.floor(x + 0.5)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different length, empty ones and zero ones."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(F.size(a) == F.size(b), F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))).otherwise(0.0)


def decay(base: Column, days: Column, rate: float = 0.05) -> Column:
    return F.when(days > 0, c01(base * F.exp(-rate * days))).otherwise(c01(base))


def mastery_label(m: Column) -> Column:
    return F.when(m >= 0.8, "strong").when(m >= 0.6, "good").when(m >= 0.3, "fair").otherwise("weak")


def triage(similarity: Column, auto: float = 0.91, review: float = 0.78) -> Column:
    return F.when(similarity >= auto, "auto").when(similarity >= review, "review").otherwise("distinct")


def novelty(most_similar: Column) -> Column:
    return c01(1 - most_similar)


def sm2_ease(ease: Column, quality: Column) -> Column:
    d = 5 - quality
    return F.greatest(F.lit(1.3), ease + 0.1 - d * (0.08 + 0.02 * d))


def sm2_quality(q: Column) -> Column:
    return clamp(half_up(q), 0, 5).cast("int")


def assessment_weight(wrong: Column, correct: Column, last: Column) -> Column:
    base = wrong - 0.5 * correct
    return F.when(last == "wrong", base + 1).when((last == "correct") & (correct > wrong), F.greatest(F.lit(0.0), base - 1)).otherwise(base)


def review_priority(mastery: Column, misconception: Column, importance: Column) -> Column:
    """Null where there is no gap and no misconception."""
    gap = F.greatest(0.5 - mastery, F.when(misconception, 0.05).otherwise(0.0))
    return F.when((gap > 0) | misconception, gap * (1 + importance / 10))


def belief_entropy(p: Column) -> Column:
    """0 at the clamp edges of 0.01 and 0.99."""
    bits = lambda x: x * F.log2(x)
    return F.when((p > 0.01) & (p < 0.99), -(bits(p) + bits(1 - p))).otherwise(0.0)


def wpm_step(wpm: Column, comprehension: Column) -> Column:
    moved = wpm + F.when(comprehension >= 0.75, 25).when(comprehension < 0.5, -25).otherwise(0)
    return clamp(moved, 150, 1000)


def block_count(concepts: Column, n_words: Column, sections: Column, load: Column, mult: Column, tiny: Column) -> Column:
    """Study blocks for a text, 5 to 60; a tiny one has 8 at most."""
    target = F.greatest(F.lit(0.25), 5 - 0.75 * (load - 1))
    n = F.greatest(F.ceil(concepts / target), F.ceil(n_words / 2200.0), sections)
    n = F.when(tiny, F.least(F.lit(8), n)).otherwise(n)
    return clamp(half_up(n * mult), 5, 60).cast("long")


def assessment_budget(n: Column, e: Column) -> Column:
    """Questions for n concepts and e relations."""
    base = clamp(F.ceil(n / 2), 4, 40)
    extra = F.when(e >= 4, F.greatest(F.lit(2), F.ceil(0.35 * e))).otherwise(F.least(F.lit(2), e))
    total = base + clamp(extra, 0, 12)
    least = F.when(n < 12, F.least(F.lit(8), F.greatest(F.lit(3), n))).otherwise(8)
    return F.least(F.lit(50), F.greatest(total, least)).cast("long")


def concept_target(n_words: Column, cap: int = 120) -> Column:
    return clamp(half_up(n_words / 300.0) * 2, 30, cap).cast("long")


def viable_minimum(n_chars: Column) -> Column:
    return F.greatest(F.lit(5), F.floor(n_chars / 5000)).cast("long")


def doc_hash(text: Column) -> Column:
    """12 hexadecimal digits of the SHA-1 of the text with plain line ends, trimmed."""
    return F.substring(F.sha1(F.encode(F.trim(F.regexp_replace(text, "\\r\\n?", "\n")), "UTF-8")), 1, 12)


def djb2(text: Column) -> Column:
    """The 32-bit djb2 hash with exclusive or, over code points, as 8 hexadecimal digits."""
    codes = F.filter(F.split(text, ""), lambda c: c != "")
    code = lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long")
    total = F.aggregate(codes, F.lit(5381).cast("long"), lambda h, c: ((h * 33).bitwiseAND(F.lit(0xFFFFFFFF))).bitwiseXOR(code(c)))
    return F.lpad(F.lower(F.hex(total)), 8, "0")

"""Study blocks and the stretch of their document that each should show.

A document's blocks take their stretches one after another: of all windows of words the one
with most of the block's terms, less what earlier blocks have taken. Everything stays in
the document's row: the windows that hold a term come from the places where it occurs, each
in four or five windows, so the work is in proportion to words and terms; the stretches
taken so far are a short array of intervals.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from studyloom.functions.expr import let
from studyloom.functions.text import fold_accents

#: The least window and step; from which share of overlap on a window keeps only this share of its hits.
LEAST_WINDOW, LEAST_STEP, CROWDED, CROWDED_SHARE = 50, 50, 0.4, 0.3
#: Overlap that makes a match weak, how far a bound snaps (share of the window), the least stretch with sections.
WEAK_OVERLAP, SNAP_SHARE, LEAST_STRETCH = 0.25, 0.15, 400
#: Fixed value: a phrase counts as so many terms.
PHRASE_WEIGHT = 2

_INTERVAL = "array<struct<lo:int,hi:int>>"


def window_size(n_words: Column, n_blocks: Column) -> Column:
    return F.greatest(F.lit(LEAST_WINDOW), F.ceil(n_words / F.greatest(n_blocks, F.lit(1)))).cast("int")


def window_step(size: Column) -> Column:
    return F.greatest(F.lit(LEAST_STEP), F.floor(size / 4)).cast("int")


def ranges(counts: Column) -> Column:
    """(lo, hi) of consecutive pieces with so many words; empty ones are left out."""

    def step(acc: Column, n: Column) -> Column:
        piece = F.array(F.struct(acc["at"].alias("lo"), (acc["at"] + n).alias("hi")))
        return F.struct(F.when(n > 0, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"), (acc["at"] + n).alias("at"))

    return F.aggregate(counts, F.struct(F.array().cast(_INTERVAL).alias("out"), F.lit(0).alias("at")), step, lambda acc: acc["out"])


def plain_text(text: Column) -> Column:
    """Lower case without accents, words apart by one space."""
    return F.trim(F.regexp_replace(fold_accents(F.coalesce(text, F.lit(""))), "[ \\t\\n\\r\\f\\x0B]+", " "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _windows(text: Column, term: Column, size: Column, step: Column) -> Column:
    """The windows that hold an occurrence of the term or phrase, each once.

    The text is cut where the term begins, so its occurrences may overlap, and the spaces of
    the pieces say in which word each begins.
    """
    cut = F.concat(F.lit("(?=\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    none = F.array().cast("array<int>")

    def held(lo: Column) -> Column:
        first = F.greatest(F.lit(0), F.ceil((lo + _spaces(term) + 1 - size) / step)).cast("int")
        last = F.floor(lo / step).cast("int")
        return F.when(first <= last, F.sequence(first, last)).otherwise(none)

    def add(acc: Column, piece: Column) -> Column:
        return F.struct((acc["at"] + _spaces(piece)).alias("at"), F.when(acc["begun"], F.array_union(acc["out"], held(acc["at"]))).otherwise(acc["out"]).alias("out"), F.lit(True).alias("begun"))

    # a space in front keeps the first piece free of the term; words count from 0 behind it
    zero = F.struct(F.lit(-1).alias("at"), none.alias("out"), F.lit(False).alias("begun"))
    pieces = F.split(F.concat(F.lit(" "), text), cut, -1)
    return F.when((term != "") & F.contains(text, term), F.aggregate(pieces, zero, add, lambda acc: acc["out"])).otherwise(none)


def _overlap(lo: Column, hi: Column, used: Column) -> Column:
    """Words of lo..hi that lie in one of the disjoint intervals used."""
    return F.aggregate(used, F.lit(0), lambda n, u: n + F.greatest(F.lit(0), F.least(hi, u["hi"]) - F.greatest(lo, u["lo"])))


def _with(used: Column, lo: Column, hi: Column) -> Column:
    """used and lo..hi, put together where they meet."""
    every = F.array_sort(F.concat(used, F.array(F.struct(lo.alias("lo"), hi.alias("hi")))))

    def step(acc: Column, u: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], u["hi"]).alias("hi"))))
        return F.when((F.size(acc) > 0) & (last["hi"] >= u["lo"]), joined).otherwise(F.concat(acc, F.array(u)))

    return F.aggregate(every, F.array().cast(_INTERVAL), step)


def _snapped(lo: Column, hi: Column, n: Column, size: Column, sections: Column) -> Column:
    """(lo, hi) moved to the last bounds of sections nearby, and made long enough by whole sections."""
    margin = F.floor(size * F.lit(SNAP_SHARE))
    near = lambda at, name: F.coalesce(F.try_element_at(F.filter(sections, lambda s: F.abs(s[name] - at) <= margin), F.lit(-1))[name], at)

    def grown(x: Column) -> Column:
        start = F.greatest(F.lit(0), F.least(x["lo"], n - 1))
        end = F.greatest(start + 1, F.least(x["hi"], n))
        wide = F.least(n, start + LEAST_STRETCH)
        whole = lambda at: F.try_element_at(F.filter(sections, lambda s: at <= s["hi"]), F.lit(1))["hi"]
        long_enough = F.when(end - start >= LEAST_STRETCH, end).otherwise(let(wide, lambda at: F.least(n, F.coalesce(whole(at), at))))
        return F.struct(start.cast("int").alias("lo"), long_enough.cast("int").alias("hi"))

    moved = let(F.struct(near(lo, "lo").alias("lo"), near(hi, "hi").alias("hi")), grown)
    return F.when(F.size(sections) > 0, moved).otherwise(F.struct(lo.alias("lo"), hi.alias("hi")))


def aligned_blocks(text: Column, blocks: Column, sections: Column | None = None) -> Column:
    """An array with a struct for each block: lo, hi (words, hi not included), quality, hits, matched.

    text: of the document, as `plain_text` gives it. blocks: structs of overview (boolean: it
    takes the beginning) and terms, an array of structs label (a term or phrase, normalised
    alike, which may lie anywhere in the text) and weight, in the order in which blocks
    choose. sections: structs lo, hi in words, in order.
    Of equally good windows the first is taken. A block without terms, or whose best window
    has no hit left, takes the window with least overlap, of equal ones the last. No words
    or no blocks give null.
    """
    n_words = F.when(text == "", 0).otherwise(_spaces(text) + 1)
    sizes = let(F.struct(n_words.alias("n"), window_size(n_words, F.size(blocks)).alias("size")), lambda x: F.struct(x["n"].alias("n"), x["size"].alias("size"), window_step(x["size"]).alias("step")))
    return let(sizes, lambda x: F.when((x["n"] > 0) & (F.size(blocks) > 0), _aligned(text, blocks, sections, x["n"], x["size"], x["step"])))


def _aligned(text: Column, blocks: Column, sections: Column | None, n: Column, size: Column, step: Column) -> Column:
    sections = F.array().cast(_INTERVAL) if sections is None else sections
    found = lambda t: F.struct(t["label"].alias("label"), t["weight"].alias("weight"), _windows(text, t["label"], size, step).alias("at"))
    asked = F.transform(blocks, lambda b, i: F.struct(b["overview"].alias("overview"), i.alias("i"), F.transform(b["terms"], found).alias("terms")))
    starts = F.sequence(F.lit(0), F.floor((n - 1) / step).cast("int"))

    def choose(acc: Column, b: Column) -> Column:
        used = acc["used"]
        end = lambda s: F.least(n, s + size)
        hits = lambda w: F.aggregate(b["terms"], F.lit(0), lambda h, t: h + F.when(F.array_contains(t["at"], w), t["weight"]).otherwise(0))

        def score(w: Column) -> Column:
            lo = w * step
            rate = lambda over, h: F.when(over == 0, h).when(over / (end(lo) - lo) >= CROWDED, F.floor(h * CROWDED_SHARE)).otherwise(h - F.floor(over / size * h))
            pair = let(F.struct(_overlap(lo, end(lo), used).alias("over"), hits(w).alias("h")), lambda x: F.struct(rate(x["over"], x["h"]).cast("int").alias("score"), x["h"].alias("h")))
            return let(pair, lambda x: F.struct(x["score"].alias("score"), (-lo).alias("back"), x["h"].alias("hits")))

        def share(lo: Column) -> Column:
            ratio = F.round(_overlap(lo, end(lo), used) / (end(lo) - lo), 9)
            return F.struct(ratio.alias("ratio"), (-lo).alias("back"))

        preferred = F.greatest(F.lit(0), F.least(F.floor(b["i"] * n / F.size(blocks)).cast("int"), n - 1))
        best = F.array_max(F.transform(starts, score))
        spare = F.array_min(F.concat(F.array(share(preferred)), F.transform(starts, lambda w: share(w * step))))
        quiet = lambda s: F.struct((-s["back"]).alias("lo"), end(-s["back"]).alias("hi"), F.when(s["ratio"] >= WEAK_OVERLAP, "weak").otherwise("fallback").alias("quality"), F.lit(0).alias("hits"), F.array().cast("array<string>").alias("matched"))

        def loud(s: Column) -> Column:
            lo = -s["back"]
            labels = F.transform(F.filter(b["terms"], lambda t: F.array_contains(t["at"], (lo / step).cast("int"))), lambda t: t["label"])

            def named(at: Column) -> Column:
                crowded = _overlap(at["lo"], at["hi"], used) / (at["hi"] - at["lo"]) >= WEAK_OVERLAP
                quality = F.when((s["hits"] >= 2) & ~crowded, "strong").otherwise("weak")
                return F.struct(at["lo"].alias("lo"), at["hi"].alias("hi"), quality.alias("quality"), s["hits"].alias("hits"), labels.alias("matched"))

            return let(_snapped(lo, end(lo), n, size, sections), named)

        first = F.struct(F.lit(0).alias("lo"), F.least(n, size).alias("hi"), F.lit("strong").alias("quality"), F.lit(0).alias("hits"), F.array().cast("array<string>").alias("matched"))
        picked = F.when(b["overview"], first).otherwise(let(best, lambda s: F.when(s["score"] > 0, loud(s)).otherwise(let(spare, quiet))))
        return let(picked, lambda p: F.struct(_with(used, p["lo"], p["hi"]).alias("used"), F.concat(acc["out"], F.array(p)).alias("out")))

    zero = F.struct(F.array().cast(_INTERVAL).alias("used"), F.array().cast("array<struct<lo:int,hi:int,quality:string,hits:int,matched:array<string>>>").alias("out"))
    return F.aggregate(asked, zero, choose, lambda acc: acc["out"])

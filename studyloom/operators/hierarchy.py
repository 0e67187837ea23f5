"""Trees of sections: nested ones as rows, and their offsets in a text of which sections are left out."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: levels below the roots that count.
DEEPEST = 6
#: What stands between two kept sections.
DELIMITER = "\n\n"

_RANGES = "array<struct<start:int,end:int,at:int>>"


def flat_tree(trees: DataFrame, key: str, tree: str, children: str = "children", deepest: int = DEEPEST) -> DataFrame:
    """(key, level, path, parent, node): the nodes of a JSON array of nested objects, level by level from 1.

    path: the places of the node and of those above it, from 1, apart by dots; parent: the
    path above, null for roots. node: the object's JSON, its children included. What isn't
    an object, and levels beyond deepest, are left out; broken JSON and nulls have no nodes.
    A row passes on itself and, at the level in turn, its children, so each object is parsed
    once for its level, and what makes the trees runs once.
    """
    parsed = lambda text: F.from_json(text, "array<string>")
    rows = trees.select(key, F.posexplode(parsed(F.col(tree))).alias("i", "node"))
    rows = rows.select(key, F.lit(1).alias("level"), (F.col("i") + 1).cast("string").alias("path"), F.lit(None).cast("string").alias("parent"), "node")
    for depth in range(2, deepest + 1):
        below = lambda x, i: F.struct(F.lit(depth).alias("level"), F.concat_ws(".", F.col("path"), (i + 1).cast("string")).alias("path"), F.col("path").alias("parent"), x.alias("node"))  # noqa: B023, E731
        more = F.when(F.col("level") == depth - 1, F.transform(parsed(F.get_json_object("node", f"$.{children}")), below))
        own = F.array(F.struct("level", "path", "parent", "node"))
        rows = rows.select(key, F.inline(F.coalesce(F.concat(own, more), own)))
    return rows.where(F.col("node").rlike("^\\s*\\{"))


def kept_ranges(ranges: Column, gap: int = len(DELIMITER)) -> Column:
    """Structs start, end, at of ranges (start, end; any order): overlapping ones are one, and `at` is where each begins in the new text."""
    def merged(s: np.ndarray, e: np.ndarray) -> list[tuple[int, int, int]]:
        order = np.lexsort((e, s))
        s, top = s[order], np.maximum.accumulate(e[order])
        first = np.flatnonzero(np.r_[True, s[1:] > top[:-1]]) if len(s) else order
        start, end = s[first], top[np.r_[first[1:] - 1, len(s) - 1]] if len(s) else top
        at = np.cumsum(end - start + gap) - (end - start + gap)
        return list(zip(start.tolist(), end.tolist(), at.tolist(), strict=True))

    @F.pandas_udf(_RANGES)
    def kept(starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([s if s is None else merged(s, e) for s, e in zip(starts, ends, strict=True)], dtype=object)

    whole = F.filter(ranges, lambda r: r["end"] > r["start"])
    return kept(F.transform(whole, lambda r: r["start"].cast("int")), F.transform(whole, lambda r: r["end"].cast("int")))


def scoped_text(text: Column, kept: Column) -> Column:
    """The kept ranges of a text, with DELIMITER between them."""
    return F.array_join(F.transform(kept, lambda r: F.substring(text, r["start"] + 1, r["end"] - r["start"])), DELIMITER)


def scoped_nodes(nodes: Column, kept: Column) -> Column:
    """Structs node, start, end of nodes (node, start, end) in the new text.

    A node that reaches beyond what is kept is cut to it, from its first kept character to
    its last, delimiters between included; nodes without any are left out.
    """

    def moved(s: np.ndarray, e: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
        # kept ranges are in order and apart, so those that meet a node are a stretch of them
        lo, hi = np.searchsorted(end, s, "right"), np.searchsorted(start, e, "left") - 1
        met = lo <= hi
        a, b = lo[met], hi[met]
        out = np.full((len(s), 2), -1, np.int64)
        out[met, 0] = at[a] + np.maximum(s[met], start[a]) - start[a]
        out[met, 1] = at[b] + np.minimum(e[met], end[b]) - start[b]
        return [tuple(x) for x in out.tolist()]

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def placed(s: pd.Series, e: pd.Series, start: pd.Series, end: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([None if x[0] is None or x[2] is None else moved(*x) for x in zip(s, e, start, end, at, strict=True)], dtype=object)

    known = F.filter(nodes, lambda n: n["start"].isNotNull() & n["end"].isNotNull())
    of = lambda rows, k: F.transform(rows, lambda r: r[k].cast("int"))
    out = F.zip_with(known, placed(of(known, "start"), of(known, "end"), of(kept, "start"), of(kept, "end"), of(kept, "at")), lambda n, p: F.struct(n["node"].alias("node"), p["start"].alias("start"), p["end"].alias("end")))
    return F.filter(out, lambda n: n["start"] >= 0)

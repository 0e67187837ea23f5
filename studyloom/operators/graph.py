"""Graph operators on edge tables: layers, reachability, fringes, cycles, affinities."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.operators.components import connected_components
from studyloom.operators.ranking import global_rank
from studyloom.session import materialize, spread

#: Edges of a graph that one task solves: some tens of MB, and seconds.
SMALL_GRAPH = 100_000


def layers(nodes: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, depth): breadth-first depth from the nodes that no edge enters.

    edges has src and dst. Each round joins the frontier only; nodes of cycles that no
    root reaches have no row. There are as many rounds as layers, unless `most` is given: then
    more layers are an error.
    """
    frontier = nodes.select("node").join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").select("node", F.lit(0).alias("depth"))
    seen = frontier = materialize(frontier, "layer")
    for depth in count(1) if most is None else range(1, most + 1):
        step = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = materialize(step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth")), "layer")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    raise ValueError(f"more than {most} layers")


def descendants(edges: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """(root, node, depth): all that each root reaches, at its least depth, itself at 0."""
    frontier = seen = materialize(roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth")), "reach")
    for depth in count(1) if most is None else range(1, most + 1):
        step = frontier.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        frontier = materialize(step.join(seen.select("root", "node"), ["root", "node"], "left_anti").select("root", "node", F.lit(depth).alias("depth")), "reach")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    raise ValueError(f"deeper than {most}")


def _peeled(edges: DataFrame) -> DataFrame:
    """The edges left when ends without a way in or out are taken off, round by round."""
    n = edges.count()
    while n:
        kept = edges.join(edges.select("g", F.col("dst").alias("src")).distinct(), ["g", "src"], "left_semi")
        edges = materialize(kept.join(edges.select("g", F.col("src").alias("dst")).distinct(), ["g", "dst"], "left_semi").select("g", "src", "dst"), "peeled")
        before, n = n, edges.count()
        if n == before:
            break
    return edges


def strong_components(edges: DataFrame) -> DataFrame:
    """(g, node, component): the nodes of cycles in each graph g of edges (g, src, dst), by their greatest node.

    Forward colouring: every node takes the greatest node that reaches it. What then reaches
    a colour's own node inside the colour is its component; the rest goes on with the edges
    inside colours. Messages go along edges only, from nodes that changed, so no table of
    reachable pairs comes about. There are as many rounds as the longest shortest ways.
    """
    left = materialize(edges.select("g", "src", "dst").where("src <> dst").distinct(), "strong")
    found = left.select("g", F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    while not (left := _peeled(left)).isEmpty():
        ends = left.select("g", F.explode(F.array("src", "dst")).alias("node")).distinct()
        colour = materialize(ends.select("g", "node", F.col("node").alias("colour"), F.lit(True).alias("fresh")), "colours")
        while not colour.where("fresh").isEmpty():
            told = left.join(colour.where("fresh").select("g", F.col("node").alias("src"), "colour"), ["g", "src"]).groupBy("g", F.col("dst").alias("node")).agg(F.max("colour").alias("heard"))
            greater = F.coalesce(F.col("heard") > F.col("colour"), F.lit(False))
            colour = materialize(colour.join(told, ["g", "node"], "left").select("g", "node", F.when(greater, F.col("heard")).otherwise(F.col("colour")).alias("colour"), greater.alias("fresh")), "colours")
        of = lambda end: colour.select("g", F.col("node").alias(end), F.col("colour").alias(f"{end}_colour"))
        left = materialize(left.join(of("src"), ["g", "src"]).join(of("dst"), ["g", "dst"]).where("src_colour = dst_colour").select("g", "src", "dst"), "strong")
        inside = fresh = materialize(colour.where("node = colour").select("g", "node", F.col("colour").alias("component")), "inside")
        while not fresh.isEmpty():
            back = left.join(fresh.select("g", F.col("node").alias("dst"), "component"), ["g", "dst"]).select("g", F.col("src").alias("node"), "component").distinct()
            fresh = materialize(back.join(inside.select("g", "node"), ["g", "node"], "left_anti"), "inside")
            inside = inside.unionByName(fresh)
        inside = materialize(inside, "components")
        several = inside.join(left.select("g", F.explode(F.array("src", "dst")).alias("node")).distinct(), ["g", "node"], "left_semi")
        found = found.unionByName(several)
        for end in ("src", "dst"):
            left = left.join(inside.select("g", F.col("node").alias(end)), ["g", end], "left_anti")
        left = materialize(left.select("g", "src", "dst"), "strong")
    # a colour's own node that lies on no cycle is alone
    alone = found.groupBy("g", "component").agg(F.count("*").alias("n")).where("n = 1").select("g", "component")
    return materialize(found.join(alone, ["g", "component"], "left_anti").select("g", "node", "component"), "components")


def _with_components(edges: DataFrame, components: DataFrame) -> DataFrame:
    """edges with `of_src` and `of_dst`, null for ends on no cycle."""
    for end in ("src", "dst"):
        edges = edges.join(components.select("g", F.col("node").alias(end), F.col("component").alias(f"of_{end}")), ["g", end], "left")
    return edges


def _by_size(edges: DataFrame, small: int) -> tuple[DataFrame, DataFrame]:
    """edges with `of`, what holds together when directions don't count: graphs of at most `small` edges, and larger ones."""
    met = connected_components(edges)
    edges = materialize(edges.join(met.select(F.col("node").alias("src"), F.col("component").alias("of")), "src"), "graphs")
    sizes = edges.groupBy("of").count()
    # as skewed as the graphs are: a join splits
    sized = materialize(edges.join(sizes, "of"), "graphs")
    return sized.where(F.col("count") <= small).drop("count"), sized.where(F.col("count") > small).drop("count")


def _solved(few: DataFrame, step: Callable[[pd.DataFrame], list[tuple]]) -> DataFrame:
    """(src, dst) that step finds in each small graph."""
    kinds = dict(few.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(step(rows), columns=["src", "dst"], dtype=object).astype(dict(rows.dtypes[["src", "dst"]]))

    return few.groupBy("of").applyInPandas(run, f"src {kinds['src']}, dst {kinds['dst']}")


def _strong_parts(pairs: list[tuple]) -> dict[object, object]:
    """The strong component of each node, named by one of its nodes: a walk by finishing times, then one against the edges."""
    ways: dict[object, list[object]] = {}
    back: dict[object, list[object]] = {}
    for src, dst in pairs:
        ways.setdefault(src, []).append(dst)
        back.setdefault(dst, []).append(src)
    seen, finished = set(), []
    for root in ways:
        open_ = [] if root in seen else [(root, iter(ways[root]))]
        seen.add(root)
        while open_:
            node, rest = open_[-1]
            step = next((x for x in rest if x not in seen), None)
            if step is None:
                finished.append(node)
                open_.pop()
            else:
                seen.add(step)
                open_.append((step, iter(ways.get(step, ()))))
    of: dict[object, object] = {}
    for root in reversed(finished):
        if root not in of:
            of[root], open_ = root, [root]
            while open_:
                for node in back.get(open_.pop(), ()):
                    if node not in of:
                        of[node] = root
                        open_.append(node)
    return of


def _cyclic(edges: pd.DataFrame) -> list[tuple]:
    """The edges of one small graph that lie on a cycle."""
    pairs = list(edges[["src", "dst"]].itertuples(index=False, name=None))
    of = _strong_parts(pairs)
    return [(a, b) for a, b in pairs if of[a] == of[b]]


def on_cycles(edges: DataFrame, small: int = SMALL_GRAPH) -> DataFrame:
    """The edges (src, dst) that lie on a cycle of more than one node: both ends are in one strong component.

    Graphs of at most `small` edges are each solved in a task, larger ones by joins.
    """
    e = edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct()
    few, many = _by_size(e, small)
    solved = _solved(few, _cyclic)
    if many.isEmpty():
        return solved
    many = many.select(F.lit("").alias("g"), "src", "dst")
    return solved.unionByName(_with_components(many, strong_components(many)).where("of_src = of_dst").select("src", "dst"))


def _closing(edges: pd.DataFrame) -> list[tuple]:
    """The edges of one small graph whose end reaches their beginning over heavier ones, by halves as in `break_cycles`."""
    pairs = list(edges.sort_values("r")[["src", "dst"]].itertuples(index=False, name=None))
    closing: list[tuple] = []
    # edges (src, dst, edge): those known to close nothing, and open ones, heaviest first
    parts: list[tuple[list[tuple], list[tuple]]] = [([], [(a, b, (a, b)) for a, b in pairs])]
    while parts:
        known, open_ = parts.pop()
        heavy, light = open_[: (len(open_) + 1) // 2], open_[(len(open_) + 1) // 2 :]
        of = _strong_parts([e[:2] for e in known + heavy])
        inside = lambda e: of.get(e[0], e[0]) == of.get(e[1], e[1])
        met = lambda es: [(of.get(a, a), of.get(b, b), e) for a, b, e in es if of.get(a, a) != of.get(b, b)]
        within = [e for e in heavy if inside(e)]
        closing += [e[2] for e in light if inside(e)]
        if len(open_) == 1:
            closing += [e[2] for e in within]
            continue
        if within:
            parts.append(([e for e in known if inside(e)], within))
        if rest := met(light):
            parts.append((met(known + heavy), rest))
    return closing


def _closing_by_rounds(many: DataFrame, small: int) -> DataFrame:
    """(src, dst) of the edges that `_closing` finds, in graphs (src, dst, r) of any size."""
    many = many.select(F.lit("").alias("g"), "src", "dst", "r")
    cyclic = materialize(_with_components(many, strong_components(many)).where("of_src = of_dst"), "cyclic")
    sizes = cyclic.groupBy("of_src").count()
    cyclic = materialize(cyclic.select("src", "dst", "r", F.col("of_src").alias("of")).join(sizes.withColumnRenamed("of_src", "of"), "of"), "cyclic")
    dropped = _solved(cyclic.where(F.col("count") <= small), _closing)
    state = cyclic.where(F.col("count") > small).select(F.col("of").cast("string").alias("g"), "src", "dst", F.struct("src", "dst").alias("edge"), "r", F.lit(True).alias("open"))
    state = materialize(state, "breaking")
    while not state.isEmpty():
        middle = state.where("open").groupBy("g").agg(F.percentile_approx("r", 0.5).alias("m"), F.count("*").alias("n"))
        s = materialize(state.join(middle, "g"), "breaking")
        heavy = ~F.col("open") | (F.col("r") <= F.col("m"))
        both = materialize(_with_components(s, strong_components(s.where(heavy))), "breaking")
        inside = F.coalesce(F.col("of_src") == F.col("of_dst"), F.lit(False))
        goes = inside & F.col("open") & ((F.col("n") == 1) | (F.col("r") > F.col("m")))
        dropped = dropped.unionByName(both.where(goes).select("edge.src", "edge.dst"))
        rest = both.where(~goes & (F.col("n") > 1))
        high = rest.where(inside).select(F.concat_ws("/", "g", F.lit("h"), F.col("of_src").cast("string")).alias("g"), "src", "dst", "edge", "r", "open")
        met = lambda end: F.coalesce(f"of_{end}", end).alias(end)
        low = rest.where(~inside).select(F.concat_ws("/", "g", F.lit("l")).alias("g"), met("src"), met("dst"), "edge", "r", (F.col("open") & (F.col("r") > F.col("m"))).alias("open"))
        state = high.unionByName(low)
        # parts without an open edge have nothing left to drop
        state = materialize(state.join(state.where("open").select("g").distinct(), "g", "left_semi"), "breaking")
    return dropped


def break_cycles(edges: DataFrame, small: int = SMALL_GRAPH) -> DataFrame:
    """(src, dst, weight, dropped) of edges (src, dst, weight): the lightest edge of every cycle is dropped.

    Dropping the lightest edge of each strong component, again and again, drops just the
    edges whose end reaches their beginning over heavier ones (of equal weights the greater
    src and dst are heavier). That is found by halves: strong components of the heavier
    half drop all lighter edges inside them; those components are searched on with the
    heavier edges, and the graph in which each is one node with the lighter ones. All parts
    of a level are solved together, so there are as many levels as the number of edges of
    the largest component has bits. Graphs and components of at most `small` edges are each
    solved in a task, by the same halves. Repeated edges count once, with their least
    weight; loops are dropped; edges with a null end aren't there.
    """
    e = edges.where("src is not null and dst is not null").groupBy("src", "dst").agg(F.min(F.coalesce("weight", F.lit(0.0))).alias("weight"))
    e = materialize(e, "weighted")
    dropped = e.where("src = dst").select("src", "dst")
    ranked = materialize(global_rank(e.where("src <> dst"), [F.desc("weight"), F.desc("src"), F.desc("dst")], "r"), "weighted")
    few, many = _by_size(ranked.select("src", "dst", "r"), small)
    dropped = dropped.unionByName(_solved(few, _closing))
    if not many.isEmpty():
        dropped = dropped.unionByName(_closing_by_rounds(many, small))
    gone = dropped.withColumn("dropped", F.lit(True))
    return e.join(gone, ["src", "dst"], "left").select("src", "dst", "weight", F.coalesce("dropped", F.lit(False)).alias("dropped"))


def probe_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges (src, dst, weight, dropped) of a graph to probe: both ends are nodes, and what is kept has no cycle.

    A node that occurs twice is an error.
    """
    twice = nodes.groupBy("node").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"node {twice[0]['node']} occurs twice")
    known = edges
    for end in ("src", "dst"):
        known = known.join(nodes.select(F.col("node").alias(end)), end, "left_semi")
    return break_cycles(known.select("src", "dst", "weight"))


def typed_edges(edges: DataFrame, undirected: tuple[str, ...] = (), loops: bool = False, rows: int | None = None) -> DataFrame:
    """(kind, src, dst), each edge once; edges of undirected kinds have their smaller end first. rows: how many edges there are at most, where that is known."""
    flat = F.col("kind").isin(*undirected) if undirected else F.lit(False)
    e = edges.select("kind", F.when(flat, F.least("src", "dst")).otherwise(F.col("src")).alias("src"), F.when(flat, F.greatest("src", "dst")).otherwise(F.col("dst")).alias("dst"))
    e = e if loops else e.where("src <> dst")
    return (spread(e, "kind", "src", "dst", rows=rows) if rows else e).distinct()


def safe_inserts(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """(a, b, kind) of wanted (a, b), b to be a prerequisite of a; edges (src, dst): src needs dst.

    kind: same for a loop, together where b needs a already, directly or not, else prerequisite.
    """
    reach = descendants(edges, wanted.select(F.col("b").alias("node")).distinct())
    needs = reach.where("depth > 0").select(F.col("root").alias("b"), F.col("node").alias("a")).distinct().withColumn("__needs", F.lit(True))
    j = wanted.join(needs, ["a", "b"], "left")
    return j.select("a", "b", F.when(F.col("a") == F.col("b"), "same").when(F.col("__needs"), "together").otherwise("prerequisite").alias("kind"))


def fringes(beliefs: DataFrame, edges: DataFrame, hi: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Outer fringe: unknown nodes whose prerequisites are all known. Inner: known nodes with no known dependent.

    edges point from prerequisite (src) to dependent (dst).
    """
    known = beliefs.where(F.col("belief") >= hi).select("node")
    p = edges.join(beliefs.select(F.col("node").alias("src"), (F.col("belief") >= hi).alias("ok")), "src", "left")
    ready = p.groupBy("dst").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("ready"))
    outer = beliefs.where(F.col("belief") < hi).select("node").join(ready, F.col("node") == F.col("dst"), "left").where(F.coalesce("ready", F.lit(True))).select("node")
    used = edges.join(known.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"))
    return outer, known.join(used, "node", "left_anti")


#: How strongly each kind of relation ties two concepts.
AFFINITY = {"part_of": 0.9, "exemplifies": 0.7, "contradicts": 0.5, "prerequisite_of": 0.3}


def structural_bonus(edges: DataFrame) -> DataFrame:
    """(node, bonus): 0.3 of the affinity of a node's edges, which counts as 1 at most."""
    weight = F.lit(0.1)
    for kind, w in AFFINITY.items():
        weight = F.when(F.col("type") == kind, w).otherwise(weight)
    ends = edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("node"), weight.alias("w"))
    return ends.groupBy("node").agg(F.round(F.least(F.lit(1.0), F.sum("w")) * 0.3, 6).alias("bonus"))


def dependents(edges: DataFrame) -> DataFrame:
    """(node, dependents, importance part): how many distinct nodes depend on each."""
    return edges.groupBy(F.col("src").alias("node")).agg(F.count_distinct("dst").alias("dependents"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """Links in both directions, from one reading of pairs (a, b)."""
    turned = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.where("a <> b").select(F.inline(turned))


def related_closure(pairs: DataFrame, rows: int | None = None) -> DataFrame:
    """Links in both directions, each once. rows: how many pairs there are at most, where that is known."""
    both = both_ways(pairs)
    return (spread(both, "a", "b", rows=2 * rows) if rows else both).distinct()

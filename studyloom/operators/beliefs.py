"""Beliefs on concept graphs: what an answer tells of a concept and its neighbours, and what to ask next.

Many graphs are handled at once: doc names the graph. edges go from prerequisite (src) to
dependent (dst). All steps are joins on (doc, node).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.functions.outcomes import binary_entropy
from studyloom.session import materialize

#: Where an answer moves the belief in its concept, and how far.
DIRECT, DIRECT_DAMP = {"knew": 0.88, "partial": 0.55, "missed": 0.15}, 0.85
#: Answer, side, where it moves the beliefs there, and how far.
SPREAD = [("knew", "up", 0.72, 0.6 * 0.55), ("knew", "down", 0.68, 0.6 * 0.45), ("partial", "up", 0.58, 0.6 * 0.35), ("partial", "down", 0.55, 0.6 * 0.3), ("missed", "down", 0.04, 0.8)]
HOPS = 2
#: A concept is worth a probe between these beliefs.
LOW, HIGH = 0.1, 0.8
#: Fixed value: what a picked concept adds to the belief in those with the same prerequisites.
SIBLING_LIFT = 0.72


def clamp(p: Column) -> Column:
    return F.greatest(F.lit(0.01), F.least(F.lit(0.99), p))


def damped(current: Column, target: float, factor: float) -> Column:
    return clamp(clamp(current) + (target - clamp(current)) * factor)


def hop_factor(factor: float, hop: int) -> float:
    """hop counts from 1; the attenuation is that of the hop before."""
    return factor * max(0.35, 1 - (hop - 1) * 0.2)


def reached(probes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc, probe, response, node, side, hop): what each probe (doc, probe, response) reaches in up to two hops.

    A node that is reached by one and by two hops has both rows; paths may come back.
    """
    sides = {"up": edges.select("doc", F.col("dst").alias("at"), F.col("src").alias("next")), "down": edges.select("doc", F.col("src").alias("at"), F.col("dst").alias("next"))}
    out = None
    for side, steps in sides.items():
        asked = [r for r, s, _, _ in SPREAD if s == side]
        front = probes.where(F.col("response").isin(asked)).select("doc", "probe", "response", F.col("probe").alias("at"))
        for hop in range(1, HOPS + 1):
            front = front.join(steps.distinct(), ["doc", "at"]).select("doc", "probe", "response", F.col("next").alias("at")).distinct()
            rows = front.select("doc", "probe", "response", F.col("at").alias("node"), F.lit(side).alias("side"), F.lit(hop).alias("hop"))
            out = rows if out is None else out.unionByName(rows)
    return out


def propagate(probes: DataFrame, edges: DataFrame, beliefs: DataFrame) -> DataFrame:
    """(doc, probe, response, node, before, after) of every node that a probe touches.

    beliefs has (doc, node, belief); each probe is told on its own. The probe's node moves
    first, then the nodes above by hops, then those below.
    """
    touched = probes.select("doc", "probe", "response", F.col("probe").alias("node"), F.lit("own").alias("side"), F.lit(0).alias("hop")).unionByName(reached(probes, edges))
    on = lambda side, hop: F.max(F.when((F.col("side") == side) & (F.col("hop") == hop), True))
    names = [("own", 0), *((s, h) for s in ("up", "down") for h in range(1, HOPS + 1))]
    flags = touched.groupBy("doc", "probe", "response", "node").agg(*(on(s, h).alias(f"{s}{h}") for s, h in names))
    j = _moved(flags.join(beliefs, ["doc", "node"]), F.col("response"), "after")
    return j.select("doc", "probe", "response", "node", F.col("belief").alias("before"), "after")


def _moved(flags: DataFrame, response: Column, name: str) -> DataFrame:
    """flags (belief, and how a node is reached) with `name`: the belief after the response."""
    after = F.col(name)
    j = flags.withColumn(name, F.col("belief"))
    direct = F.lit(None).cast("double")
    for answer, target in DIRECT.items():
        direct = F.when(response == answer, damped(after, target, DIRECT_DAMP)).otherwise(direct)
    j = j.withColumn(name, F.when(F.col("own0"), direct).otherwise(after))
    for side in ("up", "down"):
        for hop in range(1, HOPS + 1):
            moved = after
            for answer, s, target, factor in SPREAD:
                if s == side:
                    moved = F.when(response == answer, damped(after, target, hop_factor(factor, hop))).otherwise(moved)
            j = j.withColumn(name, F.when(F.col(f"{side}{hop}"), moved).otherwise(after))
    return j


def near_nodes(edges: DataFrame, beliefs: DataFrame) -> DataFrame:
    """(doc, probe, node, own0, up1, up2, down1, down2): each node of beliefs, and nodes within two hops of each other, both ways."""
    steps = edges.select("doc", "src", "dst").distinct()
    two = steps.select("doc", "src", F.col("dst").alias("at")).join(steps.select("doc", F.col("src").alias("at"), "dst"), ["doc", "at"]).select("doc", "src", "dst").distinct()
    hops = steps.withColumn("hop", F.lit(1)).unionByName(two.withColumn("hop", F.lit(2)))
    ends = F.inline(F.array(F.struct(F.col("src").alias("probe"), F.col("dst").alias("node"), F.lit("down").alias("side")), F.struct(F.col("dst").alias("probe"), F.col("src").alias("node"), F.lit("up").alias("side"))))
    own = beliefs.select("doc", F.lit(0).alias("hop"), F.col("node").alias("probe"), "node", F.lit("own").alias("side"))
    rows = hops.select("doc", "hop", ends).unionByName(own)
    on = lambda side, hop: F.max(F.when((F.col("side") == side) & (F.col("hop") == hop), True)).alias(f"{side}{hop}")
    return rows.groupBy("doc", "probe", "node").agg(on("own", 0), *(on(s, h) for s in ("up", "down") for h in range(1, HOPS + 1)))


def updated(beliefs: DataFrame, changes: DataFrame) -> DataFrame:
    """beliefs after changes (doc, node, after), of one probe in each graph at most."""
    j = beliefs.join(changes.select("doc", "node", "after"), ["doc", "node"], "left")
    return j.select("doc", "node", F.coalesce("after", "belief").alias("belief"))


def candidates(beliefs: DataFrame, probed: DataFrame) -> DataFrame:
    """Nodes that are worth a probe: not probed, and believed neither known nor unknown."""
    return beliefs.where((F.col("belief") > LOW) & (F.col("belief") < HIGH)).join(probed.select("doc", "node"), ["doc", "node"], "left_anti")


def information_gain(asked: DataFrame, near: DataFrame, beliefs: DataFrame) -> DataFrame:
    """(doc, node, gain): how much entropy an answer on each node of asked is expected to take from its graph.

    near is that of `near_nodes`. Only the nodes that a probe touches change, so only they
    are summed; both answers are worked out on the same rows.
    """
    probes = asked.select("doc", F.col("node").alias("probe"))
    j = near.join(probes, ["doc", "probe"], "left_semi").join(beliefs, ["doc", "node"])
    for response in ("knew", "missed"):
        j = _moved(j, F.lit(response), response)
    fall = lambda response: F.sum(binary_entropy(F.col("belief")) - binary_entropy(F.col(response)))
    # the probe's own row, and with it its belief, is among those of its group
    p = clamp(F.max(F.when(F.col("own0"), F.col("belief"))))
    falls = j.groupBy("doc", F.col("probe").alias("node")).agg(p.alias("p"), fall("knew").alias("knew"), fall("missed").alias("missed"))
    return falls.where("p is not null").select("doc", "node", (F.col("p") * F.col("knew") + (1 - F.col("p")) * F.col("missed")).alias("gain"))


def next_probes(edges: DataFrame, beliefs: DataFrame, probed: DataFrame) -> DataFrame:
    """(doc, node, gain): the probe of each graph that tells most, the least node on ties; none without a gain."""
    gains = information_gain(candidates(beliefs, probed), near_nodes(edges, beliefs), beliefs).withColumn("gain", F.round("gain", 9))
    best = gains.groupBy("doc").agg(F.min_by(F.struct("node", "gain"), F.struct(-F.col("gain"), "node")).alias("b"))
    return best.select("doc", "b.node", "b.gain").where("gain > 0")


def _siblings(edges: DataFrame) -> DataFrame:
    """(doc, node, kin): nodes with prerequisites; equal sets of them have equal kin, told by their number and 128 bits of sums."""
    h = F.xxhash64("src").cast("decimal(38,0)")
    sums = F.struct(F.count("*").alias("n"), F.sum(h).alias("a"), F.bit_xor(F.xxhash64("src", F.lit(1))).alias("b"))
    return edges.select("doc", "src", "dst").distinct().groupBy("doc", F.col("dst").alias("node")).agg(sums.alias("kin"))


def _near(touched: DataFrame, near: DataFrame) -> DataFrame:
    """touched (doc, node) and all within two hops up or down, whose gains their beliefs have a part in."""
    return touched.unionByName(near.join(touched, ["doc", "node"], "left_semi").select("doc", F.col("probe").alias("node"))).distinct()


def next_probe_batch(edges: DataFrame, beliefs: DataFrame, probed: DataFrame, n: int) -> DataFrame:
    """(doc, place, node, gain): up to n probes of each graph, taken one after another, all graphs at once.

    A pick counts as known from then on: beliefs move, those of concepts with the same
    prerequisites are lifted, and gains are worked out anew only for nodes within two hops
    of a belief that moved. A graph is done when no pick has a gain, the least node wins ties.
    """
    edges = materialize(edges.select("doc", "src", "dst").distinct(), "probe-edges")
    kin = materialize(_siblings(edges), "siblings")
    beliefs = materialize(beliefs.select("doc", "node", "belief"), "beliefs")
    gone = probed.select("doc", "node").distinct()
    near = materialize(near_nodes(edges, beliefs), "near")
    gains = materialize(information_gain(candidates(beliefs, gone), near, beliefs), "gains")
    picks = []
    for place in range(1, n + 1):
        rounded = gains.withColumn("gain", F.round("gain", 9))
        best = rounded.groupBy("doc").agg(F.min_by(F.struct("node", "gain"), F.struct(-F.col("gain"), "node")).alias("b"))
        pick = materialize(best.select("doc", F.lit(place).alias("place"), "b.node", "b.gain").where("gain > 0"), "picks")
        picks.append(pick)
        if place == n or pick.isEmpty():
            break
        probes = pick.select("doc", F.col("node").alias("probe"), F.lit("knew").alias("response"))
        moved = updated(beliefs, propagate(probes, edges, beliefs))
        alike = pick.join(kin, ["doc", "node"]).select("doc", F.col("node").alias("picked"), "kin").join(kin, ["doc", "kin"]).where("node <> picked").select("doc", "node", F.lit(True).alias("lifted"))
        lifted = F.when(F.col("lifted") & (F.col("belief") < HIGH), F.least(F.lit(0.99), F.col("belief") + SIBLING_LIFT)).otherwise(F.col("belief"))
        after = materialize(moved.join(alike, ["doc", "node"], "left").select("doc", "node", lifted.alias("belief")), "beliefs")
        touched = after.join(beliefs.withColumnRenamed("belief", "before"), ["doc", "node"]).where("belief <> before").select("doc", "node")
        gone = materialize(gone.unionByName(pick.select("doc", "node")), "probed")
        stale = materialize(_near(touched, near).unionByName(pick.select("doc", "node")).distinct(), "stale")
        fresh = information_gain(candidates(after, gone).join(stale, ["doc", "node"], "left_semi"), near, after)
        kept = gains.join(pick.select("doc"), "doc", "left_semi").join(stale, ["doc", "node"], "left_anti")
        gains, beliefs = materialize(kept.select("doc", "node", "gain").unionByName(fresh), "gains"), after
    return reduce(DataFrame.unionByName, picks) if picks else gains.select("doc", F.lit(0).alias("place"), "node", "gain").limit(0)

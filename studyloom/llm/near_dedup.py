"""MinHash near-dedup: one-permutation hashing, optimal densification, bands and stars.

1. A document's words are lower-cased (A-Z) and its distinct shingles hashed. One hash of
   each shingle falls into one of ROWS * BANDS bins, whose least values are the signature;
   an empty bin takes the value of a full one that it draws by a hash of its own number
   (optimal densification). Rows with equal sets are one node from here on.
2. ROWS bins make a band; nodes with an equal band meet in a bucket. Instead of all pairs
   a bucket emits a star: one centre against each member. Pairs that differ too much in
   size can't link and are left out.
3. Candidate pairs are confirmed on the full sets and the links made into components.
4. A bucket whose members aren't yet in one component may hold more links. Its members'
   exact distances to the first centre rule out most pairs, as Jaccard distance obeys the
   triangle inequality, and so do the shingles that a node shares with no other component.
   For the others more members become centres, 16 times as many in each round, against
   the members of other components; so links between any two members of a bucket are
   found, while a group of copies never emits its pairs.

A pair at the threshold of 0.8 misses all 32 bands of 5 with probability 3e-6.

Defined cases: null, empty and blank texts have no shingles and stay alone; fewer words
than a shingle make one of the whole sequence; a null id is never the smallest of its
group; rows that repeat both id and text are one document listed twice and get the same
answer; an empty table gives an empty result; columns beside id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.llm import words as W
from studyloom.llm.names import free
from studyloom.operators.components import connected_components
from studyloom.session import materialize

BANDS, ROWS = 32, 5
BINS = BANDS * ROWS
#: Members of a bucket that are all compared at once.
FEW = 8
_U = np.uint64


@lru_cache(1)
def _draws() -> np.ndarray:
    """For each bin the bins that it turns to when empty, in order."""
    tries = 64
    at = np.arange(BINS * tries, dtype=np.uint64).reshape(tries, BINS)
    return (W.mix(at + _U(0x51ED270B)) % _U(BINS)).astype(np.int64)


def shingle_sets(block: W.Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes, document after document, and their bounds."""
    hashes, n = block.word_hashes(lower=True), block.n_words
    at = W.window_starts(block, width)
    size = np.full(len(at), width)
    short = np.flatnonzero((n > 0) & (n < width))
    doc = np.concatenate([np.repeat(np.arange(len(n)), np.maximum(n - width + 1, 0)), short])
    at, size = np.concatenate([at, block.first[short]]), np.concatenate([size, n[short]])
    values = W.mix(W.span_hashes(hashes, at, at + size) + size.astype(np.uint64))
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    values, doc = values[fresh], doc[fresh]
    return values, np.searchsorted(doc, np.arange(len(n) + 1))


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The densified one-permutation signature of each set, one row for each; empty sets get zeros."""
    n = len(bounds) - 1
    doc = np.repeat(np.arange(n), np.diff(bounds))
    bins = ((values >> _U(32)) * _U(BINS) >> _U(32)).astype(np.int64)
    cell = doc * BINS + bins
    first = np.flatnonzero(np.diff(cell, prepend=-1))  # values rise within a set, so the first of a bin is its least
    out, full = np.zeros(n * BINS, np.uint64), np.zeros(n * BINS, bool)
    out[cell[first]], full[cell[first]] = values[first], True
    full = full.reshape(n, BINS)
    out = out.reshape(n, BINS)
    filled = full.copy()
    filled[np.diff(bounds) == 0] = True
    for draw in _draws():
        row, col = np.nonzero(~filled)
        if not len(row):
            return out
        good = full[row, draw[col]]
        out[row[good], col[good]] = out[row[good], draw[col[good]]]
        filled[row[good], col[good]] = True
    row, col = np.nonzero(~filled)  # 64 misses in a row: the set's least value
    out[row, col] = values[bounds[row]]
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(len(signature), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(ROWS):
        keys = W.mix(keys * _U(0x9E3779B97F4A7C15) + parts[:, :, k])
    return keys


def fingerprints(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """16 bytes for each set: two independent sums of scrambled members, with the size."""
    size = np.diff(bounds).astype(np.uint64)
    out = []
    for salt in (0xA24BAED4963EE407, 0x9FB21C651E98DF25):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(values ^ _U(salt)), dtype=np.uint64)])
        out.append(W.mix(sums[bounds[1:]] - sums[bounds[:-1]] + size * _U(salt)))
    raw = np.stack(out, 1).astype(">u8").tobytes()
    return [raw[i : i + 16] for i in range(0, len(raw), 16)]


def _sketched(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in W.blocks(batch.column(1)):
                values, bounds = shingle_sets(block, width)
                keys = band_keys(signatures(values, bounds))
                keys = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.rows.start, len(bounds) - 1), pa.array(np.diff(bounds), pa.int64()), pa.array(fingerprints(values, bounds), pa.binary()), keys], names=["id", "n", "node", "bands"])

    return run


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in W.blocks(batch.column(0)):
                values, bounds = shingle_sets(block, width)
                sets = pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(fingerprints(values, bounds), pa.binary()), sets], names=["node", "members"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, common, either) of pairs (a, b) from their full sets, which are bucketed and stay where they are."""
    left = sets.select(F.col("node").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("x", "y")).alias("common"), (F.size("x") + F.size("y")).alias("sizes"))
    # inter >= threshold * union is kept in whole numbers
    return both.select("a", "b", "common", (F.col("sizes") - F.col("common")).alias("either"))


def near_classes(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    Documents are linked when 100 * |A & B| >= percent * |A | B|, on sets of shingles of
    width words; component_id is the smallest id that links reach.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    sketched = materialize(rows.mapInArrow(_sketched(width), f"id {kind}, n long, node binary, bands array<long>"), "sketches")
    nodes = sketched.where("n > 0").groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = materialize(nodes, "nodes")
    members = nodes.select("node", "n", F.explode("bands").alias("key"))
    # stars: the member with the least hash is a bucket's centre
    first = members.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct(F.xxhash64("node", F.lit(1)).alias("h"), "node", "n")).alias("s")).where("c > 1")
    members = materialize(members.join(first.select("key", F.col("s.node").alias("centre"), F.col("s.n").alias("cn")), "key"), "buckets")
    fits = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))
    pairs = members.where((F.col("node") != F.col("centre")) & fits(F.col("n"), F.col("cn"))).select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    pairs = materialize(pairs, "pairs", thin=True)

    wanted = members.select("node").distinct().join(nodes.select("node", "id"), "node").select("id").distinct()
    texts = rows.join(wanted, rows["id"].eqNullSafe(wanted["id"]), "left_semi").select("text")
    sets = texts.mapInArrow(_full_sets(width), "node binary, members array<long>")
    sets = materialize(sets.join(members.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "sets", by="node")

    linked = (100 * F.col("common") >= percent * F.col("either")) & (F.col("either") > 0)
    seen = materialize(_confirmed(pairs, sets), "confirmed", thin=True)
    stars = seen.select(F.col("a").alias("centre"), F.col("b").alias("node"), (1 - F.col("common") / F.col("either")).alias("d"), F.col("common").cast("long").alias("inside"))
    members = members.join(stars, ["centre", "node"], "left").withColumn("d", F.when(F.col("node") == F.col("centre"), 0.0).otherwise(F.col("d")))
    # inside: how many shingles a member has in common with its bucket's centre; all of its own where that wasn't counted
    members = materialize(members.select("key", "node", "n", "centre", "d", F.coalesce("inside", "n").alias("inside")), "buckets")
    links = seen.where(linked).select("a", "b")
    labels = materialize(connected_components(links, "a", "b"), "labels", thin=True)

    reach, centres = 1 - percent / 100 + 1e-9, 8
    while True:
        open_ = materialize(_unsettled(members, labels, reach), "buckets", thin=True)
        if open_.isEmpty():
            break
        open_ = materialize(_bounded(open_, sets, percent), "buckets", thin=True)
        # a pair that shares several open buckets is formed in the least of them
        homes = open_.groupBy("node").agg(F.collect_set("key").alias("keys"))
        open_ = materialize(open_.join(homes, "node"), "buckets", thin=True)
        chosen = open_.where((F.col("left") <= FEW) | (F.pmod(F.xxhash64("node", F.lit(centres)), F.col("left")) < centres))
        c = chosen.select("key", *(F.col(x).alias(f"c_{x}") for x in ("node", "n", "label", "d", "inside", "shared", "outside", "keys")))
        near = F.coalesce(F.abs(F.col("c_d") - F.col("d")) <= reach, F.lit(True))
        # what the two can have in common at most: of the centre's shingles, and of the others
        most = F.least("shared", "c_shared", F.least("inside", "c_inside") + F.least("outside", "c_outside"))
        near &= 100 * most >= percent * (F.col("n") + F.col("c_n") - most)
        near &= F.array_min(F.array_intersect("keys", "c_keys")) == F.col("key")
        pairs = open_.join(c, "key").where((F.col("label") != F.col("c_label")) & fits(F.col("n"), F.col("c_n")) & near)
        pairs = pairs.select(F.least("c_node", "node").alias("a"), F.greatest("c_node", "node").alias("b")).distinct()
        pairs = pairs.join(seen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs", thin=True)
        if not pairs.isEmpty():
            fresh = materialize(_confirmed(pairs, sets), "confirmed", thin=True)
            seen = seen.unionByName(fresh)
            found = fresh.where(linked).select("a", "b")
            if not found.isEmpty():
                stars = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
                labels = materialize(connected_components(stars.unionByName(found), "a", "b"), "labels", thin=True)
        # a centre is settled against all others of its bucket, but for pairs that a lesser open
        # bucket holds; those stay there until one of the two is a centre of that bucket
        members = open_.join(chosen.select("key", "node"), ["key", "node"], "left_anti").select("key", "node", "n", "centre", "d", "inside")
        centres *= 16

    each = sketched.select("id", "n", "node").join(labels, "node", "left")
    each = each.select("id", "n", F.when(F.col("n") > 0, F.coalesce("component", "node")).alias("class"))
    least = each.where("class is not null").groupBy("class").agg(F.min("id").alias("least"), F.count("*").alias("c")).where("c > 1").select("class", "least")
    out = each.join(materialize(least, "classes"), "class", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def _unsettled(members: DataFrame, labels: DataFrame, reach: float) -> DataFrame:
    """Members of the buckets where two of different components could still be linked.

    Within reach of the centre (near) a member is linked to it. A far one, beyond twice the
    reach, can't be linked to a near one; the rest is the border, also where d is unknown.
    """
    at = members.join(labels, "node", "left").select("key", "node", "n", "centre", "d", "inside", F.coalesce("component", "node").alias("label"))
    far = F.coalesce(F.col("d") > 2 * reach, F.lit(False))
    near = F.coalesce(F.col("d") <= reach, F.lit(False))
    state = at.groupBy("key").agg(
        F.count("*").alias("left"),
        F.min("label").alias("lo"),
        F.max("label").alias("hi"),
        F.count_if(~far & ~near).alias("border"),
        F.count_if(far).alias("far"),
    )
    state = state.where((F.col("left") > 1) & (F.col("lo") != F.col("hi")) & ((F.col("border") > 0) | (F.col("far") > 1))).select("key", "left")
    return at.where("d is null or d > 0").join(state, "key")


def _bounded(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """open_ with `shared` and `outside`, without the members and buckets that have no link left to find.

    shared counts the shingles of a member that members of another component have as well,
    outside those of them that its bucket's centre lacks. No other shingle is in an
    intersection, and all are in the union, so a member with too few shared ones is done.
    Buckets of FEW members or less skip this and are settled at once.
    """
    few = open_.where(F.col("left") <= FEW).withColumns({"shared": F.col("n"), "outside": F.col("n")})
    many = open_.where(F.col("left") > FEW).drop("left")
    if many.isEmpty():
        return few
    nodes = many.select("node", "n", F.xxhash64("label").alias("label")).distinct()
    rows = sets.join(nodes, "node").select("node", "n", "label", F.explode("members").alias("m"))
    common = rows.groupBy("m").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("m")
    shared = rows.select("node", "n", "m").join(materialize(common, "common", thin=True), "m").groupBy("node", "n").agg(F.collect_list("m").alias("ms"))
    shared = materialize(shared.where(100 * F.size("ms") >= percent * F.col("n")).select("node", "ms"), "sharing")
    of = many.select("centre", "node").distinct().join(shared, "node").join(sets.select(F.col("node").alias("centre"), "members"), "centre")
    of = of.select("centre", "node", F.size("ms").cast("long").alias("shared"), F.size(F.array_except("ms", "members")).cast("long").alias("outside"))
    many = materialize(many.join(of, ["centre", "node"]), "buckets", thin=True)
    # a partner has as many shingles as the least of the bucket, or more
    least = many.groupBy("key").agg(F.min("n").alias("least"))
    could = 100 * F.col("shared") >= percent * (F.col("n") + F.greatest("least", "shared") - F.col("shared"))
    many = materialize(many.join(least, "key").where(could).drop("least"), "buckets", thin=True)
    left = many.groupBy("key").agg(F.count("*").alias("left"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key", "left")
    return few.unionByName(many.join(left, "key"), allowMissingColumns=True)


def near_report(docs: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    return near_classes(docs, width, percent).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that a document of smaller id is a near copy of.

    Ids of the dropped documents are joined to docs, so repeated ids fall together.
    """
    name = free(docs.columns, "gone_id")
    classes = near_classes(docs, width, percent, doc_id, text)
    gone = materialize(classes.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(name)), "near-copies")
    return docs.join(gone, docs[doc_id] == gone[name], "left_anti")


#: What `near_report` returns, for tables small enough to count shared shingles by pairs.
NEAR_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS ss FROM w),
u AS (SELECT doc_id, len(ss) AS n, unnest(ss) AS s FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS x, any_value(b.n) AS y FROM u a JOIN u b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (x + y - c)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, least) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.least FROM r JOIN e ON e.a = r.id WHERE r.least < e.b),
k AS (SELECT id, min(least) AS component FROM r GROUP BY id)
SELECT doc_id, CAST(len(ss) AS BIGINT) AS n_shingles, component AS component_id, doc_id = component AS kept FROM s JOIN k ON k.id = doc_id"""

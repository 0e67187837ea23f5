"""Conversation structure repair: the cheapest edits that make roles alternate.

A conversation should read `(s?(ua)+)?` by the initials of its roles. Every row is kept
(0), given the role user or assistant (2) or deleted (3; the only choice for blank rows and
for repeats); an empty user or assistant row may be inserted anywhere (2); a truncated row
that stays costs 1 more. Of the cheapest edits those with the ASCII-least audit win.

The method is Hirschberg's. Four states (nothing yet, after s, after u, after a) have a
cost each; a vector of costs from the front and one from the back meet in the middle of a
stretch, the audit-least of the cheapest crossings is fixed, and both halves are solved
alike, so a stretch needs space for its codes and two vectors only. Left parts end with a
row's own edit, so none begins another, and a rank beside each forward cost orders their
audits without holding them.

Conversations may be of any size, even a third of all rows. Rows are numbered within their
conversation from range partitions, cut into stretches, and each stretch gives a 4 x 4
table of costs and ranks; a thousand stretches make one on the next level. Crossings are
then fixed from the top level down to the rows. Only the checksum of a whole conversation,
which can't be put together from parts, streams through one task, with a constant state.

Defined cases: null roles and texts are one space (an unknown role that nothing keeps);
null turns come first; rows of the same turn are ordered by role, then text; a null
conv_id is a conversation like any other; an empty table gives an empty result; other
columns, whatever their names, aren't read. Two rows repeat each other when role and the
SHA-256 of the text are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.operators.ranking import rank_in_key
from studyloom.session import materialize

#: Rows of a stretch, and parts that one level puts together.
STRETCH, FAN = 1024, 1024
#: Elements of a stretch or of several that numpy handles at once.
BLOCK = 1 << 16
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: The state after a user or assistant row is put where the alternation has its next.
NEXT = (USER, USER, ASSISTANT, USER)
#: Inserts that finish a conversation in each state.
TAIL = (0, 2, 1, 0)
_FAR, _LAST = 1 << 40, 7
#: Classes of initials: others, s, u, a. A row's code is its class + 4 if it must go + 8 if truncated.
_CLASS = {"s": 1, "u": 2, "a": 3}
_OPS = "DKR"


def _one_row() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """cost, rank and edit of [code, state before, state after]; edit is 3 * inserts + place in DKR."""
    cost, rank, edit = np.full((16, 4, 4), _FAR), np.full((16, 4, 4), _LAST), np.zeros((16, 4, 4), np.int64)
    for code in range(16):
        kind, forced, cut = code % 4, code & 4, TRUNCATED if code & 8 else 0
        for before in range(4):
            best: dict[int, tuple[int, str, int]] = {}
            at = before
            for k in range(3):
                ways = [(at, DELETE, 0)]
                if not forced:
                    ways.append((NEXT[at], REROLE + cut, 2))
                    if (kind, at) in ((1, NOTHING), (2, NOTHING), (2, SYSTEM), (2, ASSISTANT), (3, USER)):
                        ways.append((kind, KEEP + cut, 1))
                for after, price, op in ways:
                    found = (INSERT * k + price, "I" * k + _OPS[op], 3 * k + op)
                    best[after] = min(best.get(after, found), found)
                at = NEXT[at]
            for place, after in enumerate(sorted(best, key=lambda q: best[q][1])):
                cost[code, before, after], rank[code, before, after], edit[code, before, after] = best[after][0], place, best[after][2]
    return cost, rank, edit


ROW_COST, ROW_RANK, ROW_EDIT = _one_row()


def _by_size(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches, longest first, and how many are longer than 0, 1, 2, ..."""
    size = hi - lo
    order = np.argsort(-size, kind="stable")
    return order, len(lo) - np.searchsorted(np.sort(size), np.arange(int(size.max(initial=0))), side="right")


def forward(which: np.ndarray, costs: np.ndarray, ranks: np.ndarray, lo: np.ndarray, hi: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least cost from start to each state over elements lo..hi, and how the states' audits are ordered."""
    cost, rank = np.full((len(lo), 4), _FAR), np.full((len(lo), 4), _LAST)
    cost[np.arange(len(lo)), start] = rank[np.arange(len(lo)), start] = 0
    order, active = _by_size(lo, hi)
    for t, n in enumerate(active.tolist()):
        k = order[:n]
        e = which[lo[k] + t]
        total = np.minimum(cost[k][:, :, None] + costs[e], _FAR)
        via = np.argmin(total * 8 + rank[k][:, :, None], axis=1)[:, None, :]
        cost[k] = np.take_along_axis(total, via, 1)[:, 0]
        audit = np.take_along_axis(rank[k][:, :, None] * 8 + ranks[e], via, 1)[:, 0]
        audit[cost[k] >= _FAR] = 8 * _LAST + _LAST
        rank[k] = np.where(cost[k] >= _FAR, _LAST, (audit[:, None, :] < audit[:, :, None]).sum(2))
    return cost, rank


def backward(which: np.ndarray, costs: np.ndarray, lo: np.ndarray, hi: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least cost from each state over elements lo..hi to end."""
    cost = np.full((len(lo), 4), _FAR)
    cost[np.arange(len(lo)), end] = 0
    order, active = _by_size(lo, hi)
    for t, n in enumerate(active.tolist()):
        k = order[:n]
        cost[k] = np.minimum((costs[which[hi[k] - 1 - t]] + cost[k][:, None, :]).min(2), _FAR)
    return cost


def crossings(which: np.ndarray, costs: np.ndarray, ranks: np.ndarray, lo: np.ndarray, hi: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The states before and after each element on the audit-least of the cheapest ways from start to end."""
    before, after = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
    while len(lo):
        done = hi - lo == 1
        before[lo[done]], after[lo[done]] = start[done], end[done]
        lo, hi, start, end = lo[~done], hi[~done], start[~done], end[~done]
        mid = (lo + hi) // 2
        cost, rank = forward(which, costs, ranks, lo, mid, start)
        meet = np.argmin((cost + backward(which, costs, mid, hi, end)) * 8 + rank, axis=1)
        lo, hi, start, end = np.concatenate([lo, mid]), np.concatenate([mid, hi]), np.concatenate([start, meet]), np.concatenate([meet, end])
    return before, after


def _blocks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of stretches with about BLOCK elements together."""
    bounds, lo = np.concatenate([[0], np.cumsum(sizes)]), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + BLOCK, side="right")) - 1)
        yield lo, hi
        lo = hi


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all rows of a column of hexadecimal strings, and the bounds of each string's."""
    raw = np.frombuffer("".join(column.to_pylist()).encode(), np.uint8).astype(np.int64)
    return np.where(raw > 57, raw - 87, raw - 48), np.concatenate([[0], np.cumsum([len(x) for x in column.to_pylist()])]).astype(np.int64)


def _matrices(parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """costs, ranks and bounds of a column of lists of parts."""
    flat, bounds = parts.flatten(), parts.offsets.to_numpy() - parts.offsets[0].as_py()
    pick = lambda name: flat.field(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, 4, 4)
    return pick("cost"), pick("rank"), bounds.astype(np.int64)


_PART = "cost array<long>, rank array<long>, first int, last int, illegal long"
#: legal[class, class of the next]
_LEGAL = np.zeros((4, 4), bool)
_LEGAL[[1, 2, 3], [2, 3, 2]] = True


def _part_batch(key: pa.Array, node: pa.Array, found: list[tuple]) -> pa.RecordBatch:
    cost, rank, first, last, illegal = (np.concatenate(x) for x in zip(*found))
    lists = [pa.ListArray.from_arrays(np.arange(0, 16 * len(first) + 1, 16, dtype=np.int32), pa.array(x.reshape(-1))) for x in (cost, rank)]
    return pa.RecordBatch.from_arrays([key, node, *lists, pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(illegal, pa.int64())], names=["conv_id", "node", "cost", "rank", "first", "last", "illegal"])


def _all_starts(which: np.ndarray, costs: np.ndarray, ranks: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 4 x 4 costs and ranks of each stretch."""
    lo, hi = np.repeat(bounds[:-1], 4), np.repeat(bounds[1:], 4)
    return forward(which, costs, ranks, lo, hi, np.tile(np.arange(4), len(bounds) - 1))


def _leaf_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        codes, bounds = _codes(batch.column("codes"))
        odd = np.concatenate([[0], np.cumsum(~_LEGAL[codes[:-1] % 4, codes[1:] % 4])]) if len(codes) else np.zeros(1)
        found = []
        for a, b in _blocks(np.diff(bounds)):
            mine = codes[bounds[a] : bounds[b]]
            cost, rank = _all_starts(mine, ROW_COST, ROW_RANK, bounds[a : b + 1] - bounds[a])
            found.append((cost, rank, codes[bounds[a:b]] % 4, codes[bounds[a + 1 : b + 1] - 1] % 4, odd[bounds[a + 1 : b + 1] - 1] - odd[bounds[a:b]]))
        yield _part_batch(batch.column("conv_id"), batch.column("node"), found)


def _upper_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column("parts")
        costs, ranks, bounds = _matrices(column)
        first, last, illegal = (column.flatten().field(x).to_numpy() for x in ("first", "last", "illegal"))
        sums = np.concatenate([[0], np.cumsum(illegal)])
        seams = np.concatenate([[0], np.cumsum(~_LEGAL[last[:-1], first[1:]])])
        cost, rank = _all_starts(np.arange(len(costs)), costs, ranks, bounds)
        inside = sums[bounds[1:]] - sums[bounds[:-1]] + seams[bounds[1:] - 1] - seams[bounds[:-1]]
        yield _part_batch(batch.column("conv_id"), batch.column("node"), [(cost, rank, first[bounds[:-1]], last[bounds[1:] - 1], inside)])


def _go_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states around each part of a node whose own are known."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column("parts")
        costs, ranks, bounds = _matrices(column)
        before, after = crossings(np.arange(len(costs)), costs, ranks, bounds[:-1], bounds[1:], batch.column("before").to_numpy(), batch.column("after").to_numpy())
        key = batch.column("conv_id").take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(bounds))))
        yield pa.RecordBatch.from_arrays([key, column.flatten().field("node"), pa.array(before), pa.array(after)], names=["conv_id", "node", "before", "after"])


def _leaf_edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A character for each row: its edit and the state before it."""
    for batch in batches:
        if not batch.num_rows:
            continue
        codes, bounds = _codes(batch.column("codes"))
        start, end, out = batch.column("before").to_numpy(), batch.column("after").to_numpy(), []
        for a, b in _blocks(np.diff(bounds)):
            mine, at = codes[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
            before, after = crossings(mine, ROW_COST, ROW_RANK, at[:-1], at[1:], start[a:b], end[a:b])
            chars = (48 + 9 * before + ROW_EDIT[mine, before, after]).astype(np.uint8).tobytes().decode()
            out += [chars[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("node"), pa.array(out, pa.string())], names=["conv_id", "node", "edits"])


def blank(text: Column) -> Column:
    return ~text.rlike("[^ \\x09-\\x0D]")


def truncated(text: Column) -> Column:
    return ~text.rlike("[.!?][ \\x09-\\x0D]*\\z")


def with_faults(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, place (from 1) and fault (blank, duplicate, truncated or null) of each row."""
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    ranked = rank_in_key(t, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], "place")
    ranked = materialize(ranked.withColumn("digest", F.unhex(F.sha2("text", 256))), "placed-turns")
    # summed up before it is dealt out, so a text may be repeated any number of times
    first = ranked.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min("place").alias("earliest"))
    j = ranked.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")))
    fault = F.when(blank(F.col("text")), "blank").when(F.col("place") > F.col("earliest"), "duplicate").when(truncated(F.col("text")), "truncated")
    return j.select("conv_id", "turn", "role", "text", "place", fault.alias("fault"))


def _grouped(parts: DataFrame) -> DataFrame:
    """The parts of a level by the node above them, in order; at most FAN each."""
    one = F.struct("node", "cost", "rank", "first", "last", "illegal")
    return parts.groupBy("conv_id", F.floor(F.col("node") / FAN).cast("long").alias("above")).agg(F.array_sort(F.collect_list(one)).alias("parts")).withColumnRenamed("above", "node")


def _on(left: DataFrame, right: DataFrame, *names: str) -> DataFrame:
    """left joined with right on conv_id and node, either of which may be null; right gives the named columns."""
    r = right.select(F.col("conv_id").alias("__c"), F.col("node").alias("__n"), *names)
    return left.join(r, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("node") == F.col("__n"))).drop("__c", "__n")


def solve(faulty: DataFrame, stretch: int = STRETCH) -> tuple[DataFrame, DataFrame]:
    """(conversations, edits) of rows with faults.

    conversations: conv_id, cost, illegal, state after the last row. edits: conv_id, node
    (the stretch) and edits, a character for each of its rows.
    """
    key = dict(faulty.dtypes)["conv_id"]
    initial, kinds = F.substring("role", 1, 1), F.lit(0)
    for letter, kind in _CLASS.items():
        kinds = F.when(initial == letter, kind).otherwise(kinds)
    code = kinds + F.when(F.col("fault").isin("blank", "duplicate"), 4).when(F.col("fault") == "truncated", 8).otherwise(0)
    node = F.floor((F.col("place") - 1) / stretch).cast("long")
    rows = faulty.select("conv_id", node.alias("node"), F.struct("place", F.lower(F.hex(code)).alias("code")).alias("x"))
    leaves = rows.groupBy("conv_id", "node").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["code"]), "").alias("codes"))
    leaves = materialize(leaves, "stretches")
    schema = f"conv_id {key}, node long, {_PART}"
    levels = [materialize(leaves.mapInArrow(_leaf_parts, schema), "stretch-costs")]
    while levels[-1].where("node > 0").limit(1).count():
        levels.append(materialize(_grouped(levels[-1]).mapInArrow(_upper_parts, schema), "stretch-costs"))
    ends = [F.struct((F.col("cost")[q] + INSERT * TAIL[q]).alias("cost"), F.col("rank")[q].alias("rank"), F.lit(q).cast("long").alias("after")) for q in range(4)]
    top = levels[-1].withColumn("end", F.array_min(F.array(*ends)))
    whole = top.select("conv_id", F.col("end.cost").alias("cost"), "illegal", F.col("end.after").alias("after"))
    goals = top.select("conv_id", "node", F.lit(NOTHING).cast("long").alias("before"), F.col("end.after").alias("after"))
    for below in reversed(levels[:-1]):
        goals = _on(_grouped(below), goals, "before", "after").mapInArrow(_go_down, f"conv_id {key}, node long, before long, after long")
        goals = materialize(goals, "crossings")
    edits = _on(leaves, goals, "before", "after").mapInArrow(_leaf_edits, f"conv_id {key}, node long, edits string")
    return whole, edits


def repair(turns: DataFrame, stretch: int = STRETCH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(repaired, conversations, faulty) of turns (conv_id, turn, role, text).

    repaired has a row for each edit, in the order of conv_id, place, step: edit (K, R, D or
    I), the role and text that the conversation has now (null for D), and the turn of the
    row, null for I. conversations: conv_id, cost, illegal. faulty: the rows with their faults.
    """
    faulty = materialize(with_faults(turns), "faulty-turns")
    whole, edits = solve(faulty, stretch)
    whole = materialize(whole, "repair-costs")
    place = F.col("place") - 1
    rows = _on(faulty.withColumn("node", F.floor(place / stretch).cast("long")), edits, "edits")
    x = F.ascii(F.substr("edits", (place % stretch + 1).cast("int"), F.lit(1))) - 48
    before, k = F.floor(x / 9).cast("int"), F.floor(x % 9 / 3).cast("int")
    after = lambda state, n: F.when(state == ASSISTANT, n % 2).when(state == USER, (n + 1) % 2).otherwise(n % 2)  # noqa: E731  1: the n-th put there is a user's
    name = lambda state, n: F.when(after(state, n) == 1, "user").otherwise("assistant")
    made = lambda n: F.struct(F.lit(n).alias("step"), F.lit("I").alias("edit"), name(F.col("before"), F.lit(n)).alias("role"), F.lit("").alias("text"), F.lit(None).cast("long").alias("turn"))
    op = F.element_at(F.array(*(F.lit(c) for c in _OPS)), F.col("op") + 1)
    new_role = F.when(op == "K", F.col("role")).when(op == "R", name(F.col("before"), F.col("k") + 1))
    own = F.struct(F.lit(3).alias("step"), op.alias("edit"), new_role.alias("role"), F.when(op != "D", F.col("text")).alias("text"), F.col("turn").cast("long").alias("turn"))
    rows = rows.select("conv_id", "place", "turn", "role", "text", before.alias("before"), k.alias("k"), (x % 3).cast("int").alias("op"))
    steps = F.concat(F.slice(F.array(made(1), made(2)), 1, F.col("k")), F.array(own))
    edited = rows.select("conv_id", "place", F.explode(steps).alias("s")).select("conv_id", "place", "s.*")
    tail = F.element_at(F.array(*(F.lit(n) for n in TAIL)), (F.col("after") + 1).cast("int"))
    last = F.slice(F.array(*(F.struct(F.lit(n).alias("step"), F.lit("I").alias("edit"), name(F.col("after"), F.lit(n)).alias("role"), F.lit("").alias("text"), F.lit(None).cast("long").alias("turn")) for n in (1, 2))), 1, tail)
    ends = whole.select("conv_id", F.lit(1 << 62).cast("long").alias("place"), F.explode(last).alias("s")).select("conv_id", "place", "s.*")
    return edited.unionByName(ends), whole.select("conv_id", "cost", "illegal"), faulty


def _digests(key: pa.DataType) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """audit and checksum of each conversation, from edits in order."""
        none = object()
        now, audit, sha, lines = none, [], hashlib.sha256(), 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], key), pa.array(["".join(audit)]), pa.array([sha.hexdigest()])], names=["conv_id", "audit", "repaired_sha256"])

        for batch in batches:
            done = []
            for c, edit, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "edit", "role", "text"))):
                if c != now:
                    if now is not none:
                        done.append(out())
                    now, audit, sha, lines = c, [], hashlib.sha256(), 0
                audit.append(edit)
                if edit != "D":
                    sha.update(f"\n{role}:{text}".encode() if lines else f"{role}:{text}".encode())
                    lines += 1
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if now is not none:
            yield out()

    return run


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, audit and repaired_sha256, from the rows of `repair`."""
    from pyspark.sql.pandas.types import to_arrow_type

    key = repaired.schema["conv_id"].dataType
    dealt = repaired.select("conv_id", "place", "step", "edit", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "place", "step")
    return dealt.mapInArrow(_digests(to_arrow_type(key)), f"conv_id {key.simpleString()}, audit string, repaired_sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in, chosen by crc32 of `conv_id:turn`, nulls as one space."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    chance = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    c = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), chance.alias("chance")).where("chance <> 0")
    text = F.when(F.col("chance") == 1, "").when(F.col("chance") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.array_repeat(F.lit(0), F.when(F.col("chance") == 3, 2).otherwise(1))
    return c.select("conv_id", "turn", F.when(F.col("chance") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times)).drop("col")


def repair_report(conversations: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """The damaged conversations' faults, cheapest repair, audit and checksum, for every conv_id."""
    repaired, whole, faulty = repair(damage(conversations), stretch)
    kinds = [F.count_if(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")]
    counts = faulty.groupBy("conv_id").agg(*kinds, F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    out = conversations.select("conv_id").distinct()
    for found in (counts, whole, digests(repaired)):
        r = found.withColumnRenamed("conv_id", "__c")
        out = out.join(r, F.col("conv_id").eqNullSafe(F.col("__c")), "left").drop("__c")
    zeros = [F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256().hexdigest()
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))

"""Substring dedup: Rabin-Karp hashes of every window of `width` words, counted in Spark.

1. Tasks hash every window of their documents. One hash picks a bucket, 56 bits of a
   second one are kept. A window that a task holds twice is known to repeat, and is sent
   once; for the others the task sends the hash with a running number, so a document's
   words aren't shuffled for this. However hot a window is, a bucket gets it once a task.
2. A bucket is counted in one group of bounded size: buckets are as many as the text has
   stretches of BUCKET_BYTES, and hashes spread evenly. What occurs twice goes back to its
   documents as window positions.
3. Each document meets its own positions in a join; overlapping windows merge into maximal
   intervals of words, which go.

Two different windows are taken for one with a probability of 2**-56 divided by the number
of buckets. Windows are judged on the input, not on what is left.

Defined cases: null text has no words; texts shorter than a window keep all of theirs;
null and repeated ids are fine, and rows that repeat both id and text repeat each other's
windows like any two documents; an empty table gives an empty result; other columns, of
any name, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.llm import words as W

BUCKET_BYTES = 32 << 20
#: Windows that a task gathers before it deals them out; about 40 bytes of memory each.
HELD_WINDOWS = 2_000_000
_SECOND_BASE = 0xC2B2AE3D27D4EB4F
_U = np.uint64


def _planes(values: np.ndarray, size: int) -> bytes:
    """The lowest `size` bytes of whole numbers, byte after byte for all, as equal ones compress."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def _unplanes(raw: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(size, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :size] = planes.T
    return out.view("<u8").ravel()


class _Held:
    """Windows of some documents, until they are dealt out to the buckets."""

    def __init__(self, n_buckets: int, kind: pa.DataType):
        self.n_buckets, self.kind = n_buckets, kind
        self.clear()

    def clear(self) -> None:
        self.ids, self.marks, self.counts, self.hashes, self.buckets, self.n = [], [], [], [], [], 0

    def add(self, block: W.Block, ids: pa.Array, marks: np.ndarray, width: int) -> None:
        words = block.word_hashes()
        at = W.window_starts(block, width)
        first = W.mix(W.span_hashes(words, at, at + width))
        second = W.mix(W.span_hashes(W.mix(words ^ _U(_SECOND_BASE)), at, at + width, _SECOND_BASE))
        counts = np.maximum(block.n_words - width + 1, 0)
        full = np.flatnonzero(counts)
        self.ids.append(ids.take(pa.array(full)))
        self.marks.append(marks[full])
        self.counts.append(counts[full])
        self.hashes.append(first >> _U(8))
        self.buckets.append(((second >> _U(32)) * _U(self.n_buckets) >> _U(32)).astype(np.int32))
        self.n += len(at)

    def deal(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        ids, marks = pa.chunked_array(self.ids, type=self.kind).combine_chunks(), np.concatenate(self.marks)
        starts = np.concatenate([[0], np.cumsum(np.concatenate(self.counts))])
        hashes, bucket = np.concatenate(self.hashes), np.concatenate(self.buckets)
        self.clear()
        doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        order = np.lexsort((hashes, bucket))
        new = np.ones(len(order), bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (bucket[order][1:] != bucket[order][:-1])
        heads = np.flatnonzero(new)
        many = np.diff(np.append(heads, len(order))) > 1
        known = np.zeros(len(order), bool)  # windows that repeat in here
        known[order[np.repeat(many, np.diff(np.append(heads, len(order))))]] = True
        told = order[heads[many]]  # one of each of those
        single = np.flatnonzero(~known)
        single = single[np.argsort(bucket[single], kind="stable")]
        told = told[np.argsort(bucket[told], kind="stable")]
        known = np.flatnonzero(known)
        spread = (W.mix(doc[known].astype(np.uint64) + _U(1)) % _U(self.n_buckets)).astype(np.int32)
        known = known[np.argsort(spread, kind="stable")]
        spread = np.sort(spread)
        ends = np.arange(self.n_buckets + 1)
        cut_s, cut_t, cut_k = np.searchsorted(bucket[single], ends), np.searchsorted(bucket[told], ends), np.searchsorted(spread, ends)
        for b in range(self.n_buckets):
            s, t, k = single[cut_s[b] : cut_s[b + 1]], told[cut_t[b] : cut_t[b + 1]], known[cut_k[b] : cut_k[b + 1]]
            if not len(s) + len(t) + len(k):
                continue
            docs = np.unique(np.concatenate([doc[s], doc[k]]))
            # windows are numbered over the documents named here only
            base = np.concatenate([[0], np.cumsum(np.diff(starts)[docs])])
            number = lambda x: base[np.searchsorted(docs, doc[x])] + x - starts[doc[x]]  # noqa: B023, E731
            step = lambda x: np.diff(number(x), prepend=0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([b], pa.int32()),
                    pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), ids.take(pa.array(docs))),
                    pa.array([marks[docs].tolist()], pa.list_(pa.int32())),
                    pa.array([_planes(np.diff(base), 4)], pa.binary()),
                    pa.array([_planes(np.concatenate([hashes[s], hashes[t]]), 7)], pa.binary()),
                    pa.array([_planes(step(s), 4)], pa.binary()),
                    pa.array([_planes(step(k), 4)], pa.binary()),
                ],
                names=["bucket", "ids", "marks", "counts", "hashes", "singles", "known"],
            )


def _dealt(n_buckets: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = held or _Held(n_buckets, batch.column(0).type)
            marks = batch.column(1).to_numpy(zero_copy_only=False)
            for block in W.blocks(batch.column(2)):
                held.add(block, batch.column(0)[block.rows.start : block.rows.stop], marks[block.rows], width)
                if held.n >= HELD_WINDOWS:
                    yield from held.deal()
        if held:
            yield from held.deal()

    return run


def _counted(table: pa.Table) -> pa.Table:
    """Positions of repeated windows, for each document of one bucket's rows."""
    rows = [{k: table[k][i] for k in table.column_names} for i in range(table.num_rows)]
    hashes = [_unplanes(r["hashes"].as_py(), 7) for r in rows]
    every = np.concatenate(hashes)
    order = np.argsort(every)
    same = every[order][1:] == every[order][:-1]
    repeated = np.zeros(len(every), bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    del every, order, same
    ids, marks, at, lengths, offset = [], [], [], [], 0
    for r, h in zip(rows, hashes):
        singles = np.cumsum(_unplanes(r["singles"].as_py(), 4).astype(np.int64) << 32 >> 32)
        known = np.cumsum(_unplanes(r["known"].as_py(), 4).astype(np.int64) << 32 >> 32)
        found = np.sort(np.concatenate([singles[repeated[offset : offset + len(singles)]], known]))
        offset += len(h)
        base = np.concatenate([[0], np.cumsum(_unplanes(r["counts"].as_py(), 4).astype(np.int64))])
        doc = np.searchsorted(base, found, side="right") - 1
        full, count = np.unique(doc, return_counts=True)
        ids.append(r["ids"].values.take(pa.array(full)))
        marks.append(r["marks"].values.take(pa.array(full)))
        at.append(found - base[doc])
        lengths.append(count)
    bounds = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int32)
    positions = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(at).astype(np.int32)))
    kind = table.schema.field("ids").type.value_type
    return pa.table({"id": pa.chunked_array(ids, type=kind), "mark": pa.chunked_array(marks, type=pa.int32()), "positions": positions})


def _cleaned(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            for block in W.blocks(batch.column(1)):
                n = block.rows.stop - block.rows.start
                mine = lists.slice(block.rows.start, n)
                counts = np.array([len(x.values) if x.is_valid else 0 for x in mine], np.int64) if mine.null_count < n else np.zeros(n, np.int64)
                values = mine.flatten().to_numpy(zero_copy_only=False).astype(np.int64) if counts.any() else np.zeros(0, np.int64)
                gone = W.covered(len(block.start), values + np.repeat(block.first[:-1], counts), width)
                kept = np.flatnonzero(~gone)
                size = block.end[kept] - block.start[kept]
                out = np.full(int(size.sum()) + len(kept), 0x20, np.uint8)
                place = np.cumsum(size + 1) - size - 1
                move = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                out[move + np.repeat(place, size)] = block.data[move + np.repeat(block.start[kept], size)]
                ends = np.append(place, len(out))[np.searchsorted(kept, block.first)]
                raw = out.tobytes()
                texts = [raw[a : max(a, b - 1)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                # maximal intervals: where covering begins and ends, cut at the documents' bounds
                edge = np.zeros(len(gone) + 1, bool)
                edge[block.first] = True
                lo = np.flatnonzero(gone & (edge[:-1] | ~np.concatenate([[False], gone[:-1]])))
                hi = np.flatnonzero(gone & (edge[1:] | ~np.concatenate([gone[1:], [False]]))) + 1
                cuts = np.searchsorted(lo, block.first).astype(np.int32)
                doc = np.repeat(np.arange(n), np.diff(cuts))
                interval = lambda x: pa.ListArray.from_arrays(pa.array(cuts), pa.array((x - block.first[doc]).astype(np.int32)))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.rows.start, n), pa.array(block.n_words, pa.int64()), pa.array(W.group_sums(gone, block.first), pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), interval(lo), interval(hi)],
                    names=["id", "n_words", "n_removed", "kept_text", "removed_from", "removed_to"],
                )

    return run


def remove_repeats(docs: DataFrame, width: int = 35, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_text, removed_from, removed_to) of every document.

    kept_text holds the words that stay, joined by one space; the two arrays hold the
    removed intervals of words, from inclusive, to exclusive.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("id"), F.hash(F.col(text)).alias("mark"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(12, -(-size // BUCKET_BYTES))
    shape = f"bucket int, ids array<{kind}>, marks array<int>, counts binary, hashes binary, singles binary, known binary"
    found = rows.mapInArrow(_dealt(n_buckets, width), shape).groupBy("bucket").applyInArrow(_counted, f"id {kind}, mark int, positions array<int>")
    found = found.groupBy("id", "mark").agg(F.flatten(F.collect_list("positions")).alias("positions"))
    found = found.select(F.col("id").alias("i"), F.col("mark").alias("m"), "positions")
    met = rows.join(found, rows["id"].eqNullSafe(found["i"]) & (rows["mark"] == found["m"]), "left").select("id", "text", "positions")
    return met.mapInArrow(_cleaned(width), f"id {kind}, n_words long, n_removed long, kept_text string, removed_from array<int>, removed_to array<int>")


def repeats_report(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: What `repeats_report` returns, for tables small enough to hold every window as text.
REPEATS_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
v AS (SELECT doc_id, list_transform(range(1, len(ws) - 33), lambda i: md5(array_to_string(ws[i:i + 34], ' '))) AS vs FROM w WHERE len(ws) >= 35),
u AS (SELECT doc_id, unnest(vs) AS v, generate_subscripts(vs, 1) AS i FROM v),
t AS (SELECT doc_id, i FROM u WHERE v IN (SELECT v FROM u GROUP BY v HAVING count(*) > 1)),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
c AS (SELECT x.doc_id, x.i, word, x.i - t.i < 35 AS gone FROM x ASOF LEFT JOIN t ON t.doc_id = x.doc_id AND t.i <= x.i),
k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (gone IS NOT TRUE), '') AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id"""

"""Best-fit decreasing packing of tokenised documents into fixed-length sequences.

Tasks tokenise whole texts and write their pieces: no more than a sequence each. Best-fit
decreasing needs only how many pieces have each length, a table of at most `capacity`
rows, so the exact global plan is made once: lengths from the longest, and for each the
tightest open sequence that still has room, found by a segment tree over the remaining
capacities. Pieces of one length are alike, so the plan has one run for all that go to the
same kind of place; it has as many runs as kinds of places, not as pieces. Each piece then
finds its run by its rank among the pieces of its length. Ranks come from small cells of
(length, salt), so a length that a third of all pieces share is no hot group.

Defined cases: null text counts as empty and is one piece of length 1 (the id 0); null or
repeated ids and repeated rows are packed like any others, each once; an empty table gives
an empty result; other columns aren't read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studyloom.llm import words as W
from studyloom.session import materialize

CAPACITY = 2048
ROWS_PER_CELL = 1 << 20
#: Bytes of words and ids that a task remembers; then it starts anew.
REMEMBERED = 24 << 20
_LETTER = np.zeros(256, bool)
_LETTER[list(range(65, 91)) + list(range(97, 123))] = True
# ASCII marks that the tokenizer's pattern never joins to a letter; not the apostrophe,
# and none that a special token is written with
_MARK = np.zeros(256, bool)
_MARK[list(b'!"#$%&()*+,-./:;=?@[\\]^_`{}~')] = True


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """Ids of texts by the `tokenizers` library, asked once for each distinct word of a block.

    The vocabulary drops white space and never joins words, so a text's ids are those of
    its parts in order. Parts are words, cut further between letters and marks.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.memory = W.SpanMemory(REMEMBERED)

    def parts(self, block: W.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes and the bounds of the parts."""
        data = block.data if b"<|" in block.data.tobytes() else W.LOWER[block.data]
        letter = _LETTER[data]
        two = np.zeros(len(data), bool)  # the second byte of U+00C0..U+00FF, letters but for two signs
        two[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        cut = (_MARK[data[1:]] & (letter | two)[:-1]) | (_MARK[data[:-1]] & letter[1:])
        at = np.flatnonzero(cut) + 1
        inside = np.searchsorted(block.start, at, side="right") - 1
        at = at[(inside >= 0) & (at < block.end[inside]) & (at > block.start[inside])] if len(block.start) else at[:0]
        return data, np.sort(np.concatenate([block.start, at])), np.sort(np.concatenate([block.end, at]))

    def asked(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many each has; a few thousand words at a time."""
        ids, count = [], []
        for lo in range(0, len(words), 4096):
            found = [x.ids for x in self.library.encode_batch_fast(words[lo : lo + 4096], add_special_tokens=False)]
            count.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter(chain.from_iterable(found), np.uint32, int(count[-1].sum())))
        return np.concatenate(ids), np.concatenate(count)

    def __call__(self, block: W.Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block, and where each document's ids begin and end."""
        data, start, end = self.parts(block)
        hashes, example, which = W.distinct_spans(data, start, end)
        a, b = start[example], end[example]
        row = self.memory.find(hashes, data, a, b)
        old, new = np.flatnonzero(row >= 0), np.flatnonzero(row < 0)
        ids, count = self.memory.ids_of(row[old])
        if len(new):
            raw = data.tobytes()
            fresh, n = self.asked([raw[x:y].decode("utf-8", "replace") for x, y in zip(a[new].tolist(), b[new].tolist())])
            self.memory.add(hashes[new], data, a[new], b[new], fresh, n)
            ids, count = np.concatenate([ids, fresh]), np.concatenate([count, n])
        # the distinct parts' ids stand in the order old, new
        at = np.empty(len(example), np.int64)
        at[np.concatenate([old, new])] = np.arange(len(example))
        first = np.cumsum(count) - count
        each = count[at][which]
        bounds = np.concatenate([[0], np.cumsum(each)])
        return ids[W.places(first[at][which], each)], bounds[np.searchsorted(start, block.bounds)]


@lru_cache(2)
def tokenizer_for(path: str) -> WordTokenizer:
    """One for each Python worker, which keeps it from task to task; what it remembers ends with the task."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordTokenizer(path)


def _pieces(path: str | None, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_for(path or vocabulary_path())
        for batch in batches:
            for block in W.blocks(batch.column(1)):
                ids, bounds = tokenizer(block)
                n_docs = len(bounds) - 1
                # each document's ids, then the id 0
                out = np.zeros(len(ids) + n_docs, "<u4")
                out[np.arange(len(ids)) + np.repeat(np.arange(n_docs), np.diff(bounds))] = ids
                total = np.diff(bounds) + 1
                pieces = -(-total // capacity)
                doc = np.repeat(np.arange(n_docs), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, total[doc] - start)
                first = (bounds[:-1] + np.arange(n_docs))[doc] + start
                raw = memoryview(out.tobytes())
                crc = [crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(first.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc + block.rows.start)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        tokenizer.memory.forget()

    return run


def tokenised_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's pieces."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_pieces(path, capacity), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class CapacityTree:
    """Segment tree over remaining capacities 0..size: the least open one that is >= x."""

    def __init__(self, size: int):
        self.half = 1 << size.bit_length()
        self.open = [False] * (2 * self.half)

    def set(self, at: int, value: bool) -> None:
        at += self.half
        self.open[at] = value
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]

    def least(self, x: int) -> int:
        """-1 if none is open."""
        at = x + self.half
        if self.open[at]:
            return x
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.half:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.half
            at //= 2
        return -1


def best_fit_runs(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """The best-fit decreasing plan: (length, first rank, first sequence, pieces in each, offset).

    Of the pieces of one length, those from first rank on go to consecutive sequences, so
    many in each, from the offset on. Best fit puts them in the tightest sequence; after
    one piece the same sequence is tighter still, so it is filled before the next begins.
    """
    tree, free, runs, sequences = CapacityTree(capacity), {}, [], 0
    for length in sorted(histogram, reverse=True):
        n, rank = histogram[length], 0
        while n:
            room = tree.least(length)
            if room < 0:
                each = capacity // length
                first, many, room = sequences, -(-n // each), capacity
                sequences += many
            else:
                first, many = free[room].pop()
                if not free[room]:
                    tree.set(room, False)
                each = room // length
            used, rest = min(many, n // each), 0
            runs.append((length, rank, first, each, capacity - room))
            if used < many and n - used * each < each:
                rest = n - used * each  # fewer than each: they go to one more sequence
            left = [(room - each * length, first, used), (room - rest * length, first + used, 1 if rest else 0), (room, first + used + (rest > 0), many - used - (rest > 0))]
            for size, at, count in left:
                if count > 0 and size > 0:
                    free.setdefault(size, []).append((at, count))
                    tree.set(size, True)
            rank += used * each + rest
            n -= used * each + rest
    return runs


def _placed(runs: list[tuple[int, int, int, int, int]]):
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    keys = table[:, 0] << 44 | table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in ("length", "rank"))
            _, first_rank, first, each, offset = table[np.searchsorted(keys, length << 44 | rank, side="right") - 1].T
            at = rank - first_rank
            shown = [batch.column(i) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*shown, pa.array(first + at // np.maximum(each, 1)), pa.array(offset + at % np.maximum(each, 1) * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with (sequence_id, offset); pieces is what tokenised_pieces returns."""
    pieces = materialize(pieces.withColumn("rid", F.monotonically_increasing_id()), "pieces")
    salts = max(16, -(-pieces.count() // ROWS_PER_CELL))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(salts)))
    cells = materialize(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "piece-cells")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    # one row for each length, so capacity rows at most
    histogram = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = best_fit_runs(histogram, capacity)
    inside = Window.partitionBy("length", "salt").orderBy("rid")
    ranked = salted.withColumn("at", F.row_number().over(inside) - 1).join(offsets, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("skip") + F.col("at")).cast("long").alias("rank"))
    kind = pieces.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(_placed(runs), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    return pack(tokenised_pieces(docs, capacity, path), capacity)

"""SentencePiece encoding and decoding by suffix-array matching, for BPE models.

A block's text is cut where no piece could ever join two characters; its distinct parts
are concatenated and indexed by a suffix array (prefix doubling to the longest piece).
Every piece is binary-searched for its range of suffixes, all pieces at once; ranges give
edges (position, piece), which are sorted by position. Relaxing then merges adjacent pairs
along the edges, the best score first and the leftmost on ties, as the model's own encoder
does. Pairs are merged in rounds, in all parts at once: an edge is taken as soon as no
other live edge that shares a character with it could come first. So a part of any length
needs some dozens of rounds, and all parts go the same way. Characters without a piece
fall back to their bytes. What a task has met before keeps its ids (compared by bytes).

Memory depends on the block and on the longest document; a part that is longer than
INDEX_CHARS is indexed in stretches, cut where no edge spans.

Decoding joins the pieces' bytes again, turns the word mark into a space and drops the
space that encoding puts in front.

Defined cases: null and empty texts have no ids and decode to an empty text; a literal
word mark (U+2581) decodes to a space, as in the model's own decoder; rows are treated one
by one, so ties and repeated rows get equal ids; an empty table gives an empty result; other
columns, of any name, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.llm import words as W
from studyloom.llm.packing import vocabulary_path

MARK = "▁"
BLOCK = 2 << 20
#: Characters of new parts that are indexed together.
INDEX_CHARS = 400_000
#: Bytes of parts and ids that a task remembers; longer parts than LONGEST aren't.
REMEMBERED, LONGEST = 32 << 20, 4096
_NONE = np.iinfo(np.int64).max


class SuffixIndex:
    """Suffixes of a text of code points, ordered by their first `depth` characters."""

    def __init__(self, text: np.ndarray, depth: int):
        self.text, n = text, len(text)
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        step = 1
        while True:
            ahead = np.zeros(n, np.int64)
            if step < n:
                ahead[: n - step] = rank[step:] + 1
            key = rank * (n + 2) + ahead
            if step >= depth:
                self.order = np.argsort(rank, kind="stable").astype(np.int32)
                return
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[:1]]) != 0)
            step *= 2

    def ranges(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pattern the suffixes that begin with it: first inclusive, last exclusive."""
        n, width = len(self.text), patterns.shape[1]
        padded = np.concatenate([self.text, np.full(width, -1, self.text.dtype)])
        inside = np.arange(width) < lengths[:, None]

        def bound(after: bool) -> np.ndarray:
            lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), n)
            while (busy := np.flatnonzero(lo < hi)).size:
                mid = (lo[busy] + hi[busy]) >> 1
                found = padded[self.order[mid][:, None] + np.arange(width)]
                differ = (found != patterns[busy]) & inside[busy]
                at = np.argmax(differ, 1)
                rows = np.arange(len(busy))
                less = np.where(differ[rows, at], found[rows, at] < patterns[busy][rows, at], after)
                lo[busy[less]] = mid[less] + 1
                hi[busy[~less]] = mid[~less]
            return lo

        return bound(False), bound(True)


class PieceModel:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != 2 or model.normalizer_spec.name != "identity":
            raise ValueError("a BPE model with the identity normaliser is wanted")
        normal = [(i, p.piece, p.score) for i, p in enumerate(model.pieces) if p.type == 1]
        self.bytes_at = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.byte_ids = np.array([self.bytes_at.get(b, model.trainer_spec.unk_id) for b in range(256)], np.uint32)
        self.ids = np.array([i for i, _, _ in normal], np.uint32)
        # equal scores are equal ranks
        self.rank = np.unique([-s for _, _, s in normal], return_inverse=True)[1].astype(np.int32)
        self.lengths = np.array([len(p) for _, p, _ in normal])
        self.depth = int(self.lengths.max())
        self.patterns = np.full((len(normal), self.depth), -2, np.int32)
        for k, (_, p, _) in enumerate(normal):
            self.patterns[k, : len(p)] = np.frombuffer(p.encode("utf-32-le"), np.int32)
        shown = {i: p.replace(MARK, " ").encode() for i, p, _ in normal} | {i: bytes([b]) for b, i in self.bytes_at.items()}
        parts = [shown.get(i, b"") for i in range(len(model.pieces))]
        self.shown = np.frombuffer(b"".join(parts), np.uint8)
        self.shown_at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        joined = np.zeros((256, 256), bool)
        after_wide = np.zeros(256, bool)  # ASCII that some piece has after another character
        for _, p, _ in normal:
            p = p.replace(MARK, " ")
            for a, b in zip(p, p[1:]):
                if ord(b) < 128:
                    if ord(a) < 128:
                        joined[ord(a), ord(b)] = True
                    else:
                        after_wide[ord(b)] = True
        single = [(ord(p), k) for k, (_, p, _) in enumerate(normal) if len(p) == 1]
        self.single = np.array(sorted(single), np.int64).reshape(-1, 2)
        self.memory = W.SpanMemory(REMEMBERED)
        #: no piece spans these two bytes
        self.apart = np.zeros((256, 256), bool)
        self.apart[:128, :128] = ~joined[:128, :128]
        self.apart[128:, :128] = ~after_wide[:128]
        self.apart[0x81, 0x20] = False  # a literal word mark ends in 0x81

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, piece) of every occurrence of a piece of two characters or more, by position."""
        index = SuffixIndex(text, self.depth)
        lo, hi = index.ranges(self.patterns, self.lengths)
        size = np.where(self.lengths > 1, hi - lo, 0)
        piece = np.repeat(np.arange(len(size), dtype=np.int32), size)
        position = index.order[W.places(lo, size)]
        order = np.argsort(position, kind="stable")
        return position[order], piece[order]

    def merged(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a token begins at each character, and the piece of each such token, -1 for none."""
        n = len(text)
        at = np.minimum(np.searchsorted(self.single[:, 0], text), len(self.single) - 1)
        token = np.where(self.single[at, 0] == text, self.single[at, 1], -1).astype(np.int32)
        head = np.ones(n + 1, bool)
        start, piece = self.edges(text)
        end = start + self.lengths[piece].astype(np.int32)
        while True:
            live = head[start] & head[end]
            start, end, piece = start[live], end[live], piece[live]
            symbol = np.cumsum(head, dtype=np.int32) - 1
            a = symbol[start]
            k = symbol[end] - a
            live = k > 1
            start, end, piece, a, k = start[live], end[live], piece[live], a[live], k[live]
            pairs = np.flatnonzero(k == 2)
            if not len(pairs):
                return head[:n], token
            key = self.rank[piece].astype(np.int64) << 32 | start
            # of each symbol: the pair that it begins
            pair = np.full(int(symbol[-1]) + 2, _NONE)
            pair[a[pairs]] = key[pairs]
            # a longer edge comes after the first of the pairs in it
            rest = np.flatnonzero(k > 2)
            inner = np.full(len(rest), _NONE)
            for j in range(int(k.max()) - 1):
                more = k[rest] > j + 1
                inner[more] = np.minimum(inner[more], pair[a[rest[more]] + j])
            reached = inner < _NONE
            dead = rest[~reached]
            rest, soonest = rest[reached], np.maximum(inner, key[rest])[reached]
            longer = np.full(len(pair), _NONE)
            for j in range(int(k.max())):
                more = k[rest] > j
                np.minimum.at(longer, a[rest[more]] + j, soonest[more])
            at = a[pairs]
            mine = key[pairs]
            before = np.where(at > 0, pair[at - 1], _NONE)
            other = np.minimum(longer[at], longer[at + 1])
            first = (mine <= before) & (mine <= pair[at + 1]) & (mine <= other)
            # a run of pairs of one rank, as in "aaaa": every second one, from the first
            rank = mine >> 32
            even = (before >> 32 >= rank) & (pair[at + 1] >> 32 >= rank) & (other >> 32 > rank)
            follows = np.zeros(len(at), bool)
            follows[1:] = even[1:] & even[:-1] & (at[1:] == at[:-1] + 1) & (rank[1:] == rank[:-1])
            opens = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
            take = first | follows & first[opens] & ((np.arange(len(at)) - opens) % 2 == 0)
            chosen = pairs[take]
            token[start[chosen]] = piece[chosen]
            head[np.flatnonzero(head)[a[chosen] + 1]] = False
            if len(dead):
                keep = np.ones(len(start), bool)
                keep[dead] = False
                start, end, piece = start[keep], end[keep], piece[keep]

    def stretches(self, text: np.ndarray) -> Iterator[np.ndarray]:
        """A long part cut where no edge spans; a stretch grows until there is such a place."""
        lo, size = 0, INDEX_CHARS
        while lo < len(text):
            hi = min(len(text), lo + size)
            if hi < len(text):
                start, piece = self.edges(text[lo:hi])
                spans = np.zeros(hi - lo + 1, np.int64)
                np.add.at(spans, start + 1, 1)
                np.add.at(spans, start + self.lengths[piece], -1)
                free = np.flatnonzero(np.cumsum(spans)[: hi - lo - self.depth] == 0)
                if free[-1] == 0 if len(free) else True:
                    size *= 2
                    continue
                hi = lo + int(free[-1])
            yield text[lo:hi]
            lo, size = hi, INDEX_CHARS

    def relax(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts, and how many each has."""
        if len(parts) == 1 and len(parts[0]) > INDEX_CHARS:
            every = [self._relaxed(x, np.array([len(x)])) for x in self.stretches(np.frombuffer(parts[0].encode("utf-32-le"), np.int32))]
            return np.concatenate([x for x, _ in every]), np.array([sum(len(x) for x, _ in every)])
        text = np.frombuffer("\0".join(parts).encode("utf-32-le"), np.int32)
        return self._relaxed(text, np.fromiter(map(len, parts), np.int64, len(parts)))

    def _relaxed(self, text: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """text holds parts of these lengths with a character between them that no piece has."""
        head, token = self.merged(text)
        begin = np.cumsum(lengths + 1) - lengths - 1
        head[begin[1:] - 1] = False
        start = np.flatnonzero(head)
        ids, n_ids = self.ids[token[start]], np.ones(len(start), np.int64)
        # characters without a piece become their bytes
        loose = np.flatnonzero(token[start] < 0)
        if len(loose):
            raw = [chr(c).encode("utf-8", "replace") for c in text[start[loose]].tolist()]
            n_ids[loose] = [len(x) for x in raw]
            ids = np.repeat(ids, n_ids)
            ids[W.places((np.cumsum(n_ids) - n_ids)[loose], n_ids[loose])] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        sums = np.concatenate([[0], np.cumsum(n_ids)])
        return ids, sums[np.searchsorted(start, begin + lengths)] - sums[np.searchsorted(start, begin)]

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive documents, and their bounds; data has the space in front of each."""
        cut = self.apart[data[:-1], data[1:]]
        starts = np.unique(np.concatenate([bounds[:-1][np.diff(bounds) > 0], np.flatnonzero(cut) + 1]))
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        hashes, example, which = W.distinct_spans(data, starts, ends)
        a, b = starts[example], ends[example]
        row = self.memory.find(hashes, data, a, b)
        old, new = np.flatnonzero(row >= 0), np.flatnonzero(row < 0)
        ids, count = self.memory.ids_of(row[old])
        ids, count, raw, lo = [ids], [count], data.tobytes(), 0
        size = np.cumsum(b[new] - a[new])
        while lo < len(new):
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + INDEX_CHARS, side="right")))
            mine = new[lo:hi]
            fresh, n = self.relax([raw[x:y].decode("utf-8", "replace").replace(" ", MARK) for x, y in zip(a[mine].tolist(), b[mine].tolist())])
            short = (b - a)[mine] <= LONGEST
            self.memory.add(hashes[mine[short]], data, a[mine[short]], b[mine[short]], fresh[np.repeat(short, n)], n[short])
            ids.append(fresh)
            count.append(n)
            lo = hi
        ids, count = np.concatenate(ids), np.concatenate(count)
        # the distinct parts' ids stand in the order old, new
        at = np.empty(len(example), np.int64)
        at[np.concatenate([old, new])] = np.arange(len(example))
        first = np.cumsum(count) - count
        each = count[at][which]
        ends_at = np.concatenate([[0], np.cumsum(each)])
        return ids[W.places(first[at][which], each)], ends_at[np.searchsorted(starts, bounds)]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of consecutive documents, with the space in front of each, and their bounds."""
        size = np.diff(self.shown_at)[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.shown[W.places(self.shown_at[:-1][ids], size)], ends[bounds]


@lru_cache(2)
def model_for(path: str) -> PieceModel:
    """One for each Python worker, which keeps it from task to task; what it remembers ends with the task."""
    return PieceModel(path)


def _spaced(column: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Blocks of documents: rows, bytes with a space before each text that isn't empty, bounds."""
    data, bounds = W.utf8(column)
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + BLOCK, side="right")) - 1)
        b = bounds[lo : hi + 1]
        full = (np.diff(b) > 0).astype(np.int64)
        out = np.full(int(b[-1] - b[0] + full.sum()), 0x20, np.uint8)
        shift = np.cumsum(full)
        out[np.arange(b[-1] - b[0]) + np.repeat(shift, np.diff(b))] = data[b[0] : b[-1]]
        yield slice(lo, hi), out, b - b[0] + np.concatenate([[0], shift])
        lo = hi


def _encoded(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_for(path or vocabulary_path("piece_bpe_32k.model"))
        for batch in batches:
            for rows, data, bounds in _spaced(batch.column(1)):
                ids, at = model(data, bounds)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(rows.start, rows.stop - rows.start), lists], names=["id", "ids"])
        model.memory.forget()

    return run


def _decoded(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_for(path or vocabulary_path("piece_bpe_32k.model"))
        for batch in batches:
            lists = batch.column(1)
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            data, at = model.decode(ids, bounds)
            raw = data.tobytes()
            texts = [raw[a + 1 : b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return run


def encode(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids) of every document."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(_encoded(path), f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(id, text) of what encode returns."""
    rows = encoded.select("id", "ids")
    return rows.mapInArrow(_decoded(path), f"id {rows.schema['id'].dataType.simpleString()}, text string")


def _reported(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_for(path or vocabulary_path("piece_bpe_32k.model"))
        for batch in batches:
            for rows, data, bounds in _spaced(batch.column(1)):
                ids, at = model(data, bounds)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                back, back_at = model.decode(ids, at)
                same = back_at[1:] - back_at[:-1] == bounds[1:] - bounds[:-1]
                if len(back) == len(data):  # else some text differs; compare one by one
                    wrong = W.group_sums(back != data, bounds)
                    same &= (wrong == 0) & (back_at[:-1] == bounds[:-1])
                else:
                    same &= [bool(np.array_equal(back[a:b], data[c:d])) for a, b, c, d in zip(back_at[:-1], back_at[1:], bounds[:-1], bounds[1:])]
                loose = W.group_sums(np.isin(ids, model.byte_ids), at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(rows.start, rows.stop - rows.start), pa.array(np.diff(at)), pa.array(loose), pa.array(crc, pa.int64()), pa.array(same)], names=["doc_id", "n_ids", "n_byte_ids", "ids_crc32", "round_trip"])
        model.memory.forget()

    return run


def pieces_report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_ids, n_byte_ids, ids_crc32 (little-endian unsigned 32-bit ids) and whether decoding gives the text back."""
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(_reported(path), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_ids long, n_byte_ids long, ids_crc32 long, round_trip boolean")

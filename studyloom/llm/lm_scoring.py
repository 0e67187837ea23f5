"""LM scoring: a trigram model in Elias-Fano tries, one for each bucket of contexts.

Model. Tokens are words, A-Z lower-cased, then one end. With counts from the training
documents and a discount D, a token w after u, v has log10 probability

    log((c(u,v,w) - D) / c(u,v))                        if u,v,w was seen,
    log(D t(u,v) / c(u,v)) + log((c(v,w) - D) / c(v))   else if v,w was seen,
    ... + log(D t(v) / c(v)) + log((c(w) + 0.1) / (N + 0.1 (V + 1)))  else,

t being the number of different followers; a context that was never seen is left out, and
a text's first word has the last term only. What seen words take twice isn't given back,
so the probabilities after a context sum to less than one, never to more.

Work. One pass counts the words; counts are combined in the tasks. Then each task sends
every word position, with its left and right neighbour, to the bucket of its word; equal
texts of a task travel once. A bucket has about BUCKET_TOKENS positions: it holds all
counts of its contexts, builds its trie in a temporary file, maps it into memory and
scores the same positions against it; it returns sums for each text. A word that would
fill half a bucket or more, or is 1/400 of all, is dealt over as many as it needs by a
class of its left neighbour. Each class holds all of its u, so its counts of u,v,w are whole; its counts of
v,w are summed over the classes, and what follows no known u,v is joined with those sums.
What no trie knows goes through one more join for c(w). Neighbours are kept as hashes of
32 bits. The list of dealt words is cut at HOT, so a bucket can grow only by words beyond
the HOT most frequent ones, or by one u,v that alone is more than a bucket.

Trie. Level one has the sorted context words; level two the followers of each context and
its left neighbours; level three the followers of each left neighbour. A level is one
rising sequence, the context's number above the hash, in Elias-Fano form: low bytes plus a
unary bit vector of high parts, whose runs are the pointers into the level. It is queried
as it is stored, through a count of zeros for every 64 bits. Probabilities and back-off
weights are 8-bit codes of a book that has the most frequent values exactly; in tests the
scores are within 0.005 a token of those of plain counts.

Defined cases: null and empty texts have the end token only; documents with a null id
train; null, repeated ids and repeated rows each get a row; an empty table gives an empty
result, and without training documents N and V are 0; other columns aren't read.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.llm import words as W
from studyloom.llm.substring_dedup import _planes, _unplanes
from studyloom.session import materialize

#: Positions that a bucket holds; about 200 bytes of memory each while it is scored.
BUCKET_TOKENS = 700_000
#: Positions that a task gathers before it deals them out; about 50 bytes each.
HELD_TOKENS = 1_000_000
#: Words that are dealt over several buckets, at most: 16 bytes each in every task.
HOT = 50_000
#: A word of this share is treated like those that fill half a bucket, so that inputs of all sizes treat frequent words alike.
FREQUENT = 1 / 400
DISCOUNT = 0.75
_U = np.uint64
END = 0x656E640065
START = 0x73740073
#: Values of a code book that are exact; the rest of its 256 are quantiles of the others.
EXACT = 96


def code_book(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Up to 256 rising values, and for each of values the number of the nearest."""
    book, n = np.unique(np.round(values, 4), return_counts=True)
    if len(book) > 256:
        often = np.zeros(len(book), bool)
        often[np.argsort(-n, kind="stable")[:EXACT]] = True
        rest = np.repeat(book[~often], n[~often])
        book = np.unique(np.concatenate([book[often], rest[np.linspace(0, len(rest) - 1, 256 - EXACT).astype(np.int64)]]))
    return book, np.searchsorted((book[1:] + book[:-1]) / 2, values).astype(np.uint8)


class EliasFano:
    """A rising sequence of whole numbers: low bytes, and high parts in unary."""

    @staticmethod
    def write(values: np.ndarray, path: str) -> tuple[str, int, int]:
        n, top = len(values), int(values[-1]) + 1 if len(values) else 1
        low = max(0, -(-max(0, (top // max(n, 1)).bit_length() - 1) // 8))  # whole bytes
        high = (values >> _U(8 * low)).astype(np.int64)
        size = n + (int(high[-1]) if n else 0) + 1
        bits = np.ones(-(-size // 64) * 64, np.uint8)  # the last word is filled up with ones
        bits[:size] = 0
        bits[high + np.arange(n)] = 1
        lows = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :low])
        zeros = np.cumsum(64 - bits.reshape(-1, 64).sum(1, dtype=np.int64))
        with open(path, "wb") as out:
            out.write(np.concatenate([[0], zeros]).astype("<u4").tobytes())
            out.write(np.packbits(bits).tobytes())
            out.write(lows.tobytes())
        return path, n, low

    def __init__(self, stored: tuple[str, int, int]):
        path, self.n, self.low = stored
        raw = np.memmap(path, np.uint8, "r")
        n_words = (len(raw) - self.n * self.low - 4) // 12
        self.zeros = raw[: 4 * (n_words + 1)].view("<u4")  # before each word of 64 bits, and in all
        self.bits = raw[4 * (n_words + 1) : 4 * (n_words + 1) + 8 * n_words].reshape(-1, 8)
        self.lows = raw[len(raw) - self.n * self.low :].reshape(self.n, self.low)

    def _low(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for k in range(self.low):
            out |= self.lows[at, k].astype(np.uint64) << _U(8 * k)
        return out

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Where the k-th zero is, from 1; 0 is in front of the sequence."""
        out = np.full(len(k), -1)
        for lo in range(0, len(k), 1 << 15):
            want = k[lo : lo + (1 << 15)]
            word = np.maximum(np.searchsorted(self.zeros, want, side="left") - 1, 0)
            seen = np.cumsum(1 - np.unpackbits(self.bits[word], axis=1), axis=1, dtype=np.uint8)
            inside = np.argmax(seen >= (want - self.zeros[word].astype(np.int64))[:, None], axis=1)
            out[lo : lo + (1 << 15)] = np.where(want > 0, 64 * word + inside, -1)
        return out

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of each value, -1 where it is missing: its run, then its least successor there."""
        high = (values >> _U(8 * self.low)).astype(np.int64)
        inside = high < int(self.zeros[-1])
        high = np.where(inside, high, 0)
        distinct, which = np.unique(high, return_inverse=True)
        # the run of a high part lies between two zeros
        lo, hi = (self._zero(distinct) + 1 - distinct)[which], np.where(inside, (self._zero(distinct + 1) - distinct)[which], 0)
        stop, want = hi.copy(), values & _U((1 << (8 * self.low)) - 1)
        while (busy := np.flatnonzero(lo < hi)).size:
            mid = (lo[busy] + hi[busy]) >> 1
            less = self._low(mid) < want[busy]
            lo[busy[less]] = mid[less] + 1
            hi[busy[~less]] = mid[~less]
        found = inside & (lo < stop)
        at = np.flatnonzero(found)
        found[at] = self._low(lo[at]) == want[at]
        return np.where(found, lo, -1)


class Trie:
    """The three levels of one bucket, memory-mapped."""

    def __init__(self, folder: str, contexts: np.ndarray, pairs, lefts, triples):
        """contexts: sorted words, c, t. pairs: (context, w), c. lefts: (context, u), c, t. triples: (left, w), c.

        Parts are given as tuples of arrays, rising in their key.
        """
        word, c1, t1 = contexts
        self.words = EliasFano(EliasFano.write(word, f"{folder}/words"))
        self.pairs = EliasFano(EliasFano.write(pairs[0], f"{folder}/pairs"))
        self.lefts = EliasFano(EliasFano.write(lefts[0], f"{folder}/lefts"))
        self.triples = EliasFano(EliasFano.write(triples[0], f"{folder}/triples"))
        of = lambda keys: (keys >> _U(32)).astype(np.int64)
        self.codes = {
            "back1": self._store(folder, "back1", DISCOUNT * t1 / c1),
            "pair": self._store(folder, "pair", (pairs[1] - DISCOUNT) / c1[of(pairs[0])]),
            "back2": self._store(folder, "back2", DISCOUNT * lefts[2] / lefts[1]),
            "triple": self._store(folder, "triple", (triples[1] - DISCOUNT) / lefts[1][of(triples[0])]),
        }

    @staticmethod
    def _store(folder: str, name: str, probability: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code book and the mapped codes."""
        path = f"{folder}/{name}.codes"
        book, codes = code_book(np.log10(np.maximum(probability, 1e-12)))
        codes.tofile(path)
        return book, np.memmap(path, np.uint8, "r") if len(probability) else codes

    def _value(self, name: str, at: np.ndarray) -> np.ndarray:
        book, codes = self.codes[name]
        return book[codes[at]]

    def score(self, words: np.ndarray, lefts: np.ndarray, triples: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each triple: log10 of what the trie knows, and whether c(w), or for hot contexts the term of v,w, has to be multiplied in.

        lefts and triples have the number of a word, or of a left, above 32 bits of u, or of w.
        """
        high, low = lambda x: (x >> _U(32)).astype(np.int64), lambda x: x & _U(0xFFFFFFFF)

        def level(parent: np.ndarray, keys: np.ndarray, sequence: EliasFano) -> np.ndarray:
            at = np.full(len(keys), -1)
            known = np.flatnonzero(parent >= 0)
            at[known] = sequence.find(parent[known].astype(np.uint64) << _U(32) | low(keys[known]))
            return at

        context = self.words.find(words)
        left = level(context[high(lefts)], lefts, self.lefts)
        left_of = left[high(triples)]
        triple = level(left_of, triples, self.triples)
        out, open_ = np.zeros(len(triples)), triple < 0
        out[~open_] = self._value("triple", triple[~open_])
        miss = np.flatnonzero(open_ & (left_of >= 0))
        out[miss] += self._value("back2", left_of[miss])
        miss = np.flatnonzero(open_)
        word = high(lefts)[high(triples[miss])]
        miss, word = miss[~hot[word]], word[~hot[word]]
        miss, word = miss[context[word] >= 0], word[context[word] >= 0]
        pair = level(context[word], triples[miss], self.pairs)
        hit = pair >= 0
        out[miss[hit]] += self._value("pair", pair[hit])
        open_[miss[hit]] = False
        out[miss[~hit]] += self._value("back1", context[word[~hit]])
        return out, open_


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, n, c): how often it occurs, and how often in training texts, for some megabytes at a time."""
    hashes, train, n = [], [], 0

    def counted() -> pa.RecordBatch:
        word, which = np.unique(np.concatenate(hashes), return_inverse=True)
        every, learnt = np.bincount(which, minlength=len(word)), np.bincount(which, np.concatenate(train), len(word))
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(every, pa.int64()), pa.array(learnt.astype(np.int64))], names=["word", "n", "c"])

    for batch in batches:
        learns = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
        for block in W.blocks(batch.column(1)):
            hashes.append(block.word_hashes(lower=True))
            train.append(np.repeat(learns[block.rows], block.n_words))
            n += len(hashes[-1])
            if n >= HELD_TOKENS:
                yield counted()
                hashes, train, n = [], [], 0
    if n:
        yield counted()


class _Held:
    """Word positions of some texts, until they are dealt out to the buckets."""

    def __init__(self, n_buckets: int, hot: np.ndarray, classes: np.ndarray):
        self.n_buckets, self.hot, self.classes = n_buckets, hot, classes
        self.flush = 0
        self.clear()

    def clear(self) -> None:
        self.texts: dict[tuple[int, int], int] = {}
        self.train, self.test, self.parts, self.n = [], [], [], 0

    def add(self, block: W.Block, key: np.ndarray, mark: np.ndarray, train: np.ndarray) -> None:
        n_docs, fresh = len(key), np.zeros(len(key), bool)
        number = np.zeros(n_docs, np.int64)
        for i, k in enumerate(zip(key.tolist(), mark.tolist())):
            if (at := self.texts.get(k)) is None:
                at = self.texts[k] = len(self.texts)
                self.train.append(0)
                self.test.append(0)
                fresh[i] = True
            number[i] = at
            (self.train if train[i] else self.test)[at] += 1
        hashes, doc = block.word_hashes(lower=True), block.doc
        left = np.concatenate([np.full(1, START, np.uint64), hashes])[: len(hashes)]
        right = np.concatenate([hashes[1:], np.full(1, END, np.uint64)])[: len(hashes)]
        full = block.n_words > 0
        first = np.zeros(len(hashes), bool)
        first[block.first[:-1][full]] = True
        left[first] = START
        right[block.first[1:][full] - 1] = END
        use = fresh[doc]
        self.parts.append((hashes[use], left[use], right[use], number[doc[use]].astype(np.int32), first[use]))
        self.n += int(use.sum())

    def deal(self) -> Iterator[pa.RecordBatch]:
        if not self.texts:
            return
        flush = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24 | self.flush
        self.flush += 1
        v, u, w, text, first = (np.concatenate(x) for x in zip(*self.parts))
        keys = np.array(list(self.texts), np.int64).reshape(-1, 2)
        train, test = np.array(self.train, np.int64), np.array(self.test, np.int64)
        self.clear()
        yield _row({"bucket": flush % self.n_buckets, "flush": flush, "keys": keys[:, 0].tolist(), "marks": keys[:, 1].tolist()}, SENT)
        spread = np.zeros(len(v), np.uint64)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, v), len(self.hot) - 1)
            is_hot = self.hot[at] == v
            spread[is_hot] = W.mix(u[is_hot]) % self.classes[at[is_hot]].astype(np.uint64)
        context = _context(v, spread)
        bucket = ((context >> _U(32)) * _U(self.n_buckets) >> _U(32)).astype(np.int32)
        order = np.lexsort((context, bucket))
        cuts = np.searchsorted(bucket[order], np.arange(self.n_buckets + 1))
        for b in range(self.n_buckets):
            mine = order[cuts[b] : cuts[b + 1]]
            if not len(mine):
                continue
            c = context[mine]
            new = np.concatenate([[True], c[1:] != c[:-1]])
            held = test[text[mine]] > 0
            yield _row(
                {
                    "bucket": b,
                    "flush": flush,
                    "train": _packed(train, 4),
                    "test": _packed(test, 4),
                    "words": _packed(v[mine][new], 8),
                    "spread": _packed(spread[mine][new], 4),
                    "runs": _packed(np.diff(np.append(np.flatnonzero(new), len(c))), 4),
                    "u": _packed(W.mix(u[mine]), 4),
                    "w": _packed(w[mine], 4),
                    "ref": _packed(np.diff(text[mine], prepend=0), 3),
                    "first": _packed(first[mine], 1),
                    "held": _packed(w[mine][held] >> _U(32), 4),
                },
                SENT,
            )


def _context(v: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """One value for a word and the class of its left neighbour."""
    return W.mix(v + spread.astype(np.uint64) * _U(0x9E3779B97F4A7C15))


def _packed(values: np.ndarray, size: int) -> bytes:
    return zstandard.compress(_planes(values, size), 1)


def _unpacked(raw: bytes, size: int) -> np.ndarray:
    return _unplanes(zstandard.decompress(raw), size)


LONGS, INTS = pa.list_(pa.int64()), pa.list_(pa.int32())
#: What tasks send to a bucket: a row of positions for each flush, or a flush's texts.
SENT = {"bucket": pa.int32(), "flush": pa.int64(), "keys": LONGS, "marks": INTS} | dict.fromkeys("train test words spread runs u w ref first held".split(), pa.binary())
SENT_SCHEMA = "bucket int, flush long, keys array<long>, marks array<int>, train binary, test binary, words binary, spread binary, runs binary, u binary, w binary, ref binary, first binary, held binary"
#: What a bucket returns. Kind 0: sums for a flush's texts; 1: a follower that no trie knows; 3: a flush's texts; 4: a follower of a hot word prev whose u,v,w is unknown; 5: a class's count of a hot word and a follower's 32 bits.
GOT = {"kind": pa.int32(), "flush": pa.int64(), "keys": LONGS, "marks": INTS, "ref": pa.int32(), "prev": pa.int64(), "word": pa.int64(), "n": pa.int64()} | dict.fromkeys("refs counts known base score".split(), pa.binary())
GOT_SCHEMA = "kind int, flush long, keys array<long>, marks array<int>, ref int, prev long, word long, n long, refs binary, counts binary, known binary, base binary, score binary"


def _row(values: dict, schema: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([values.get(k)], t) for k, t in schema.items()], names=list(schema))


def _rows(schema: dict, **columns) -> pa.Table:
    size = len(next(iter(columns.values())))
    return pa.table({k: pa.array(columns[k], t) if k in columns else pa.nulls(size, t) for k, t in schema.items()})


def _dealt(n_buckets: int, hot: np.ndarray, classes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(n_buckets, hot, classes)
        for batch in batches:
            key, mark, train = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for block in W.blocks(batch.column(3)):
                held.add(block, key[block.rows], mark[block.rows], train[block.rows])
                if held.n >= HELD_TOKENS:
                    yield from held.deal()
        yield from held.deal()

    return run


def _distinct(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    new = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
    which = np.empty(len(keys), np.int32)
    which[order] = np.cumsum(new, dtype=np.int32) - 1
    return keys[new], which, np.bincount(which, weights, int(new.sum()))


def _scored(hot: np.ndarray, hot_counts: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        is_list = table["keys"].is_valid().to_numpy()
        texts = table.filter(pa.array(is_list)).select(["flush", "keys", "marks"]).append_column("kind", pa.array(np.full(int(is_list.sum()), 3), pa.int32()))
        out = [pa.table({k: texts[k] if k in texts.column_names else pa.nulls(len(texts), t) for k, t in GOT.items()})]
        table = table.filter(pa.array(~is_list)).drop_columns(["keys", "marks"])
        n_rows = table.num_rows
        if not n_rows:
            return out[0]
        get = lambda k, size: [_unpacked(x, size) for x in table[k].to_pylist()]
        train = get("train", 4)
        skip = np.cumsum([0, *map(len, train)])  # a text's number here: its flush's first plus its own there
        runs = np.concatenate(get("runs", 4)).astype(np.int64)
        refs = [np.cumsum(x.astype(np.int64) << 40 >> 40) for x in get("ref", 3)]
        text = np.concatenate([r + skip[i] for i, r in enumerate(refs)]).astype(np.int32)
        row_of = np.repeat(np.arange(n_rows), [len(r) for r in refs])
        del refs
        word = np.concatenate(get("words", 8))
        weight = np.concatenate(train).astype(np.float32)[text]

        # the counts of this bucket's contexts; numbers stand for contexts from here on
        contexts, which = np.unique(_context(word, np.concatenate(get("spread", 4))), return_inverse=True)
        words = np.zeros(len(contexts), np.uint64)
        words[which] = word
        number = np.repeat(which.astype(np.int32), runs)
        del word, which, runs
        c1 = np.bincount(number, weight, len(contexts))
        n_text = int(skip[-1])
        unigram, is_hot = c1.copy(), np.zeros(len(contexts), bool)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, words), len(hot) - 1)
            is_hot = hot[at] == words
            unigram = np.where(is_hot, hot_counts[at], unigram)
        base = np.log10(unigram + 0.1)[number]
        first = np.concatenate(get("first", 1)).astype(bool)
        out_n = np.bincount(text, minlength=n_text)
        out_known = np.bincount(text, (unigram > 0)[number], n_text)
        out_base = np.bincount(text, base, n_text)
        out_score = np.zeros(n_text) + np.bincount(text[first], base[first], n_text)
        del base, first, unigram

        seen = np.flatnonzero(c1 > 0)
        rank = np.cumsum(c1 > 0) - 1  # a seen context's place in the trie
        w = np.concatenate(get("w", 4)).astype(np.uint64)
        high = number.astype(np.uint64) << _U(32)
        pair, pair_of, c2 = _distinct(high | w, weight)
        t1 = np.bincount((pair >> _U(32)).astype(np.int64), c2 > 0, len(contexts))
        del pair_of  # only the counts are wanted
        of_hot = is_hot[(pair >> _U(32)).astype(np.int64)]
        at = np.flatnonzero(of_hot & (c2 > 0))
        out.append(_rows(GOT, kind=np.full(len(at), 5), prev=words[(pair[at] >> _U(32)).astype(np.int64)].view(np.int64), word=(pair[at] & _U(0xFFFFFFFF)).view(np.int64), n=c2[at].astype(np.int64)))
        of_hot = ~of_hot & (c2 > 0)
        left, left_of, cl = _distinct(high | np.concatenate(get("u", 4)), weight)
        del high, number
        triple, triple_of, c3 = _distinct(left_of.astype(np.uint64) << _U(32) | w, weight)
        del left_of, weight
        triple_of = triple_of.astype(np.int32)
        t2 = np.bincount((triple >> _U(32)).astype(np.int64), c3 > 0, len(left))
        left_rank = np.cumsum(cl > 0) - 1
        low = _U(0xFFFFFFFF)
        moved = lambda keys, ok, ranks: ranks[(keys[ok] >> _U(32)).astype(np.int64)].astype(np.uint64) << _U(32) | keys[ok] & low
        with tempfile.TemporaryDirectory() as folder:
            trie = Trie(
                folder,
                (contexts[seen], c1[seen], t1[seen]),
                (moved(pair, of_hot, rank), c2[of_hot]),
                (moved(left, cl > 0, rank), cl[cl > 0], t2[cl > 0]),
                (moved(triple, c3 > 0, left_rank), c3[c3 > 0]),
            )
            del pair, of_hot, c2, t1, cl, t2, c3, rank, left_rank
            known, open_ = trie.score(contexts, left, triple, is_hot)
            context_of = (left >> _U(32)).astype(np.int32)[(triple >> _U(32)).astype(np.int64)]  # of each triple
            del trie, triple, left
        out_score += np.bincount(text, known[triple_of], n_text)

        # a text without a held-out copy trained all it holds; the others sent their followers' high half too
        held = np.concatenate(get("test", 4))[text] > 0
        w[held] |= np.concatenate(get("held", 4)) << _U(32)
        at = np.flatnonzero(open_[triple_of])
        flush = table["flush"].to_numpy()
        v = context_of[triple_of[at]]
        out.append(_rows(GOT, kind=np.where(is_hot[v], 4, 1), flush=flush[row_of[at]], ref=text[at] - skip[row_of[at]], prev=words[v].view(np.int64), word=w[at].view(np.int64), n=np.ones(len(at), np.int64)))
        sums = {k: [] for k in ("refs", "counts", "known", "base", "score")}
        for i in range(n_rows):
            mine = skip[i] + np.flatnonzero(out_n[skip[i] : skip[i + 1]])
            sums["refs"].append(_packed(np.diff(mine - skip[i], prepend=0), 4))
            sums["counts"].append(_packed(out_n[mine], 4))
            sums["known"].append(_packed(out_known[mine].astype(np.int64), 4))
            sums["base"].append(out_base[mine].tobytes())
            sums["score"].append(out_score[mine].astype(np.float32).tobytes())
        out.append(_rows(GOT, kind=np.zeros(n_rows, np.int32), flush=flush, **sums))
        return pa.concat_tables(out)

    return run


def _summed(table: pa.Table) -> pa.Table:
    """The sums of one flush's texts over all buckets."""
    one = table.filter(pa.array(table["kind"].to_numpy() == 3))
    keys, marks = one["keys"][0].values, one["marks"][0].values
    sums = np.zeros((4, len(keys)))
    for r in table.filter(pa.array(table["kind"].to_numpy() == 0)).select(["refs", "counts", "known", "base", "score"]).to_pylist():
        at = np.cumsum(_unpacked(r["refs"], 4).astype(np.int64))
        sums[0, at] += _unpacked(r["counts"], 4)
        sums[1, at] += _unpacked(r["known"], 4)
        sums[2, at] += np.frombuffer(r["base"])
        sums[3, at] += np.frombuffer(r["score"], np.float32)
    n, known = sums[:2].astype(np.int64)
    return pa.table({"flush": pa.array(np.full(len(keys), one["flush"][0].as_py())), "ref": pa.array(np.arange(len(keys)), pa.int32()), "key": keys, "mark": marks, "n": n, "n_known": known, "base": sums[2], "score": sums[3]})


def _looked_up(keys: np.ndarray, values: np.ndarray):
    """A function of a column: the value of each key, null where it is NaN or missing. keys are HOT at most."""
    order = np.argsort(keys)
    keys, values = keys[order], values[order]

    @F.pandas_udf("double")
    def find(column: pd.Series) -> pd.Series:
        wanted = column.to_numpy()
        at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        return pd.Series(np.where(keys[at] == wanted, values[at], np.nan) if len(keys) else np.full(len(wanted), np.nan))

    return find


def is_training(doc_id: Column) -> Column:
    """The documents to learn from: crc32 of the id as text, modulo 10, is not 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 != 0, F.lit(True))


def score_documents(docs: DataFrame, training: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, training, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    spark = docs.sparkSession
    value = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("id"), training.alias("train"), F.xxhash64(value).alias("key"), F.hash(value).alias("mark"), value.alias("text"))
    n_train = rows.where("train").count()
    words = rows.select("train", "text").mapInArrow(_word_counts, "word long, n long, c long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    words = materialize(words, "word-counts", thin=True)
    total, v, n = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("c") > 0), F.coalesce(F.sum("c"), F.lit(0))).first()
    n_buckets = max(12, -(-total // BUCKET_TOKENS))
    # HOT rows at most
    often = words.where(F.col("n") >= min(BUCKET_TOKENS / 2, FREQUENT * total)).orderBy(F.desc("n"), "word").limit(HOT).collect()
    often = sorted((np.int64(r["word"]).view(np.uint64), r["n"], r["c"]) for r in often)
    hot = np.array([x for x, _, _ in often], np.uint64)
    classes = np.array([2 * m // BUCKET_TOKENS + 1 for _, m, _ in often], np.int64)
    exact = np.array([c for _, _, c in often], np.float64)

    sent = rows.select("key", "mark", "train", "text").mapInArrow(_dealt(n_buckets, hot, classes), SENT_SCHEMA)
    got = materialize(sent.groupBy("bucket").applyInArrow(_scored(hot, exact), GOT_SCHEMA), "scored")
    v, n = v + (n_train > 0), n + n_train  # the end token, once for each training document
    ends = spark.range(1).select(F.lit(END).cast("long").alias("word"), F.lit(n_train).cast("long").alias("c"))
    total_mass = float(np.log10(n + 0.1 * (v + 1)))

    # the bigrams of frequent words, over all classes; at most HOT rows of totals
    pairs = materialize(got.where("kind = 5").groupBy("prev", "word").agg(F.sum("n").alias("c2")), "hot-pairs")
    followers = {r["prev"]: r["t"] for r in pairs.groupBy("prev").agg(F.count("*").alias("t")).collect()}
    c1, t1 = np.where(exact > 0, exact, np.nan), np.array([followers.get(x, 0) for x in hot.view(np.int64).tolist()], np.float64)
    total_of = _looked_up(hot.view(np.int64), c1)
    back_off = _looked_up(hot.view(np.int64), np.log10(np.maximum(DISCOUNT * t1, 1e-12)) - np.log10(c1))
    after = got.where("kind = 4").select("flush", "ref", "prev", "word", "n", F.col("word").bitwiseAND(F.lit(0xFFFFFFFF)).alias("low"))
    after = after.join(pairs.select("prev", F.col("word").alias("low"), "c2"), ["prev", "low"], "left")
    term = F.when(F.col("c2").isNotNull(), F.log10((F.col("c2") - DISCOUNT) / total_of("prev"))).otherwise(F.coalesce(back_off("prev"), F.lit(0.0)))
    after = materialize(after.select("flush", "ref", F.when(F.col("c2").isNull(), F.col("word")).alias("word"), "n", (F.col("n") * term).alias("term")), "after-hot")

    unknown = got.where("kind = 1").select("flush", "ref", "word", "n").unionByName(after.where("word is not null").select("flush", "ref", "word", "n"))
    open_ = unknown.groupBy("flush", "ref", "word").agg(F.sum("n").alias("n")).join(words.select("word", "c").unionByName(ends), "word", "left")
    open_ = open_.select("flush", "ref", (F.col("n") * (F.log10(F.coalesce("c", F.lit(0)) + 0.1) - total_mass)).alias("term"))
    open_ = open_.unionByName(after.select("flush", "ref", "term")).groupBy("flush", "ref").agg(F.sum("term").alias("open_score"))
    sums = got.where("kind in (0, 3)").groupBy("flush").applyInArrow(_summed, "flush long, ref int, key long, mark int, n long, n_known long, base double, score double")
    # equal texts of several flushes have equal sums but for what was open
    sums = sums.join(open_, ["flush", "ref"], "left").groupBy("key", "mark").agg(*(F.first(x).alias(x) for x in ("n", "n_known", "base")), F.max(F.col("score") + F.coalesce("open_score", F.lit(0.0))).alias("score"))
    sums = materialize(sums, "text-scores")
    end = float(np.log10(n_train + 0.1)) - total_mass
    out = rows.select("id", "train", "key", "mark").join(sums, ["key", "mark"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    count = F.coalesce("n", F.lit(0))
    first = F.when(count > 0, -total_mass).otherwise(end)  # the first word's, or the lone end's
    return out.select(
        "id",
        F.col("train").alias("training"),
        (count + 1).alias("n_tokens"),
        (F.coalesce("n_known", F.lit(0)) + int(n_train > 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (zero(F.col("base")) - count * total_mass + end).alias("base_score"),
        (zero(F.col("score")) + first).alias("score"),
    )


def scores_report(docs: DataFrame) -> DataFrame:
    out = score_documents(docs, is_training(F.col("doc_id")))
    return out.select(F.col("id").alias("doc_id"), (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

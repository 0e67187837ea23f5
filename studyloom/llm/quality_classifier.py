"""Quality classifier: a linear support vector machine on naive Bayes features (NBSVM).

A text is the set of its word n-grams (one and two words, lower case) and of the n-grams of
its words' shapes (one to three: capitals, small letters, digits and marks in runs, and
whether a word repeats the one before), hashed into a fixed number of buckets. Spark counts
in how many labelled training documents of each class every bucket occurs, over all of
them. The log of the ratio of the two shares scales the indicators. A hinge-loss model is
then fitted by dual coordinate descent on at most FIT_ROWS labelled documents (a parameter;
those with the smallest hash of their id), its weights are drawn towards their mean size as
NBSVM does, and margins become probabilities by a sigmoid fitted on margins that models of
the other half gave.

Both counts are smoothed in proportion to the classes, so a bucket that training never met
weighs nothing. Indicators of a document are scaled to unit length.

Defined cases: null and empty texts have no n-grams, so they get the score that the
intercept gives. Labels other than 0 and 1, of unknown documents, or that contradict each
other for one id aren't learned from. With labels of one class only, or none, every score is
the smoothed share of label 1 (a half without labels). Repeated rows are scored each;
repeated training documents count each. An empty table gives an empty result; other columns
aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.llm import words as W

BUCKETS = 1 << 18
#: Documents that the support vectors are chosen from.
FIT_ROWS = 10_000
#: Smoothing of the counts, cost of a margin fault, share of the fitted weights, rounds of descent.
SMOOTHING, COST, OWN_SHARE, ROUNDS = 1.0, 1.0, 0.25, 20
THRESHOLD = 0.3
_KINDS = ((False, 1), (False, 2), (True, 1), (True, 2), (True, 3))

#: Classes of bytes in a shape: capitals, small letters and letters beyond ASCII, digits; marks stand for themselves.
_SHAPE = np.arange(256)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:], _SHAPE[48:58] = 65, 97, 97, 48


def shapes(block: W.Block, hashes: np.ndarray) -> np.ndarray:
    """A hash for each word's shape: its classes without repeats, and whether the word repeats the one before."""
    inside = np.zeros(len(block.data) + 1, np.int64)
    inside[block.start] += 1
    inside[block.end] -= 1
    inside = np.cumsum(inside[:-1]) > 0
    kind = _SHAPE[block.data]
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[block.start] = True
    new &= inside
    at = np.concatenate([[0], np.cumsum(new)])
    lo, hi = at[block.start], at[block.end]
    out = W.mix(W.span_hashes(W.byte_codes()[kind[new]], lo, hi) + (hi - lo).astype(np.uint64))
    again = np.zeros(len(out), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[block.first[:-1][block.n_words > 0]] = False
    return out + again.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def features(block: W.Block) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of a block's distinct n-grams, in order of documents."""
    plain = block.word_hashes(lower=True)
    of = {False: plain, True: shapes(block, plain)}
    found, n_docs = [], len(block.first) - 1
    for k, (shape, width) in enumerate(_KINDS):
        at = W.window_starts(block, width)
        doc = np.repeat(np.arange(n_docs), np.maximum(block.n_words - width + 1, 0))
        hashes = W.mix(W.span_hashes(of[shape], at, at + width) + np.uint64(k))
        found.append(doc * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64))
    keys = np.unique(np.concatenate(found))
    return keys // BUCKETS, keys % BUCKETS


def is_held_out(doc: Column) -> Column:
    return F.crc32(F.coalesce(doc.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def clean_labels(labels: DataFrame) -> DataFrame:
    """doc_id and quality of the documents whose labels agree, without the held-out ones."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    return known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").select("doc_id", F.col("quality").cast("int").alias("quality"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of a task's documents of each class a bucket occurs; bucket -1 counts the documents."""
    counts, docs = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
    for batch in batches:
        label = batch.column("quality").to_numpy(zero_copy_only=False)
        docs += np.bincount(label, minlength=2)
        for block in W.blocks(batch.column("text")):
            doc, bucket = features(block)
            counts += np.bincount(label[block.rows][doc] * BUCKETS + bucket, minlength=2 * BUCKETS).reshape(2, -1)
    at = np.flatnonzero(counts.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], at]), pa.int32()), *(pa.array(np.concatenate([[docs[c]], counts[c, at]])) for c in (0, 1))], names=["bucket", "bad", "good"])


def class_counts(documents: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents of each class, and those that hold each bucket, over all labelled training documents; BUCKETS rows at most."""
    # only documents that may be learned from are dealt out to meet their labels; those have no bound, so they are merged at every size
    known = documents.select("doc_id", "text").where(~is_held_out(F.col("doc_id"))).join(labels.hint("merge"), "doc_id").select("text", "quality")
    found = known.mapInArrow(_counted, "bucket int, bad long, good long").groupBy("bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toPandas()
    counts, docs = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
    bucket = found["bucket"].to_numpy()
    for c, name in enumerate(("bad", "good")):
        counts[c, bucket[bucket >= 0]] = found[name].to_numpy()[bucket >= 0]
        docs[c] = found[name].to_numpy()[bucket < 0].sum()
    return docs, counts


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """The log of each bucket's share in good documents over its share in bad ones."""
    total = counts.sum(1, keepdims=True).astype(float)
    share = (counts + 2 * SMOOTHING * total / total.sum()) / total
    return np.log(share[1] / share[0])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in W.blocks(batch.column("text")):
            doc, bucket = features(block)
            bounds = np.searchsorted(doc, np.arange(len(block.first))).astype(np.int32)
            rows = batch.slice(block.rows.start, block.rows.stop - block.rows.start)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("quality"), pa.ListArray.from_arrays(bounds, pa.array(bucket, pa.int32()))], names=["doc_id", "quality", "buckets"])


def sample(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets and labels of the documents to fit on: those of at most `rows` labels."""
    drawn = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # as many rows as the parameter says, so it may be sent to every task
    schema = f"doc_id {dict(documents.dtypes)['doc_id']}, quality int, buckets array<int>"
    met = documents.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("doc_id", "quality", "text").mapInArrow(_buckets, schema)
    found = met.orderBy(F.xxhash64("doc_id"), "doc_id", "buckets").limit(rows).toArrow()
    return [x.values.to_numpy() for x in found.column("buckets")], found.column("quality").to_numpy()


def dual_descent(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: float = COST, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Weights of the hinge-loss model over sparse rows (place, value); the last is the intercept.

    Each step solves one row's dual variable exactly; rows come in a new random order each
    round, until the projected gradients are small or the rounds are over.
    """
    w, alpha, rng = np.zeros(size + 1), np.zeros(len(x)), np.random.default_rng(seed)
    square = np.array([v @ v + 1 for _, v in x])
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(x)).tolist():
            at, value = x[i]
            slope = y[i] * (w[at] @ value + w[-1]) - 1
            if (alpha[i] == 0 and slope >= 0) or (alpha[i] == cost and slope <= 0):
                continue
            worst = max(worst, abs(slope))
            new = min(max(alpha[i] - slope / square[i], 0.0), cost)
            step = (new - alpha[i]) * y[i]
            alpha[i] = new
            w[at] += step * value
            w[-1] += step
        if worst < 1e-3:
            break
    return w


def sigmoid_of(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """a and b of 1 / (1 + exp(-(a * margin + b))), fitted by Newton's steps on smoothed labels (Platt)."""
    n = np.array([(good == 0).sum(), (good == 1).sum()])
    target = np.where(good == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    z = np.stack([margin, np.ones(len(margin))], 1)
    loss = lambda t: float((np.logaddexp(0, z @ t) - target * (z @ t)).sum())
    t = np.array([0.0, np.log((n[1] + 1) / (n[0] + 1))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ t))
        grad = z.T @ (p - target)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-9 * np.eye(2), grad)
        size = 1.0
        while size > 1e-6 and loss(t - size * step) > loss(t):
            size /= 2
        t = t - size * step
        if np.abs(grad).max() < 1e-6 * len(z):
            break
    return float(t[0]), float(t[1])


@dataclass
class Model:
    """Weights of the buckets, for indicators of unit length, the intercept, and the sigmoid."""

    weights: np.ndarray
    intercept: float
    slope: float
    shift: float

    def scores(self, doc: np.ndarray, bucket: np.ndarray, n_docs: int) -> np.ndarray:
        size = np.maximum(np.bincount(doc, minlength=n_docs), 1)
        margin = np.bincount(doc, self.weights[bucket], n_docs) / np.sqrt(size) + self.intercept
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))


def _weights(buckets: list[np.ndarray], good: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, float]:
    rows = [(b, ratios[b] / np.sqrt(max(len(b), 1))) for b in buckets]
    w = dual_descent(rows, np.where(good == 1, 1.0, -1.0), BUCKETS)
    used = w[:-1][w[:-1] != 0]
    even = np.abs(used).mean() if len(used) else 0.0
    return ((1 - OWN_SHARE) * even + OWN_SHARE * w[:-1]) * ratios, float(w[-1])


def train(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """The model of documents (doc_id, text) and labels (doc_id, quality)."""
    known = clean_labels(labels)
    docs, counts = class_counts(documents, known)
    flat = Model(np.zeros(BUCKETS), 0.0, 0.0, float(np.log((docs[1] + 1) / (docs[0] + 1))))
    if not docs.all():
        return flat
    ratios = log_ratios(counts) if counts.sum(1).all() else np.zeros(BUCKETS)
    buckets, good = sample(documents, known, rows)
    if len(set(good.tolist())) < 2:
        return flat
    whole = Model(*_weights(buckets, good, ratios), 1.0, 0.0)
    margin, half = np.zeros(len(good)), np.arange(len(good)) % 2
    for side in (0, 1):
        mine = np.flatnonzero(half != side)
        if len(set(good[mine].tolist())) < 2:
            mine = np.arange(len(good))
        w, intercept = _weights([buckets[i] for i in mine], good[mine], ratios)
        for i in np.flatnonzero(half == side):
            margin[i] = w[buckets[i]].sum() / np.sqrt(max(len(buckets[i]), 1)) + intercept
    whole.slope, whole.shift = sigmoid_of(margin, good)
    return whole


def _scored(model: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in W.blocks(batch.column("text")):
                scores = model.value.scores(*features(block), len(block.first) - 1)
                ids = batch.column("doc_id").slice(block.rows.start, block.rows.stop - block.rows.start)
                yield pa.RecordBatch.from_arrays([ids, pa.array(scores)], names=["doc_id", "score"])

    return run


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    d = documents.select("doc_id", "text")
    return d.mapInArrow(_scored(sent), f"doc_id {dict(d.dtypes)['doc_id']}, score double")


def classifier_report(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score(documents, train(documents, labels, rows))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))

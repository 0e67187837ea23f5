"""The quality classifier: counts, optimum, accuracy on held-out rows, and odd tables."""

import re
import zlib
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
import pytest

from studyloom.llm import quality_classifier as Q
from studyloom.llm import words as W

DOCS = "doc_id long, text string"
LABELS = "doc_id long, quality int, toxic int"


def shape(word):
    kind = lambda c: "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else c if c < "\x80" and not "a" <= c <= "z" else "a"
    return "".join(k for k, _ in groupby(map(kind, word)))


def grams(text):
    """The distinct n-grams of a text, told apart by their own values."""
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    plain = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    forms = [(shape(w), i > 0 and words[i] == words[i - 1]) for i, w in enumerate(plain)]
    out = set()
    for kind, seq, widths in (("w", words, (1, 2)), ("s", forms, (1, 2, 3))):
        out |= {(kind, *seq[i : i + n]) for n in widths for i in range(len(seq) - n + 1)}
    return out


TEXTS = [None, "", " \n", "one", "One two TWO two Two! 3rd 44 A.b é É", "the the the cat", "x " * 500, "#### $$$ a1b2", *(" ".join(f"w{i * j % 13}" for i in range(40)) for j in range(1, 9))]


def test_features():
    """As many distinct buckets as n-grams, equal ones for equal n-grams, alone or in a block."""
    (block,) = W.blocks(pa.array(TEXTS))
    doc, bucket = Q.features(block)
    name = {}
    for i, text in enumerate(TEXTS):
        mine = set(bucket[doc == i].tolist())
        assert len(mine) == len(grams(text))
        (alone,) = W.blocks(pa.array([text]))
        assert set(Q.features(alone)[1].tolist()) == mine
        for j, other in enumerate(TEXTS[:i]):
            assert len(mine & set(bucket[doc == j].tolist())) == len(grams(text) & grams(other))
        name[i] = mine


def test_counts(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)]
    labels = [(i, i % 2, 0) for i in range(len(rows))] + [(0, 1, 0), (5, None, 0), (7, 3, 0), (None, 1, 0), (9999, 1, 0)]
    docs, counts = Q.class_counts(spark.createDataFrame(rows, DOCS).repartition(3), Q.clean_labels(spark.createDataFrame(labels, LABELS)))
    known = {i: i % 2 for i in range(len(rows)) if zlib.crc32(str(i).encode()) % 5}
    known.pop(0, None)  # has both labels
    known.pop(7, None)
    known[7] = 1
    known = {i: v for i, v in known.items() if zlib.crc32(str(i).encode()) % 5}
    assert docs.tolist() == [sum(v == c for v in known.values()) for c in (0, 1)]
    for c in (0, 1):
        plain = Counter(g for i, v in known.items() if v == c for g in grams(rows[i][1]))
        assert sorted(counts[c][counts[c] > 0].tolist()) == sorted(plain.values())


def test_descent():
    """No weights have a lower loss than those of the descent: the gap to the dual is small."""
    rng = np.random.default_rng(4)
    x = [(np.sort(rng.choice(50, 8, replace=False)), rng.standard_normal(8)) for _ in range(200)]
    hidden = rng.standard_normal(50)
    y = np.array([1.0 if v @ hidden[at] + rng.standard_normal() > 0 else -1.0 for at, v in x])
    w = Q.dual_descent(x, y, 50, rounds=3000)
    loss = lambda w: w @ w / 2 + sum(max(0.0, 1 - t * (w[at] @ v + w[-1])) for (at, v), t in zip(x, y))
    least = loss(w)
    for _ in range(200):
        assert loss(w + 0.01 * rng.standard_normal(51)) > least
    plain, step = np.zeros(51), 0.0
    for k in range(4000):
        grad = plain.copy()
        for (at, v), t in zip(x, y):
            if t * (plain[at] @ v + plain[-1]) < 1:
                grad[at] -= t * v
                grad[-1] -= t
        step = 1 / (k + 50)
        plain = plain - step * grad
    assert least <= loss(plain) + 1e-3


def test_sigmoid():
    rng = np.random.default_rng(6)
    margin = rng.standard_normal(4000) * 3
    good = (rng.random(4000) < 1 / (1 + np.exp(-(1.5 * margin + 0.7)))).astype(int)
    a, b = Q.sigmoid_of(margin, good)
    assert abs(a - 1.5) < 0.15 and abs(b - 0.7) < 0.15


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    out = Q.classifier_report(docs, labels)
    assert [c for c, _ in out.dtypes] == ["doc_id", "held_out", "score", "predicted"] and out.count() == docs.count()
    assert [t for _, t in out.dtypes] == ["bigint", "boolean", "double", "int"]
    rows = [r for r in out.join(labels, "doc_id").collect() if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out.collect())
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)
    assert all(r["predicted"] == 1 for r in rows if r["quality"] == 1)


@pytest.mark.parametrize("labels, share", [([], 0.5), ([(i, 1, 0) for i in range(1, 8)], None), ([(None, 0, 0), (3, None, None), (4, 7, 0)], 0.5)])
def test_one_class_or_none(spark, labels, share):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], DOCS)
    scores = {r["score"] for r in Q.classifier_report(docs, spark.createDataFrame(labels, LABELS)).collect()}
    assert len(scores) == 1 and (share is None or abs(scores.pop() - share) < 1e-12)


def test_odd_tables(spark):
    rows = [(i % 30, (TEXTS[i % len(TEXTS)] or "") + (" ### $$$" * 9 if i % 2 else " fine words")) for i in range(200)] + [(None, None), (5, "z " * 60000), (6, "")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], DOCS + ", score int, bucket int")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(30)] * 2, LABELS)
    out = Q.classifier_report(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    assert Q.classifier_report(docs.limit(0), labels).collect() == []
    fit = Q.sample(docs.select("doc_id", "text"), Q.clean_labels(labels), 10)
    assert len(fit[0]) == len(fit[1]) == 10

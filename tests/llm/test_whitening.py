"""Whitening against whole numbers and numpy's own eigenvalues."""

import math

import numpy as np
import pytest

from studyloom.llm import embedding_whitening as EW

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(rows):
    """{(id, component): ...} by plain whole numbers and a dense solver."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in good]
    n, s = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * c - t) ** 2 for c, t in zip(v, s)) for v in x]
    d = np.array([[(n * c - t) / n for c, t in zip(v, s)] for v in x])
    e, u = np.linalg.eigh(d.T @ d / n)
    return good, n, deviation, d, e[::-1], u[:, ::-1]


def check(df, rows, k):
    good, n, deviation, d, e, u = expected(rows)
    out = df.collect()
    assert len(out) == len(good) * k and {r["component"] for r in out} == set(range(1, k + 1))
    at = {i: j for j, (i, _) in enumerate(good)}
    w = np.zeros((len(good), k))
    for r in out:
        j = at[r["vec_id"]]
        w[j, r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["deviation"] == deviation[j] and r["identity_error"] < 1e-9
        assert abs(r["explained"] * e.sum() / e[r["component"] - 1] - 1) < 1e-10
    plain = d @ u[:, :k] / np.sqrt(e[:k])
    assert np.abs(w * np.sign((w * plain).sum(0)) - plain).max() < 1e-6


def test_given_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    check(EW.whitened(df), [(r["vec_id"], r["embedding"]) for r in df.collect()], 32)


def test_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in rng.standard_normal(5) * [9, 4, 4, 1, 0]]) for i in range(90)]
    rows += [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [float("nan")] * 5), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in [*rows, (104, [1.0, 2.0]), (105, [])]], SCHEMA).repartition(3)
    check(EW.whitened(df.withColumn("n", df.label).withColumn("component", df.label)), rows, 4)


def test_huge_entries(spark):
    rows = [(i, [float((i * 7919 + j * 104729) % 1000 - 500) * 1e6 for j in range(3)]) for i in range(40)]
    out = EW.whitened(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)).collect()
    _, _, deviation, _, _, _ = expected(rows)
    assert all(r["deviation"] == (deviation[r["vec_id"]] if deviation[r["vec_id"]] < 1 << 63 else None) for r in out) and len(out) == 120


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(i, [3.0, 4.0]) for i in range(5)], [(1, None)], [(1, [])]])
def test_nothing_to_whiten(spark, rows):
    assert EW.whitened(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)).collect() == []


def test_contours():
    """Flat, falling, tied and rank-poor spectra; inertia counts against the eigenvalues."""
    rng = np.random.default_rng(1)
    for n, e in [(64, np.linspace(1, 1.5, 64)), (64, 0.5 ** np.arange(64)), (40, np.repeat([5.0, 3.0, 3.0, 1.0], 10)), (48, np.r_[np.ones(40), np.zeros(8)]), (50, np.r_[1e6, np.full(49, 1e-3)]), (3, np.array([2.0, 1.0, 0.0])), (1, np.ones(1))]:
        q, _ = np.linalg.qr(rng.standard_normal((n, n)))
        v = (q * e) @ q.T
        v = (v + v.T) / 2
        values, x = EW.components(v)
        true = np.sort(e)[::-1]
        k = min(32, int((true > EW.NO_VARIANCE * true.sum()).sum()))
        assert len(values) == k and np.abs(values - true[:k]).max() < 1e-12 * true[0] * n
        assert np.abs(x.T @ x - np.eye(k)).max() < 1e-12 and np.abs(v @ x - x * values).max() < 1e-12 * true[0] * n
        for at in (0.7, 2.5, 1.2):
            assert EW.negatives(v - at * np.eye(n)) == (true < at).sum()

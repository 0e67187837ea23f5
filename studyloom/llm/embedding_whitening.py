"""Embedding whitening by FEAST: components from contour integrals of the covariance.

Spark sums the vectors, as whole numbers, and then their products about the rounded mean;
what reaches the driver are sums for each dimension and pair of dimensions, whatever the
number of rows. There an interval around the wanted eigenvalues is cut into parts by
inertia counts. In each part a few random vectors are multiplied by the integral of the
resolvent around it (complex shifted solves at the nodes of a half circle), which leaves
its eigenvectors and little else; Rayleigh-Ritz takes them out, and the steps repeat until
residuals are at rounding. A part is accepted only if it has as many eigenvalues as the
inertia counts at its ends say, so none is missed. The rows are then projected in tasks.

Defined cases: vectors that are null or hold null, NaN or infinite entries go; so do those
whose length isn't the most frequent one (of equally frequent ones the longest), which
have no place in one covariance; entries beyond 2^45 / 64 in size count as that. No
vectors, one, equal ones, or directions without variance (below 1e-12 of the whole) have
no components, so they give no rows. Repeated rows and ids count as often as they occur.
deviation is null where a long can't hold it. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, MOST = 64, 1_000_000, 1 << 45
COMPONENTS = 32
#: Nodes on the half circle, eigenvalues in one interval, rounds of an interval.
NODES, PART, ROUNDS = 12, 8, 40
#: Shares of the largest variance: what counts as none, and the residual that ends an interval.
NO_VARIANCE, RESIDUAL = 1e-12, 2e-14


def negatives(a: np.ndarray) -> int:
    """How many eigenvalues of a symmetric matrix are negative, from its LDL factors (Bunch and Parlett's pivoting)."""
    a, found = a.copy(), 0
    while len(a):
        n = len(a)
        diagonal = np.abs(np.diag(a))
        d = int(np.argmax(diagonal))
        off = np.abs(a - np.diag(np.diag(a)))
        i, j = np.unravel_index(int(np.argmax(off)), off.shape)
        if diagonal[d] == 0 and off[i, j] == 0:
            break
        single = n == 1 or diagonal[d] >= (1 + 17**0.5) / 8 * off[i, j]
        pivot = [d] if single else [int(i), int(j)]
        rest = np.setdiff1d(np.arange(n), pivot)
        block, side = a[np.ix_(pivot, pivot)], a[np.ix_(rest, pivot)]
        # a block of two that is taken has one eigenvalue of each sign
        found += int(block[0, 0] < 0) if single else 1
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
        a = (a + a.T) / 2
    return found


def _quiet(v: np.ndarray, lo: float, hi: float) -> tuple[float, int]:
    """A place between lo and hi with no eigenvalue close to it, and how many lie above."""
    n, eye = len(v), np.eye(len(v))
    for gap in (0.05, 0.01, 1e-3, 1e-5):
        for share in (0.5, 0.4, 0.6, 0.3, 0.7):
            at, d = lo + share * (hi - lo), gap * (hi - lo)
            above = n - negatives(v - (at + d) * eye)
            if above == n - negatives(v - (at - d) * eye):
                return at, above
    at = (lo + hi) / 2
    return at, n - negatives(v - at * eye)


def intervals(v: np.ndarray, most: int, floor: float) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues within), which together hold the `most` largest eigenvalues above floor, or more where they tie."""
    top = float(np.abs(v).sum(1).max()) * 1.001
    wanted = min(most, len(v) - negatives(v - floor * np.eye(len(v))))
    out, open_ = [], [(floor, top, len(v) - negatives(v - floor * np.eye(len(v))), 0)]
    while open_:
        lo, hi, n, above = open_.pop()
        if not n or above >= wanted:
            continue
        if (n <= PART and above + n <= wanted) or hi - lo <= 1e-11 * top:
            out.append((lo, hi, n))
            continue
        mid, over = _quiet(v, lo, hi)
        over -= above
        open_ += [(lo, mid, n - over, above + over), (mid, hi, over, above)]
    return out


def feast(v: np.ndarray, lo: float, hi: float, n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The n eigenvalues of v between lo and hi, with unit eigenvectors as columns."""
    size = len(v)
    scale = np.abs(v).sum(1).max()
    rng = np.random.default_rng(seed)
    width = min(size, n + max(6, n // 2))
    y = rng.standard_normal((size, width))
    centre, radius = (lo + hi) / 2, (hi - lo) / 2
    turns = np.exp(1j * np.pi * (np.arange(NODES) + 0.5) / NODES)
    for _ in range(ROUNDS):
        q = sum((radius * t * np.linalg.solve((centre + radius * t) * np.eye(size) - v, y.astype(complex))).real for t in turns) / NODES
        q, _ = np.linalg.qr(q)
        values, u = np.linalg.eigh(q.T @ v @ q)
        y = q @ u
        inside = (values > lo) & (values <= hi)
        residual = np.linalg.norm(v @ y[:, inside] - y[:, inside] * values[inside], axis=0)
        if inside.sum() == n and residual.max(initial=0) <= RESIDUAL * scale * size**0.5:
            return values[inside], y[:, inside]
    raise ArithmeticError(f"{inside.sum()} eigenvalues found where inertia counts {n}")


def components(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a covariance, falling, and their unit eigenvectors as columns."""
    if not len(v) or not np.trace(v) > 0:
        return np.zeros(0), np.zeros((len(v), 0))
    found = [feast(v, *part) for part in intervals(v, most, NO_VARIANCE * float(np.trace(v)))]
    x, _ = np.linalg.qr(np.concatenate([y for _, y in found], axis=1))
    values, u = np.linalg.eigh(x.T @ v @ x)
    order = np.argsort(-values)[:most]
    x = (x @ u)[:, order]
    x *= np.sign(x[np.abs(x).argmax(0), np.arange(x.shape[1])])
    return values[order], x


@dataclass
class Whitening:
    """What the tasks need: n, the rounded mean, n * (mean - rounded mean), components and their variances, the whole variance."""

    n: int
    centre: np.ndarray
    rest: list[int]
    values: np.ndarray
    vectors: np.ndarray
    total: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre).astype(float) - np.array([float(r) / self.n for r in self.rest])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        d = x - self.centre
        if (self.n * int(np.abs(d).max(initial=0)) + max(map(abs, self.rest))) ** 2 * len(self.rest) < 1 << 63:
            return ((self.n * d - np.array(self.rest)) ** 2).sum(1).tolist()
        found = ((self.n * d.astype(object) - np.array(self.rest, object)) ** 2).sum(1).tolist()
        return [x if x < 1 << 63 else None for x in found]


def _numbers(column: pa.Array, size: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
    return np.clip(np.floor(SCALE * flat), -MOST, MOST).astype(np.int64) + SHIFT


def usable(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """(key, v) of the vectors that count, and their length."""
    whole = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    e = embeddings.where(F.col(vector).isNotNull() & whole).select(F.col(key).alias("key"), F.col(vector).alias("v"))
    sizes = e.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    size = sizes[0]["size"] if sizes else 0
    return e.where(F.size("v") == size), size


def _sums(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _numbers(batch.column("v"), size)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(np.full(size, len(x))), pa.array(x.sum(0))], names=["i", "n", "s"])

    return run


def _products(size: int, of: Callable[[pa.Array], np.ndarray]) -> Callable:
    """The sums of a task's rows (j = -1) and of the products of their entries i <= j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            d = of(batch.column("v"))
            total += d.T @ d
            sums += d.sum(0)
        i, j = np.triu_indices(size)
        i, j, s = np.concatenate([np.arange(size), i]), np.concatenate([np.full(size, -1), j]), np.concatenate([sums, total[i, j]])
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(s)], names=["i", "j", "s"])

    return run


def _moments(rows: DataFrame, size: int, of: Callable[[pa.Array], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums, and the symmetric matrix of product sums; size * size numbers."""
    found = rows.select("v").mapInArrow(_products(size, of), "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    sums, total = np.zeros(size), np.zeros((size, size))
    i, j, s = found["i"].to_numpy(), found["j"].to_numpy(), found["s"].to_numpy()
    sums[i[j < 0]] = s[j < 0]
    total[i[j >= 0], j[j >= 0]] = s[j >= 0]
    return sums, np.triu(total) + np.triu(total, 1).T


def fit(rows: DataFrame, size: int, most: int = COMPONENTS) -> Whitening | None:
    """The whitening of usable rows; None if there is no row."""
    if not size:
        return None
    exact = F.sum(F.col("s").cast("decimal(38,0)"))
    found = rows.select("v").mapInArrow(_sums(size), "i long, n long, s long").groupBy("i").agg(F.sum("n").alias("n"), exact.alias("s")).orderBy("i").collect()
    n, s = int(found[0]["n"]), [int(Decimal(r["s"])) for r in found]
    centre = [(2 * t + n) // (2 * n) for t in s]
    rest = [t - n * c for t, c in zip(s, centre)]
    middle = np.array(centre, np.int64)
    # whole numbers: these sums are exact below 2^53, in any order
    _, products = _moments(rows, size, lambda v: (_numbers(v, size) - middle).astype(float))
    off = np.array([float(r) / n for r in rest])
    covariance = products / n - np.outer(off, off)
    values, vectors = components(covariance, most)
    return Whitening(n, middle, rest, values, vectors, float(np.trace(covariance)))


def identity_error(rows: DataFrame, size: int, model: Whitening) -> float:
    """The largest entry of the whitened vectors' covariance less the identity."""
    k = len(model.values)
    sums, products = _moments(rows, k, lambda v: model.whiten(_numbers(v, size)))
    mean = sums / model.n
    return float(np.abs(products / model.n - np.outer(mean, mean) - np.eye(k)).max(initial=0))


def _projected(size: int, model: Whitening, error: float) -> Callable:
    k = len(model.values)
    share = model.values / model.total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _numbers(batch.column("v"), size)
            each = pa.array(np.repeat(np.arange(len(x)), k))
            deviation = pa.array(model.deviations(x), pa.int64())
            columns = [np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), np.full(len(x) * k, model.n), model.whiten(x).ravel(), np.tile(share, len(x)), np.full(len(x) * k, error)]
            component, n, whitened, explained, worst = (pa.array(c) for c in columns)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(each), component, n, deviation.take(each), whitened, explained, worst], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whitened(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: the whitened coordinate and what the component explains."""
    rows, size = usable(embeddings, key, vector)
    schema = f"vec_id {dict(embeddings.dtypes)[key]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(rows, size, most)
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema)
    return rows.mapInArrow(_projected(size, model, identity_error(rows, size, model)), schema)

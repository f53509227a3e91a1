"""Whitening of embeddings by QDWH spectral divide and conquer.

Vectors become whole numbers x = floor(64 c) + 1,000,000. Each different x counts once for
the fit. Sums and second moments are sums of whole numbers, kept exact (decimals beyond what
a task can hold in 53 bits), of x less the rounded mean of its dimension, so nothing cancels
and reruns agree to the last bit. They are made per task, summed per entry by Spark, and only
the d x d covariance comes to the driver.

There the covariance is split: the orthogonal polar factor U of A - s I, found by the
dynamically weighted Halley iteration through QR factorisations, gives the projector
(I + U) / 2 onto the eigenvectors above the shift s; its range and the range of its complement
are orthonormal bases in which A falls into two blocks, and each is split in turn until blocks
are numbers or multiples of the identity (Nakatsukasa and Higham, "Stable and efficient
spectral divide and conquer algorithms", 2013). The components, scaled by the roots of their
eigenvalues, are broadcast (16 numbers per dimension) and applied in one pass.

Defined results: vectors that are null, hold null or non-finite entries or such of 2 ** 42 and
more in size, and vectors not of the most frequent length (the longest of equally frequent
ones) take no part; zero vectors and null ids do; equal vectors all get rows and count once.
Components whose eigenvalue is not above the rounding error of the largest one cannot be
scaled and have no rows, so one different vector, or none, gives an empty result. ``deviation`` is
null where it exceeds a long. Other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .vectors import matrix

GRID, SHIFT = 64, 1_000_000
#: Entries from this size on are not taken; products of grid values then fit a decimal.
LARGEST = float(1 << 42)
#: Components returned.
COMPONENTS = 16
EPS = float(np.finfo(np.float64).eps)
#: Rows that are multiplied at once.
ROWS = 4096


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix without singular values near 0, by QR-based dynamically weighted Halley steps."""
    n = len(a)
    size = float(np.linalg.norm(a))
    x = a / size
    low = 1.0 / (float(np.linalg.norm(np.linalg.inv(x))) if n else 1.0)  # a lower bound of the least singular value
    low = min(1.0, max(low, EPS))
    for _ in range(30):
        d = np.cbrt(4.0 * (1.0 - low * low) / low**4)
        p = np.sqrt(1.0 + d) + 0.5 * np.sqrt(8.0 - 4.0 * d + 8.0 * (2.0 - low * low) / (low * low * np.sqrt(1.0 + d)))
        q = (p - 1.0) ** 2 / 4.0
        r = p + q - 1.0
        top, _ = np.linalg.qr(np.vstack([np.sqrt(r) * x, np.eye(n)]))
        new = (q / r) * x + (1.0 / np.sqrt(r)) * (p - q / r) * (top[:n] @ top[n:].T)
        moved, x = float(np.linalg.norm(new - x)), (new + new.T) / 2.0
        low = min(1.0, low * (p + q * low * low) / (1.0 + r * low * low))
        if moved < np.cbrt(EPS) and 1.0 - low < 10 * EPS:  # the step converges with the third power
            break
    return x


def ranges(c: np.ndarray, k: int) -> np.ndarray:
    """An orthogonal matrix whose first k columns span the range of the projector c of rank k, and the others that of I - c."""
    n = len(c)
    order = np.argsort(-np.diag(c), kind="stable")
    start = c[:, order]
    q = np.linalg.qr(np.hstack([start[:, :k], np.eye(n)[:, order[k:]]]))[0]
    rng = np.random.default_rng(n)
    for attempt in range(4):  # a subspace step or two is enough unless the start was badly placed
        v1 = np.linalg.qr(c @ q[:, :k])[0]
        v2 = q[:, k:] - c @ q[:, k:]
        v2 = np.linalg.qr(v2 - v1 @ (v1.T @ v2))[0]
        q = np.hstack([v1, v2])
        bad = np.linalg.norm(q.T @ q - np.eye(n)) > 1e-10 or np.linalg.norm(c @ v2) > 1e-8 * n
        if not bad and attempt:
            return q
        if bad:
            q = np.linalg.qr(np.hstack([c @ rng.standard_normal((n, k)), (np.eye(n) - c) @ rng.standard_normal((n, n - k))]))[0]
    return q


def divide(a: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and orthonormal eigenvectors (columns) of a symmetric matrix; blocks within ``floor`` of a multiple of the identity end."""
    n = len(a)
    if n <= 1 or np.linalg.norm(a - np.eye(n) * (np.trace(a) / n)) <= floor:
        return np.diag(a).copy(), np.eye(n)
    # The shift must part the spectrum and stay clear of eigenvalues; the diagonal's median and means lie within it.
    diag = np.sort(np.diag(a))
    widest = int(np.argmax(np.diff(diag)))
    r = np.random.default_rng(n).standard_normal((n, 2))
    rayleigh = [float(v @ a @ v / (v @ v)) for v in r.T]
    spread = np.linalg.norm(a - np.eye(n) * (np.trace(a) / n)) / np.sqrt(n)
    for shift in (float(np.median(diag)) + 1e-3 * spread, float(diag.mean()), float(diag[widest] + diag[widest + 1]) / 2.0, *rayleigh, *(float(diag.mean()) + spread * f for f in (0.1, -0.1, 0.3, -0.3))):
        moved = a - np.eye(n) * shift
        try:
            if np.linalg.cond(moved, 1) > 0.01 / EPS:
                continue
        except np.linalg.LinAlgError:
            continue
        c = (np.eye(n) + polar(moved)) / 2.0
        k = round(float(np.trace(c)))
        if not 0 < k < n:
            continue
        q = ranges(c, k)
        b = q.T @ a @ q
        if np.linalg.norm(b[:k, k:]) <= max(floor, 1e3 * n * EPS * np.linalg.norm(a)):
            break
    else:
        raise ArithmeticError("no shift parts the spectrum")
    halves = [divide((b[x, x] + b[x, x].T) / 2.0, floor) for x in (slice(0, k), slice(k, n))]
    vectors = np.hstack([q[:, :k] @ halves[0][1], q[:, k:] @ halves[1][1]])
    return np.concatenate([halves[0][0], halves[1][0]]), vectors


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors (columns) of a covariance, with what divide and conquer left off the diagonal removed to first order."""
    size = float(np.abs(v).max()) if v.size else 0.0
    if size == 0.0:
        return np.zeros(len(v)), np.eye(len(v))
    a = v / size
    _, q = divide(a, len(a) * EPS * float(np.linalg.norm(a)))
    for _ in range(2):
        b = q.T @ a @ q
        e = np.diag(b)
        gap = e[None, :] - e[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            turn = np.where(np.abs(gap) > 1e3 * np.abs(b), b / gap, 0.0)
        np.fill_diagonal(turn, 0.0)
        q = np.linalg.qr(q @ (np.eye(len(a)) + turn))[0]
    e = np.einsum("ik,ij,jk->k", q, a, q)
    order = np.argsort(-e, kind="stable")
    return e[order] * size, q[:, order]


def on_grid(vectors: DataFrame) -> DataFrame:
    """``(vec_id, x)``: the usable vectors as whole numbers."""
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < LARGEST))
    x = vectors.where(F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))
    top = x.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    x = x.where(F.size("embedding") == (top["d"] if top else 0))
    return x.select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * GRID) + SHIFT).alias("x"))


def whole(column: pa.Array) -> np.ndarray:
    """A list column of longs as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def products(y: np.ndarray) -> list[list[int]]:
    """Exact sums of the products of columns of whole numbers."""
    most = int(np.abs(y).max(initial=0))
    if most * most * len(y) < 1 << 53:
        return (y.astype(np.float64).T @ y.astype(np.float64)).astype(np.int64).tolist()
    exact = y.astype(object)
    return (exact.T @ exact).tolist()


def summed(rows: DataFrame, d: int, make: object, kind: str) -> np.ndarray:
    """Sums of the d x d tables that ``make`` builds from each batch of rows; a task sends one table per ``ROWS`` rows at most."""

    def run(batches):  # noqa: ANN001, ANN202
        total = None
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = np.array(make(b.column(0).slice(lo, ROWS)), dtype=object if kind.startswith("decimal") else np.float64)
                total = part if total is None else total + part
        if total is not None:
            values = [[str(c) for c in r] for r in total] if kind.startswith("decimal") else total.tolist()
            yield pa.record_batch([pa.array(range(len(values)), pa.int32()), pa.array(values)], names=["i", "row"])

    sent = "string" if kind.startswith("decimal") else kind
    each = rows.mapInArrow(run, f"i int, row array<{sent}>").select("i", F.posexplode("row").alias("j", "value"))
    table_ = np.zeros((d, d), dtype=object if sent == "string" else np.float64)
    for r in each.groupBy("i", "j").agg(F.sum(F.col("value").cast(kind)).alias("value")).collect():  # d * d entries
        table_[r["i"], r["j"]] = int(r["value"]) if sent == "string" else r["value"]
    return table_


@dataclass
class Whitening:
    """A fitted transform: ``mean_whole + rest / n`` is the mean, ``basis`` holds the scaled components as columns."""

    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    trace: float
    basis: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows of grid vectors; the mean is taken off in two steps, so that no digit is lost."""
        whole_ = np.array([round(s / self.n) if abs(s) < 1 << 52 else (2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)
        rest = np.array([(s - self.n * int(w)) / self.n for s, w in zip(self.sums, whole_)])
        return ((x - whole_).astype(np.float64) - rest) @ self.basis

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums over the dimensions of (n x - S) ** 2; None beyond a long."""
        s = np.array(self.sums, dtype=object)
        top = max((abs(self.n * int(v) - int(c)) for col, c in ((x.max(axis=0), s), (x.min(axis=0), s)) for v, c in zip(col, s)), default=0) if len(x) else 0
        if top * top * max(1, x.shape[1]) < 1 << 62 and all(abs(int(v)) < 1 << 62 for v in s):
            y = self.n * x - np.array(self.sums, np.int64)
            return (y * y).sum(axis=1).tolist()
        y = self.n * x.astype(object) - s
        return [v if v < 1 << 63 else None for v in (y * y).sum(axis=1).tolist()]


def fit(fit_list: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The transform for different vectors ``fit_list(x)``; None if there are none."""
    d = fit_list.select(F.size("x").alias("d")).first()
    if d is None or d["d"] <= 0:
        return None
    d = d["d"]
    got = fit_list.agg(F.count("*"), *[F.sum(F.get("x", F.lit(k)).cast("decimal(38,0)")) for k in range(d)]).first()
    n, sums = got[0], [int(s) for s in got[1:]]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    c = np.array(centre, np.int64)
    second = summed(fit_list, d, lambda col: products(whole(col) - c), "decimal(38,0)")
    rest = [s - n * m for s, m in zip(sums, centre)]
    # (n * sum(y_i y_j) - r_i r_j) / n**2 from whole numbers, rounded once.
    v = np.array([[(n * second[i][j] - rest[i] * rest[j]) / (n * n) for j in range(d)] for i in range(d)])
    values, vectors = eigen(v)
    keep = [k for k in range(min(components, d)) if values[k] > d * EPS * max(values[0], 0.0)]
    return Whitening(n, sums, values[keep], float(sum(np.diag(v))), vectors[:, keep] / np.sqrt(values[keep]))


def identity_error(fit_list: DataFrame, made: Whitening) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity, measured on the data."""
    k = made.basis.shape[1]

    def moments(col: pa.Array) -> np.ndarray:
        w = made.apply(whole(col))
        w = np.hstack([w, np.ones((len(w), 1))])
        return w.T @ w

    total = summed(fit_list, k + 1, moments, "double")
    mean = total[k, :k] / made.n
    return float(np.abs(total[:k, :k] / made.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(rows: DataFrame, made: Whitening) -> DataFrame:
    """``(vec_id, deviation, whitened array<double>)`` of ``rows(vec_id, x)``."""
    known = rows.sparkSession.sparkContext.broadcast(made)

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                x = whole(part.column(1))
                yield pa.record_batch([part.column(0), pa.array(known.value.deviations(x), pa.int64()), pa.array(known.value.apply(x).tolist(), pa.list_(pa.float64()))], names=["vec_id", "deviation", "whitened"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, deviation bigint, whitened array<double>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: whitened components of every usable vector."""
    rows = cut(on_grid(table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long"), "embedding")))
    different = cut(rows.select("x").distinct())
    made = fit(different)
    if made is None or not len(made.values):
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(different, made)
    share = F.array(*[F.lit(float(e / made.trace)) for e in made.values])
    x = whiten(rows, made).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return x.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(made.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))

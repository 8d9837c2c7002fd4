"""Embedding whitening by a one-sided Jacobi SVD of what TSQR leaves of the centred rows.

Entries become integers, so that the sums S of all dimensions are exact, and a
row is centred as (n*x - S) / n, rounded once. Each task keeps one triangle R
of the rows that it has seen (QR of R on top of the next block); triangles are
merged FAN at a time until one is left, of d x d numbers whatever the number of
rows. Plane rotations then make R's columns orthogonal: their lengths are the
singular values of the centred rows, which keeps small deviations accurate (no
product of R with itself is formed), and the accumulated rotations are the
components. Pairs of columns that share none are rotated at once.

The driver gets d sums, and d numbers for each component. What a row becomes is
computed anew from the table in the last two passes (the covariance of the
whitened rows, then the rows), so nothing of the table's size is written.

Defined results: null vectors and vectors with null or non-finite entries take
no part; shorter vectors count as padded with zeros, empty ones too; an entry
over LARGEST units counts as LARGEST; each row is a row of its own, so
repeated rows repeat their result, and a null id stays null; a component
without variance (to RANK of the largest) has no whitened value (null),
explains 0 and is left out of identity_error, which is 0 where no component is
left; a deviation that a long can't hold is null; equal eigenvalues come in any
order, the largest entry of a component is positive; other columns are ignored;
an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.sources.shared import discard, written

#: Integer entries are cut off here: doubles beyond hold no units.
LARGEST = 1 << 53
#: Triangles merged by one task at a time.
FAN = 16
#: Rows that enter one QR at a time, in multiples of the dimension.
STACK = 32
#: Singular values below so many roundings a dimension of the largest are none.
RANK = 8 * 2.0**-52
SWEEPS = 60
OUT = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integer_entries(table: DataFrame, key: str, vector: str, scale: int, shift: int) -> DataFrame:
    """The key and x = floor(scale * c) + shift of the rows that take part."""
    c = F.col(vector).cast("array<double>")
    finite = c.isNotNull() & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return table.where(finite).select(F.col(key).alias("vec_id"), F.transform(c, lambda v: _units(v * scale) + shift).alias("x"))


def _units(v: Column) -> Column:
    return F.floor(F.greatest(F.least(v, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("long")


def _matrix(column, dim: int, shift: int) -> np.ndarray:
    """Rows of a list column; missing entries are the shift, which is what zero becomes."""
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes == dim).all():
        return column.flatten().to_numpy().reshape(-1, dim)
    out = np.full((len(sizes), dim), shift, np.int64)
    out[np.arange(dim) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _packed(r: np.ndarray) -> bytes:
    return np.ascontiguousarray(r, np.float64).tobytes()


class Fit:
    """Exact sums of the rows, and what follows from them for a block of rows."""

    def __init__(self, n: int, sums: list[int], spread: int, shift: int):
        self.n, self.sums, self.dim, self.shift = n, sums, len(sums), shift
        self.whole = n * spread < 1 << 62  # n * x - S fits 64 bits, whatever overflows on the way

    def scaled(self, batch) -> np.ndarray:
        """n * x - S, exact."""
        x = _matrix(batch.column("x"), self.dim, self.shift)
        if not self.whole:
            return x.astype(object) * self.n - np.array(self.sums, object)
        least = [(s + (1 << 63)) % (1 << 64) - (1 << 63) for s in self.sums]
        with np.errstate(over="ignore"):
            return x * np.int64(self.n) - np.array(least, np.int64)

    def centred(self, batch) -> np.ndarray:
        return self.scaled(batch).astype(np.float64) / self.n

    def deviations(self, scaled: np.ndarray) -> pa.Array:
        """Sum of squares of each row, exact; null where 64 bits don't hold it."""
        about = (scaled.astype(np.float64) ** 2).sum(axis=1)
        out = [None] * len(scaled)
        small = about < 9e18
        exact = (scaled[small].astype(np.int64) ** 2).sum(axis=1)
        for k, v in zip(np.flatnonzero(small), exact.tolist(), strict=True):
            out[k] = v
        for k in np.flatnonzero(~small & (about < 9.3e18)):
            v = sum(int(a) ** 2 for a in scaled[k])
            out[k] = v if v < 1 << 63 else None
        return pa.array(out, pa.int64())


def fit_sums(rows: DataFrame, shift: int) -> Fit | None:
    """Sums of each dimension: d of them for a task, added up by dimension. Two halves of a number are summed apart, so none overflows."""
    dim = rows.agg(F.max(F.size("x"))).first()[0]
    if not dim:
        return None

    def sums(batches):
        n, low, high = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        least, most = np.full(dim, np.iinfo(np.int64).max), np.full(dim, np.iinfo(np.int64).min)
        for b in batches:
            x = _matrix(b.column("x"), dim, shift)
            n += len(x)
            low += (x & 0xFFFFFFFF).sum(axis=0)
            high += (x >> 32).sum(axis=0)
            if len(x):
                least, most = np.minimum(least, x.min(axis=0)), np.maximum(most, x.max(axis=0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([n] * dim), *map(pa.array, (low, high, least, most))], names=["at", "n", "low", "high", "least", "most"])

    each = rows.mapInArrow(sums, "at int, n long, low long, high long, least long, most long")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found = sorted(each.groupBy("at").agg(exact("n"), exact("low"), exact("high"), F.min("least").alias("least"), F.max("most").alias("most")).collect())  # a row a dimension
    return Fit(int(found[0]["n"]), [(int(r["high"]) << 32) + int(r["low"]) for r in found], max(r["most"] - r["least"] for r in found), shift)


def triangle(rows: DataFrame, fit: Fit) -> DataFrame:
    """One row with R, by TSQR: a triangle for each task, then FAN of them at a time."""
    dim = fit.dim

    def local(batches):
        r = np.zeros((0, dim))
        for b in batches:
            x = fit.centred(b)
            for k in range(0, len(x), STACK * dim):
                r = np.linalg.qr(np.vstack([r, x[k : k + STACK * dim]]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([_packed(r)], pa.binary())], names=["r"])

    def merged(t: pa.Table) -> pa.Table:
        r = np.zeros((0, dim))
        for b in t.column("r"):
            r = np.linalg.qr(np.vstack([r, np.frombuffer(b.as_py()).reshape(-1, dim)]), mode="r")
        return pa.table({"r": pa.array([_packed(r)], pa.binary())})

    now = written(rows.mapInArrow(local, "r binary").withColumn("at", F.monotonically_increasing_id()), "triangles")
    n = now.count()
    while n > 1:
        n = -(-n // FAN)
        after = written(now.groupBy(F.pmod(F.xxhash64("at"), F.lit(n)).alias("g")).applyInArrow(merged, "r binary").withColumn("at", F.monotonically_increasing_id()), "triangles")
        discard(now)
        now, n = after, after.count()
    return now


def _rounds(d: int):
    """Disjoint pairs of columns, in d - 1 rounds (one more for odd d) that hold each pair once."""
    seats = list(range(d + d % 2))
    for _ in range(len(seats) - 1):
        pairs = [(a, b) for a, b in zip(seats[: len(seats) // 2], reversed(seats[len(seats) // 2 :]), strict=True) if a < d and b < d]
        yield np.array(pairs, int).reshape(-1, 2).T
        seats = [seats[0], seats[-1], *seats[1:-1]]


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors (columns) of r, by rotating pairs of columns until all are orthogonal."""
    d = r.shape[1]
    u, v = r.astype(np.float64).copy(), np.eye(d)
    rounds = list(_rounds(d))
    for _ in range(SWEEPS):
        worst = 0.0
        for a, b in rounds:
            x, y = u[:, a], u[:, b]
            p, q, s = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            turn = np.abs(s) > 2.0**-52 * np.sqrt(p * q)
            if not turn.any():
                continue
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                worst = max(worst, np.where(turn, np.abs(s) / np.sqrt(p * q), 0).max())
                zeta = np.where(turn, (q - p) / np.where(turn, 2 * s, 1), 0)
            t = np.where(turn, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta)), 0)
            c = 1 / np.hypot(1, t)
            for m in (u, v):
                x, y = m[:, a].copy(), m[:, b].copy()
                m[:, a], m[:, b] = c * x - c * t * y, c * t * x + c * y
        if worst <= 8 * 2.0**-52:
            break
    sigma = np.sqrt((u * u).sum(axis=0))
    order = np.argsort(-sigma, kind="stable")
    sigma, v = sigma[order], v[:, order]
    return sigma, v * np.where(v[np.abs(v).argmax(axis=0), np.arange(d)] < 0, -1, 1)


class Whitening:
    """Projection of centred rows on the first components, over their deviations."""

    def __init__(self, fit: Fit, sigma: np.ndarray, v: np.ndarray, components: int):
        k = min(components, fit.dim)
        e = sigma**2 / fit.n
        self.fit, self.count = fit, k
        self.live = sigma[:k] > RANK * fit.dim * sigma[0]
        self.explained = np.where(self.live, e[:k] / e.sum(), 0.0) if e.sum() else np.zeros(k)
        self.weights = v[:, :k] / np.where(self.live, np.sqrt(e[:k]), 1.0)

    def apply(self, centred: np.ndarray) -> np.ndarray:
        return centred @ self.weights


def identity_error(rows: DataFrame, w: Whitening) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, from means and products of blocks, each centred on its own mean."""
    k = int(w.live.sum())
    if not k:
        return 0.0

    def join(a, b):
        if a is None:
            return b
        n, gap = a[0] + b[0], b[1] - a[1]
        return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)

    def of(z):
        mean = z.mean(axis=0)
        return len(z), mean, (z - mean).T @ (z - mean)

    def row(a):
        return pa.table({"n": pa.array([a[0]], pa.int64()), "mean": pa.array([_packed(a[1])], pa.binary()), "products": pa.array([_packed(a[2])], pa.binary())})

    def local(batches):
        now = None
        for b in batches:
            if b.num_rows:
                now = join(now, of(w.apply(w.fit.centred(b))[:, w.live]))
        if now is not None:
            yield from row(now).to_batches()

    def merged(t: pa.Table) -> pa.Table:
        now = None
        for r in t.to_pylist():
            now = join(now, (r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["products"]).reshape(k, k)))
        return row(now)

    schema = "n long, mean binary, products binary"
    found = rows.mapInArrow(local, schema).withColumn("g", F.pmod(F.spark_partition_id(), F.lit(FAN * FAN))).groupBy("g").applyInArrow(merged, schema)
    total = None
    for r in found.collect():  # FAN * FAN rows at most
        total = join(total, (r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["products"]).reshape(k, k)))
    return float(np.abs(total[2] / total[0] - np.eye(k)).max())


def whiten(table: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 64, shift: int = 1_000_000, components: int = 32) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: a row for each row that takes part and component."""
    rows = integer_entries(table, key, vector, scale, shift)
    schema = OUT.format(table.schema[key].dataType.simpleString())
    fit = fit_sums(rows, shift)
    if fit is None:
        return table.sparkSession.createDataFrame([], schema)
    r = triangle(rows, fit)
    sigma, v = jacobi(np.frombuffer(r.first()["r"]).reshape(-1, fit.dim))
    discard(r)
    w = Whitening(fit, sigma, v, components)
    error = identity_error(rows, w)

    def rows_of(batches):
        k = w.count
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                scaled, m = fit.scaled(b), b.num_rows
                z = np.where(w.live, w.apply(scaled.astype(np.float64) / fit.n), np.nan).ravel()
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, fit.n)), fit.deviations(scaled).take(each), pa.array(z, mask=np.isnan(z)), pa.array(np.tile(w.explained, m)), pa.array(np.full(m * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(rows_of, schema)

"""Embedding whitening: project vectors on the leading eigenvectors of their
covariance and scale each projection to variance 1.

An entry c becomes the integer x = floor(scale * c) + offset.  Four passes, each
a ``mapInArrow`` over the rows as they lie; nothing but partial sums is shuffled:

1. sums of x and the largest |x|: exact, as integers of any size;
2. the covariance, of entries centred exactly (n*x - S is an integer) before
   they are multiplied: d*(d+1)/2 partial sums a task, added by cell;
3. the covariance of the whitened rows, which gives ``identity_error``;
4. the result.

In between the driver solves one d x d matrix, whose size is the length of a
vector and does not grow with the rows: Householder reflections bring it to
tridiagonal form, Sturm counts bisect the ``components`` largest eigenvalues,
inverse iteration gives their eigenvectors, those of a cluster of close values
made orthogonal to each other in turn.  Mean, vectors and values travel with
the tasks of passes 3 and 4 (components x d numbers).

Edge cases: rows whose vector is null or has a null, infinite or NaN entry are
dropped; repeated rows, ids and null ids stay; a vector shorter than the longest
is filled up with entries 0; x is held within +-2^53.  Directions without
variance cannot be scaled: components end at the first eigenvalue of at most
``rank`` times the largest one, so equal rows, or a single one, give none.  An
empty table gives no rows.  A deviation above 2^63 - 1 is null.  Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 4096   # rows that are multiplied at a time
HELD = 1 << 53


@dataclass(frozen=True)
class Params:
    scale: int = 64
    offset: int = 1_000_000
    components: int = 32
    rank: float = 1e-11     # of the largest eigenvalue: below it a direction has no variance
    cluster: float = 1e-3   # of the matrix norm: closer eigenvalues are one cluster


def _entries(vectors: pa.Array, dim: int | None, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(rows that remain, their x as a matrix) of a list column; ``dim`` None
    takes the longest vector of the batch."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    flat = vectors.flatten()
    value = np.asarray(flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False))
    size = np.asarray(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    keep = np.asarray(vectors.is_valid().to_numpy(zero_copy_only=False)).copy()
    keep[row[~np.isfinite(value)]] = False
    rows = np.flatnonzero(keep)
    dim = int(size[rows].max(initial=0)) if dim is None else dim
    x = np.full((len(size), dim), p.offset, np.int64)
    inside = keep[row]
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    with np.errstate(over="ignore"):
        held = np.clip(np.floor(p.scale * value[inside]), -HELD, HELD - p.offset).astype(np.int64)
    x[row[inside], at[inside]] = held + p.offset
    return rows, x[rows]


@dataclass(frozen=True)
class Sums:
    n: int
    sums: list[int]     # of x, by dimension
    largest: int        # |x|

    @property
    def dim(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: 64-bit integers, or Python's where those are too short."""
        if self.n * max(self.largest, 1) < 1 << 61:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def mean_free(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, unrounded but for the quotient's last bit."""
        return (self.centred(x) / self.n).astype(np.float64)


def sums(vectors: DataFrame, column: str, p: Params) -> Sums:
    """Pass 1.  A row with a shorter vector counts ``offset`` in the dimensions
    it lacks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, largest, total = 0, 0, []
        for batch in batches:
            rows, x = _entries(batch["v"], None, p)
            if not len(rows):
                continue
            total += [p.offset * n] * (x.shape[1] - len(total))
            largest = max(largest, int(np.abs(x).max(initial=0)))
            wide = x.astype(object) if largest * len(x) >= 1 << 62 else x
            own = wide.sum(axis=0).tolist()
            total = [a + b for a, b in zip(total, own + [p.offset * len(rows)] * (len(total) - len(own)))]
            n += len(rows)
        if n:
            dims = range(-1, len(total))  # -1: a row of its own for n, whatever the dimensions
            yield pa.RecordBatch.from_arrays(
                [pa.array(dims, pa.int32()), pa.array([n] * len(dims)), pa.array([Decimal(t) for t in [0, *total]], pa.decimal128(38, 0)), pa.array([largest] * len(dims))],
                names=["dim", "n", "total", "largest"])

    found = (vectors.select(F.col(column).alias("v")).mapInArrow(run, "dim int, n long, total decimal(38,0), largest long")
             .groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("largest").alias("largest")).collect())  # a row a dimension
    by = {r["dim"]: r for r in found}
    if not by:
        return Sums(0, [], 0)
    n = by[-1]["n"]
    return Sums(n, [int(by[d]["total"]) + p.offset * (n - by[d]["n"]) for d in range(len(by) - 1)], max(r["largest"] for r in found))


def _gram(vectors: DataFrame, column: str, dim: int, f, p: Params) -> np.ndarray:
    """The d x d matrix of sums of z_i * z_j over all rows, z = f(x)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, width = None, 0
        for batch in batches:
            _, x = _entries(batch["v"], dim, p)
            for i in range(0, len(x), ROWS):
                z = f(x[i:i + ROWS])
                width = z.shape[1]
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None and width:
            i, j = np.triu_indices(width)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "v"])

    cells = vectors.select(F.col(column).alias("v")).mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # d*(d+1)/2
    size = max((r["j"] for r in cells), default=-1) + 1
    out = np.zeros((size, size))
    for r in cells:
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflections) of Q' a Q; the k-th reflection is a
    unit vector over rows k+1.., or empty where nothing had to be done."""
    a = a.copy()
    n = len(a)
    turns = []
    for k in range(n - 2):
        v = a[k + 1:, k].copy()
        top = np.abs(v).max()
        if top == 0 or not np.abs(v[1:]).max():
            turns.append(np.empty(0))
            continue
        v[0] += np.copysign(np.linalg.norm(v / top) * top, v[0])
        v /= np.linalg.norm(v / np.abs(v).max()) * np.abs(v).max()
        rest = a[k + 1:, k + 1:]
        w = rest @ v
        w -= (v @ w) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1:, k] -= 2 * v * (v @ a[k + 1:, k])
        turns.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), turns


def below(d: np.ndarray, e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues of the tridiagonal matrix lie below
    each value of ``at``."""
    least = np.finfo(float).tiny / np.finfo(float).eps
    count = np.zeros(len(at), np.int64)
    q = np.ones(len(at))
    for i in range(len(d)):
        q = d[i] - at - (e[i - 1] ** 2 / q if i else 0.0)
        q = np.where(np.abs(q) < least, -least, q)
        count += q < 0
    return count


def leading(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, bisected to the last bit."""
    n = len(d)
    around = np.abs(np.append(e, 0)) + np.abs(np.append(0, e))
    low, high = (d - around).min(), (d + around).max()
    slack = 4 * np.finfo(float).eps * max(abs(low), abs(high), np.finfo(float).tiny)
    lo, hi = np.full(k, low - slack), np.full(k, high + slack)
    rank = n - 1 - np.arange(k)  # so many eigenvalues lie below the wanted one
    while True:
        middle = (lo + hi) / 2
        live = (middle > lo) & (middle < hi)
        if not live.any():
            return hi
        over = below(d, e, middle) > rank
        lo, hi = np.where(live & ~over, middle, lo), np.where(live & over, middle, hi)


def _solver(d: np.ndarray, e: np.ndarray, at: float, floor: float):
    """x -> (T - at)^-1 x by elimination with row exchanges; pivots below
    ``floor`` count as it."""
    n = len(d)
    u0, u1, u2, factor, turned = d - at, np.append(e, 0.0), np.zeros(n), np.zeros(n), np.zeros(n, bool)
    for i in range(n - 1):
        if abs(e[i]) > abs(u0[i]):
            turned[i] = True
            f = u0[i] / e[i]
            above, after = u1[i], u0[i + 1]
            u0[i], u1[i], u2[i] = e[i], after, u1[i + 1]
            u0[i + 1], u1[i + 1] = above - f * after, -f * u2[i]
        else:
            if abs(u0[i]) < floor:
                u0[i] = floor
            f = e[i] / u0[i]
            u0[i + 1] -= f * u1[i]
        factor[i] = f
    if abs(u0[-1]) < floor:
        u0[-1] = floor

    def solve(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        for i in range(n - 1):
            if turned[i]:
                x[i], x[i + 1] = x[i + 1], x[i] - factor[i] * x[i + 1]
            else:
                x[i + 1] -= factor[i] * x[i]
        for i in range(n - 1, -1, -1):
            x[i] = (x[i] - (u1[i] * x[i + 1] if i + 1 < n else 0) - (u2[i] * x[i + 2] if i + 2 < n else 0)) / u0[i]
        return x

    return solve


def eigenvectors(d: np.ndarray, e: np.ndarray, values: np.ndarray, p: Params = Params()) -> np.ndarray:
    """Unit eigenvectors (rows) of the tridiagonal matrix for falling ``values``.
    Those of a cluster come out orthogonal: each is freed of the others before
    and after every step of its iteration."""
    n = len(d)
    norm = max(np.abs(d).max(), np.abs(e).max(initial=0), np.finfo(float).tiny)
    eps = np.finfo(float).eps
    rng = np.random.default_rng(7)
    out = np.zeros((len(values), n))
    first, shift = 0, 0.0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > p.cluster * norm:
            first = k
        # equal values are shifted apart a little, so that the systems differ
        shift = value if k == first else min(value, shift - 4 * eps * norm)
        solve = _solver(d, e, shift, eps * norm)
        x = rng.standard_normal(n)
        for _ in range(6):
            x = solve(x / np.abs(x).max())
            x /= np.abs(x).max()
            for _ in range(2):
                x -= out[first:k].T @ (out[first:k] @ x)
            x /= np.linalg.norm(x)
        out[k] = x
    return out


def eigen(a: np.ndarray, k: int, p: Params = Params()) -> tuple[np.ndarray, np.ndarray]:
    """(values, unit vectors as rows) of the k largest eigenvalues of a
    symmetric matrix."""
    scale = np.abs(a).max(initial=0)
    if not len(a) or not scale:
        return np.zeros(min(k, len(a))), np.eye(len(a))[:k]
    d, e, turns = tridiagonal(a / scale)
    values = leading(d, e, min(k, len(d)))
    vectors = eigenvectors(d, e, values, p)
    for i in range(len(turns) - 1, -1, -1):
        v = turns[i]
        if len(v):
            vectors[:, i + 1:] -= 2 * np.outer(vectors[:, i + 1:] @ v, v)
    return values * scale, vectors


@dataclass(frozen=True)
class Model:
    sums: Sums
    values: np.ndarray    # eigenvalues, falling
    vectors: np.ndarray   # their unit eigenvectors, as rows
    trace: float
    identity_error: float = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.sums.mean_free(x) @ (self.vectors / np.sqrt(self.values)[:, None]).T


def fit(vectors: DataFrame, column: str = "embedding", p: Params = Params()) -> Model:
    """Passes 1 to 3 over the rows of ``vectors``."""
    s = sums(vectors, column, p)
    if not s.n or not s.dim:
        return Model(s, np.empty(0), np.empty((0, s.dim)), 0.0)
    v = _gram(vectors, column, s.dim, s.mean_free, p) / s.n
    values, components = eigen(v, min(p.components, s.dim), p)
    k = int((values > p.rank * max(values[0], 0)).sum()) if values[0] > 0 else 0
    m = Model(s, values[:k], components[:k], float(np.trace(v)))
    if not k:
        return m
    # the whitened means count too: a 1 beside the projections sums them
    g = _gram(vectors, column, s.dim, lambda x: np.hstack([m.whitened(x), np.ones((len(x), 1))]), p) / s.n
    error = g[:k, :k] - np.outer(g[:k, k], g[:k, k]) - np.eye(k)
    return Model(s, m.values, m.vectors, m.trace, float(np.abs(error).max()))


def transform(rows: DataFrame, m: Model, column: str = "embedding", carry: tuple[str, ...] = ("vec_id",), p: Params = Params()) -> DataFrame:
    """Pass 4: for each remaining row its ``carry`` columns, ``whitened`` (the
    projections, scaled, as an array) and ``deviation``."""
    names = [f"c{i}" for i in range(len(carry))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _entries(batch["v"], m.sums.dim, p)
            white = m.whitened(x)
            own = m.sums.centred(x)
            if own.dtype != object and len(own) and int(np.abs(own).max(initial=0)) ** 2 * max(1, m.sums.dim) >= 1 << 63:
                own = own.astype(object)
            deviation = [v if v < 1 << 63 else None for v in (own * own).sum(axis=1).tolist()]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * white.shape[1], pa.int32()), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch[c].take(pa.array(at)) for c in names), pa.array(deviation, pa.int64()), lists], names=[*names, "deviation", "whitened"])

    own = rows.select(*[F.col(c).alias(a) for c, a in zip(carry, names)], F.col(column).alias("v"))
    kinds = ", ".join(f"{a} {own.schema[a].dataType.simpleString()}" for a in names)
    out = own.mapInArrow(run, f"{kinds}, deviation long, whitened array<double>")
    return out.select(*[F.col(a).alias(c) for c, a in zip(carry, names)], "deviation", "whitened")


def components(rows: DataFrame, p: Params = Params()) -> DataFrame:
    """A row for each remaining vector of ``rows`` (vec_id, embedding) and
    component: vec_id, component (from 1), n, deviation, whitened, explained,
    identity_error."""
    m = fit(rows, p=p)
    share = F.array(*[F.lit(float(v / m.trace)) for v in m.values]).cast("array<double>")
    each = transform(rows, m, p=p).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(m.sums.n).cast("long").alias("n"), "deviation", "whitened",
                       F.get(share, F.col("at")).alias("explained"), F.lit(m.identity_error).alias("identity_error"))

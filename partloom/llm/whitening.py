"""Whiten embeddings by principal components that a Jacobi-Davidson iteration finds without the covariance matrix.

The matrix is touched only as a product: each task centres its rows, multiplies them with a thin block W and adds up
Xc' (Xc W), a block of the dimension by the width of W; the tasks' blocks are added up in two steps, in a fixed order.
Around that stands a block Jacobi-Davidson iteration on small arrays: Rayleigh-Ritz in the search space gives the leading
pairs; those whose residual is at double precision are locked; for the others the correction equation, projected away
from all leading vectors, is solved by inner MINRES, all at once, so that a step of MINRES is one product; the corrections,
made orthogonal, widen the search space, which shrinks to its best vectors when it is full. It ends when the residuals of
all wanted pairs, computed afresh, are at double precision.

Entries are integers, so sums and each row's deviation are exact. A row is centred by the integer part of the mean first
and its fraction next, which keeps all digits.

Defined results: rows whose vector is null, has a null or an entry that isn't finite are dropped, as are rows of another
length than the commonest (the longer of equally common ones; a vector without entries is of length zero); repeated rows
count each; entries beyond 2^61 count as 2^61; a deviation beyond 64 bits is null. Directions in which the vectors don't
vary have no component, so a single vector, equal vectors or an empty table give an empty result. A null vec_id stays
null; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.common import cut

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Vectors searched beside the wanted ones; MINRES steps of a correction, and by how much it is to shrink the residual; rounds.
SPARE, INNER, ENOUGH, ROUNDS = 8, 8, 0.05, 200
EPS = float(np.finfo(float).eps)
_ROWS = 4096
_FAR = 1 << 61


@dataclass
class Centre:
    """What is known of the fit list: its size, its dimension, and per dimension the exact sum, as mean = whole + part."""

    n: int
    sums: list[int]

    def __post_init__(self) -> None:
        self.whole = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = [s - self.n * w for s, w in zip(self.sums, self.whole.tolist(), strict=True)]
        self.part = np.array([r / self.n for r in self.rest])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(float) - self.part

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - sum) ** 2, exactly."""
        away = x - self.whole
        if len(x) and self.n * (int(np.abs(away).max()) + 1) < math.isqrt((1 << 62) // max(1, x.shape[1])):
            z = self.n * away - np.array(self.rest, np.int64)
            return (z * z).sum(axis=1).tolist()
        exact = [sum((self.n * a - r) ** 2 for a, r in zip(row, self.rest, strict=True)) for row in away.tolist()]
        return [d if d < 1 << 63 else None for d in exact]


def integers(vectors: DataFrame, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id, x (the entries as integers) of the rows whose entries are all there and finite."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            size = np.asarray(lists.value_lengths().fill_null(0))
            value = flat.to_numpy(zero_copy_only=False).astype(float)  # a null becomes NaN
            ends = np.cumsum(size)
            bad = np.r_[0, np.cumsum(~np.isfinite(value))]
            keep = np.asarray(lists.is_valid()) & (bad[ends] == bad[ends - size])
            value = value[np.repeat(keep, size)]
            x = np.clip(np.floor(SCALE * value), -_FAR, _FAR - SHIFT).astype(np.int64) + SHIFT
            offset = np.r_[0, np.cumsum(size[keep])].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), pa.ListArray.from_arrays(pa.array(offset), pa.array(x))], names=["vec_id", "x"])

    given = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{column}`").cast("array<double>").alias("v"))
    return given.mapInArrow(run, "vec_id long, x array<long>")


def _matrix(batch: pa.RecordBatch, d: int, column: int = 0) -> np.ndarray:
    """The vectors of length d of a batch, a row each."""
    lists = batch.column(column)
    size = np.asarray(lists.value_lengths())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat[np.repeat(size == d, size)].reshape(-1, d)


def centre(rows: DataFrame) -> Centre | None:
    """Size and exact sums of the commonest length of x."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = {}
        sums: dict[int, list[int]] = {}
        for batch in batches:
            for d in np.unique(np.asarray(batch.column(0).value_lengths())).tolist():
                x = _matrix(batch, d) if d else np.empty((batch.num_rows, 0), np.int64)
                # Halves of 31 bits add up without overflow.
                new = [h * (1 << 31) + lo for h, lo in zip((x >> 31).sum(axis=0).tolist(), (x & 0x7FFFFFFF).sum(axis=0).tolist(), strict=True)]
                n[d] = n.get(d, 0) + int((np.asarray(batch.column(0).value_lengths()) == d).sum())
                sums[d] = [a + b for a, b in zip(sums.get(d, [0] * d), new, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int32()), pa.array(list(n.values()), pa.int64()), pa.array([list(map(str, s)) for s in sums.values()], pa.list_(pa.string()))], names=["d", "n", "sums"])

    found = rows.select("x").mapInArrow(run, "d int, n long, sums array<string>")
    lengths = found.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if not lengths or not lengths["d"]:
        return None
    mine = found.where(F.col("d") == lengths["d"]).select(F.posexplode("sums"))
    # A row a dimension, whatever the table's size; sums of any 64-bit numbers fit 38 digits.
    sums = mine.groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).orderBy("pos").collect()
    return Centre(lengths["n"], [int(r["s"]) for r in sums])


def _added(rows: DataFrame, d: int, shape: tuple[int, int], of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of what `of` gives for some of them: an array for each task, then for each of about as many tasks
    as the root of that, then one. Always added in the order of the tasks."""
    names = ["slot", "sum"]

    def one(slot: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([slot], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=names)

    def by_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(shape)
        for batch in batches:
            x = _matrix(batch, d)
            for at in range(0, len(x), _ROWS):
                total += of(x[at : at + _ROWS])
        yield one(TaskContext.get().partitionId(), total)

    def by_some(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = {s: t for b in batches for s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
        if parts:
            yield one(min(parts), sum(np.frombuffer(parts[s]).reshape(shape) for s in sorted(parts)))

    parts = rows.select("x").mapInArrow(by_task, "slot long, sum binary")
    tasks = parts.rdd.getNumPartitions()
    if tasks > 16:
        parts = parts.repartition(math.isqrt(tasks), F.col("slot")).mapInArrow(by_some, "slot long, sum binary")
    return sum((np.frombuffer(r["sum"]).reshape(shape) for r in sorted(parts.collect(), key=lambda r: r["slot"])), np.zeros(shape))


def product(rows: DataFrame, at: Centre) -> Callable[[np.ndarray], np.ndarray]:
    """The covariance of the fit list, divisor n, as a product with a thin block."""
    d = len(at.sums)

    def times(w: np.ndarray) -> np.ndarray:
        def of(x: np.ndarray) -> np.ndarray:
            c = at.centred(x)
            return c.T @ (c @ w)

        return _added(rows, d, w.shape, of) / at.n

    return times


def minres(times: Callable[[np.ndarray], np.ndarray], away: Callable[[np.ndarray], np.ndarray], theta: np.ndarray, r: np.ndarray, steps: int, enough: float) -> np.ndarray:
    """Solve (I - QQ')(A - theta)(I - QQ') t = r for each column by MINRES, in step; `away` is the projection, r lies in its range."""
    x, beta = np.zeros_like(r), np.linalg.norm(r, axis=0)
    v, before = r / np.where(beta > 0, beta, 1), np.zeros_like(r)
    eta, first = beta.copy(), beta.copy()
    c0, c1, s0, s1 = (np.full(r.shape[1], f) for f in (1.0, 1.0, 0.0, 0.0))
    w0, w1, last = np.zeros_like(r), np.zeros_like(r), np.zeros(r.shape[1])
    for _ in range(steps):
        u = away(times(v) - v * theta)
        alpha = (v * u).sum(axis=0)
        u = u - v * alpha - before * last
        beta = np.linalg.norm(u, axis=0)
        # Givens rotations turn the tridiagonal matrix upper triangular.
        delta = c1 * alpha - c0 * s1 * last
        rho2, rho3 = s1 * alpha + c0 * c1 * last, s0 * last
        rho1 = np.hypot(delta, beta)
        live = rho1 > EPS * np.abs(first)
        safe = np.where(live, rho1, 1)
        c, s = np.where(live, delta / safe, 1), np.where(live, beta / safe, 0)
        w = np.where(live, (v - w1 * rho2 - w0 * rho3) / safe, 0)
        x = x + w * (c * eta)
        eta = -s * eta
        w0, w1, c0, c1, s0, s1, last = w1, w, c1, c, s1, s, beta
        before, v = v, u / np.where(beta > 0, beta, 1)
        if (np.abs(eta) <= enough * first).all():
            break
    return x


def jacobi_davidson(times: Callable[[np.ndarray], np.ndarray], d: int, k: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray, int]:
    """The k leading eigenpairs of a symmetric positive semidefinite matrix of size d, given as a product with thin blocks:
    values in falling order, vectors as columns, number of products."""
    made = 0

    def applied(w: np.ndarray) -> np.ndarray:
        nonlocal made
        made += 1
        return times(w)

    width = min(d, k + SPARE)
    most = min(d, 3 * width)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
    image = applied(basis)
    fresh = True
    for _ in range(ROUNDS):
        small = basis.T @ image
        value, y = np.linalg.eigh((small + small.T) / 2)
        value, y = value[::-1], y[:, ::-1]
        ritz, ritz_image = basis @ y[:, :width], image @ y[:, :width]
        theta = value[:k]
        u, r = ritz[:, :k], ritz_image[:, :k] - ritz[:, :k] * value[:k]
        enough = max(64, d) * EPS * max(theta[0], 0)
        open_ = np.linalg.norm(r, axis=0) > enough  # the others are locked
        if not open_.any():
            if fresh:
                return theta, u, made
            # Residuals were told from images made of images: restart and compute them afresh before they count.
            basis = np.linalg.qr(ritz)[0]
            image, fresh = applied(basis), True
            continue
        if basis.shape[1] == d:
            basis, fresh = np.linalg.qr(basis @ y)[0], True  # the whole space is searched: only rounding is left
            image = applied(basis)
            continue
        away = lambda z, q=u: z - q @ (q.T @ z)
        wanted = away(-r[:, open_])
        t = away(minres(applied, away, theta[open_], wanted, INNER, ENOUGH))
        if basis.shape[1] + t.shape[1] > most and basis.shape[1] > width:
            basis, image = ritz, ritz_image
        t = t / np.maximum(np.linalg.norm(t, axis=0), np.finfo(float).tiny)
        for _ in range(2):
            t = t - basis @ (basis.T @ t)
        left, size, _ = np.linalg.svd(t, full_matrices=False)
        t = left[:, size > 1e-8][:, : d - basis.shape[1]]
        if not t.shape[1]:  # a space that holds its own corrections is refined by its images
            basis = np.linalg.qr(ritz)[0]
            image, fresh = applied(basis), True
            continue
        t = np.linalg.qr(t - basis @ (basis.T @ t))[0]
        basis, image, fresh = np.c_[basis, t], np.c_[image, applied(t)], False
    raise ArithmeticError(f"residuals of {int(open_.sum())} of {k} components are above double precision after {ROUNDS} rounds")


@dataclass
class Whitening:
    """Components of a table: values and unit vectors in falling order, the trace, and the largest entry by which the covariance
    of the whitened vectors differs from the identity."""

    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    products: int
    identity_error: float = 0.0

    def of(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.vectors / np.sqrt(self.values)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit to rows (vec_id, x); None where nothing varies."""
    at = centre(rows)
    if not at:
        return None
    d = len(at.sums)
    trace = float(_added(rows, d, (1, 1), lambda x: np.square(at.centred(x)).sum().reshape(1, 1))[0, 0]) / at.n
    if trace <= 0:
        return None
    values, vectors, made = jacobi_davidson(product(rows, at), d, min(components, d))
    some = values > max(64, d) * EPS * values[0]
    out = Whitening(at, values[some], vectors[:, some], trace, made)
    k = len(out.values)
    # Sums of products and, in the last row, of the whitened values themselves.
    sums = _added(rows, d, (k + 1, k), lambda x: np.vstack([(z := out.of(x)).T @ z, z.sum(axis=0)])) / at.n
    out.identity_error = float(np.abs(sums[:k] - np.outer(sums[k], sums[k]) - np.eye(k)).max())
    return out


def whitened(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each row that remains and each component."""
    rows = cut(integers(vectors, column, key))
    got = fit(rows, components)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not got:
        return vectors.sparkSession.createDataFrame([], schema)
    d, k = len(got.centre.sums), len(got.values)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = got.values / got.trace
        for batch in batches:
            batch = batch.filter(pa.array(np.asarray(batch.column(1).value_lengths()) == d))
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                x, m = _matrix(part, d, 1), part.num_rows
                each = np.repeat(np.arange(m), k)
                columns = [part.column(0).take(pa.array(each)), np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, got.centre.n), pa.array(got.centre.deviations(x), pa.int64()).take(pa.array(each))]
                columns += [got.of(x).ravel(), np.tile(share, m), np.full(m * k, got.identity_error)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[c.split()[0] for c in schema.split(", ")])

    return rows.mapInArrow(run, schema)

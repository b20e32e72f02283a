"""Whitening of embeddings by an incremental eigendecomposition.

Each task keeps the count, the mean and the eigendecomposition of the centred scatter
of what it has read. One more row is a centred rank-one update of that scatter: the new
eigenvalues are the roots of a secular equation, the new eigenvectors come from them
(with the update vector recomputed from the roots, which keeps them orthogonal). Parts
of the update that change nothing, and equal eigenvalues, are deflated first. Spectra
of tasks are combined, a bounded number at a time, by one rank-one update for each
eigenvector of the one and one for the distance of the means. The leading directions
are refined by Rayleigh-Ritz steps whose products are summed over all rows, until the
residual is at the level of rounding.

A task holds one matrix of the dimension squared, the driver as well. Nothing else is
gathered: sums and spectra meet in a tree of groupings.

Defined results for odd inputs:

- a vector that is null or holds null or non-finite entries takes no part, nor does an
  empty one, nor one that has not the most frequent length (ties: the longer).
- entries beyond 2**53 in size after scaling count as 2**53.
- repeated rows and null ids each get their rows and count in the fit.
- a component without variance (fewer different rows than dimensions, say) has null
  ``whitened``; ``explained`` is null if there is no variance at all.
- a ``deviation`` beyond 64 bits is null.
- empty table: no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import written

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
# Directions refined besides those returned.
SPARE = 8
# Most spectra combined at once, and most refinements.
FAN_IN, ROUNDS = 16, 6
EPS = np.finfo(float).eps
MOST = float(1 << 53)
STATE = "part long, counts array<long>, state array<double>"
State = tuple[np.ndarray, np.ndarray]


# Rank-one updates.


def secular_roots(poles: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum(z**2 / (poles - root)) for rising poles: for each root the
    pole next to it and the distance from that, which keeps its digits."""
    k, squares = len(poles), rho * z * z
    width = np.append(np.diff(poles), squares.sum())
    half = width / 2
    middle = 1 + (1 / (poles[None, :] - (poles + half)[:, None])) @ squares
    origin = np.arange(k)
    upper = (middle < 0) & (origin < k - 1)  # the root lies nearer the next pole
    origin = origin + upper
    low = np.where(upper, -half, np.where(middle < 0, half, 0.0))
    high = np.where(upper, 0.0, np.where(middle < 0, width, half))
    delta = poles[None, :] - poles[origin][:, None]
    place = np.arange(k)
    left = (place[None, :] <= place[:, None]).astype(float)  # poles below a root
    a, b = delta[place, place], delta[place, np.minimum(place + 1, k - 1)]
    t, last = (low + high) / 2, place == k - 1
    inverse, below_only, work = np.empty((3, k, k))
    for _ in range(60):
        np.reciprocal(np.subtract(delta, t[:, None], out=inverse), out=inverse)
        np.multiply(inverse, left, out=below_only)
        terms, terms_below = inverse @ squares, below_only @ squares
        f = 1 + terms
        below = np.multiply(below_only, inverse, out=work) @ squares
        above = np.multiply(inverse, inverse, out=work) @ squares - below
        done = np.abs(f) <= 4 * EPS * k * (1 + terms - 2 * terms_below)
        low, high = np.where(f < 0, t, low), np.where(f < 0, high, t)
        if (done | (high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high)))).all():
            break
        # Where two poles with these slopes, or for the last root one, would vanish.
        d1, d2 = a - t, b - t
        with np.errstate(all="ignore"):
            c = f - d1 * below - d2 * above
            p, q = (d1 + d2) * f - d1 * d2 * (below + above), d1 * d2 * f
            root = np.sqrt(np.maximum(p * p - 4 * q * c, 0))
            two = np.where(p <= 0, (p - root) / (2 * c), 2 * q / (p + root))
            one = d1 + below * d1 * d1 / (f - d1 * below)
            step = t + np.where(last, one, two)
        inside = (step > low) & (step < high)
        t = np.where(done, t, np.where(inside, step, (low + high) / 2))
    return origin, t


def rank_one(lam: np.ndarray, vec: np.ndarray, rho: float, x: np.ndarray) -> State:
    """Rising eigenvalues and the eigenvectors of ``vec @ diag(lam) @ vec.T + rho x x.T``."""
    z = vec.T @ x
    size = float(np.sqrt(z @ z))
    if rho <= 0 or size == 0:
        return lam, vec
    z, rho = z / size, rho * size * size
    tol = 8 * EPS * max(lam[-1], rho)
    close = np.diff(lam) <= tol
    if close.any():  # of equal eigenvalues one direction takes the whole update
        vec = vec.copy()
        start = 0
        for end in [*(np.flatnonzero(~close) + 1), len(lam)]:
            part = z[start:end]
            if end - start > 1 and (norm := np.sqrt(part @ part)) > 0:
                mirror = part.copy()
                mirror[-1] += np.copysign(norm, part[-1])
                mirror /= np.sqrt(mirror @ mirror)
                block = vec[:, start:end]
                vec[:, start:end] = block - 2 * np.outer(block @ mirror, mirror)
                z[end - 1], z[start : end - 1] = -np.copysign(norm, part[-1]), 0
            start = end
    used = rho * np.abs(z) > tol
    poles, weight = lam[used], z[used]
    k = len(poles)
    if not k:
        return lam, vec
    origin, t = secular_roots(poles, weight, rho)
    apart = (poles[origin][None, :] - poles[:, None]) + t[None, :]  # root - pole
    gaps = poles[None, :] - poles[:, None]
    place = np.arange(k)
    # The vector whose roots these are exactly.
    ratio = apart.copy()
    ratio[:, : k - 1] /= np.where(place[None, :-1] < place[:, None], gaps[:, :-1], gaps[:, 1:])
    exact = np.sqrt(np.maximum(ratio.prod(1), 0))
    inner = np.copysign(exact, weight)[:, None] / -apart
    inner /= np.sqrt((inner * inner).sum(0))
    lam, vec = lam.copy(), vec.copy()
    lam[used] = poles[origin] + t
    vec[:, used] = vec[:, used] @ inner
    order = np.argsort(lam, kind="stable")
    return lam[order], vec[:, order]


class Spectrum:
    """Count, mean and eigendecomposition of the centred scatter of some rows."""

    def __init__(self, dim: int):
        self.n, self.mean = 0, np.zeros(dim)
        self.lam, self.vec = np.zeros(dim), np.eye(dim)

    def add(self, row: np.ndarray) -> None:
        gap = row - self.mean
        self.n += 1
        self.mean = self.mean + gap / self.n
        self.lam, self.vec = rank_one(self.lam, self.vec, (self.n - 1) / self.n, gap)

    def merge(self, other: Spectrum) -> None:
        if not self.n or not other.n:
            if other.n:
                self.n, self.mean, self.lam, self.vec = other.n, other.mean, other.lam, other.vec
            return
        n, gap = self.n + other.n, other.mean - self.mean
        for value, direction in zip(other.lam, other.vec.T):
            self.lam, self.vec = rank_one(self.lam, self.vec, value, direction)
        self.lam, self.vec = rank_one(self.lam, self.vec, self.n * other.n / n, gap)
        self.mean, self.n = self.mean + gap * (other.n / n), n

    def packed(self) -> np.ndarray:
        return np.concatenate([[self.n], self.mean, self.lam, self.vec.ravel()])

    @classmethod
    def of(cls, state: np.ndarray, dim: int) -> Spectrum:
        out = cls(dim)
        out.n, out.mean, out.lam = int(state[0]), state[1 : 1 + dim], state[1 + dim : 1 + 2 * dim]
        out.vec = state[1 + 2 * dim :].reshape(dim, dim)
        return out


# Sums and spectra of all rows.


def usable(rows: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, int]:
    """(vec_id, vector) of the rows that take part, and their dimension."""
    kept = rows.select(
        F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")
    ).filter(F.col("vector").isNotNull() & (F.size("vector") > 0))
    kept = kept.filter(
        F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    )
    sizes = kept.groupBy(F.size("vector").alias("dim")).count()
    common = sizes.orderBy(F.desc("count"), F.desc("dim")).head()
    dim = common["dim"] if common else 0
    return kept.filter(F.size("vector") == dim), dim


def scaled(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """Rows of integers, without the shift that all have."""
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return np.clip(np.floor(flat * SCALE), -MOST, MOST).astype(np.int64)


def summed(
    rows: DataFrame,
    make: Callable[[Iterator[pa.RecordBatch]], State | None],
    combine: Callable[[list[State]], State],
) -> State | None:
    """``make`` of each task's rows, combined in a tree of bounded fan-in."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found = make(batches)
        if found is not None:
            yield packed(TaskContext.get().partitionId(), found)

    def packed(part: int, state: State) -> pa.RecordBatch:
        columns = [[part], [state[0].tolist()], [state[1].tolist()]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        return pa.RecordBatch.from_arrays(arrays, ["part", "counts", "state"])

    def join(table: pa.Table) -> pa.Table:
        held = sorted(zip(*(table.column(c).to_pylist() for c in ("part", "counts", "state"))))
        states = [(np.array(c, np.int64), np.array(s)) for _, c, s in held]
        return pa.Table.from_batches([packed(held[0][0] // FAN_IN, combine(states))])

    states = written(rows.mapInArrow(each, STATE), "states")
    left = 1 + (states.agg(F.max("part")).head()[0] or 0)
    while left > 1:
        grouped = states.groupBy(F.expr(f"part div {FAN_IN}").alias("group"))
        states = written(grouped.applyInArrow(join, STATE), "states")
        left = -(-left // FAN_IN)
    row = states.head()
    return row and (np.array(row["counts"], np.int64), np.array(row["state"]))


def added(states: list[State]) -> State:
    return sum(s[0] for s in states), sum(s[1] for s in states)


def spectrum(rows: DataFrame, dim: int) -> tuple[int, np.ndarray, Spectrum] | None:
    """Count, exact sums and the incremental eigendecomposition of all rows."""

    def make(batches: Iterator[pa.RecordBatch]) -> State | None:
        held, sums = Spectrum(dim), np.zeros(dim, np.int64)
        for batch in batches:
            values = scaled(batch, dim)
            sums += values.sum(0)
            for row in values.astype(float):
                held.add(row)
        return (np.append(held.n, sums), held.packed()) if held.n else None

    def combine(states: list[State]) -> State:
        held = Spectrum(dim)
        for _, state in states:
            held.merge(Spectrum.of(state, dim))
        return sum(s[0] for s in states), held.packed()

    found = summed(rows, make, combine)
    return found and (int(found[0][0]), found[0][1:], Spectrum.of(found[1], dim))


class Whitening(NamedTuple):
    """Of vectors with ``n`` rows and ``sums`` (both without the shift)."""

    n: int
    sums: np.ndarray
    values: np.ndarray  # variances of the components, falling
    directions: np.ndarray  # a column each
    trace: float

    def centred(self, values: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: 64 bits where they hold it, else of any size."""
        most = max(int(np.abs(values).max(initial=0)), 1) * self.n + int(np.abs(self.sums).max())
        if most < 1 << 62:
            return self.n * values - self.sums
        return self.n * values.astype(object) - self.sums.astype(object)

    def white(self, centred: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            out = (centred / self.n).astype(float) @ self.directions / np.sqrt(self.values)
        out[:, self.values <= 0] = np.nan
        return out


def refined(rows: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening | None:
    """The leading components: from the incremental spectrum, by Rayleigh-Ritz steps."""
    found = spectrum(rows, dim)
    if found is None:
        return None
    n, sums, start = found
    mean = sums / n
    trace, k = float(np.maximum(start.lam, 0).sum()) / n, min(components, dim)
    basis, best = start.vec[:, ::-1][:, : min(k + SPARE, dim)], None
    shared_with = rows.sparkSession.sparkContext.broadcast
    for _ in range(ROUNDS):
        basis = np.linalg.qr(basis)[0]
        held = shared_with((mean, basis))

        def make(batches: Iterator[pa.RecordBatch]) -> State:
            mean, basis = held.value
            product = np.zeros(basis.shape)
            for batch in batches:
                gap = scaled(batch, dim) - mean
                product += gap.T @ (gap @ basis)
            return np.zeros(1, np.int64), product.ravel()

        product = summed(rows, make, added)[1].reshape(basis.shape) / n
        inner = basis.T @ product
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz = basis @ turn
        left = product @ turn[:, :k] - ritz[:, :k] * values[:k]
        error = float(np.sqrt((left * left).sum(0)).max())
        if best is None or error < best[0]:
            best = error, values[:k], ritz[:, :k]
        else:
            break
        if error <= 64 * EPS * values[0] or len(values) == dim:
            break
        basis = np.concatenate([ritz, left], 1)[:, :dim]
    _, values, directions = best
    none = values <= dim * EPS * max(trace, EPS)
    return Whitening(n, sums, np.where(none, 0.0, values), directions, trace)


def identity_error(rows: DataFrame, dim: int, white: Whitening) -> float | None:
    """Largest entry of |covariance of the whitened rows - identity|, components without
    variance left out."""
    held = rows.sparkSession.sparkContext.broadcast(white)
    some = white.values > 0
    k = int(some.sum())
    if not k:
        return None

    def make(batches: Iterator[pa.RecordBatch]) -> State:
        total, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            out = held.value.white(held.value.centred(scaled(batch, dim)))[:, some]
            total += out.sum(0)
            products += out.T @ out
        return np.zeros(1, np.int64), np.append(total, products.ravel())

    state = summed(rows, make, added)[1]
    mean = state[:k] / white.n
    covariance = state[k:].reshape(k, k) / white.n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(k)).max())


SCHEMA = (
    "component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def whitened(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row for each vector that takes part and each component: see the module."""
    kept, dim = usable(rows, vec_id, vector)
    schema = f"vec_id {dict(kept.dtypes)['vec_id']}, {SCHEMA}"
    fit = refined(kept, dim) if dim else None
    if fit is None:
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(kept, dim, fit)
    held = rows.sparkSession.sparkContext.broadcast((fit, error))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, error = held.value
        k = len(fit.values)
        explained = [v / fit.trace if fit.trace > 0 else None for v in fit.values.tolist()]
        for batch in batches:
            count = batch.num_rows
            centred = fit.centred(scaled(batch, dim))
            if centred.dtype == object or dim * int(np.abs(centred).max(initial=0)) ** 2 >= 1 << 63:
                exact = (centred.astype(object) ** 2).sum(1)
                squares = [v if v < 1 << 63 else None for v in exact.tolist()]
            else:
                squares = (centred**2).sum(1).tolist()
            out = fit.white(centred).ravel()
            each = np.repeat(np.arange(count), k)
            arrays = [
                batch.column("vec_id").take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)),
                pa.array(np.full(count * k, fit.n, np.int64)),
                pa.array(squares, pa.int64()).take(pa.array(each)),
                pa.array(out, mask=np.isnan(out)),
                pa.array(explained * count, pa.float64()),
                pa.array([error] * (count * k), pa.float64()),
            ]
            names = [f.split()[0] for f in ["vec_id x", *SCHEMA.split(", ")]]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return kept.mapInArrow(run, schema)

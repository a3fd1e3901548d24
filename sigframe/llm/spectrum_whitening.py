"""Whitening of embeddings by spectrum slicing of their covariance.

Entries become whole numbers x = floor(64 c) + 1000000. Sums over the fit list (each distinct
x vector once) are exact; the covariance is summed over centred vectors, task by task. It has
the size of the dimensions squared, whatever the number of rows, and its leading eigenvectors
are found on the driver:

* the number of eigenvalues below a shift is the number of negative pivots of the LDL^T
  factors of the shifted matrix (symmetric pivoting, blocks of one or two);
* bisection by these counts isolates each leading eigenvalue, or a group too close to part;
* Rayleigh quotient iteration started inside the slice converges cubically to its vector;
* counts on both sides of every eigenvalue found certify its number.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.llm.common import cut

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
# Entries from here on are no whole numbers that a double holds exactly after scaling.
LARGEST = float(1 << 46)
TOLERANCE = 1e-11  # of the largest eigenvalue: closer ones form a group
STEPS = 60
LOW_BITS = 24


def inertia(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric ``a`` are below ``shift``: the negative pivots of
    P(a - shift)P^T = LDL^T with Bunch-Kaufman pivoting."""
    a = a - shift * np.eye(len(a))
    n, k, below = len(a), 0, 0
    alpha = (1 + 17 ** 0.5) / 8
    while k < n:
        rest = np.abs(a[k + 1:, k])
        r = k + 1 + int(rest.argmax()) if len(rest) else k
        most = float(rest.max()) if len(rest) else 0.0
        size = 1
        if abs(a[k, k]) < alpha * most:
            column = np.abs(a[k:, r])
            column[r - k] = 0.0
            sigma = float(column.max())
            if abs(a[k, k]) * sigma >= alpha * most * most:
                pass
            elif abs(a[r, r]) >= alpha * sigma:
                _swap(a, k, r)
            else:
                _swap(a, k + 1, r)
                size = 2
        if size == 1:
            pivot = a[k, k]
            below += pivot < 0
            c = a[k + 1:, k].copy()
            if pivot:  # of a zero pivot the whole column is zero
                a[k + 1:, k + 1:] -= np.outer(c / pivot, c)
        else:
            block = a[k:k + 2, k:k + 2].copy()
            below += int((np.linalg.eigvalsh(block) < 0).sum())
            c = a[k + 2:, k:k + 2].copy()
            a[k + 2:, k + 2:] -= c @ np.linalg.solve(block, c.T)
        k += size
    return int(below)


def _swap(a: np.ndarray, i: int, j: int) -> None:
    if i != j:
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]


def _slices(a: np.ndarray, m: int, tolerance: float) -> list[tuple[float, float, int]]:
    """(low, high, count) from the largest eigenvalue down, ``m`` of them at least where there
    are so many: each slice holds ``count`` eigenvalues, one if they can be parted."""
    n = len(a)
    radius = np.abs(a).sum(axis=1) - np.abs(a.diagonal())
    low, high = float((a.diagonal() - radius).min()), float((a.diagonal() + radius).max())
    pad = max(abs(low), abs(high)) * 1e-6 + tolerance
    todo, out, found = [(low - pad, high + pad, 0, n)], [], 0  # how many are below either end
    while todo and found < m:
        low, high, under, upto = todo.pop()  # the highest slice is on top
        if upto == under:
            continue
        if upto - under == 1 or high - low <= tolerance:
            out.append((low, high, upto - under))
            found += upto - under
            continue
        middle = (low + high) / 2
        split = min(max(inertia(a, middle), under), upto)
        todo.append((low, middle, under, split))
        todo.append((middle, high, split, upto))
    return out


def _narrow(a: np.ndarray, low: float, high: float, width: float) -> tuple[float, float]:
    """The slice of a single eigenvalue, bisected to ``width``."""
    under = inertia(a, low)
    while high - low > width:
        middle = (low + high) / 2
        if inertia(a, middle) > under:
            high = middle
        else:
            low = middle
    return low, high


def _apart(v: np.ndarray, known: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for u in known:
            v = v - (u @ v) * u
    return v / np.linalg.norm(v)


def _solve(a: np.ndarray, shift: float, v: np.ndarray, scale: float) -> np.ndarray:
    """(a - shift)^-1 v up to its length; a shift on an eigenvalue is moved by a rounding step."""
    eye = np.eye(len(a))
    for step in (0.0, 4e-16, 1e-14):
        try:
            x = np.linalg.solve(a - (shift + step * scale) * eye, v)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(x).all() and x.any():
            return x
    return v


def _vector(a: np.ndarray, low: float, high: float, known: list[np.ndarray], scale: float, seed: int) -> tuple[float, np.ndarray, bool]:
    """Rayleigh quotient iteration from the middle of the slice, apart from the vectors ``known``;
    also whether it ended on an eigenvector inside the slice."""
    pad = 1e-13 * scale
    v = _apart(np.random.default_rng(seed).normal(size=len(a)), known)
    for _ in range(2):  # inverse iteration points the start at the slice
        v = _apart(_solve(a, (low + high) / 2, v, scale), known)
    value, ended = v @ a @ v, False
    for _ in range(STEPS):
        residual = np.linalg.norm(a @ v - value * v)
        if residual <= 1e-15 * scale * len(a) ** 0.5:
            ended = True
            break
        v = _apart(_solve(a, value, v, scale), known)
        value = v @ a @ v
    return value, v, bool(ended and low - pad <= value <= high + pad)


def leading(a: np.ndarray, m: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``m`` largest eigenvalues of the symmetric ``a``, falling, and their unit vectors as
    columns. Only eigenvalues above rounding (``len(a)`` steps of the largest) are returned."""
    n = len(a)
    a = (a + a.T) / 2
    scale = float(np.abs(a).sum(axis=1).max()) if n else 0.0
    if not scale:
        return np.empty(0), np.empty((n, 0))
    values: list[float] = []
    vectors: list[np.ndarray] = []
    for low, high, count in _slices(a, min(m, n), TOLERANCE * scale):
        for nth in range(count):
            # A group's vectors are any unit vectors of its space, each apart from those before.
            value, vector, inside = _vector(a, low, high, vectors, scale, nth)
            if not inside and count == 1:
                low, high = _narrow(a, low, high, 1e-10 * scale)
                value, vector, inside = _vector(a, low, high, vectors, scale, nth)
            if not inside and not low <= value <= high:
                raise ArithmeticError("no eigenvector in a slice that holds one")
            values.append(float(value))
            vectors.append(vector)
    order = np.argsort(-np.array(values), kind="stable")[:m]
    keep = [i for i in order if values[i] > n * np.finfo(float).eps * scale]
    out = np.array([values[i] for i in keep])
    gap = 4 * TOLERANCE * scale
    for k, e in enumerate(out.tolist(), 1):  # at most k - 1 eigenvalues are larger, at least k as large
        if n - inertia(a, e + gap) > k - 1 or n - inertia(a, e - gap) < k:
            raise ArithmeticError("the counts do not certify the number of an eigenvalue")
    q = np.array([vectors[i] for i in keep]).T.reshape(n, len(keep))
    return out, q * np.where(q[np.abs(q).argmax(axis=0), range(len(keep))] < 0, -1.0, 1.0) if len(keep) else q


def whole(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x), one row per input row whose vector is not null, not empty and holds no null,
    non-finite or larger entry than ``LARGEST``."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("c"))
    fit = F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    return rows.filter("c is not null and size(c) > 0").filter(F.coalesce(fit, F.lit(False))).select(
        "vec_id", F.transform("c", lambda c: (F.floor(c * SCALE) + OFFSET).cast("long")).alias("x"))


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows of the batch, matrix) for each length of vectors in it."""
    for batch in batches:
        lists = batch.column(column)
        flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        sizes = np.diff(offsets)
        for d in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == d)
            yield d, (batch, at), flat[(offsets[at][:, None] + np.arange(d)).reshape(-1)].reshape(-1, d)


def _sums(listed: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """The number of vectors of each length and their exact sums by dimension."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for d, _, x in _blocks(batches, 0):
            high = x >> LOW_BITS  # summed apart, so that neither sum leaves 64 bits
            part = [len(x), high.sum(axis=0), (x - (high << LOW_BITS)).sum(axis=0)]
            total[d] = [a + b for a, b in zip(total[d], part)] if d in total else part
        for d, (n, high, low) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n, np.int64)),
                                              pa.array(high.astype(np.int64)), pa.array(low.astype(np.int64))], ["dims", "i", "n", "high", "low"])

    parts = listed.select("x").mapInArrow(add, "dims int, i int, n long, high long, low long")
    out: dict[int, tuple[int, list[int]]] = {}
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    for r in parts.groupBy("dims", "i").agg(F.sum("n").alias("n"), wide("high"), wide("low")).orderBy("dims", "i").collect():
        out.setdefault(r["dims"], (r["n"], []))[1].append((int(r["high"]) << LOW_BITS) + int(r["low"]))
    return out


class _Centre:
    """The mean as a whole number and the rest below one, so that centring loses nothing."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.base = np.array([round(Fraction(s, n)) for s in sums], np.int64)
        self.left = [s - n * b for s, b in zip(sums, self.base.tolist())]
        self.rest = np.array([float(Fraction(r, n)) for r in self.left])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - self.rest

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n x - S)^2, exact; null where a long cannot hold it."""
        y = x - self.base
        top = int(np.abs(y).max(initial=0)) * self.n + max(map(abs, self.left))
        if top * top * x.shape[1] < 1 << 63:
            return ((self.n * y - np.array(self.left, np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * v - r) ** 2 for v, r in zip(row, self.left)) for row in y.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def _products(listed: DataFrame, project) -> dict[int, np.ndarray]:
    """For each length the sum over the list of the outer products of ``project(length, x)``:
    tasks sum whole matrices, which then meet row by row."""
    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for d, _, x in _blocks(batches, 0):
            y = project(d, x)
            total[d] = total[d] + y.T @ y if d in total else y.T @ y
        for d, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), d, np.int32)), pa.array(np.arange(len(m), dtype=np.int32)),
                                              pa.array([r.tobytes() for r in m], pa.binary())], ["dims", "i", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for d, i, v in zip(*(batch.column(c).to_pylist() for c in range(3))):
                v = np.frombuffer(v, np.float64)
                total[d, i] = total[d, i] + v if (d, i) in total else v
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in total], pa.int32()), pa.array([i for _, i in total], pa.int32()),
                                              pa.array([v.tobytes() for v in total.values()], pa.binary())], ["dims", "i", "v"])

    schema = "dims int, i int, v binary"
    rows = listed.select("x").mapInArrow(multiply, schema).repartition("dims", "i").mapInArrow(add, schema).collect()
    out: dict[int, dict[int, np.ndarray]] = {}
    for r in rows:
        out.setdefault(r["dims"], {})[r["i"]] = np.frombuffer(r["v"], np.float64)
    return {d: np.array([m[i] for i in range(len(m))]) for d, m in out.items()}


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): for each remaining
    row its projections on the leading ``components`` unit eigenvectors of the covariance of the
    fit list, over the root of their eigenvalues.

    Rows whose vector is null, empty or holds a null, non-finite or too large entry (see
    ``LARGEST``) are left out; null and repeated ids stay, each row by itself. Repeated vectors
    count once in the fit. Vectors of different lengths have fits of their own. Components
    without variance are left out (they cannot be whitened), so a table of one distinct vector
    gives no rows, like an empty one. ``deviation`` is null where a long cannot hold it.
    """
    rows = whole(vectors)
    listed = cut(rows.select("x").distinct())
    centres = {d: _Centre(n, s) for d, (n, s) in _sums(listed).items()}
    sent = vectors.sparkSession.sparkContext.broadcast(centres)
    covariance = {d: m / centres[d].n for d, m in _products(listed, lambda d, x: sent.value[d](x)).items()}
    fits = {}
    for d, v in covariance.items():
        e, q = leading(v, components)
        fits[d] = (q / np.sqrt(e), e / np.trace(v)) if len(e) else (np.empty((d, 0)), e)
    maps = vectors.sparkSession.sparkContext.broadcast({d: q for d, (q, _) in fits.items()})
    moments = _products(listed, lambda d, x: sent.value[d](x) @ maps.value[d])
    errors = {d: float(np.abs(m / centres[d].n - np.eye(len(m))).max()) for d, m in moments.items() if len(m)}
    shares = {d: s for d, (_, s) in fits.items()}

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, (batch, at), x in _blocks(batches, 1):
            centre, q = sent.value[d], maps.value[d]
            k = q.shape[1]
            if not k:
                continue
            white = centre(x) @ q
            ids = batch.column(0).take(pa.array(at))
            every = pa.array(np.repeat(np.arange(len(at)), k))
            yield pa.RecordBatch.from_arrays([
                ids.take(every), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(len(every), centre.n, np.int64)),
                pa.array(centre.deviation(x), pa.int64()).take(every), pa.array(white.reshape(-1)), pa.array(np.tile(shares[d], len(at))),
                pa.array(np.full(len(every), errors[d]))], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(
        project, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")

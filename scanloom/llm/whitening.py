"""Whitening of embeddings: blockwise QR, Householder bidiagonalization, dqds, twisted factorizations.

Components are scaled to whole numbers x = floor(256 * c), and statistics are over the distinct x vectors. Centred
rows are reduced to one triangle R by QR factorizations of blocks, in tasks and then over the tasks' triangles, a
bounded number at a time. R is as large as the dimension squared and is all that the driver gets: it brings R to
bidiagonal form, finds its singular values by differential qd transforms with shifts, and the directions of the
largest ones by twisted factorizations. Neither products of rows nor squares of singular values in R are formed
before, so small directions keep their accuracy.

Vectors that are null or empty or hold null or non-finite components (or any of 2**37 or more in size), and vectors
that don't have the most frequent length (ties: the longer), are dropped. Rows that share a vector or an id, or have no
id, are whitened one by one. A component along which the fit rows don't vary gives 0 for all rows; so does a fit list
of one row. Fewer dimensions than components wanted: one component for each. An empty table gives no rows; other
columns are left behind, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from scanloom.llm import texts

SCALE, MOST_SIZE, COMPONENTS = 256, 1 << 37, 4
BLOCK_ROWS, FAN_IN = 4096, 32
EPS = np.finfo(float).eps


# ------------------------------------------------------------------ vectors as whole numbers
def _whole(vectors: pa.Array, dimension: int) -> np.ndarray:
    return np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64).reshape(-1, dimension)


def _usable(vector: Column) -> Column:
    return (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(MOST_SIZE)))


def whole_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """Id and usable vector of each row that is left (vec_id, v), and the dimension (0: no rows)."""
    kept = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & _usable(F.col("v")))
    common = kept.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    dimension = common["size"] if common else 0
    return kept.where(F.size("v") == dimension), dimension


# ------------------------------------------------------------------ bidiagonal qd
def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right vectors V of r = U B V' by Householder reflections."""
    a, d = r.astype(float).copy(), r.shape[1]
    v = np.eye(d)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        largest = np.abs(x).max(initial=0.0)
        if not largest:
            return None
        h = x / largest
        h[0] += np.copysign(np.linalg.norm(h), h[0])
        return h / np.linalg.norm(h)

    for k in range(d):
        if (h := reflector(a[k:, k])) is not None:
            a[k:, k:] -= 2 * np.outer(h, h @ a[k:, k:])
        if k < d - 2 and (h := reflector(a[k, k + 1:])) is not None:
            a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ h, h)
            v[:, k + 1:] -= 2 * np.outer(v[:, k + 1:] @ h, h)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _transformed(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """One dqds step and its differences; a negative one, the last, says that the shift was too large."""
    d, new_q, new_e, differences = q[0] - shift, [], [], []
    for k in range(len(e)):
        differences.append(d)
        if d < 0:
            break
        top = d + e[k]
        ratio = q[k + 1] / top if top else 0.0
        new_q.append(top)
        new_e.append(e[k] * ratio)
        # A zero decouples the rows above: the next ones begin anew.
        d = (d * ratio if top else q[k + 1]) - shift
    else:
        differences.append(d)
    return new_q + [d], new_e, differences


def singular_squares(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix, largest first, by dqds."""
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    if not scale:
        return np.zeros(len(diagonal))
    q, e = (((x / scale) ** 2).tolist() for x in (diagonal, above))
    total, found, safe, turn = 0.0, [], 0.0, True
    while q:
        if len(q) == 1 or e[-1] <= (10 * EPS) ** 2 * (total + q[-1]):
            found.append(total + q.pop())
            e, safe, turn = e[:-1], 0.0, True
            continue
        if turn and 1.5 * q[0] < q[-1]:  # the smallest value is sought at the end
            q.reverse()
            e.reverse()
        turn = False
        # First the smaller eigenvalue of the corner; if that is too large by a little, less what was too much; then a
        # bound that always holds (the trace of the inverse, from the differences of the step before); then none.
        half = (q[-2] + e[-1] - q[-1]) / 2
        corner = q[-2] * q[-1] / ((q[-2] + e[-1] + q[-1]) / 2 + np.hypot(half, np.sqrt(q[-1] * e[-1]))) if q[-1] else 0.0
        shift = corner if corner > EPS * total else 0.0
        step = _transformed(q, e, shift)
        if step[2][-1] < 0 and len(step[2]) == len(q) and 0 < shift + step[2][-1]:
            shift += step[2][-1] * (1 + 4 * EPS)
            step = _transformed(q, e, max(0.0, shift))
        if step[2][-1] < 0:
            shift = safe * (1 - 1e-10)
            step = _transformed(q, e, shift)
        if step[2][-1] < 0:
            shift = 0.0
            step = _transformed(q, e, shift)
        q, e, differences = step
        total += max(0.0, shift)
        safe = 1 / sum(1 / d for d in differences) if min(differences) > 0 else 0.0
    return np.sort(np.array(found))[::-1] * scale ** 2


def _twisted(diagonal: np.ndarray, above: np.ndarray, value: float) -> np.ndarray:
    """Unit eigenvector of B'B for the eigenvalue ``value``: stationary and progressive factorizations meet where the residual is least."""
    n = len(diagonal)
    small = EPS * max(np.abs(diagonal).max(), np.abs(above).max(initial=0.0))
    a = np.where(np.abs(diagonal) < small, small, diagonal)
    d, l = a * a, above / a[:-1]
    tiny = small * small
    down, up, s, p = np.zeros(n - 1), np.zeros(n - 1), np.full(n, -value), np.zeros(n)
    for k in range(n - 1):
        pivot = d[k] + s[k]
        pivot = pivot if abs(pivot) > tiny else tiny
        down[k] = d[k] * l[k] / pivot
        s[k + 1] = down[k] * l[k] * s[k] - value
    p[-1] = d[-1] - value
    for k in range(n - 2, -1, -1):
        pivot = d[k] * l[k] * l[k] + p[k + 1]
        pivot = pivot if abs(pivot) > tiny else tiny
        ratio = d[k] / pivot
        up[k] = l[k] * ratio
        p[k] = p[k + 1] * ratio - value
    z = np.zeros(n)
    twist = int(np.argmin(np.abs(s + p + value)))
    z[twist] = 1.0
    for k in range(twist - 1, -1, -1):
        z[k] = -down[k] * z[k + 1]
    for k in range(twist, n - 1):
        z[k + 1] = -up[k] * z[k]
    largest = np.abs(z).max()
    return z / largest / np.linalg.norm(z / largest) if np.isfinite(largest) else np.full(n, np.nan)


def directions(diagonal: np.ndarray, above: np.ndarray, squares: np.ndarray, most: int) -> np.ndarray:
    """Orthonormal eigenvectors (columns) of B'B for the ``most`` largest values."""
    n = len(diagonal)
    if not squares.any():
        return np.eye(n)[:, :most]
    gram = np.diag(diagonal ** 2) + np.diag(np.append(0.0, above ** 2)) if n > 1 else np.diag(diagonal ** 2)
    if n > 1:
        gram = gram + np.diag(diagonal[:-1] * above, 1) + np.diag(diagonal[:-1] * above, -1)
    out, scale, rng = np.zeros((n, 0)), max(float(squares[0]), np.finfo(float).tiny), np.random.default_rng(0)

    def cleared(z: np.ndarray) -> np.ndarray:
        for _ in range(2):
            z = z - out @ (out.T @ z)
        return z

    for value in squares[:most]:
        z = _twisted(diagonal, above, float(value)) if n > 1 else np.ones(1)
        close = np.isfinite(z).all() and np.linalg.norm(cleared(z)) > 0.999
        if not close or np.linalg.norm(gram @ z - value * z) > 1e-12 * scale:
            # Values too close for one vector each (repeated ones): inverse iteration beside the vectors found.
            z, shifted = cleared(rng.standard_normal(n)), gram - value * (1 + 4 * EPS) * np.eye(n) - 4 * EPS * scale * np.eye(n)
            for _ in range(4):
                z = cleared(np.linalg.solve(shifted, z / np.linalg.norm(z)))
        z = cleared(z)
        out = np.column_stack([out, z / np.linalg.norm(z)])
    return out


# ------------------------------------------------------------------ fit and transform
@dataclass(frozen=True)
class Whitening:
    """Exact count and sums of the fit list, its leading eigenvalues and unit eigenvectors (columns), and all of the trace."""
    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: whole parts are taken off exactly."""
        whole, rest = zip(*(divmod(s, self.n) for s in self.sums))
        return (x - np.array(whole, np.int64)).astype(float) - np.array([r / self.n for r in rest])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors * np.where(self.values > 0, 1 / np.sqrt(np.where(self.values > 0, self.values, 1.0)), 0.0))

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n*x - S)**2, exact."""
        n, size = self.n, int(np.abs(x).max(initial=0))
        fits = x.shape[1] * size * max(size, max(map(abs, self.sums))) < 1 << 62
        x, s = (x, np.array(self.sums, np.int64)) if fits else (x.astype(object), np.array(self.sums, object))
        squares, products, constant = (x * x).sum(axis=1).tolist(), (x @ s).tolist(), sum(v * v for v in self.sums)
        return [n * n * a - 2 * n * b + constant for a, b in zip(squares, products)]


def fit_list(rows: DataFrame, dimension: int) -> DataFrame:
    """Each distinct whole vector once (x, bytes of 8 a component or as few as its largest one takes), written."""
    def run(batches):
        for batch in batches:
            x = _whole(batch.column("v"), dimension)
            size = np.maximum(x, -1 - x).max(axis=1, initial=0)
            yield pa.RecordBatch.from_arrays([pa.array([v.astype("<i2" if m < 1 << 15 else "<i4" if m < 1 << 31 else "<i8").tobytes() for v, m in zip(x, size.tolist())], pa.binary())], ["x"])

    return texts.written(rows.select("v").mapInArrow(run, "x binary").distinct())


def _blocks(batches, dimension: int):
    """Whole vectors of up to ``BLOCK_ROWS`` rows at a time."""
    held: list[np.ndarray] = []
    for batch in batches:
        held += [np.frombuffer(b, f"<i{len(b) // dimension}").astype(np.int64) for b in batch.column("x").to_pylist()]
        while len(held) >= BLOCK_ROWS:
            yield np.stack(held[:BLOCK_ROWS])
            held = held[BLOCK_ROWS:]
    if held:
        yield np.stack(held)


def _moments(fit: DataFrame, dimension: int) -> tuple[int, tuple[int, ...]]:
    def run(batches):
        n, sums = 0, [0] * dimension
        for x in _blocks(batches, dimension):
            n, sums = n + len(x), [a + b for a, b in zip(sums, x.sum(axis=0).tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dimension), pa.int32()), pa.array([Decimal(v) for v in (n, *sums)], pa.decimal128(38, 0))], ["place", "value"])

    got = {r["place"]: int(r["value"]) for r in fit.mapInArrow(run, "place int, value decimal(38,0)").groupBy("place").agg(F.sum("value").alias("value")).collect()}
    return got.get(-1, 0), tuple(got.get(k, 0) for k in range(dimension))


def _triangle(fit: DataFrame, centre: Whitening, dimension: int) -> np.ndarray:
    """R of the centred fit rows: blocks in tasks, then triangles of up to ``FAN_IN`` tasks at a time."""
    def first(batches):
        r = np.zeros((0, dimension))
        for x in _blocks(batches, dimension):
            r = np.linalg.qr(np.vstack([r, centre.centred(x)]), mode="r")
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["task", "r"])

    def again(batches):
        r = np.zeros((0, dimension))
        for batch in batches:
            for raw in batch.column("r").to_pylist():
                r = np.linalg.qr(np.vstack([r, np.frombuffer(raw).reshape(-1, dimension)]), mode="r")
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["task", "r"])

    level = texts.written(fit.mapInArrow(first, "task long, r binary"))
    left = level.count()
    while left > 1:
        left = -(-left // FAN_IN)
        level = level.repartition(left).mapInArrow(again, "task long, r binary")
    rows = [np.frombuffer(row["r"]).reshape(-1, dimension) for row in level.collect()]  # one triangle
    r = np.linalg.qr(np.vstack([np.zeros((dimension, dimension)), *rows]), mode="r")
    return r


def fitted(fit: DataFrame, dimension: int, components: int = COMPONENTS) -> Whitening:
    n, sums = _moments(fit, dimension)
    centre = Whitening(n, sums, np.zeros(0), np.zeros((dimension, 0)), 0.0)
    diagonal, above, right = bidiagonal(_triangle(fit, centre, dimension))
    squares = singular_squares(diagonal, above)
    squares = np.where(squares <= (EPS * dimension) ** 2 * squares[0], 0.0, squares)
    vectors = right @ directions(diagonal, above, squares, min(components, dimension))
    return Whitening(n, sums, squares[:components] / n, vectors, float(squares.sum()) / n)


def identity_error(fit: DataFrame, model: Whitening, dimension: int) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, over components that vary."""
    k = len(model.values)

    def run(batches):
        first, second = np.zeros(k), np.zeros((k, k))
        for x in _blocks(batches, dimension):
            w = model.whitened(x)
            first, second = first + w.sum(axis=0), second + w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k + k * k), pa.int32()), pa.array(np.concatenate([first, second.ravel()]))], ["place", "value"])

    got = {r["place"]: r["value"] for r in fit.mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()}
    total = np.array([got[p] for p in range(k + k * k)]) / model.n
    varies = model.values > 0
    off = total[k:].reshape(k, k) - np.outer(total[:k], total[:k]) - np.eye(k)
    return float(np.abs(off[np.ix_(varies, varies)]).max(initial=0.0))


def whiten(df: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained, identity_error of each row and component."""
    rows, dimension = whole_vectors(df, key, vector)
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not dimension:
        return df.sparkSession.createDataFrame([], schema)
    fit = fit_list(rows, dimension)
    model = fitted(fit, dimension, components)
    error, k = identity_error(fit, model, dimension), len(model.values)
    explained = model.values / model.trace if model.trace else np.zeros(k)

    def run(batches):
        for batch in batches:
            x = _whole(batch.column("v"), dimension)
            at = pa.array(np.repeat(np.arange(len(x)), k))
            deviation = pa.array([Decimal(v) for v in model.deviations(x)], pa.decimal128(38, 0))
            columns = [batch.column("vec_id").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(at), model.n)), deviation.take(at),
                       pa.array(model.whitened(x).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(at), error))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)

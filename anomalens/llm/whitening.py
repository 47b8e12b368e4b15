"""Whitening of embeddings by a bidiagonal qd solver.

1. Entries become whole numbers, floor(``scale`` * entry). The fit list holds every
   distinct vector once; its count and sums are exact.
2. Blockwise QR reduces the centred rows of the fit list: every task keeps one
   triangle, triangles meet ``FAN`` at a time in further rounds, and only the last one,
   d x d, comes to the driver. No task and no round holds more than ``FAN`` triangles.
3. Householder reflections bring the triangle to bidiagonal form. Its singular values
   come from dqds, which has no subtraction and so keeps small ones to high relative
   accuracy; a component's direction comes from the twisted factorisation of the
   tridiagonal with the smallest twist, and goes back through the reflections.
4. Directions, a few numbers each, travel to the rows in the closure.

The error reported is measured over the fit list after the fact: the largest absolute
entry of the whitened covariance minus the identity, from blocks that are centred
before they are multiplied and merged pairwise.

Defined cases: rows whose vector is null or holds null or non-finite entries are
dropped; vectors of different lengths are whitened apart, each length with its own fit
list (no more than ``MOST_LENGTHS`` lengths and ``MOST_ENTRIES`` entries, else a
ValueError); an empty vector has no components and yields no row; a vector of d < 4
entries has d components; a direction without variance has ``whitened`` null and
``explained`` 0, and takes no part in the error, which is null if no direction has any;
a deviation beyond a long is null (``deviation_exact`` always has it);
repeated rows and null ids are returned as often as they come; an empty table gives an
empty result. Magnitudes of scaled entries must stay below 2^31, else a ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from anomalens.plans.storage import cut_lineage

COMPONENTS, SCALE, FAN = 4, 256, 16
MOST_LENGTHS, MOST_ENTRIES = 64, 2048
_BLOCK_NUMBERS = 1 << 20
_EPS = np.finfo(np.float64).eps


@dataclass(frozen=True)
class Whitening:
    """The fit of one vector length."""

    n: int
    sums: tuple[int, ...]
    directions: np.ndarray  # entries x components
    values: np.ndarray  # eigenvalues of the covariance; 0: no variance
    trace: float


def finite(vector: Column) -> Column:
    good = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(good, F.lit(False))


def scaled(vectors: DataFrame, id: str, vector: str, scale: int) -> DataFrame:
    """(id, x): the rows that take part, with whole numbers."""
    rows = vectors.select(F.col(f"`{id}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    return rows.filter(finite(F.col("v"))).select(
        "id", F.transform("v", lambda c: F.floor(c * F.lit(float(scale)))).alias("x"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def _by_length(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, positions, matrix) of the batch's vectors, in blocks of bounded size."""
    column = batch.column(batch.schema.get_field_index(name))
    sizes = np.diff(column.offsets.to_numpy())
    for size in np.unique(sizes):
        if not size:
            continue
        at = np.flatnonzero(sizes == size)
        for piece in np.array_split(at, max(1, -(-len(at) * int(size) // _BLOCK_NUMBERS))):
            yield int(size), piece, _matrix(column.take(pa.array(piece)), int(size))


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n with one rounding of an exact whole number. n * x fits a long: n
    is a count of distinct rows and x below 2^31."""
    return (n * x - sums) / n


def _triangle(blocks: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.concatenate(blocks), mode="r")


_TRIANGLES = "d int, r binary"


def _packed(triangles: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(triangles), pa.int32()),
                            pa.array([np.ascontiguousarray(r).tobytes() for r in triangles.values()], pa.binary())],
                           names=["d", "r"])


def _unpacked(r: bytes, d: int) -> np.ndarray:
    return np.frombuffer(r, np.float64).reshape(-1, d)


def _reduce_rows(fits: dict[int, tuple[int, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in _by_length(batch, "x"):
                block = centred(x, *fits[d])
                held[d] = _triangle([held[d], block] if d in held else [block])
        if held:
            yield _packed(held)
    return run


def _merge_triangles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for d, r in zip(batch.column(0).to_pylist(), batch.column(1)):
            new = _unpacked(r.as_py(), d)
            held[d] = _triangle([held[d], new]) if d in held else new
    if held:
        yield _packed(held)


def _one_triangle(fit: DataFrame, fits: dict[int, tuple[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """The triangle of each length; all rounds but the last run on the cluster."""
    found = cut_lineage(fit.mapInArrow(_reduce_rows(fits), _TRIANGLES))
    n = found.count()
    while n > FAN * len(fits):
        parts = -(-n // FAN)
        found = cut_lineage(found.repartition(parts).mapInArrow(_merge_triangles, _TRIANGLES))
        n = found.count()
    rows = found.repartition(1).mapInArrow(_merge_triangles, _TRIANGLES).collect()
    return {r.d: _unpacked(bytes(r.r), r.d) for r in rows}


# The solver, on one triangle.

def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, superdiagonal and right reflections (unit vectors) of the upper
    bidiagonal form of a matrix with no fewer columns than rows."""
    a = np.zeros((r.shape[1], r.shape[1]))
    a[:len(r)] = r
    d = len(a)
    right = []

    def reflection(x: np.ndarray) -> np.ndarray | None:
        norm = np.linalg.norm(x)
        if norm == 0.0:
            return None
        u = x / norm
        u[0] += np.copysign(1.0, u[0])
        return u / np.linalg.norm(u)
    for k in range(d):
        u = reflection(a[k:, k].copy())
        if u is not None:
            a[k:, k:] -= 2.0 * np.outer(u, u @ a[k:, k:])
        v = reflection(a[k, k + 1:].copy()) if k + 2 <= d else None
        full = np.zeros(d)
        if v is not None:
            a[k:, k + 1:] -= 2.0 * np.outer(a[k:, k + 1:] @ v, v)
            full[k + 1:] = v
        right.append(full)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float]:
    """One transform of the qd array with a shift, and the least diagonal met."""
    n = len(q)
    nq, ne = [0.0] * n, [0.0] * (n - 1)
    d = q[0] - shift
    least = d
    for i in range(n - 1):
        nq[i] = d + e[i]
        if nq[i] == 0.0:
            nq[i] = np.finfo(np.float64).tiny
        t = q[i + 1] / nq[i]
        ne[i] = e[i] * t
        d = d * t - shift
        if d < least:
            least = d
    nq[-1] = d
    return nq, ne, least


def singular_squares(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix, falling, by dqds."""
    out: list[float] = []
    stack = [([float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in above], 0.0)]
    while stack:
        q, e, sigma = stack.pop()
        sweeps = 0
        while q:
            if len(q) == 1:
                out.append(max(0.0, q[0] + sigma))
                break
            sweeps += 1
            # A negligible coupling splits the array.
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= (_EPS ** 2) * (sigma + q[i]) or e[i] == 0.0
                        or e[i] <= _EPS ** 2 * (sigma + q[i + 1])), None)
            if cut is not None:
                stack.append((q[:cut + 1], e[:cut], sigma))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            # Gershgorin below the least eigenvalue of the last two rows' block.
            a, b, c = q[-2], e[-1], q[-1]
            half = (a + b + c) / 2.0
            root = max(0.0, half * half - a * c) ** 0.5
            least = a * c / (half + root) if half + root > 0.0 else 0.0
            shift = min(least, c) * (0.98 if sweeps < 100 else 0.0)
            for _ in range(4):
                nq, ne, low = _dqds(q, e, shift)
                if low >= 0.0 or shift == 0.0:
                    break
                shift = shift * 0.25 if _ < 2 else 0.0
            q, e = nq, ne
            q[-1] = max(q[-1], 0.0)
            sigma += shift
            if q[0] < q[-1] * 0.25 and sweeps % 8 == 0:
                # A graded array the wrong way round converges from its other end.
                q, e = q[::-1], e[::-1]
    return np.sort(np.array(out))[::-1]


def twisted(diagonal: np.ndarray, above: np.ndarray, square: float) -> np.ndarray:
    """A unit vector z with B^T B z near ``square`` z, by the twisted factorisation of
    B^T B - square I whose twist is least."""
    n = len(diagonal)
    main = diagonal ** 2
    main[1:] += above ** 2
    off = diagonal[:-1] * above
    tiny = _EPS * max(float(np.max(np.abs(main))), np.finfo(np.float64).tiny)
    down, up = np.zeros(n), np.zeros(n)  # pivots from the top and from the bottom
    down[0], up[-1] = main[0] - square, main[-1] - square
    for i in range(1, n):
        pivot = down[i - 1] if abs(down[i - 1]) > tiny * _EPS else tiny * _EPS
        down[i] = main[i] - square - off[i - 1] ** 2 / pivot
    for i in range(n - 2, -1, -1):
        pivot = up[i + 1] if abs(up[i + 1]) > tiny * _EPS else tiny * _EPS
        up[i] = main[i] - square - off[i] ** 2 / pivot
    twist = down + up - (main - square)
    r = int(np.argmin(np.abs(twist)))
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        pivot = down[i] if abs(down[i]) > tiny * _EPS else tiny * _EPS
        z[i] = -off[i] * z[i + 1] / pivot
        if not np.isfinite(z[i]) or abs(z[i]) > 1e150:
            z /= np.max(np.abs(z[np.isfinite(z)]))
    for i in range(r + 1, n):
        pivot = up[i] if abs(up[i]) > tiny * _EPS else tiny * _EPS
        z[i] = -off[i - 1] * z[i - 1] / pivot
        if abs(z[i]) > 1e150:
            z /= np.max(np.abs(z))
    return z / np.linalg.norm(z)


def principal(r: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values, right singular vectors as columns) of a triangle, the
    largest first. The array is split where it is decoupled, so each twisted
    factorisation sees an unreduced block; vectors of close values are made orthogonal."""
    diagonal, above, right = bidiagonal(r)
    d = len(diagonal)
    scale = max(float(np.max(np.abs(diagonal), initial=0.0)), float(np.max(np.abs(above), initial=0.0)))
    if scale == 0.0:
        return np.zeros(min(components, d)), np.eye(d)[:, :min(components, d)]
    cuts = [0, *[i + 1 for i in range(d - 1) if abs(above[i]) <= _EPS * scale], d]
    found = []
    for a, b in zip(cuts, cuts[1:]):
        for value in singular_squares(diagonal[a:b], above[a:b - 1])[:components]:
            found.append((float(value), a, b))
    found.sort(key=lambda f: -f[0])
    values, vectors = [], []
    for value, a, b in found[:components]:
        z = np.zeros(d)
        z[a:b] = twisted(diagonal[a:b], above[a:b - 1], value)
        for _ in range(2):
            for w in vectors:
                z -= (w @ z) * w
            norm = np.linalg.norm(z)
            if norm < 0.5:  # as good as in the span of the ones before: start from an axis
                z = _inside(diagonal, above, value, a, b, vectors, d)
                norm = 1.0
            z /= norm
        values.append(value)
        vectors.append(z)
    out = np.stack(vectors, 1)
    for u in reversed(right):
        out -= 2.0 * np.outer(u, u @ out)
    return np.array(values), out / np.linalg.norm(out, axis=0)


def _inside(diagonal, above, value, a, b, vectors, d) -> np.ndarray:
    """Another eigenvector of a cluster: inverse iteration, orthogonal to the ones found."""
    n = b - a
    t = np.diag(diagonal[a:b] ** 2)
    if n > 1:
        t[range(1, n), range(1, n)] += above[a:b - 1] ** 2
        off = diagonal[a:b - 1] * above[a:b - 1]
        t[range(n - 1), range(1, n)] = t[range(1, n), range(n - 1)] = off
    # A little beside the value, so that the matrix is not singular.
    t[range(n), range(n)] -= value + 64 * _EPS * float(np.abs(t).max())
    z = np.zeros(d)
    z[a:b] = np.random.default_rng(7).standard_normal(n)
    for _ in range(4):
        for w in vectors:
            z -= (w @ z) * w
        z[a:b] = np.linalg.solve(t, z[a:b] / np.linalg.norm(z))
        z /= np.linalg.norm(z)
    for w in vectors:
        z -= (w @ z) * w
    return z / np.linalg.norm(z)


# Fit and use.

def fit_list(rows: DataFrame) -> DataFrame:
    """(x): every distinct vector once, written. Copies meet in a map-side combine."""
    return cut_lineage(rows.select("x").distinct())


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for d, _, x in _by_length(batch, "x"):
            if np.abs(x).max(initial=0) >= 1 << 31:
                raise ValueError("scaled entries must stay below 2^31")
            n, s = held.get(d, (0, np.zeros(d, np.int64)))
            held[d] = n + len(x), s + x.sum(axis=0)
    if held:
        yield pa.record_batch([pa.array(list(held), pa.int32()), pa.array([n for n, _ in held.values()], pa.int64()),
                               pa.array([s.tolist() for _, s in held.values()], pa.list_(pa.int64()))], names=["d", "n", "s"])


def fit(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """The whitening of every vector length in a fit list."""
    # A row per task, length and entry; the totals are as many as the entries of the lengths.
    part = rows.mapInArrow(_sums, "d int, n bigint, s array<bigint>")
    entries = part.select("d", "n", F.posexplode("s").alias("at", "s")).groupBy("d", "at").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"))
    totals = entries.groupBy("d").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "s"))).alias("s"))
    found = totals.limit(MOST_LENGTHS + 1).collect()
    if len(found) > MOST_LENGTHS or any(r.d > MOST_ENTRIES for r in found):
        raise ValueError(f"more than {MOST_LENGTHS} vector lengths or {MOST_ENTRIES} entries")
    fits = {r.d: (r.n, np.array([e.s for e in r.s], np.int64)) for r in found}
    out = {}
    for d, r in (_one_triangle(rows, fits) if fits else {}).items():
        n, sums = fits[d]
        squares, directions = principal(r, components)
        trace = float((r ** 2).sum()) / n
        values = squares / n
        values[values <= 64 * _EPS * max(trace, 0.0)] = 0.0
        out[d] = Whitening(n, tuple(int(s) for s in sums), directions, values, trace)
    return out


def _project(x: np.ndarray, w: Whitening) -> np.ndarray:
    """One column per component; NaN where there is no variance."""
    out = centred(x, w.n, np.array(w.sums)) @ w.directions
    return np.divide(out, np.sqrt(w.values), out=np.full_like(out, np.nan), where=w.values > 0)


def _moments(models: dict[int, Whitening]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for d, _, x in _by_length(batch, "x"):
                w = _project(x, models[d])[:, models[d].values > 0]
                mean = w.mean(axis=0)
                new = len(w), mean, (w - mean).T @ (w - mean)
                held[d] = merged(held[d], new) if d in held else new
        if held:
            yield pa.record_batch([
                pa.array(list(held), pa.int32()), pa.array([m[0] for m in held.values()], pa.int64()),
                pa.array([m[1].tolist() for m in held.values()], pa.list_(pa.float64())),
                pa.array([m[2].ravel().tolist() for m in held.values()], pa.list_(pa.float64()))],
                names=["d", "n", "mean", "m2"])
    return run


def merged(a, b):
    """Counts, means and centred products of two blocks together."""
    n, step = a[0] + b[0], b[1] - a[1]
    return n, a[1] + step * (b[0] / n), a[2] + b[2] + np.outer(step, step) * (a[0] * b[0] / n)


def _merge_moments(table: pa.Table) -> pa.Table:
    total = None
    for r in table.to_pylist():
        new = r["n"], np.array(r["mean"]), np.array(r["m2"]).reshape(len(r["mean"]), len(r["mean"]))
        total = new if total is None else merged(total, new)
    return pa.table({"d": table["d"][:1], "n": pa.array([total[0]], pa.int64()),
                     "mean": pa.array([total[1].tolist()], pa.list_(pa.float64())),
                     "m2": pa.array([total[2].ravel().tolist()], pa.list_(pa.float64()))})


def identity_errors(rows: DataFrame, models: dict[int, Whitening]) -> dict[int, float | None]:
    """Per length the largest absolute entry of the whitened covariance minus the
    identity; one row per task, merged in two rounds."""
    schema = "d int, n bigint, mean array<double>, m2 array<double>"
    part = cut_lineage(rows.mapInArrow(_moments(models), schema))
    some = part.groupBy("d", F.pmod(F.xxhash64("n", "mean", "m2"), F.lit(64)).alias("g")).applyInArrow(
        _merge_moments, schema)
    out = {}
    for r in some.groupBy("d").applyInArrow(_merge_moments, schema).collect():
        k = len(r["mean"])
        cov = np.array(r["m2"]).reshape(k, k) / r["n"]
        out[r["d"]] = float(np.abs(cov - np.eye(k)).max()) if k else None
    return out


def _deviations(x: np.ndarray, w: Whitening) -> list[int]:
    """Sum of (n * x - S)^2 per row, exact."""
    sums = np.array(w.sums, np.int64)
    gap = w.n * x - sums
    most = int(np.abs(gap).max(initial=0))
    if most * most * x.shape[1] < 1 << 63:
        return (gap * gap).sum(axis=1).tolist()
    return [sum(int(g) ** 2 for g in row) for row in gap]


def whiten(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS,
           scale: int = SCALE) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error,
    deviation_exact): one row per vector that takes part and component."""
    rows = scaled(vectors, id, vector, scale)
    distinct = fit_list(rows)
    models = fit(distinct, components)
    errors = identity_errors(distinct, models) if models else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in _by_length(batch, "x"):
                w = models[d]
                k = len(w.values)
                exact = _deviations(x, w)
                share = w.values / w.trace if w.trace > 0 else np.zeros(k)
                values = _project(x, w).ravel()
                yield pa.record_batch([
                    batch.column(0).take(pa.array(np.repeat(at, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * k, w.n, np.int64)),
                    pa.array([v if v < 1 << 63 else None for v in exact for _ in range(k)], pa.int64()),
                    pa.array(values, mask=np.isnan(values)), pa.array(np.tile(share, len(x))),
                    pa.array([errors.get(d)] * (len(x) * k), pa.float64()),
                    pa.array([str(v) for v in exact for _ in range(k)])],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error", "exact"])
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, "
                               "identity_error double, exact string")
    return out.select(F.col("id").alias(id), "component", "n", "deviation", "whitened", "explained", "identity_error",
                      F.col("exact").cast("decimal(38,0)").alias("deviation_exact"))

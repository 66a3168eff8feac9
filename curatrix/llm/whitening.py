"""Whitening of catalogue vectors.

Components of the stored vectors' grid values are found from their scatter: a
Cholesky factor with pivoting by the largest remaining diagonal, then one-sided
Jacobi rotations of the factor's own columns. The rotated columns' squared norms
are the eigenvalues of the scatter and the normalised columns its eigenvectors,
so the scatter is never squared nor rotated from both sides. The scatter itself
is summed by Spark: tasks emit its rows, groups of tasks are added, then all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import settle
from .common import key_type, quoted

# Grid x = floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
# Entries further out than this have no grid value that sums stay exact for.
FARTHEST = float(1 << 54)
# Rows worked on at once in a task, and partial sums added in one group.
ROWS, GROUP = 8192, 128
SWEEPS = 60
# Share of the largest variance under which a direction counts as having none:
# sums of a long table leave rounding errors of some 1e-14 of it.
NOISE = 1e-12
DIGITS = 38


def pivoted_cholesky(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with scatter[order][:, order] = L L^T, one column of L per
    pivot. Pivots end where the largest remaining diagonal falls under NOISE of
    the first, so a singular scatter gives a narrower L."""
    a = np.array(scatter, dtype=np.float64)
    d = len(a)
    order = np.arange(d)
    factor = np.zeros((d, d))
    left = a.diagonal().copy()
    least = NOISE * left.max(initial=0.0)
    for k in range(d):
        p = k + int(np.argmax(left[k:]))
        if not left[p] > least:
            return factor[:, :k], order
        for held in (order, left):
            held[[k, p]] = held[[p, k]]
        factor[[k, p]] = factor[[p, k]]
        a[[k, p]] = a[[p, k]]
        a[:, [k, p]] = a[:, [p, k]]
        factor[k, k] = np.sqrt(left[k])
        below = a[k + 1 :, k] - factor[k + 1 :, :k] @ factor[k, :k]
        factor[k + 1 :, k] = below / factor[k, k]
        left[k + 1 :] -= factor[k + 1 :, k] ** 2
    return factor, order


def _rounds(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Every two of n columns once, as rounds of disjoint pairs."""
    seats = list(range(n + n % 2))
    out = []
    for _ in range(len(seats) - 1):
        half = len(seats) // 2
        pairs = [(a, b) for a, b in zip(seats[:half], seats[:half - 1 : -1], strict=True) if max(a, b) < n]
        if pairs:
            out.append(tuple(np.array(p) for p in zip(*pairs, strict=True)))
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return out


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared norms, unit columns) of the factor's columns once rotations have
    made them orthogonal, by falling norm."""
    # Columns lie as rows, so that a rotation touches two runs of memory.
    g = np.ascontiguousarray(factor.T)
    n = len(g)
    enough = 4 * np.finfo(float).eps * max(1.0, np.sqrt(n))
    for _ in range(SWEEPS):
        turned = False
        for i, j in _rounds(n):
            x, y = g[i], g[j]
            xx, yy, xy = ((p * q).sum(axis=1) for p, q in ((x, x), (y, y), (x, y)))
            big = np.abs(xy) > enough * np.sqrt(xx * yy)
            if not big.any():
                continue
            turned = True
            i, j, x, y, xx, yy, xy = (v[big] for v in (i, j, x, y, xx, yy, xy))
            zeta = (yy - xx) / (2 * xy)
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s = (c * t)[:, None]
            c = c[:, None]
            g[i], g[j] = c * x - s * y, s * x + c * y
        if not turned:
            break
    norms = (g * g).sum(axis=1)
    order = np.argsort(-norms, kind="stable")
    norms, g = norms[order], g[order]
    return norms, (g / np.sqrt(norms)[:, None]).T


def components_of(scatter: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of scatter / n, largest first.
    Directions in which the scatter is zero are left out."""
    factor, order = pivoted_cholesky(scatter)
    norms, units = one_sided_jacobi(factor)
    back = np.empty_like(units)
    back[order] = units
    return norms / n, back


def grid_values(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(_key, _x array<long>): grid values of every usable vector, one row each."""
    v = F.col("_vec")
    near = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(FARTHEST)))
    rows = vectors.select(quoted(key).alias("_key"), quoted(vector).cast("array<double>").alias("_vec"))
    usable = rows.where(v.isNotNull() & near)
    # Held within bounds, as Spark may compute values of rows that the filter drops.
    held = lambda c: F.least(F.greatest(c, F.lit(-FARTHEST)), F.lit(FARTHEST))
    shifted = F.transform(v, lambda c: F.floor(held(c) * F.lit(float(SCALE))).cast("long") + F.lit(SHIFT))
    return usable.select("_key", shifted.alias("_x"))


def _matrices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            flat = part.column(part.schema.get_field_index(column)).flatten()
            yield part, flat.to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def _sum_of_rows(partial: DataFrame) -> np.ndarray:
    """Sum of matrices emitted as (part, i, row array<double>), one per task.
    Always added in the order of parts, so that results repeat."""

    def add(table: pa.Table) -> pa.Table:
        rows = np.array(table.column("row").to_pylist())
        rows = rows[np.argsort(table.column("part").to_numpy(), kind="stable")]
        return pa.table({
            "part": pa.array([table.column("part")[0].as_py() // GROUP], pa.int64()),
            "i": table.column("i").slice(0, 1),
            "row": pa.array([rows.sum(axis=0)], pa.list_(pa.float64())),
        })

    kind = "part long, i int, row array<double>"
    grouped = partial.groupBy("i", F.expr(f"part div {GROUP}")).applyInArrow(add, kind)
    # As many rows as a vector has entries, whatever the table holds.
    rows = grouped.groupBy("i").applyInArrow(add, kind).collect()
    return np.array([r["row"] for r in sorted(rows, key=lambda r: r["i"])])


def _product_rows(total: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if total is None:
        return
    part = TaskContext.get().partitionId()
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(total), part), pa.int64()),
            pa.array(np.arange(len(total)), pa.int32()),
            pa.array(list(total), pa.list_(pa.float64())),
        ],
        names=["part", "i", "row"],
    )


def _exact_sums(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """(rows, sum of every entry), exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * size
        for _, x in _matrices(batches, "_x"):
            n += len(x)
            # Two sums of 31 bits each cannot overflow in a block of rows.
            high, low = x >> 31, x & ((1 << 31) - 1)
            for j, (h, w) in enumerate(zip(high.sum(axis=0).tolist(), low.sum(axis=0).tolist(), strict=True)):
                total[j] += (h << 31) + w
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(-1, size), pa.int32()),
                pa.array([n, *total], pa.decimal128(DIGITS, 0)),
            ],
            names=["i", "total"],
        )

    partial = fit.mapInArrow(run, f"i int, total decimal({DIGITS},0)")
    rows = partial.groupBy("i").agg(F.sum("total").cast(f"decimal({DIGITS},0)").alias("total")).collect()
    sums = {r["i"]: int(r["total"]) for r in rows}
    return sums[-1], [sums[j] for j in range(size)]


class Centre:
    """Mean of the fit list as a whole number and a rest, so that centring loses
    nothing before values are multiplied."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        whole = [(2 * s + n) // (2 * n) for s in sums]
        self.whole = np.array(whole, dtype=np.int64)
        self.over = [s - n * w for s, w in zip(sums, whole, strict=True)]
        self.rest = np.array([o / n for o in self.over])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over entries of (n x - S)^2 of every row, as whole numbers."""
        near = x - self.whole
        n, over = self.n, self.over
        most = int(np.abs(near).max(initial=0))
        # n x - S = n near - over, and |over| <= n / 2.
        if most * max(most, n) * len(over) < 1 << 62:
            squares = np.square(near).sum(axis=1).tolist()
            mixed = (near @ np.array(over, dtype=np.int64)).tolist()
            constant = sum(o * o for o in over)
            return [n * n * s - 2 * n * m + constant for s, m in zip(squares, mixed, strict=True)]
        return [sum((n * a - o) ** 2 for a, o in zip(row, over, strict=True)) for row in near.tolist()]


def whiten_vectors(
    vectors: DataFrame,
    key: str = "item_id",
    vector: str = "vector",
    components: int = COMPONENTS,
) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): one
    row per usable vector of the catalogue's vector table and component.

    An entry c has the grid value x = floor(64 c) + 1000000. The distinct grid
    vectors, each once, are fitted: n of them with sums S. Components are unit
    eigenvectors of their covariance (divisor n, centred before multiplying),
    numbered from 1 by falling eigenvalue, at most `components`; directions
    without variance are no components, so fewer rows per vector come out of a
    table of fewer dimensions or fewer distinct vectors, and none where all grid
    vectors are equal. Either sign of a component may come out; it is one for all
    rows. deviation is the sum over entries of (n x - S)^2, a whole number of up
    to 38 digits, null where it has more; whitened is the centred vector's
    projection over the root of the eigenvalue; explained is the eigenvalue's
    share of the trace; identity_error is the largest entry, in amount, of the
    covariance of whitened over the fitted vectors minus the identity.

    Left out: vectors that are null or empty, hold a null or non-finite entry or
    one of 2^54 or more in amount, and those of another length than most rows
    have (of lengths equally frequent the least stays). Repeated rows count once
    in the fit and come out as often as they stand; null and repeated keys are
    kept; an empty table gives an empty result; further columns are left out.

    Only sums of the fixed vector length reach the driver. The distinct vectors
    are written once to the shared folder and read three times."""
    rows = grid_values(vectors, key, vector).where(F.size("_x") > 0)
    counted = rows.groupBy(F.size("_x").alias("size")).count()
    most = counted.agg(F.max(F.struct("count", (-F.col("size")).alias("size")))["size"].alias("size")).first()
    kind = key_type(rows)
    shape = (
        f"_key {kind}, component int, n long, deviation decimal({DIGITS},0), "
        "whitened double, explained double, identity_error double"
    )
    named = [
        F.col("_key").alias(key), "component", "n", "deviation", "whitened", "explained", "identity_error",
    ]
    if most["size"] is None:
        return vectors.sparkSession.createDataFrame([], shape).select(*named)
    size = -most["size"]
    rows = rows.where(F.size("_x") == size)
    # Spark merges equal vectors before the exchange, so copies stay cheap.
    fit = settle(rows.select("_x").distinct(), "grid")
    n, sums = _exact_sums(fit, size)
    centre = Centre(n, sums)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _matrices(batches, "_x"):
            y = centre.centred(x)
            total = y.T @ y if total is None else total + y.T @ y
        yield from _product_rows(total)

    partial = "part long, i int, row array<double>"
    scatter = _sum_of_rows(fit.mapInArrow(products, partial))
    values, units = components_of(scatter, n)
    held = min(components, len(values))
    trace = float(np.trace(scatter)) / n
    scaled = units[:, :held] / np.sqrt(values[:held])
    explained = values[:held] / trace if held else values[:0]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _matrices(batches, "_x"):
            w = centre.centred(x) @ scaled
            # Squares and, in the last row, plain sums.
            both = np.vstack([w.T @ w, w.sum(axis=0)])
            total = both if total is None else total + both
        yield from _product_rows(total)

    error = 0.0
    if held:
        whole = _sum_of_rows(fit.mapInArrow(spread, partial)) / n
        covariance = whole[:-1] - np.outer(whole[-1], whole[-1])
        error = float(np.abs(covariance - np.eye(held)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = 10**DIGITS
        for part, x in _matrices(batches, "_x"):
            if not held:
                continue
            w = centre.centred(x) @ scaled
            m = len(x)
            apart = [d if d < limit else None for d in centre.deviations(x)]
            at = pa.array(np.repeat(np.arange(m), held))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(at),
                    pa.array(np.tile(np.arange(1, held + 1), m), pa.int32()),
                    pa.array(np.full(m * held, n), pa.int64()),
                    pa.array(apart, pa.decimal128(DIGITS, 0)).take(at),
                    pa.array(w.reshape(-1)),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * held, error)),
                ],
                names=[
                    "_key", "component", "n", "deviation", "whitened", "explained", "identity_error",
                ],
            )

    return rows.mapInArrow(project, shape).select(*named)

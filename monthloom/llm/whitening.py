"""Whitening of vectors with eigenvectors found by contour integration (FEAST).

Two passes gather the covariance: exact integer sums, then products of integers centred at the rounded mean, in
one partial matrix per task. The matrix has a side per dimension, whatever the number of vectors, and is solved
where the job is declared: inertia counts of shifted factorisations isolate an interval that holds the wanted
eigenvalues, a quadrature of complex shifted solves around that interval projects a subspace onto it, and
Rayleigh-Ritz extracts the components. The inertia at both ends says how many eigenvalues there must be, so none
is missed. A third pass projects, a fourth verifies the covariance of what was projected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.llm.common import frugal, ship

#: x = floor(SCALE * c) + SHIFT
SCALE, SHIFT = 1024, 100_000
#: Components beyond this magnitude would not fit the integers; their rows are refused.
LARGEST = float(1 << 50)
#: The covariance matrix is solved in one place, so vectors may not be longer.
MOST_DIMENSIONS = 4096
NODES = 8
#: Eigenvalues below this share of the trace count as zero: such a component has no spread to scale.
NOTHING = 1e-13
CHUNK = 4096


def inertia_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix exceed ``shift``: the positive pivots of a symmetric
    factorisation of ``matrix - shift I`` with 1 x 1 and 2 x 2 pivots (Sylvester's law of inertia)."""
    a = matrix - shift * np.eye(len(matrix))
    scale = max(np.abs(a).max(initial=0.0), 1e-300)
    bound, count = (1 + np.sqrt(17)) / 8, 0
    while len(a):
        n = len(a)
        if n == 1:
            return count + int(a[0, 0] > 0)
        column = np.abs(a[1:, 0])
        r = int(column.argmax()) + 1
        largest = column[r - 1]
        if max(abs(a[0, 0]), largest) <= 1e-15 * scale:
            a = a[1:, 1:]  # a pivot of zero: the eigenvalue lies on the shift
            continue
        if abs(a[0, 0]) >= bound * largest:
            size = 1
        else:
            other = np.abs(np.delete(a[:, r], r)).max()
            if abs(a[0, 0]) * other >= bound * largest ** 2:
                size = 1
            elif abs(a[r, r]) >= bound * other:
                size, order = 1, [r, *range(1, r), 0, *range(r + 1, n)]
                a = a[np.ix_(order, order)]
            else:
                size, order = 2, [0, r, *range(2, r), *([1] if r > 1 else []), *range(r + 1, n)]
                a = a[np.ix_(order, order)]
        pivot, side, rest = a[:size, :size], a[size:, :size], a[size:, size:]
        if size == 1:
            count += int(pivot[0, 0] > 0)
            a = rest - side * (side.T / pivot[0, 0])
        else:
            determinant = pivot[0, 0] * pivot[1, 1] - pivot[0, 1] ** 2
            count += 1 if determinant < 0 else 2 * int(pivot[0, 0] > 0)
            a = rest - side @ np.linalg.solve(pivot, side.T)
        a = (a + a.T) / 2
    return count


def interval_for(matrix: np.ndarray, wanted: int) -> tuple[float, float, int]:
    """An interval whose eigenvalues are the ``wanted`` largest or, where the last of them stands in a cluster,
    that cluster too; and how many it holds. Its lower end lies in a gap between eigenvalues."""
    radius = np.abs(matrix).sum(axis=1).max()
    high = radius * (1 + 1e-12) + 1e-300
    low, top = -high, high  # at least `wanted` above low, fewer above top
    if inertia_above(matrix, low) <= wanted:
        return low, high, len(matrix)
    while top - low > 1e-9 * high:
        middle = (low + top) / 2
        if inertia_above(matrix, middle) >= wanted:
            low = middle
        else:
            top = middle
    # low is just below the last wanted eigenvalue; go down to the middle of the first gap
    count, step = inertia_above(matrix, low), 1e-6 * high
    while True:
        lower = inertia_above(matrix, low - step)
        if lower == count:
            return low - step / 2, high, count
        low, count = low - step, lower
        if count == len(matrix):
            return -high, high, count


def feast(matrix: np.ndarray, low: float, high: float, count: int, rounds: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs of a symmetric matrix in ``[low, high]``, by falling eigenvalue.

    ``count`` comes from the inertia at the ends. A contour much wider than the gap at its ends separates slowly, so
    an interval that does not converge is cut in two, each with its own inertia count and contour, until each
    has found as many eigenpairs as it must hold.
    """
    size = len(matrix)
    if count == 0:
        return np.zeros(0), np.zeros((size, 0))
    width = min(size, max(count + 4, 3 * count // 2))
    basis = np.random.default_rng(13).standard_normal((size, width))
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    centre, radius = (low + high) / 2, (high - low) / 2
    scale = np.abs(matrix).sum(axis=1).max()
    onto = np.zeros((size, size))
    for angle, weight in zip(np.pi / 2 * (nodes + 1), weights):  # the lower half circle gives the complex conjugate
        lead = radius * np.exp(1j * angle)
        onto += weight / 2 * np.real(lead * np.linalg.solve((centre + lead) * np.eye(size) - matrix, np.eye(size)))
    for turn in range(rounds):
        kept, size_of, _ = np.linalg.svd(onto @ basis, full_matrices=False)
        kept = kept[:, size_of > 1e-14 * size_of[0]] if size_of[0] > 0 else kept
        values, turned = np.linalg.eigh(kept.T @ matrix @ kept)  # Rayleigh-Ritz
        vectors = kept @ turned
        inside = (values >= low) & (values <= high)
        missing = np.linalg.norm(matrix @ vectors - vectors * values, axis=0)
        if inside.sum() == count and (missing[inside] <= 2e-14 * scale * np.sqrt(size)).all():
            order = np.argsort(-values[inside], kind="stable")
            return values[inside][order], vectors[:, inside][:, order]
        basis = vectors
        if basis.shape[1] < width:
            basis = np.c_[basis, np.random.default_rng(turn).standard_normal((size, width - basis.shape[1]))]
    if radius <= 1e-12 * scale:
        raise ArithmeticError(f"{int(inside.sum())} of {count} eigenvalues found in [{low}, {high}]")
    cuts = low + (high - low) * np.linspace(0.3, 0.7, 9)
    cut = cuts[np.abs(cuts[:, None] - values).min(axis=1).argmax()]  # away from the approximate eigenvalues
    above = count - (inertia_above(matrix, low) - inertia_above(matrix, cut))
    upper, lower = feast(matrix, cut, high, above, rounds), feast(matrix, low, cut, count - above, rounds)
    return np.concatenate([upper[0], lower[0]]), np.concatenate([upper[1], lower[1]], axis=1)


def leading_components(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues and unit eigenvectors (columns), at most ``wanted``; those that are zero are left out.

    Each vector's entry of largest magnitude is positive.
    """
    trace = float(np.trace(matrix))
    if trace <= 0:
        return np.zeros(0), np.zeros((len(matrix), 0))
    low, high, count = interval_for(matrix, min(wanted, len(matrix)))
    values, vectors = feast(matrix, low, high, count)
    keep = values[:wanted] > NOTHING * trace
    values, vectors = values[:wanted][keep], vectors[:, :wanted][:, keep]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values, vectors * signs


@dataclass
class Whitener:
    """What the fit leaves: count and integer sums, eigenvalues, components (columns) and the trace."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float


def _integers(column: pa.ListArray, size: int) -> np.ndarray:
    """Rows of x, missing trailing entries as those of 0."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.zeros((len(lengths), size))
    x[np.arange(size) < lengths[:, None]] = flat
    return np.floor(x * SCALE).astype(np.int64) + SHIFT


def _parts(batches: Iterator[pa.RecordBatch], column: str):
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            yield part, part.column(column)


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is neither null nor holds null or non-finite entries."""
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(F.col(vector).isNotNull() & ~odd)


def _summed(df: DataFrame, run, place: str) -> dict:
    """Sums of ``value`` by place, over partial tables of one bounded size per task."""
    rows = df.mapInArrow(frugal(run), f"{place}, value double").groupBy(*[p.split()[0] for p in place.split(", ")]).agg(
        F.sum("value").alias("value"))
    return {tuple(r)[:-1]: r["value"] for r in rows.collect()}


def fit(vectors: DataFrame, vector: str = "embedding", wanted: int = 8) -> Whitener | None:
    """Mean, covariance and leading components over all usable vectors; None if there are none."""
    ship(vectors.sparkSession)
    data = usable(vectors, vector).select(F.col(vector).cast("array<double>").alias("v"))
    shape = data.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d"),
                     F.max(F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0.0))).alias("top")).first()
    n, size = shape["n"], shape["d"] or 0
    if n == 0:
        return None
    if size > MOST_DIMENSIONS or shape["top"] > LARGEST:
        raise ValueError(f"vectors of {size} dimensions with entries up to {shape['top']} can't be whitened")
    if size == 0:
        return Whitener(n, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 0)), 0.0)

    def totals(batches):
        total = [0] * size  # Python integers: exact whatever the count
        for _, column in _parts(batches, "v"):
            total = [a + b for a, b in zip(total, _integers(column, size).sum(axis=0).tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(map(str, total), pa.string())], ["i", "s"])
    rows = (data.mapInArrow(frugal(totals), "i int, s string").groupBy("i")
            .agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())
    sums = [int(r["s"]) for r in sorted(rows)]
    middle = np.array([(2 * s + n) // (2 * n) for s in sums])  # the rounded mean
    rest = np.array([(s - int(m) * n) / n for s, m in zip(sums, middle)])
    upper = np.triu_indices(size)

    def products(batches):
        gram = np.zeros((size, size))
        for _, column in _parts(batches, "v"):
            y = (_integers(column, size) - middle).astype(np.float64) - rest
            gram += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)),
                                          pa.array(gram[upper])], ["i", "j", "value"])
    covariance = np.zeros((size, size))
    for (i, j), value in _summed(data, products, "i int, j int").items():
        covariance[i, j] = covariance[j, i] = value / n
    values, components = leading_components(covariance, wanted)
    return Whitener(n, np.array(sums, object), values, components, float(np.trace(covariance)))


def _whitened(fitted: Whitener, x: np.ndarray) -> np.ndarray:
    n = fitted.n
    middle = np.array([int(s) // n for s in fitted.sums], np.int64)
    rest = np.array([int(s) % n / n for s in fitted.sums])
    return ((x - middle).astype(np.float64) - rest) @ fitted.components / np.sqrt(fitted.values)


def _deviations(fitted: Whitener, x: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exactly; None where it does not fit 64 bits."""
    n, sums = fitted.n, fitted.sums
    reach = np.abs(x).max(initial=0) * n + max((abs(int(s)) for s in sums), default=0)
    if int(reach) ** 2 * max(1, x.shape[1]) < 1 << 62:
        return ((n * x - sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
    found = [sum((n * a - int(s)) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]
    return [f if f < 1 << 63 else None for f in found]


def identity_error(vectors: DataFrame, fitted: Whitener, vector: str = "embedding") -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, from all rows."""
    size, k = len(fitted.sums), len(fitted.values)
    if k == 0:
        return 0.0
    data = usable(vectors, vector).select(F.col(vector).cast("array<double>").alias("v"))
    place = [(i, j) for i in range(k) for j in range(i, k)] + [(i, -1) for i in range(k)]

    def products(batches):
        gram, total = np.zeros((k, k)), np.zeros(k)
        for _, column in _parts(batches, "v"):
            w = _whitened(fitted, _integers(column, size))
            gram += w.T @ w
            total += w.sum(axis=0)
        value = [gram[i, j] if j >= 0 else total[i] for i, j in place]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in place], pa.int32()), pa.array([j for _, j in place], pa.int32()),
                                          pa.array(value, pa.float64())], ["i", "j", "value"])
    found = _summed(data, products, "i int, j int")
    mean = np.array([found[i, -1] for i in range(k)]) / fitted.n
    return max(abs(found[i, j] / fitted.n - mean[i] * mean[j] - (i == j)) for i, j in place if j >= 0)


def whiten(vectors: DataFrame, wanted: int = 8, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per usable row and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Rows whose vector is null or holds null or non-finite entries are left out. Shorter vectors read as if
    filled up with zeros. Components number from 1 by falling eigenvalue; one of eigenvalue zero (fewer
    different vectors than components, constant dimensions) has no rows, so equal vectors throughout or an empty
    table give an empty result. Equal eigenvalues leave the choice of their components free. Repeated rows
    and ids each count and each return. ``deviation`` is exact, and null where 64 bits can't hold it.
    Vectors of more than ``MOST_DIMENSIONS`` entries or with entries beyond ``LARGEST`` raise an error.
    Other columns are not read.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double"
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    fitted = fit(rows, "v", wanted)
    if fitted is None or len(fitted.values) == 0:
        return spark.createDataFrame([], f"{schema}, identity_error double")
    size, k = len(fitted.sums), len(fitted.values)
    names, share = [f.strip().split()[0] for f in schema.split(",")], fitted.values / fitted.trace

    def run(batches):
        for part, column in _parts(batches, "v"):
            x = _integers(column, size)
            ids = part.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), k)))
            deviation = pa.array(_deviations(fitted, x), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, fitted.n)),
                 deviation, pa.array(_whitened(fitted, x).ravel()), pa.array(np.tile(share, len(x)))], names)
    data = usable(rows, "v").select("vec_id", F.col("v").cast("array<double>").alias("v"))
    return data.mapInArrow(frugal(run), schema).withColumn("identity_error", F.lit(identity_error(rows, fitted, "v")))

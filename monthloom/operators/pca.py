"""Principal components of ``features`` vectors, from one centred Gram matrix.

The matrix has a side per feature, whatever the number of rows: tasks add up their rows' products, a few tasks add up
those, and a symmetric eigen-solver works on the sum. Such a solver always converges, with constant, repeated or
collinear features too, where an SVD routine may give up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partial matrices are added up in so many tasks before they reach the driver.
ADDERS = 8


@dataclass(frozen=True)
class Components:
    """``mean`` and the orthonormal ``axes`` (columns) by falling ``variances``; the variances of all axes are kept."""

    n: int
    mean: np.ndarray
    axes: np.ndarray
    variances: np.ndarray


def _rows(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _gram(mean: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(mean), len(mean)))
        for batch in batches:
            centred = _rows(batch, len(mean)) - mean
            total += centred.T @ centred
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["gram"])
    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for part in batch.column("gram"):
            own = np.frombuffer(part.as_buffer(), np.float64)
            total = own.copy() if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["gram"])


def fit_components(df: DataFrame, k: int | None = None, column: str = "features") -> Components:
    """The ``k`` leading components of the vectors (all, if None), centred, not scaled; variances have divisor ``n - 1``.

    Axes without variance are completed to an orthonormal set, so ``k`` may exceed the rank; their values are 0 up to
    rounding. Each axis has a positive entry of largest magnitude.
    """
    if df.isEmpty():
        raise ValueError("no rows to find components of")
    first = df.agg(Summarizer.metrics("mean", "count").summary(F.col(column)).alias("s")).select("s.mean", "s.count").first()
    n, mean = first["count"], first["mean"].toArray()
    arrays = df.select(vector_to_array(column).alias("v"))
    partial = arrays.mapInArrow(_gram(mean), "gram binary").repartition(ADDERS).mapInArrow(_added, "gram binary")
    total = sum(np.frombuffer(bytes(r["gram"]), np.float64) for r in partial.collect()).reshape(len(mean), len(mean))
    covariance = total / max(n - 1, 1)
    scale = np.abs(covariance).max(initial=0.0) or 1.0  # neither huge nor tiny numbers meet the solver
    values, axes = np.linalg.eigh((covariance + covariance.T) / (2 * scale))
    order = np.argsort(-values, kind="stable")
    variances, axes = np.maximum(values[order], 0.0) * scale, axes[:, order[:k]]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    return Components(n, mean, axes, variances)


def project(df: DataFrame, fitted: Components, column: str = "features", out: str = "components") -> DataFrame:
    """``df`` with the array ``out`` of its rows' component values in place of the vectors."""
    rest = [f for f in df.schema.fields if f.name not in (column, out)]
    mean, axes = fitted.mean, fitted.axes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = (_rows(batch, len(mean)) - mean) @ axes
            ends = np.arange(len(values) + 1, dtype=np.int32) * axes.shape[1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in rest), pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))],
                [*(f.name for f in rest), out])
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest) + f"`{out}` array<double>"
    return df.select(*(f.name for f in rest), vector_to_array(column).alias("v")).mapInArrow(run, schema)

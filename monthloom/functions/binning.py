"""Right-closed binning of numeric columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interval_label(lo, hi) -> str:
    return f"({lo}, {hi}]"


def bin_labels(edges: Sequence) -> list[str]:
    return [interval_label(a, b) for a, b in zip(edges, edges[1:])]


def bin_right_closed(value: Column, edges: Sequence) -> Column:
    """Label ``(a, b]`` of the interval holding the value, NULL outside the edges."""
    if len(edges) < 2 or any(a >= b for a, b in zip(edges, edges[1:])):
        raise ValueError("edges must be at least two increasing numbers")
    out = F.when(value <= edges[0], F.lit(None).cast("string"))
    for a, b in zip(edges, edges[1:]):
        out = out.when(value <= b, interval_label(a, b))
    return out


def bin_equal_width(df: DataFrame, column: str, bins: int, output: str,
                    range_of: DataFrame | None = None) -> DataFrame:
    """Add ``output``: 1-based index among ``bins`` equal-width right-closed intervals.

    The observed range comes from a scalar subquery, so no row is joined; ``range_of`` may name a
    cheaper table with the same values to take it from. A constant column gets a range widened by
    0.1 % on both sides.
    """
    if bins < 1:
        raise ValueError("bins must be positive")
    mn, mx = F.min(column).cast("double"), F.max(column).cast("double")
    pad = lambda v: F.when(v == 0, 0.001).otherwise(F.abs(v) * 0.001)
    span = (df if range_of is None else range_of).agg(F.struct(
        F.when(mn == mx, mn - pad(mn)).otherwise(mn).alias("lo"),
        F.when(mn == mx, mx + pad(mx)).otherwise(mx).alias("hi"),
    ).alias("span")).scalar()
    x = F.col(column).cast("double")
    step = (span["hi"] - span["lo"]) / F.lit(float(bins))
    inner_edges = [F.lit(float(i)) * step + span["lo"] for i in range(1, bins)]
    index = F.lit(1)
    for edge in inner_edges:
        index = index + (x > edge).cast("int")
    return df.withColumn(output, F.when(x.isNotNull(), index))


def bin_column(df: DataFrame, column: str, bins, output: str, groups: Sequence) -> DataFrame:
    """``bins`` is ``'groups'``, ``'equal'`` (10 bins), a bin count, or a list of edges."""
    if bins == "groups":
        bins = list(groups)
    elif bins == "equal":
        bins = 10
    if isinstance(bins, int):
        indexed = bin_equal_width(df, column, bins, output)
        return indexed.withColumn(output, F.col(output).cast("string"))
    return df.withColumn(output, bin_right_closed(F.col(column), bins))

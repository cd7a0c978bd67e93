"""Metrics of predictions, as plain aggregates over ``label`` and ``pred``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _hit_rate(cls: int) -> Column:
    """Share of a class that was predicted right; NULL when the class is absent."""
    return F.avg(F.when(F.col("label") == cls, (F.col("pred") == cls).cast("int")))


def classification_metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``auc`` of the hard predictions (mean of both classes' hit rates) and ``accuracy``."""
    return df.groupBy(*by).agg(((_hit_rate(1) + _hit_rate(0)) / 2).alias("auc"),
                               F.avg((F.col("label") == F.col("pred")).cast("int")).alias("accuracy"))


def regression_metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``rmse`` and Pearson's r; r is NULL when label or prediction is constant."""
    y, p = F.col("label").cast("double"), F.col("pred").cast("double")
    spread = F.nullif(F.stddev_pop(y) * F.stddev_pop(p), F.lit(0.0))
    return df.groupBy(*by).agg(F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"),
                               (F.covar_pop(y, p) / spread).alias("pearson_r"))


def evaluate(df: DataFrame, is_clf: bool, by: Sequence[str] = ()) -> DataFrame:
    return classification_metrics(df, by) if is_clf else regression_metrics(df, by)


def baseline_metrics(dataset: DataFrame, is_clf: bool) -> DataFrame:
    """The dataset's naive baseline scored on validation and test."""
    scored = dataset.where(F.col("split").isin("val", "test")).withColumn("pred", F.col("baseline"))
    return evaluate(scored, is_clf, ["split"])


def confusion_matrix(df: DataFrame, classes: Sequence[int] = (0, 1)) -> DataFrame:
    """Counts for every (label, pred) pair of ``classes``, zero where none occurred. One pass."""
    pairs = [(a, b) for a in classes for b in classes]
    totals = df.agg(*[F.count_if((F.col("label") == a) & (F.col("pred") == b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return (totals.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("label"), F.lit(b).alias("pred"), F.col(f"c{i}").alias("n"))
        for i, (a, b) in enumerate(pairs)])).alias("r")).select("r.*"))


def misclassified(df: DataFrame) -> DataFrame:
    return df.where(F.col("label") != F.col("pred"))


def tagged(metrics: DataFrame, name: str, kind: str, family: str) -> DataFrame:
    """Metric rows with model or task name, ``predicted`` / ``baseline`` type and task family."""
    return metrics.withColumns({"name": F.lit(name), "type": F.lit(kind), "family": F.lit(family)})


def stack_metrics(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of metric tables; metrics a family lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

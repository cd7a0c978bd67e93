"""Prediction datasets: features before a target period, label and naive baseline."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.functions.binning import bin_column
from monthloom.functions.periods import PeriodSpec
from monthloom.functions.scalars import improved
from monthloom.model import AGE_GROUP_EDGES
from monthloom.operators.features import DEFAULT_FEATURES, FeatureSpec, fill_missing

KINDS = ("clf", "regr", "regrdiff")

# Periods of the task matrix as (months per period, 0-based start month of the target).
TASK_PERIODS = ((1, 11), (6, 6), (12, None))


@dataclass(frozen=True)
class Task:
    """One prediction task: ``kind`` of label at a period of ``n_months``."""

    kind: str
    n_months: int
    year: int
    start: int | None

    @property
    def name(self) -> str:
        return f"{self.kind}_{self.n_months}"

    @property
    def is_clf(self) -> bool:
        return self.kind == "clf"

    @property
    def period(self) -> PeriodSpec:
        return PeriodSpec(self.n_months)

    @property
    def target(self) -> int:
        return self.period.ordinal(self.year, self.start)


def task_matrix(year: int, periods=TASK_PERIODS, kinds: Sequence[str] = KINDS) -> list[Task]:
    return [Task(kind, n, year, start) for n, start in periods for kind in kinds]


def target_cells(period: PeriodSpec, target: int, measure: str = "rat_mean") -> tuple[str, str]:
    """Column names of the target period and of the one before it."""
    return f"{measure}_{period.suffix(target)}", f"{measure}_{period.suffix(target - 1)}"


def target_labels(period: PeriodSpec, target: int, measure: str = "rat:mean") -> tuple[str, str]:
    return period.label(measure, target), period.label(measure, target - 1)


def x_y_split(cells: DataFrame, target: int) -> tuple[DataFrame, DataFrame]:
    """Long cells before the target period, and from it on."""
    before = F.col("period_ord") < target
    return cells.where(before), cells.where(~before)


def select_columns(wide: DataFrame, keep) -> DataFrame:
    """Columns whose name satisfies ``keep``."""
    return wide.select([c for c in wide.columns if keep(c)])


def build_dataset(features: DataFrame, period: PeriodSpec, ordinals: Sequence[int], target: int, kind: str,
                  specs: Sequence[FeatureSpec] = DEFAULT_FEATURES, bins="groups", diff: float = 10,
                  measure: str = "rat_mean", require_prev: bool = False) -> DataFrame:
    """``id, sex, k, age_bin``, feature cells before ``target``, ``label`` and ``baseline``.

    ``features`` is an unfilled feature table. Kinds: ``clf`` labels an improvement by more than
    ``diff`` (baseline 0), ``regr`` is the value itself (baseline: previous period), ``regrdiff`` the
    change (baseline 0). Entities absent in the previous period count with its fill value unless
    ``require_prev``.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    if target not in ordinals or target - 1 not in ordinals:
        raise ValueError("the target period and the one before it must be among the features")
    current, previous = target_cells(period, target, measure)
    wide = features.where(F.col(previous).isNotNull()) if require_prev else features
    wide = fill_missing(wide, specs, period, ordinals)
    wide = bin_column(wide, "age", bins, "age_bin", AGE_GROUP_EDGES)
    curr, prev = F.col(current).cast("double"), F.col(previous).cast("double")
    if kind == "clf":
        label, baseline = improved(curr, prev, diff).cast("double"), F.lit(0.0)
    elif kind == "regr":
        label, baseline = curr, prev
    else:
        label, baseline = curr - prev, F.lit(0.0)
    x = [s.cell_name(period, o) for s in specs for o in ordinals if o < target]
    return wide.select("id", "sex", "k", "age_bin", *x, label.alias("label"), baseline.alias("baseline"))

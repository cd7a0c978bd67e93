"""Discrete time: months grouped into periods of ``n_months`` inside a year."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def month_index(year="year", mon="mon") -> Column:
    """Months since year 0; orders rows of an entity in time."""
    return F.col(year) * 12 + F.col(mon) - 1


def month_label(year="year", mon="mon") -> Column:
    """``2019 / 03``."""
    return F.format_string("%d / %02d", F.col(year), F.col(mon))


@dataclass(frozen=True)
class PeriodSpec:
    """Periods of ``n_months`` counted from January; the last one of a year may be short."""

    n_months: int

    def __post_init__(self):
        if not 1 <= self.n_months <= 12:
            raise ValueError(f"n_months must be between 1 and 12, got {self.n_months}")

    @property
    def per_year(self) -> int:
        return -(-12 // self.n_months)

    @property
    def yearly(self) -> bool:
        return self.n_months == 12

    # ---- columns -------------------------------------------------------
    def bucket(self, mon="mon") -> Column:
        return F.expr(f"(`{mon}` - 1) div {self.n_months}").cast("int")

    def ordinal_column(self, year="year", mon="mon") -> Column:
        """Running period number; consecutive periods differ by one, also across years."""
        if self.yearly:
            return F.col(year).cast("int")
        return (F.col(year) * self.per_year + self.bucket(mon)).cast("int")

    def label_column(self, feature, ordinal="period_ord") -> Column:
        """``rat:mean/2019/6/6`` or ``rat:mean/2019//yearly``."""
        what = F.lit(feature) if isinstance(feature, str) else feature
        o = F.col(ordinal)
        if self.yearly:
            return F.concat(what, F.lit("/"), o.cast("string"), F.lit("//yearly"))
        start = (o % self.per_year) * self.n_months
        return F.concat(
            what, F.lit("/"), F.floor(o / self.per_year).cast("string"), F.lit("/"),
            start.cast("string"), F.lit(f"/{self.n_months}"))

    # ---- plain numbers -------------------------------------------------
    def ordinal(self, year: int, start: int | None = None) -> int:
        """Ordinal of the period that begins ``start`` months (0-based) into ``year``."""
        return year * self.per_year + (0 if self.yearly else (start or 0) // self.n_months)

    def of_month(self, year: int, mon: int) -> int:
        return self.ordinal(year, mon - 1)

    def start(self, ordinal: int) -> tuple[int, int | None]:
        year, bucket = divmod(ordinal, self.per_year)
        return year, None if self.yearly else bucket * self.n_months

    def suffix(self, ordinal: int) -> str:
        """Column-name suffix: ``2019_6``, or ``2019`` for whole years."""
        year, start = self.start(ordinal)
        return str(year) if start is None else f"{year}_{start}"

    def label(self, feature: str, ordinal: int) -> str:
        year, start = self.start(ordinal)
        return f"{feature}/{year}//yearly" if start is None else f"{feature}/{year}/{start}/{self.n_months}"

    def span(self, first: tuple[int, int], last: tuple[int, int]) -> list[int]:
        """All ordinals from month ``first`` to month ``last``, both ``(year, mon)`` and inclusive."""
        return list(range(self.of_month(*first), self.of_month(*last) + 1))

    def observed_span(self, panel: DataFrame) -> list[int]:
        """Ordinals between the first and last month in the data (runs one two-value aggregate)."""
        o = self.ordinal_column()
        lo, hi = panel.agg(F.min(o), F.max(o)).first()
        return [] if lo is None else list(range(lo, hi + 1))


def parse_label(label="label") -> tuple[Column, Column]:
    """``(year, start month or NULL)`` read back from a feature label column."""
    parts = F.split(F.col(label), "/")
    return parts[1].try_cast("int"), parts[2].try_cast("int")

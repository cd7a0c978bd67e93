"""Entity-level repair of the panel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom.functions.scalars import (age_in, fingerprint, recode_flag, strictly_between,
                                         title_rank)
from monthloom.model import TEXT_COLUMNS, TITLES, WOMEN_TITLES
from monthloom.operators.skew import salted_join


@dataclass(frozen=True)
class CleaningRules:
    """``birth_fix='documented'``: a birth year is usable when the age it gives lies inside
    ``age_range``; other rows take the entity's greatest usable one. ``'as_coded'``: only missing
    years and ages up to the lower bound are replaced, by the entity's greatest year of any kind,
    so 0 stays and its rows fall to the age filter.

    ``wtit_source`` is the column women's titles are ranked from.
    """

    ref_year: int
    age_range: tuple[int, int] = (5, 110)
    birth_fix: str = "documented"
    wtit_source: str = "tit_code"

    def __post_init__(self):
        if self.birth_fix not in ("documented", "as_coded"):
            raise ValueError(f"unknown birth_fix {self.birth_fix!r}")

    def plausible(self, birth_year: Column) -> Column:
        """True when the year gives an age in range; false, never NULL, otherwise."""
        inside = strictly_between(age_in(self.ref_year, birth_year), *self.age_range)
        return F.coalesce(inside, F.lit(False))

    def keeps_own(self, birth_year: Column) -> Column:
        if self.birth_fix == "documented":
            return self.plausible(birth_year)
        return F.coalesce(age_in(self.ref_year, birth_year) > self.age_range[0], F.lit(False))

    def donor(self, birth_year: Column) -> Column:
        """What a row offers to the repair of its entity's other rows."""
        if self.birth_fix == "documented":
            return F.when(self.plausible(birth_year), birth_year)
        return birth_year


def conflicting_sex() -> Column:
    """Aggregate: more than one non-null sex in the group."""
    fp = fingerprint(F.col("sex"))
    return F.coalesce(F.min(fp) != F.max(fp), F.lit(False))


def drop_sex_changes(panel: DataFrame) -> DataFrame:
    """Remove every row of entities seen with more than one sex."""
    changed = panel.groupBy("id").agg(conflicting_sex().alias("conflict")).where("conflict").select("id")
    return salted_join(panel, changed, "id", "left_anti")


def fix_birth_years(panel: DataFrame, rules: CleaningRules) -> DataFrame:
    """Replace unusable birth years from the entity's own other rows."""
    b = F.col("birth_year")
    donors = (panel.groupBy("id")
              .agg(F.max(rules.donor(b)).alias("known_birth"), F.bool_or(~rules.keeps_own(b)).alias("gap"))
              .where("gap").select("id", "known_birth"))
    return (salted_join(panel, donors, "id", "left")
            .withColumn("birth_year", F.when(rules.keeps_own(b), b).otherwise(F.col("known_birth")))
            .drop("known_birth"))


def recode_rows(panel: DataFrame, rules: CleaningRules) -> DataFrame:
    """Row-local part of cleaning: flag recoding, text NULLs, title ranks."""
    return (panel
            .withColumn("flag", recode_flag(F.col("flag")))
            .na.fill("", list(TEXT_COLUMNS))
            .withColumn("tit", title_rank(F.col("tit_code"), TITLES))
            .withColumn("wtit", title_rank(F.col(rules.wtit_source), WOMEN_TITLES)))


def cleaning_exceptions(panel: DataFrame, rules: CleaningRules) -> DataFrame:
    """``id, conflict, known_birth`` of entities with several sexes or a row lacking a usable birth year.

    The aggregate combines map-side, so no entity's rows have to meet in one task.
    """
    b = F.col("birth_year")
    return (panel.groupBy("id")
            .agg(conflicting_sex().alias("conflict"),
                 F.max(rules.donor(b)).alias("known_birth"),
                 F.bool_or(~rules.keeps_own(b)).alias("gap"))
            .where("conflict or gap")
            .select("id", "conflict", "known_birth"))


def clean_panel(panel: DataFrame, rules: CleaningRules, exceptions: DataFrame | None = None) -> DataFrame:
    """Drop sex changes, repair birth years, filter ages, recode flags and titles.

    Only exceptional entities enter the join. Pass them as a stored table
    (``cut_lineage(cleaning_exceptions(...))``) and the planner knows their size: it broadcasts them
    when they are below ``spark.sql.autoBroadcastJoinThreshold`` and the panel is not shuffled at
    all. Without a stored table the join is salted, so that an entity with very many rows is spread
    over several tasks whatever runs on top of the join.
    """
    b = F.col("birth_year")
    if exceptions is None:
        joined = salted_join(panel, cleaning_exceptions(panel, rules), "id", "left")
    else:
        joined = panel.join(exceptions, "id", "left")
    repaired = (joined
                .where(~F.coalesce(F.col("conflict"), F.lit(False)))
                .withColumn("birth_year", F.when(rules.keeps_own(b), b).otherwise(F.col("known_birth")))
                .drop("conflict", "known_birth")
                .withColumn("age", age_in(rules.ref_year, F.col("birth_year")))
                .where(strictly_between(F.col("age"), *rules.age_range)))
    return recode_rows(repaired, rules)

"""Profiles of a panel: small tables describing entities, activity, titles and ratings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom.functions.periods import month_label
from monthloom.functions.scalars import is_active, or_none
from monthloom.model import K_FACTORS, TITLES, WOMEN_TITLES
from monthloom.operators.dedup import first_per_key


# ---- generic counting ------------------------------------------------------


def distinct_entities(panel: DataFrame, column: str = "id") -> DataFrame:
    """Number of distinct values, NULL counting as one."""
    return panel.select(column).distinct().agg(F.count("*").alias("n"))


def distinct_values(panel: DataFrame, column: str) -> DataFrame:
    return panel.select(column).distinct()


def counts(df: DataFrame, *by: str) -> DataFrame:
    """Rows per value; the discrete histogram."""
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def weighted_counts(df: DataFrame, by: str, weight: str) -> DataFrame:
    return df.groupBy(by).agg(F.sum(weight).alias("n"))


def category_counts(df: DataFrame, column: str, categories: Sequence, name: str = "category") -> DataFrame:
    """Rows per listed category, in the given order, zero when absent. One pass, one partial row per task."""
    totals = df.agg(*[F.count_if(F.col(column) == F.lit(c)).alias(f"c{i}") for i, c in enumerate(categories)])
    return (totals.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias(name), F.col(f"c{i}").alias("n"))
        for i, c in enumerate(categories)])).alias("r")).select("r.*"))


def histogram(df: DataFrame, column: str, lo: float, hi: float, width: float) -> DataFrame:
    """Fixed-width bins over ``[lo, hi]``, the last edge inclusive, empty bins included."""
    x = F.col(column)
    bins = int(-(-(hi - lo) // width))
    index = F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("long")
    found = (df.where((x >= lo) & (x <= hi)).groupBy(index.alias("bin")).agg(F.count("*").alias("n")))
    return (df.sparkSession.range(bins).withColumnRenamed("id", "bin")
            .join(found, "bin", "left")
            .select("bin", (F.col("bin") * width + lo).alias("bin_start"),
                    F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def grouped_histogram(df: DataFrame, column: str, width: float, *facets: str) -> DataFrame:
    """Counts per ``floor(x / width)`` within each facet combination."""
    return (df.where(F.col(column).isNotNull())
            .groupBy(*facets, F.floor(F.col(column) / F.lit(float(width))).alias("bin"))
            .agg(F.count("*").alias("n")))


def share(condition: Column) -> Column:
    return F.avg(F.when(condition, 1).otherwise(0))


# ---- demographics ------------------------------------------------------------


def country_counts(panel: DataFrame, min_entities: int | None = None, by_sex: bool = False) -> DataFrame:
    """Entities per country, largest first. Entities that moved count in each of their countries."""
    keys = ["sex", "fed"] if by_sex else ["fed"]
    per_country = panel.select("id", *keys).distinct().groupBy(*keys).agg(F.count("id").alias("n"))
    if min_entities is not None:
        per_country = per_country.where(F.col("n") > min_entities)
    return per_country.orderBy(F.desc("n"), *keys)


def birth_year_histogram(panel: DataFrame, lo: int = 1920, hi: int = 2010, width: int = 5) -> DataFrame:
    years = panel.where(F.col("birth_year") > 1900).select("id", "birth_year").distinct()
    return histogram(years, "birth_year", lo, hi, width)


def sex_counts(panel: DataFrame) -> DataFrame:
    return panel.select("id", "sex").distinct().groupBy("sex").agg(F.count("*").alias("n"))


def k_factor_counts(panel: DataFrame) -> DataFrame:
    """Entities by their highest K."""
    return category_counts(panel.groupBy("id").agg(F.max("k").alias("k")), "k", K_FACTORS, "k")


# ---- activity ------------------------------------------------------------------


def active_months(panel: DataFrame, only_active: bool = True) -> DataFrame:
    """Months per entity and sex: active ones, or all registered ones."""
    rows = panel.where(is_active(F.col("flag"))) if only_active else panel
    return rows.groupBy("id", "sex").agg(F.count("year").alias("months"))


def active_months_distribution(panel: DataFrame, only_active: bool = True) -> DataFrame:
    return counts(active_months(panel, only_active), "sex", "months")


def registered_and_active(panel: DataFrame) -> DataFrame:
    """Registered entities, active entities and active share per month."""
    active = is_active(F.col("flag")).cast("int")
    return (panel.groupBy("year", "mon")
            .agg(F.count("id").alias("registered"), F.sum(active).alias("active"), F.avg(active).alias("active_share"))
            .withColumn("ym", month_label()))


def games_histogram(panel: DataFrame, below: int = 22) -> DataFrame:
    return counts(panel.where((F.col("gms") > 0) & (F.col("gms") < below)), "gms")


def always_active(panel: DataFrame, periods: int, active: Column) -> DataFrame:
    """Entities active in at least ``periods`` rows."""
    return (panel.where(active).groupBy("id").agg(F.count("*").alias("active_periods"))
            .where(F.col("active_periods") >= periods))


def first_last_difference(rows: DataFrame, period: str, first, last, measure: str,
                          carry: Sequence[str] = ()) -> DataFrame:
    """Measure in the last minus the first period, for entities present in both.

    Conditional aggregation replaces the self-join; carried attributes come from the first period.
    """
    at = lambda p, c: F.max(F.when(F.col(period) == p, F.col(c)))
    return (rows.where(F.col(period).isin(first, last)).groupBy("id")
            .agg(at(first, measure).alias("a"), at(last, measure).alias("z"), *[at(first, c).alias(c) for c in carry])
            .where(F.col("a").isNotNull() & F.col("z").isNotNull())
            .select("id", *carry, (F.col("z") - F.col("a")).alias("diff")))


# ---- titles and ratings -----------------------------------------------------------


def entity_titles(panel: DataFrame) -> DataFrame:
    """One row per entity and title pair, with the sex first seen with it."""
    filled = panel.select("id", "year", "mon", or_none(F.col("wtit_code")).alias("wtit"),
                          or_none(F.col("tit_code")).alias("tit"), "sex")
    return first_per_key(filled, ["id", "wtit", "tit"]).select("id", "sex", "wtit", "tit")


def title_counts(panel: DataFrame) -> DataFrame:
    """Titles held: women by women's and by open titles, men by open titles. One pass."""
    views = [("F", "wtit", WOMEN_TITLES), ("M", "tit", TITLES), ("F", "tit", TITLES)]
    cells = [(sex, col, t) for sex, col, scale in views for t in scale]
    totals = entity_titles(panel).agg(*[
        F.count_if((F.col("sex") == sex) & (F.col(col) == t)).alias(f"c{i}") for i, (sex, col, t) in enumerate(cells)])
    return (totals.select(F.explode(F.array(*[
        F.struct(F.lit(sex).alias("sex"), F.lit(col).alias("scale"), F.lit(t).alias("title"), F.col(f"c{i}").alias("n"))
        for i, (sex, col, t) in enumerate(cells)])).alias("r")).select("r.*"))


def title_share(panel: DataFrame) -> DataFrame:
    """Share of titled entities by sex, by open and by women's titles."""
    return (entity_titles(panel).groupBy("sex")
            .agg(F.round(share(F.col("tit") != "None"), 2).alias("tit_share"),
                 F.round(share(F.col("wtit") != "None"), 2).alias("wtit_share")))


def group_rating(panel: DataFrame, title: str) -> DataFrame:
    """Mean rating per entity and title."""
    return panel.groupBy("id", or_none(F.col(title)).alias("title")).agg(F.avg("rat").alias("rat"))


def top_rows(panel: DataFrame, measure: str = "gms", n: int = 1) -> DataFrame:
    """Rows with the greatest measure; ties go to the smallest entity and earliest month."""
    return panel.orderBy(F.desc(measure), "id", "year", "mon").limit(n)

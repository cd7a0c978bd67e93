"""Year-over-year changes of yearly entity aggregates.

All years of an entity meet in one row: finished yearly aggregates are gathered by entity, one array of cells per year,
and changes, merged titles and labels are taken inside that row. No year is joined with another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom.functions.aggregates import longest
from monthloom.functions.binning import bin_equal_width
from monthloom.functions.scalars import age_in, longer_of, strictly_between

TITLE_COLUMNS = ("tit_code", "wtit_code", "otit", "foa")
MEASURES = ("rat:mean", "gms:sum", "gms:mean")


def yearly_aggregates(panel: DataFrame, strings: Sequence[str] = TITLE_COLUMNS) -> DataFrame:
    """Rating mean, games sum and mean, longest titles, by (id, year, sex, birth year)."""
    return (panel.na.fill("", list(strings)).groupBy("id", "year", "sex", "birth_year")
            .agg(F.avg("rat").alias("rat:mean"), F.sum("gms").alias("gms:sum"), F.avg("gms").alias("gms:mean"),
                 *[longest(F.col(c)).alias(c) for c in strings]))


def with_age_bins(yearly: DataFrame, ref_year: int, bins: int = 3, age_range=(0, 100),
                  panel: DataFrame | None = None) -> DataFrame:
    """Replace the birth year by an equal-width age bin (1-based).

    Given the ``panel`` behind the aggregates, the age range is read from its birth years, without
    aggregating first.
    """
    def aged(df):
        return (df.withColumn("age", age_in(ref_year, F.col("birth_year")))
                .where(strictly_between(F.col("age"), *age_range)))

    binned = bin_equal_width(aged(yearly), "age", bins, "age_bin", range_of=aged(yearly if panel is None else panel))
    return binned.drop("age", "birth_year")


def _cells(year: int) -> Column:
    return F.col(f"cells_{year}")


def yearly_cells(panel: DataFrame, ref_year: int, years: Sequence[int], strings: Sequence[str] = (), bins: int = 3,
                 age_range=(0, 100)) -> DataFrame:
    """``id`` and, for each of ``years``, ``cells_<year>``: its aggregates by sex and birth year, as an array of
    structs (``sex, age_bin``, measures, ``strings``), empty if there are none.

    Two shuffles: rows combined map-side by (id, year, sex, birth year), then finished cells by id. An entity's
    cells are bounded by its different sexes and birth years in ``age_range``, not by its rows. Age bins span the
    whole panel's ages. Rows without an id are left out.
    """
    wanted = panel.where(F.col("id").isNotNull() & F.col("year").isin(list(years)))
    yearly = with_age_bins(yearly_aggregates(wanted, strings), ref_year, bins, age_range, panel=panel)
    cell = F.struct("sex", "age_bin", *[F.col(f"`{c}`") for c in (*MEASURES, *strings)])
    return yearly.groupBy("id").agg(*[
        F.collect_list(F.when(F.col("year") == y, cell)).alias(f"cells_{y}") for y in years])


def _change_array(year: int, measures: Sequence[str] = MEASURES) -> Column:
    """Measures of ``year`` minus the year before, for all cells matching on sex and age bin."""
    def of(now):
        same = F.filter(_cells(year - 1), lambda then: (then["sex"] == now["sex"]) & (then["age_bin"] == now["age_bin"]))
        return F.transform(same, lambda then: F.struct(
            now["sex"].alias("sex"), now["age_bin"].alias("age_bin"),
            *[(now[m] - then[m]).alias(m) for m in measures]))
    return F.flatten(F.transform(_cells(year), of))


def changes(cells: DataFrame, year: int, measures: Sequence[str] = MEASURES) -> DataFrame:
    """``id, sex, age_bin`` and the change of each measure from the year before to ``year``.

    Cells without a partner, or without a sex, give no row.
    """
    return cells.select("id", F.explode(_change_array(year, measures)).alias("change")).select("id", "change.*")


def changes_with_strings(cells: DataFrame, year: int, first_year: int, second_year: int,
                         strings: Sequence[str] = TITLE_COLUMNS) -> DataFrame:
    """Changes with the entity's strings of two years, keeping the longer; ``first_year`` wins ties."""
    return (cells.select("id", _cells(first_year), _cells(second_year), F.explode(_change_array(year)).alias("change"))
            .select("id", _cells(second_year), "change", F.explode(_cells(first_year)).alias("x"))
            .select("id", "change", "x", F.explode(_cells(second_year)).alias("y"))
            .select("id", "change.*", *[longer_of(F.col(f"x.{c}"), F.col(f"y.{c}")).alias(c) for c in strings]))


def next_change_label(cells: DataFrame, year: int, measure: str = "rat:mean", threshold: float = 5,
                      strings: Sequence[str] = ()) -> DataFrame:
    """Changes of ``year`` labelled by whether the next year's change exceeds ``threshold``; one row per entity.

    ``strings`` are the longer ones of ``year - 1`` and ``year``. Entities with several rows keep the smallest by
    all columns: the parts vary independently, so that row is made of the smallest of each part.
    """
    titles = F.flatten(F.transform(_cells(year - 1), lambda x: F.transform(_cells(year), lambda y: F.struct(
        *[longer_of(x[c], y[c]).alias(c) for c in strings])))) if strings else F.array(F.struct(F.lit(0).alias("none")))
    following = F.transform(_change_array(year + 1, [measure]), lambda c: c[measure])
    one = cells.select("id", F.array_min(_change_array(year)).alias("change"), F.array_min(titles).alias("titles"),
                       F.size(following).alias("n_next"), F.array_min(following).alias("next_change"))
    return one.where("change IS NOT NULL AND titles IS NOT NULL AND n_next > 0").select(
        "id", "change.*", *[F.col(f"titles.{c}").alias(c) for c in strings],
        (F.col("next_change") > threshold).cast("int").alias("label"))


def change_histograms(cells: DataFrame, years: Sequence[int], widths: dict[str, float]) -> DataFrame:
    """Counts per ``floor(change / width)`` for every year and measure, by sex and age bin, in one pass."""
    def binned(year):
        return F.transform(_change_array(year, list(widths)), lambda c: F.array(*[
            F.struct(F.lit(year).alias("year"), F.lit(m).alias("measure"), c["sex"].alias("sex"), c["age_bin"].alias("age_bin"),
                     F.floor(c[m].cast("double") / F.lit(float(w))).alias("bin")) for m, w in widths.items()]))

    measured = F.flatten(F.array(*[binned(y) for y in years]))
    return (cells.select(F.explode(F.flatten(measured)).alias("c")).select("c.*").where("bin IS NOT NULL")
            .groupBy("year", "measure", "sex", "age_bin", "bin").agg(F.count("*").alias("n")))

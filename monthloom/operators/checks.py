"""Consistency of entity attributes over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.operators.dedup import first_per_key, mark_repeats, repeated_groups
from monthloom.operators.skew import salted_join


def attribute_variants(panel: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Distinct attribute values per entity, with the month each was first seen."""
    return (panel.groupBy("id", *attributes)
            .agg(F.min(F.struct("year", "mon")).alias("seen"))
            .select("id", *attributes, F.col("seen.year").alias("first_year"), F.col("seen.mon").alias("first_mon")))


def attribute_changes(panel: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """All variants of entities that show more than one, sorted by entity."""
    variants = attribute_variants(panel, attributes)
    return repeated_groups(variants, ["id"]).orderBy("id", "first_year", "first_mon", *attributes)


def changed_entities(panel: DataFrame, attribute: str) -> DataFrame:
    """Entities with several non-null values of an attribute, and how many."""
    return (panel.groupBy("id").agg(F.count_distinct(attribute).alias("n_values"))
            .where("n_values > 1"))


def sex_changes(panel: DataFrame) -> DataFrame:
    """One row per additional sex of an entity; a missing sex is none."""
    variants = panel.where(F.col("sex").isNotNull()).groupBy("id", "sex").agg(F.count("*").alias("n"))
    return mark_repeats(variants, ["id"], ["sex"]).where("repeat").select("id", "sex", "n")


def since(panel: DataFrame, skip_year: int, skip_month: tuple[int, int]) -> DataFrame:
    """Leave out one whole year and one further month."""
    year, mon = skip_month
    return panel.where((F.col("year") != skip_year) & ~((F.col("year") == year) & (F.col("mon") == mon)))


def name_changes(panel: DataFrame, scope: str = "entity") -> DataFrame:
    """``id, name`` of names an entity took after its first one.

    ``scope='entity'`` compares with the entity's own first name; ``'global'`` lists only names that
    are nobody's first name. A missing name is no name: the first one is the earliest that is known.
    """
    named = panel.where(F.col("name").isNotNull())
    variants = named.select("id", "name").distinct()
    firsts = first_per_key(named.select("id", "year", "mon", "name"), ["id"]).select("id", "name")
    if scope == "entity":
        return variants.join(firsts, ["id", "name"], "left_anti")
    if scope == "global":
        # Names are compared once each, however many entities share one.
        unseen = variants.select("name").distinct().join(firsts.select("name").distinct(), "name", "left_anti")
        return salted_join(variants, unseen, "name", "left_semi").select("id", "name")
    raise ValueError(f"unknown scope {scope!r}")


def name_change_examples(panel: DataFrame, changes: DataFrame, n: int = 5) -> DataFrame:
    """Every name ever used by the first ``n`` changed entities, one row per name."""
    ids = changes.select("id").distinct().orderBy("id").limit(n)
    return panel.join(F.broadcast(ids), "id", "left_semi").select("id", "name").distinct().orderBy("id", "name")


def implausible_birth_years(panel: DataFrame, before: int = 1910) -> DataFrame:
    """First row of each entity that ever had a birth year in ``(0, before)``, sorted by it."""
    odd = (F.col("birth_year") > 0) & (F.col("birth_year") < before)
    ids = panel.where(odd).select("id").distinct()
    return first_per_key(salted_join(panel, ids, "id", "left_semi"), ["id"]).orderBy("birth_year", "id")


def flag_sex_crosstab(panel: DataFrame) -> DataFrame:
    """Which sexes occur under which flag."""
    return panel.groupBy("flag", "sex").agg(F.count("*").alias("n"))


def flag_implies_sex(panel: DataFrame, flag: str) -> DataFrame:
    return panel.where(F.col("flag") == flag).select("sex").distinct()


def attribute_cardinality(panel: DataFrame) -> DataFrame:
    """Named rows per (entity, country, sex)."""
    return panel.groupBy("id", "fed", "sex").agg(F.count("name").alias("n"))

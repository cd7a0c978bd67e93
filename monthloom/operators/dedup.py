"""Duplicates by key, expressed as aggregations so that big groups are combined before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.operators.skew import salted_join


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ("year", "mon"),
                  keep: str = "first") -> DataFrame:
    """The earliest (or latest) row of each key; the remaining columns break ties."""
    rest = [c for c in order if c not in keys] + [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*rest)
    pick = F.min(packed) if keep == "first" else F.max(packed)
    return df.groupBy(*keys).agg(pick.alias("row")).select(
        [F.col(c) if c in keys else F.col(f"row.{c}").alias(c) for c in df.columns])


def mark_repeats(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``repeat``: true on every row after the first of its key (``order`` unique in a key)."""
    rank = F.struct(*order)
    first = (df.groupBy(*keys).agg(F.min(rank).alias("first_rank"), F.count("*").alias("n_in_key"))
             .where("n_in_key > 1").drop("n_in_key"))
    return (salted_join(df, first, keys, "left")
            .withColumn("repeat", F.coalesce(rank != F.col("first_rank"), F.lit(False))).drop("first_rank"))


def repeated_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of keys that occur more than once."""
    repeated = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)
    return salted_join(df, repeated, keys, "left_semi")

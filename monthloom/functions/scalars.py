"""Row-level expressions on panel columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def recode_flag(flag: Column) -> Column:
    """Drop the sex from the activity flag: ``wi`` reads ``i``, ``w`` reads empty."""
    return F.when(flag == "wi", "i").when(flag == "w", "").otherwise(flag)


def is_active(flag: Column) -> Column:
    """An entity is inactive when its raw flag contains ``i``; no flag means active."""
    return ~F.coalesce(flag.contains("i"), F.lit(False))


def active_indicator(recoded: Column) -> Column:
    """0/1 on the recoded flag; NULL counts as active."""
    return (~recoded.eqNullSafe(F.lit("i"))).cast("int")


def or_none(title: Column) -> Column:
    return F.coalesce(title, F.lit("None"))


def domain_rank(value: Column, domain: Sequence[str]) -> Column:
    """1-based position in ``domain``; 0 for other values, NULL for NULL."""
    return F.array_position(F.array(*[F.lit(d) for d in domain]), value).cast("int")


def strict_rank(value: Column, domain: Sequence[str], what: str) -> Column:
    """:func:`domain_rank` that fails on a value outside the domain instead of losing it."""
    rank = domain_rank(value, domain)
    named = F.concat(F.lit(f"{what} outside {list(domain)}: "), value)
    return F.when(rank == 0, F.raise_error(named).cast("int")).otherwise(rank)


def domain_value(rank: Column, domain: Sequence[str]) -> Column:
    """Inverse of :func:`domain_rank`; NULL where the value was outside the domain."""
    return F.try_element_at(F.array(*[F.lit(d) for d in domain]), F.nullif(rank, F.lit(0)))


def title_rank(title: Column, scale: Sequence[str]) -> Column:
    """Ordinal title: 0 for none or unknown, then 1.. along the scale."""
    return F.coalesce(domain_rank(title, scale), F.lit(0))


def age_in(ref_year: int, birth_year: Column) -> Column:
    return (F.lit(ref_year) - birth_year).cast("int")


def strictly_between(value: Column, lo, hi) -> Column:
    return (value > lo) & (value < hi)


def improved(current: Column, previous: Column, diff) -> Column:
    """1 when ``current`` beats ``previous`` by more than ``diff``."""
    return (current > previous + F.lit(diff)).cast("int")


def longer_of(left: Column, right: Column) -> Column:
    """The longer string; the left one wins ties."""
    return F.when(F.length(left) >= F.length(right), left).otherwise(right)


def fingerprint(value: Column) -> Column:
    """64-bit hash, NULL for NULL. Its min and max stay inside hash aggregation, strings do not."""
    return F.when(value.isNotNull(), F.xxhash64(value))

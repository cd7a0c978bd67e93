"""Named aggregates for features. An aggregate is a function ``Column -> Column``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

AggBuilder = Callable[[Column], Column]


def longest(value: Column) -> Column:
    """Longest string; among equally long ones the greatest, so row order never matters."""
    return F.max(F.struct(F.length(value).alias("n"), value.alias("s")))["s"]


_AGGREGATES: dict[str, AggBuilder] = {
    "sum": F.sum,
    "mean": F.avg,
    "max": F.max,
    "str": longest,
}


def register_aggregate(name: str, builder: AggBuilder) -> None:
    """Make ``builder`` available to feature specs. Anything Spark can aggregate qualifies."""
    _AGGREGATES[name] = builder


def aggregate(name: str) -> AggBuilder:
    try:
        return _AGGREGATES[name]
    except KeyError:
        raise ValueError(f"unknown aggregate {name!r}; known: {sorted(_AGGREGATES)}") from None


def earliest(value: Column, month: Column) -> Column:
    """Integer attribute of the earliest month (smallest value if that month repeats).

    The ordering key is one bigint, so the aggregate stays a hash aggregate.
    """
    key = month.cast("long") * F.lit(1 << 32) + F.coalesce(value.cast("long"), F.lit(0))
    return F.min_by(value, key)


def latest(value: Column, month: Column) -> Column:
    key = month.cast("long") * F.lit(1 << 32) + F.coalesce(value.cast("long"), F.lit(0))
    return F.max_by(value, key)

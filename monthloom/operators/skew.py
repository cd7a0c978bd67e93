"""Joins that stay balanced when a few entities have very many rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key is heavy if it holds more rows than an average partition, or more than one row in ``MOST``.
MOST = 256
#: Keys a sketch tracks: counts are off by less than one row in 1500, so no heavy key is missed.
TRACKED = 4096
#: Sketches are merged in so many groups of partitions first, so that none task merges all.
MERGES = 256


def key_hash(keys: Sequence[str], types: Sequence[T.DataType]) -> Column:
    """A hash of the keys as these types, since equal numbers of two types differ in their hashes."""
    return F.xxhash64(*[F.col(k).try_cast(t) for k, t in zip(keys, types)])


def key_types(rows: DataFrame, keys: Sequence[str]) -> list[T.DataType]:
    return [rows.schema[k].dataType for k in keys]


def heavy_keys(rows: DataFrame, keys: str | Sequence[str]) -> dict[int, int]:
    """Hashes of the keys that hold more than their share of ``rows``, each with the number of tasks it needs.

    Every partition keeps a sketch of frequent keys of a fixed size; sketches are merged in two steps. Only the
    key columns are read, and at most ``MOST`` keys reach the driver.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sketches = (rows.select(key_hash(keys, key_types(rows, keys)).alias("h"), F.pmod(F.spark_partition_id(), F.lit(MERGES)).alias("g"))
                .groupBy("g").agg(F.expr(f"approx_top_k_accumulate(h, {TRACKED})").alias("s"), F.count("*").alias("n")))
    # grouped, as no sketches can't be combined: no rows then
    found = sketches.groupBy(F.lit(True)).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(s), {MOST})").alias("top"), F.sum("n").alias("n")).first()
    if found is None:
        return {}
    least = found.n * max(1 / parts, 1 / MOST)
    return {r["item"]: max(2, math.ceil(r["count"] * parts / found.n)) for r in found.top if r["count"] > least}


def salted_join(rows: DataFrame, facts: DataFrame, keys: str | Sequence[str], how: str,
                heavy: dict[int, int] | None = None, spread: Sequence[str] = ()) -> DataFrame:
    """Join ``rows`` with a table holding one row per key, spreading each heavy key over several tasks.

    ``heavy`` is what ``heavy_keys`` finds, and is looked up when the join is built if not given. Only the
    facts of heavy keys are repeated, once for each of the key's tasks; without heavy keys it is a plain join.
    The salt is a hash of ``spread``; by default of the month where rows have one, so that no other column is read
    for it, else of the whole row. A retried task assigns it again the same way. The result is not clustered by the key: an
    aggregation on top combines map-side before it shuffles.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    heavy = heavy_keys(rows, keys) if heavy is None else heavy
    if not heavy:
        return rows.join(facts, keys, how)
    known = F.create_map(*[F.lit(x).cast("bigint") for pair in heavy.items() for x in pair])
    tasks = F.coalesce(known[key_hash(keys, key_types(rows, keys))], F.lit(1))
    months = [c for c in ("year", "mon") if c in rows.columns and c not in keys]
    hashed = list(spread) or months or [c for c in rows.columns if c not in keys] or keys
    repeated = facts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), tasks - 1)))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*hashed), tasks)).join(repeated, [*keys, "salt"], how).drop("salt")

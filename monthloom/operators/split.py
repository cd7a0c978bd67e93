"""Reproducible train / validation / test assignment of exact size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PREFIX = 4  # hex digits of the digest used for the counting pass: 65 536 buckets


def split_panel(df: DataFrame, val: float = 0.1, test: float = 0.2, seed: int = 42,
                stratify: str | None = None) -> DataFrame:
    """Add ``split``: test takes ``ceil(test·n)`` entities, validation the like share of the rest.

    Entities (unique ``id``) are ordered by ``md5(seed:id)``. ``stratify`` names a 0/1 label; sizes
    are then exact in each class. Instead of sorting everything, a first pass counts digest
    prefixes, a second ranks only the entities in the prefixes where a cut falls, and the rows
    themselves are assigned by comparing digests with the two cuts of their class, unshuffled.
    ``df`` is read three times, so pass a stored table rather than a long lineage.
    """
    positive = F.coalesce(F.col(stratify) == 1, F.lit(False)) if stratify else F.lit(False)
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    keyed = df.select("id", positive.alias("stratum"), digest.alias("digest"))

    prefix = F.substring("digest", 1, PREFIX)
    in_order = Window.partitionBy("stratum").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
    # At most 16**PREFIX rows per class enter this window.
    cumulative = (keyed.groupBy("stratum", prefix.alias("prefix")).agg(F.count("*").alias("m"))
                  .withColumn("upto", F.sum("m").over(in_order))
                  .withColumn("n", F.sum("m").over(Window.partitionBy("stratum"))))
    n_test = F.ceil(F.lit(float(test)) * F.col("n"))
    n_val = F.ceil(F.lit(val / (1 - test)) * (F.col("n") - n_test))
    cuts = (cumulative.select("*", F.explode(F.array(
        F.struct(F.lit("test").alias("name"), n_test.alias("at")),
        F.struct(F.lit("val").alias("name"), (n_test + n_val).alias("at")))).alias("cut"))
        .where((F.col("cut.at") <= F.col("upto")) & (F.col("cut.at") > F.col("upto") - F.col("m")))
        .select("stratum", "prefix", F.col("cut.name").alias("name"),
                (F.col("cut.at") - F.col("upto") + F.col("m")).alias("k")))

    # One cut lies in one prefix: at most four rows to broadcast, and so below with the thresholds.
    nearby = keyed.withColumn("prefix", prefix).join(F.broadcast(cuts), ["stratum", "prefix"])
    rank = F.row_number().over(Window.partitionBy("stratum", "name").orderBy("digest", "id"))
    thresholds = (nearby.withColumn("r", rank).where("r = k").groupBy("stratum")
                  .agg(F.max(F.when(F.col("name") == "test", F.col("digest"))).alias("test_cut"),
                       F.max(F.when(F.col("name") == "val", F.col("digest"))).alias("val_cut")))
    marked = df.withColumns({"stratum": positive, "digest": digest}).join(
        F.broadcast(thresholds), "stratum", "left")
    return (marked.withColumn("split", F.when(F.col("digest") <= F.col("test_cut"), "test")
                              .when(F.col("digest") <= F.col("val_cut"), "val").otherwise("train"))
            .select(*df.columns, "split"))


def split_sizes(split: DataFrame, label: str = "label") -> DataFrame:
    return split.groupBy("split").agg(F.count("*").alias("n"), F.sum(label).cast("long").alias("positive"))

"""One-hot encoding, with categories given or learned, and feature vectors.

Learned categories are a table, the dictionary: nothing but one row per encoded *column* is gathered, so a column may
have as many values as there are rows. Vectors are sparse and built from the slots of an entity's values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from monthloom.sources.store import cut_lineage, scratch_path

NUMERIC_TYPES = ("byte", "short", "integer", "long", "float", "double", "decimal")


def learn_categories(df: DataFrame, columns: Sequence[str], limit: int | None = None) -> dict[str, list]:
    """Sorted distinct values per column, found in one job.

    Each value becomes a column of the encoded table; ``limit`` refuses columns with more of them.
    """
    if not columns:
        return {}
    seen = (df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])).alias("p"))
        .select("p.*").distinct())
    seen = (seen if limit is None else seen.limit(limit * len(columns) + 1)).collect()
    found: dict[str, list] = {c: [] for c in columns}
    for row in seen:
        found[row["c"]].append(row["v"])
    crowded = [c for c, v in found.items() if limit is not None and len(v) > limit]
    if crowded or limit is not None and len(seen) > limit * len(columns):
        raise ValueError(f"too many categories to one-hot encode: {crowded}")
    numeric = _numeric_columns(df)
    return {c: _ordered(v, c in numeric) for c, v in found.items()}


def _numeric_columns(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema if f.dataType.typeName() in NUMERIC_TYPES}


def _ordered(values: list, numeric: bool) -> list:
    known = sorted((v for v in values if v is not None), key=float if numeric else str)
    return known + ([None] if None in values else [])


def one_hot_names(column: str, categories: Sequence) -> list[tuple[str, object]]:
    """Indicator columns; a two-valued column keeps only its second value."""
    kept = list(categories)[1:] if len(categories) == 2 else list(categories)
    return [(f"{column}={v}", v) for v in kept]


def one_hot(df: DataFrame, categories: dict[str, Sequence]) -> DataFrame:
    """Replace the columns by 0/1 indicators: indicators first, remaining columns after them."""
    flags = [F.col(c).cast("string").eqNullSafe(F.lit(None if v is None else str(v))).cast("double").alias(n)
             for c, values in categories.items() for n, v in one_hot_names(c, values)]
    return df.select(*flags, *[c for c in df.columns if c not in categories])


def assemble(dataset: DataFrame, categories: dict[str, Sequence],
             keep: Sequence[str] = ("id", "split", "label", "baseline")) -> DataFrame:
    """Dataset with one ``features`` vector: one-hot block, then numeric columns."""
    encoded = one_hot(dataset, categories)
    inputs = [c for c in encoded.columns if c not in keep]
    return (VectorAssembler(inputCols=inputs, outputCol="features").transform(encoded)
            .select(*[c for c in keep if c in encoded.columns], "features"))


# ---- learned categories as a table ----------------------------------------------------------


def category_dictionary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``place, column, value, n, slot`` of every value seen: its rows and its slot in the one-hot block.

    Columns follow each other in the order given, a column's values in ascending order (numeric columns by number),
    NULL last. A two-valued column keeps only its second value: the first has no slot. Equal values are counted
    map-side, so a hot one is a single row by the time it is shuffled. Slots come from range-partitioned values:
    each partition numbers its own, and the partitions' sizes give the offsets. The table is stored.
    """
    numeric = _numeric_columns(df)
    seen = _entries(df, columns).groupBy("entry.place", "entry.value").agg(F.count("*").alias("n"))
    numbers = [i for i, c in enumerate(columns) if c in numeric]
    keys = ["place", "missing", "number", "value"]
    placed = cut_lineage(
        seen.withColumns({"missing": F.col("value").isNull(),
                          "number": F.when(F.col("place").isin(numbers), F.col("value").try_cast("double"))})
        .repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), "categories")
    # the number of a row: its partition in the upper bits, its row there in the lower 33
    placed = placed.withColumns({"part": F.shiftright("at", 33), "row": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = placed.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))  # one row per partition
    ranked = placed.join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.col("row"))
    spans = ranked.groupBy("place").agg(F.min("rank").alias("first"), F.count("*").alias("values"))
    width = F.when(F.col("values") == 2, 1).otherwise(F.col("values"))
    starts = spans.select("place", "first", "values", (F.sum(width).over(Window.orderBy("place")) - width).alias("start"))  # one row per column
    rank = F.col("rank") - F.col("first")
    slot = F.when(F.col("values") == 2, F.when(rank == 1, F.col("start"))).otherwise(F.col("start") + rank)
    names = F.array(*[F.lit(c) for c in columns]) if columns else F.array(F.lit(""))
    found = ranked.join(F.broadcast(starts), "place").select(
        "place", names[F.col("place")].alias("column"), "value", "n", slot.cast("int").alias("slot"))
    return cut_lineage(found, "dictionary")


def _entries(df: DataFrame, columns: Sequence[str], *others: Column) -> DataFrame:
    """``others`` and ``entry`` (``place, value``), one row per row and encoded column."""
    listed = F.array(*[F.struct(F.lit(i).alias("place"), F.col(f"`{c}`").cast("string").alias("value"))
                       for i, c in enumerate(columns)])
    none = F.array().cast("array<struct<place:int,value:string>>")
    return df.select(*others, F.explode(listed if columns else none).alias("entry"))


def one_hot_slots(df: DataFrame, columns: Sequence[str], dictionary: DataFrame, *others: Column) -> DataFrame:
    """``others``, ``place`` and ``slot`` for every row and encoded column; values outside the dictionary, like the
    first of two, have no slot. The stored dictionary is broadcast if the planner finds it small; beyond that the
    join shuffles by value, and adaptive execution splits hot values."""
    entries, known = _entries(df, columns, *others), dictionary.select("place", "value", "slot")
    same = (entries["entry.place"] == known["place"]) & entries["entry.value"].eqNullSafe(known["value"])
    return entries.join(known, same, "left").drop(known["place"], known["value"]).withColumn("place", F.col("entry.place")).drop("entry")


def learned_vectors(dataset: DataFrame, columns: Sequence[str], keep: Sequence[str] = ("id", "split", "label", "baseline"),
                    key: str = "id", dictionary: DataFrame | None = None) -> DataFrame:
    """Dataset with one stored sparse ``features`` vector: the one-hot block, then all other columns as numbers.

    ``key`` is unique and not NULL; a repeated one, or a number that is NULL, fails the query. An entity's slots
    and numbers meet in one aggregation by ``key``, combined map-side, since its entries stand together.
    """
    spark, columns = dataset.sparkSession, list(columns)
    kept = [c for c in keep if c in dataset.columns and c != key]
    others = [c for c in dataset.columns if c not in (*columns, *keep, key)]
    dictionary = category_dictionary(dataset, columns) if dictionary is None else dictionary
    width = (dictionary.agg(F.max("slot")).first()[0] + 1) if columns and not dictionary.isEmpty() else 0
    size = width + len(others)
    # numbers are sparse before they move
    dataset = dataset.withColumn("_numbers", F.array(*[F.col(f"`{c}`").cast("double") for c in others]).cast("array<double>"))
    numbers = F.transform("_numbers", lambda x: F.coalesce(x, F.raise_error(F.lit("a feature is NULL")).cast("double")))
    at = F.filter(F.transform("_numbers", lambda x, i: F.when(x != 0, i + F.lit(width))), lambda i: i.isNotNull())
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in kept], at.alias("_at"), F.filter(numbers, lambda x: x != 0).alias("_x"))
    if columns:
        # the row itself rides on its first entry only
        slots = one_hot_slots(dataset.select(F.col(f"`{key}`").alias("key"), *[F.col(f"`{c}`") for c in columns], row.alias("row")),
                              columns, dictionary, F.col("key"), F.col("row"))
        once = F.when(F.col("place") == 0, F.col("row"))
        met = slots.select("key", "slot", once.alias("row")).groupBy("key").agg(
            F.sort_array(F.collect_list("slot")).alias("slots"), F.first("row", ignorenulls=True).alias("row"),
            F.count("*").alias("n"))
        known = F.when(F.col("n") == len(columns), F.col("slots")).otherwise(
            F.raise_error(F.concat(F.lit("key repeated: "), F.col("key").cast("string"))).cast("array<int>"))
    else:
        met, known = dataset.select(F.col(f"`{key}`").alias("key"), row.alias("row")), F.array().cast("array<int>")
    entries = met.select("key", "row", known.alias("slots"))
    path = scratch_path(spark, "vectors")
    entries.select(
        F.col("key").alias(key), *[F.col(f"row.`{c}`").alias(c) for c in kept],
        F.struct(F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"),
                 F.concat("slots", "row._at").alias("indices"), F.concat(F.transform("slots", lambda s: F.lit(1.0)), "row._x").alias("values"))
        .alias("features")).write.parquet(path)
    # Parquet keeps a vector as this struct, so the table is read back as vectors
    fields = {f.name: f for f in dataset.schema}
    schema = T.StructType([fields[key], *[fields[c] for c in kept], T.StructField("features", VectorUDT())])
    stored = spark.read.schema(schema).parquet(path)
    return stored.withColumn("features", F.col("features").alias("features", metadata={"ml_attr": {"num_attrs": size}}))


def category_columns(dataset: DataFrame) -> list[str]:
    return ["age_bin", "sex", "k"] + [c for c in dataset.columns if c.startswith("flag_")]

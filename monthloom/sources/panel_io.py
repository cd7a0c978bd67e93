"""Reading and writing panels."""

from __future__ import annotations

import csv
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from monthloom.model import EXTRACT_HEADER, PANEL_SCHEMA

KEYS = ("id", "year", "mon")
QUARANTINE_SCHEMA = "file string, reason string, line string"


def _typed(df: DataFrame, header: dict[str, str]) -> DataFrame:
    """Rename extract headers to panel columns and cast; columns not in the file stay absent."""
    present = set(df.columns)
    return df.select([
        F.col(f"`{header[f.name]}`").cast(f.dataType).alias(f.name)
        for f in PANEL_SCHEMA if header.get(f.name) in present
    ])


def read_extracts(spark: SparkSession, *globs: str, header: dict[str, str] | None = None,
                  sep: str = "|") -> DataFrame:
    """Union of delimited monthly extracts, aligned by column name.

    Files matched by one glob share a header, which Spark verifies file by file. Extracts with
    another layout go in a glob of their own; columns they lack become NULL.
    """
    header = header or EXTRACT_HEADER
    reader = (spark.read.option("header", True).option("sep", sep)
              .option("enforceSchema", False).option("mode", "FAILFAST"))
    parts = [_typed(reader.csv(g), header) for g in globs]
    panel = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return panel.select([
        (F.col(f.name) if f.name in panel.columns else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in PANEL_SCHEMA
    ])


def header_lines(spark: SparkSession, *globs: str) -> dict[str, str]:
    """The first line of every file that is not empty. Files are listed by Spark, and of each only the beginning
    is read, several at a time; a monthly extract is a file or a few, so what comes to the driver is one line for each."""
    listed = spark.read.format("binaryFile").load(list(globs)).select("path")
    paths = sorted(r["path"] for r in listed.collect())

    def first(path):
        found = spark.read.text(path).where("_metadata.file_block_start = 0").select("value").limit(1).collect()
        return found[0]["value"].lstrip("\ufeff") if found else ""

    with ThreadPool(8) as pool:
        return dict(zip(paths, pool.map(first, paths)))


def _names(line: str, sep: str) -> list[str]:
    return [n.strip() for n in next(csv.reader([line], delimiter=sep), [])]


def read_mixed_extracts(spark: SparkSession, *globs: str, header: dict[str, str] | None = None,
                        sep: str = "|") -> tuple[DataFrame, DataFrame]:
    """Panel rows of extracts whose layouts differ from file to file, and what could not be read.

    Files are grouped by their header line and each layout is read by name, so columns may come in any order; unknown
    ones are left out and absent ones are NULL. Nothing bad ends the job: the second table holds ``file, reason, line``
    of every line with a wrong number of fields (``fields``), a value that is not of its column's type or a missing
    key (the panel columns concerned), and the header line of every file whose header lacks a key column or names a
    column twice. An empty file gives nothing. Lines of wrong length are given as they stand, others
    joined again from their fields. Both tables read the files when they are used.
    """
    header = header or EXTRACT_HEADER
    columns = {header[f.name]: f for f in PANEL_SCHEMA if f.name in header}
    layouts: dict[str, list[str]] = {}
    refused = []
    for path, line in header_lines(spark, *globs).items():
        names = _names(line, sep)
        missing = [header[k] for k in KEYS if header[k] not in names]
        twice = sorted({n for n in names if n in columns and names.count(n) > 1})
        if missing or twice:
            refused.append((path, f"no column {', '.join(missing)}" if missing else f"twice: {', '.join(twice)}", line))
        else:
            layouts.setdefault(line, []).append(path)
    panels = [spark.createDataFrame([], PANEL_SCHEMA)]
    problems = [spark.createDataFrame(refused, QUARANTINE_SCHEMA)]
    for line, paths in layouts.items():
        names = _names(line, sep)
        rows = _judged(spark, paths, names, columns, sep)
        panels.append(rows.where("reason IS NULL").select([
            (F.col(f"v.{f.name}") if header.get(f.name) in names else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in PANEL_SCHEMA]))
        problems.append(rows.where("reason IS NOT NULL").select("file", "reason", "line"))
    return reduce(DataFrame.unionByName, panels), reduce(DataFrame.unionByName, problems)


def _judged(spark: SparkSession, paths: list[str], names: list[str], columns: dict[str, T.StructField], sep: str) -> DataFrame:
    """``file, reason, line`` and the typed values ``v`` of all lines of one layout; ``reason`` is NULL for good ones."""
    raw = [f"c{i}" for i in range(len(names))]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*raw, "malformed")])
    lines = (spark.read.schema(schema).option("header", True).option("sep", sep).option("mode", "PERMISSIVE")
             .option("columnNameOfCorruptRecord", "malformed").option("columnPruning", False).csv(paths))
    values = {columns[n].name: (F.col(c), F.trim(c).try_cast(columns[n].dataType) if columns[n].dataType != T.StringType() else F.col(c))
              for n, c in zip(names, raw) if n in columns}
    wrong = [F.when(typed.isNull() if name in KEYS else text.isNotNull() & typed.isNull(), name)
             for name, (text, typed) in values.items()]
    whole = F.concat_ws(sep, *[F.coalesce(c, F.lit("")) for c in raw])
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.when(F.col("malformed").isNotNull(), "fields").otherwise(F.nullif(F.concat_ws(", ", *wrong), F.lit(""))).alias("reason"),
        F.coalesce("malformed", whole).alias("line"),
        F.struct(*[typed.alias(name) for name, (_, typed) in values.items()]).alias("v"))


def write_extracts(panel: DataFrame, path: str, header: dict[str, str] | None = None,
                   sep: str = "|") -> None:
    header = header or EXTRACT_HEADER
    (panel.select([F.col(c).alias(header[c]) for c in panel.columns])
     .write.mode("overwrite").option("header", True).option("sep", sep).csv(path))


def write_panel(panel: DataFrame, path: str) -> None:
    """Parquet by year and month; rerunning a month replaces only that month.

    The rebalance hint lets AQE cut big months into several files and merge small ones.
    """
    (panel.hint("rebalance", F.col("year"), F.col("mon"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("year", "mon").parquet(path))


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PANEL_SCHEMA).parquet(path)


def preview(panel: DataFrame, n: int = 10) -> DataFrame:
    return panel.orderBy("id", "year", "mon").limit(n)


def entity_history(panel: DataFrame, entity: int) -> DataFrame:
    return panel.where(F.col("id") == entity).orderBy("year", "mon")

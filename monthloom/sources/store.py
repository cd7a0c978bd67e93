"""Result tables kept between sessions: datasets, predictions, metrics."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

METRICS_SCHEMA = T.StructType([
    T.StructField("family", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("split", T.StringType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("auc", T.DoubleType()),
    T.StructField("rmse", T.DoubleType()),
    T.StructField("pearson_r", T.DoubleType()),
    T.StructField("task", T.StringType()),
])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Without the setting a temporary folder is used, which is only right on a local master.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="monthloom-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back, so lost executors never recompute past it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Inside, the shuffle files of each query are deleted when it has ended, for what is needed later is stored.

    Otherwise all of them stay on the executors' disks until the driver happens to collect its garbage.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: One row for each finished task: what it was made from, and the columns and rows of its dataset.
COMMITS_SCHEMA = T.StructType([
    T.StructField("inputs", T.StringType()),
    T.StructField("columns", T.StringType()),
    T.StructField("n_rows", T.LongType()),
    T.StructField("models", T.ArrayType(T.StringType())),
    T.StructField("task", T.StringType()),
])


def input_digest(table: DataFrame, *settings: object) -> str:
    """A digest of a table's columns and rows, in any order and with repeats, and of settings."""
    content = table.agg(F.count("*"), F.sum(F.xxhash64(*table.columns).cast("decimal(38,0)"))).first()
    return hashlib.sha256(repr((table.dtypes, tuple(content), settings)).encode()).hexdigest()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system Spark writes to, if it is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(stored: DataFrame) -> None:
    """Delete a table of ``cut_lineage`` that nothing reads any more."""
    for path in {file.rpartition("/")[0] for file in stored.inputFiles()}:
        remove(stored.sparkSession, path)


class ResultStore:
    """Parquet tables below one root, each partitioned by task.

    ``begin`` and ``commit`` frame the work on a task. The commit is one row in one file, which appears when all
    else is written; what a task without it has left is not read with ``committed=True``, and the next ``begin``
    removes it.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _read(self, path: str, schema: T.StructType | None = None) -> DataFrame | None:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        try:
            return reader.parquet(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    # ---- metrics: one table, partition per task ------------------------
    def save_metrics(self, metrics: DataFrame, task: str) -> None:
        complete = metrics.select([
            (F.col(f.name) if f.name in metrics.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in METRICS_SCHEMA if f.name != "task"
        ]).withColumn("task", F.lit(task))
        (complete.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("task").parquet(self._path("metrics")))

    def metrics(self, committed: bool = False) -> DataFrame:
        found = self._read(self._path("metrics"), METRICS_SCHEMA)
        if found is None:
            return self.spark.createDataFrame([], METRICS_SCHEMA)
        return self._finished(found) if committed else found

    def export_metrics_csv(self, path: str) -> None:
        self.metrics().coalesce(1).write.mode("overwrite").option("header", True).csv(path)

    def pending(self, tasks: DataFrame, inputs: str | None = None) -> DataFrame:
        """Rows of ``tasks`` (column ``task``) without stored metrics; with ``inputs``, without a commit of these."""
        if inputs is None:
            return tasks.join(self.metrics().select("task").distinct(), "task", "left_anti")
        return tasks.join(self.commits().where(F.col("inputs") == inputs).select("task"), "task", "left_anti")

    # ---- commits: one row a task ---------------------------------------
    def commits(self) -> DataFrame:
        found = self._read(self._path("commits"), COMMITS_SCHEMA)
        return self.spark.createDataFrame([], COMMITS_SCHEMA) if found is None else found

    def _finished(self, table: DataFrame) -> DataFrame:
        return table.join(self.commits().select("task"), "task", "left_semi").select(table.columns)

    def begin(self, task: str) -> None:
        """Remove all that is stored of ``task``, its commit first, so that no half of it can count as done."""
        for table in ("commits", "metrics", "predictions", "dataset"):
            remove(self.spark, self._path(f"{table}/task={task}"))

    def commit(self, task: str, inputs: str) -> None:
        """Declare ``task`` done, made from ``inputs`` (any text; ``input_digest`` makes one)."""
        dataset, predictions = self.dataset(task), self._read(self._path(f"predictions/task={task}"))
        models = [] if predictions is None else sorted(r[0] for r in predictions.select("model").distinct().collect())  # a grid's
        columns = "" if dataset is None else hashlib.sha256(dataset.schema.simpleString().encode()).hexdigest()
        row = (inputs, columns, 0 if dataset is None else dataset.count(), models, task)
        (self.spark.createDataFrame([row], COMMITS_SCHEMA).coalesce(1).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("task").parquet(self._path("commits")))

    # ---- datasets and predictions: a folder per task -------------------
    def save_dataset(self, dataset: DataFrame, task: str) -> DataFrame:
        path = self._path(f"dataset/task={task}")
        dataset.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(dataset.schema).parquet(path)

    def dataset(self, task: str) -> DataFrame | None:
        return self._read(self._path(f"dataset/task={task}"))

    def save_predictions(self, predictions: DataFrame, task: str, model: str) -> DataFrame:
        path = self._path(f"predictions/task={task}/model={model}")
        predictions.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(predictions.schema).parquet(path)

    def predictions(self, committed: bool = False) -> DataFrame | None:
        found = self._read(self._path("predictions"))
        return self._finished(found) if committed and found is not None else found

"""PCA and random-forest models on ``features`` vectors, a whole grid from few fits."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom.operators.forests import forest_votes
from monthloom.operators.metrics import evaluate, stack_metrics, tagged
from monthloom.operators.pca import fit_components, project
from monthloom.sources.store import cut_lineage, discard, freed_shuffles, scratch_path

# The model grid and the model chosen for the final evaluation.
PCA_SIZES = (2, 10, 20)
FOREST_SIZES = (50, 100, 500)
FINAL_MODEL = "PCA_20-RF_100"

#: Spark's forests grow on the driver, node by node. Deeper ones than this have as many nodes as there are rows, and
#: grow in the tasks instead.
SHALLOW = 10


@dataclass(frozen=True)
class ForestModel:
    """``trees`` trees on the first ``k`` components, or on the features as they are if ``k`` is None.

    Forests grow to ``max_depth``; 30 is the deepest Spark allows. ``memory_mb`` bounds the statistics one task
    of a forest up to ``SHALLOW`` gathers per pass: more of it means fewer passes over the training rows.
    """

    is_clf: bool
    k: int | None
    trees: int
    max_depth: int = 30
    seed: int = 42
    memory_mb: int = 512

    def tried(self, n_features: int) -> int:
        """Features a node tries."""
        return math.ceil(math.sqrt(n_features)) if self.is_clf else n_features

    def forest(self, trees: int):
        """Forests keep each row's node ids on the executors instead of shipping the grown trees with every
        job; Spark checkpoints these ids into ``spark.checkpoint.dir``."""
        kwargs = dict(featuresCol="inputs", labelCol="label", predictionCol="pred", numTrees=trees,
                      maxDepth=self.max_depth, seed=self.seed, maxMemoryInMB=self.memory_mb, cacheNodeIds=True)
        if self.is_clf:
            return RandomForestClassifier(featureSubsetStrategy="sqrt", **kwargs)
        return RandomForestRegressor(featureSubsetStrategy="all", **kwargs)


def vector_size(dataset: DataFrame, column: str = "features") -> int:
    return dataset.schema[column].metadata["ml_attr"]["num_attrs"]


def make_models(is_clf: bool, n_features: int, pca: Sequence[int | None] = PCA_SIZES, trees: Sequence[int] = FOREST_SIZES,
                max_depth: int = 30, seed: int = 42, memory_mb: int = 512) -> dict[str, ForestModel]:
    """``PCA_k-RF_n`` models, and ``RF_n`` ones without components for a ``k`` of None.

    Names tell the ``k`` asked for; with fewer features a model works on as many components as there are.
    """
    return {
        f"RF_{n}" if k is None else f"PCA_{k}-RF_{n}": ForestModel(
            is_clf, None if k is None else min(k, n_features), n, max_depth, seed, memory_mb)
        for k in pca for n in trees
    }


def first_trees(stored: str, n: int, is_clf: bool, spark):
    """The forest of the first ``n`` trees of a stored forest. Trees grow independently of each other, so this is a
    forest of ``n`` trees like any other."""
    path = scratch_path(spark, f"forest-{n}")
    told = json.loads(spark.read.text(f"{stored}/metadata").first()[0])
    told["numTrees"] = told["paramMap"]["numTrees"] = n
    spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.read.parquet(f"{stored}/data").where(F.col("treeID") < n).write.parquet(f"{path}/data")
    spark.read.parquet(f"{stored}/treesMetadata").where(F.col("_1") < n).write.parquet(f"{path}/treesMetadata")
    return (RandomForestClassificationModel if is_clf else RandomForestRegressionModel).load(path)


def _input(k: int | None) -> Column:
    """The first k components, or all features."""
    return F.col("raw") if k is None else F.slice("components", 1, k)


def _inputs(data: DataFrame, k: int | None) -> DataFrame:
    return data.withColumn("inputs", array_to_vector(_input(k)))


def _deep(data: DataFrame, spec: ForestModel, on: str, sizes: Sequence[int]) -> list[DataFrame]:
    """Predictions of the rows of split ``on`` by the first ``sizes[i]`` trees of one forest.

    Votes meet their rows once, in a stored table. Stored they are small files, which the planner would broadcast,
    every row through the driver and again for each model.
    """
    votes = forest_votes(data.select(
        "row", F.xxhash64("id", _input(spec.k)).alias("key"), F.col("label").cast("double").alias("label"),
        (F.col("split") == on).alias("scored"), _input(spec.k).alias("inputs")), sizes, spec.max_depth, spec.tried, spec.seed)
    rows = cut_lineage(data.where(F.col("split") == on).select("row", "id", "split", "label", "baseline")
                       .join(votes.hint("merge"), "row").drop("row"), "forest-predictions")
    pred = [(F.col(f"s{j}") > n / 2).cast("double") if spec.is_clf else F.col(f"s{j}") / n for j, n in enumerate(sizes)]
    return [rows.select("id", "split", "label", "baseline", p.alias("pred")) for p in pred]


def evaluate_models(dataset: DataFrame, models: dict[str, ForestModel], is_clf: bool, on: str = "val",
                    family: str | None = None, keep_predictions=None,
                    parallelism: int = 8) -> tuple[dict[str, DataFrame], DataFrame]:
    """Predictions per model of the rows of split ``on``, and one metric table.

    Components are found once, on the training rows, for the largest ``k``; smaller ones are their first
    components. For each ``k`` one forest of the largest size grows, and smaller forests are its first trees. Component
    values are stored before the forests grow, ``parallelism`` of them at a time, so that the short jobs of
    one forest's levels leave no executors idle. Labels of classifiers are 0 and 1. ``keep_predictions(df, name)`` may store a prediction
    table and return the stored one; metrics then read that table.
    """
    spark, family = dataset.sparkSession, family or ("clf" if is_clf else "regr")
    data = dataset.where(F.col("split").isin("train", on))
    sizes = [m.k for m in models.values() if m.k is not None]
    plain = any(m.k is None for m in models.values())
    with freed_shuffles(spark):
        if sizes:
            fitted = fit_components(dataset.where(F.col("split") == "train"), max(sizes))
            data = project(data.withColumn("raw", vector_to_array("features")) if plain else data, fitted)
        else:
            data = data.withColumn("raw", vector_to_array("features")).drop("features")
        data = cut_lineage(data.withColumn("row", F.monotonically_increasing_id()), "model-inputs")
    groups: dict[tuple, list[str]] = {}
    for name, m in models.items():
        groups.setdefault((m.k, m.max_depth, m.seed, m.memory_mb), []).append(name)

    @inheritable_thread_target(spark)
    def grown(names: list[str]) -> list[tuple[str, DataFrame]]:
        spec, most = models[names[0]], max(models[n].trees for n in names)
        if spec.max_depth > SHALLOW:
            sizes = sorted({models[n].trees for n in names})
            predicted = dict(zip(sizes, _deep(data, spec, on, sizes)))
            return [(n, keep_predictions(predicted[models[n].trees], n) if keep_predictions else predicted[models[n].trees]) for n in names]
        train = _inputs(data.where(F.col("split") == "train"), spec.k).select("inputs", "label")
        forest = spec.forest(most).fit(train)
        rows, stored, found = _inputs(data.where(F.col("split") == on), spec.k), None, []
        for name in names:
            own = forest
            if models[name].trees < most:
                if stored is None:
                    stored = scratch_path(spark, "forest")
                    forest.save(stored)
                own = first_trees(stored, models[name].trees, is_clf, spark)
            scored = own.transform(rows).select("id", "split", "label", "baseline", "pred")
            found.append((name, keep_predictions(scored, name) if keep_predictions else scored))
        return found

    with freed_shuffles(spark), ThreadPool(min(parallelism, len(groups))) as pool:
        scored = dict(pair for pairs in pool.map(grown, list(groups.values()), chunksize=1) for pair in pairs)
    if all(m.max_depth > SHALLOW for m in models.values()):  # these predictions are stored
        discard(data)
    predictions = {name: scored[name] for name in models}
    rows = [tagged(evaluate(p, is_clf, ["split"]), name, "predicted", family) for name, p in predictions.items()]
    return predictions, stack_metrics(rows)

"""The task matrix end to end: features, datasets, splits, models, metrics, all kept in a store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.functions.periods import PeriodSpec
from monthloom.operators.clean import CleaningRules
from monthloom.operators.encode import category_columns, learned_vectors
from monthloom.operators.features import DEFAULT_FEATURES, FeatureSpec, feature_table
from monthloom.operators.metrics import baseline_metrics, stack_metrics, tagged
from monthloom.operators.models import (FINAL_MODEL, FOREST_SIZES, PCA_SIZES, evaluate_models, make_models, vector_size)
from monthloom.operators.split import split_panel
from monthloom.operators.targets import KINDS, TASK_PERIODS, Task, build_dataset, task_matrix
from monthloom.sources.store import ResultStore, cut_lineage, input_digest


def vectors_of(dataset: DataFrame, task: Task, seed: int = 42) -> DataFrame:
    """Split a stored dataset and assemble its feature vector."""
    split = split_panel(dataset, seed=seed, stratify="label" if task.is_clf else None)
    return learned_vectors(split, category_columns(split))


def run_tasks(panel: DataFrame, rules: CleaningRules, store: ResultStore, year: int, first: tuple[int, int],
              last: tuple[int, int], periods=TASK_PERIODS, kinds: Sequence[str] = KINDS,
              specs: Sequence[FeatureSpec] = DEFAULT_FEATURES, bins="groups", diff: float = 10,
              pca: Sequence[int] = PCA_SIZES, trees: Sequence[int] = FOREST_SIZES, max_depth: int = 30,
              seed: int = 42) -> DataFrame:
    """Run every task not yet committed with these inputs and return the metrics of committed ones.

    The wide features are computed and stored once per granularity and shared by its tasks. Each
    task stores its dataset, the validation predictions of every model, one set of metric rows
    for models and baselines, and last its commit, which names a digest of the panel and the settings.
    An interrupted run resumes at the task it was in, which begins anew; so does a task whose inputs changed.
    """
    spark = panel.sparkSession
    tasks = task_matrix(year, periods, kinds)
    wanted = spark.createDataFrame([(t.name,) for t in tasks], "task string")
    inputs = input_digest(panel, rules, year, first, last, tuple(specs), bins, diff, tuple(pca), tuple(trees), max_depth, seed)
    pending = {r["task"] for r in store.pending(wanted, inputs).collect()}  # at most one row per task
    for n, _ in periods:
        todo = [t for t in tasks if t.n_months == n and t.name in pending]
        if not todo:
            continue
        period = PeriodSpec(n)
        span = period.span(first, last)
        features = cut_lineage(feature_table(panel, rules, period, span, specs), f"features-{n}")
        for task in todo:
            store.begin(task.name)
            dataset = store.save_dataset(
                build_dataset(features, period, span, task.target, task.kind, specs, bins, diff), task.name)
            data = vectors_of(dataset, task, seed)
            models = make_models(task.is_clf, vector_size(data), pca, trees, max_depth, seed)
            keep = lambda p, model, task=task: store.save_predictions(p, task.name, model)
            _, scores = evaluate_models(data, models, task.is_clf, family=task.kind, keep_predictions=keep)
            base = tagged(baseline_metrics(data, task.is_clf), "baseline", "baseline", task.kind)
            store.save_metrics(stack_metrics([scores, base]), task.name)
            store.commit(task.name, inputs)
    return store.metrics(committed=True)


def final_evaluation(store: ResultStore, tasks: Sequence[Task], model: str = FINAL_MODEL,
                     pca: Sequence[int] = PCA_SIZES, trees: Sequence[int] = FOREST_SIZES, max_depth: int = 30,
                     seed: int = 42) -> tuple[dict[str, DataFrame], DataFrame]:
    """Test predictions of one model per task, and its metrics next to the baseline's."""
    predictions, rows = {}, []
    for task in tasks:
        data = vectors_of(store.dataset(task.name), task, seed)
        chosen = {task.name: make_models(task.is_clf, vector_size(data), pca, trees, max_depth, seed)[model]}
        scored, metrics = evaluate_models(
            data, chosen, task.is_clf, on="test", family=task.kind,
            keep_predictions=lambda p, name: store.save_predictions(p, name, f"{model}-test"))
        predictions.update(scored)
        base = baseline_metrics(data, task.is_clf).where(F.col("split") == "test")
        rows += [metrics, tagged(base, task.name, "baseline", task.kind)]
    return predictions, stack_metrics(rows)

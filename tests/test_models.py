"""Models on a planted signal, and the task runner."""

import pytest
from pyspark.sql import functions as F

from helpers import rows
from monthloom.operators.encode import assemble
from monthloom.operators.metrics import baseline_metrics, classification_metrics, regression_metrics
from monthloom.operators.models import FINAL_MODEL, evaluate_models, make_models, vector_size
from monthloom.operators.split import split_panel
from monthloom.sources.store import cut_lineage


@pytest.fixture(scope="module")
def planted(spark):
    x = lambda s: F.rand(s)
    raw = spark.range(400).select("id", x(1).alias("a"), x(2).alias("b"), F.when(F.col("id") % 2 == 0, "M").otherwise("F").alias("sex"))
    raw = cut_lineage(raw, "planted")
    clf = raw.withColumns({"label": (F.col("a") > 0.5).cast("double"), "baseline": F.lit(0.0)})
    regr = raw.withColumns({"label": 10 * F.col("a") + F.col("b"), "baseline": F.lit(5.0)})
    out = {}
    for name, df, strat in (("clf", clf, "label"), ("regr", regr, None)):
        out[name] = assemble(split_panel(df, stratify=strat), {"sex": ["F", "M"]})
    return out


def test_grid_names():
    names = [f"PCA_{k}-RF_{n}" for k in (2, 10, 20) for n in (50, 100, 500)]
    assert FINAL_MODEL in names


@pytest.mark.parametrize("kind", ["clf", "regr"])
def test_models_beat_the_baseline(spark, planted, kind):
    data, is_clf = planted[kind], kind == "clf"
    assert vector_size(data) == 3
    models = make_models(is_clf, 3, pca=(2, 20), trees=(10,), max_depth=5)
    assert list(models) == ["PCA_2-RF_10", "PCA_20-RF_10"]  # named by the components asked for
    assert models["PCA_20-RF_10"].k == 3
    predictions, table = evaluate_models(data, models, is_clf)
    assert set(predictions) == set(models)
    best = {r["name"]: r for r in table.collect()}["PCA_20-RF_10"]
    base = baseline_metrics(data, is_clf).where("split = 'val'").first()
    if is_clf:
        assert best["accuracy"] > 0.85 and best["auc"] > base["auc"]
    else:
        assert best["rmse"] < base["rmse"] / 2 and base["pearson_r"] is None


def test_metric_edges(spark):
    same = spark.createDataFrame([(1, 1), (1, 0)], "label int, pred int")
    assert rows(classification_metrics(same)) == [(None, 0.5)]
    one = spark.createDataFrame([(2.0, 3.0)], "label double, pred double")
    assert rows(regression_metrics(one)) == [(1.0, None)]


def test_task_run_and_resume(spark, sf_dir):
    from monthloom.operators.clean import CleaningRules
    from monthloom.operators.metrics import confusion_matrix
    from monthloom.operators.targets import task_matrix
    from monthloom.plans.tasks import final_evaluation, run_tasks
    from monthloom.sources.driver_tables import orders_panel
    from monthloom.sources.store import ResultStore, scratch_path

    store = ResultStore(spark, scratch_path(spark, "run"))
    small = dict(pca=(2,), trees=(5,), max_depth=3)
    args = (orders_panel(spark, sf_dir), CleaningRules(2000), store, 2000, (1995, 1), (2001, 8))
    run_tasks(*args, periods=((6, 6),), kinds=("clf",), **small)
    both = run_tasks(*args, periods=((6, 6),), kinds=("clf", "regr"), **small)
    assert rows(both.groupBy("task", "type").count()) == [
        ("clf_6", "baseline", 2), ("clf_6", "predicted", 1), ("regr_6", "baseline", 2), ("regr_6", "predicted", 1)]
    assert rows(store.predictions().select("task", "model").distinct()) == [("clf_6", "PCA_2-RF_5"), ("regr_6", "PCA_2-RF_5")]
    tasks = task_matrix(2000, ((6, 6),), ("clf", "regr"))
    predictions, final = final_evaluation(store, tasks, "PCA_2-RF_5", **small)
    assert rows(final.select("name", "type")) == [("clf_6", "baseline"), ("clf_6", "predicted"), ("regr_6", "baseline"), ("regr_6", "predicted")]
    matrix = confusion_matrix(predictions["clf_6"])
    assert matrix.agg({"n": "sum"}).first()[0] == predictions["clf_6"].count()


def test_one_forest_serves_smaller_ones(spark, planted):
    """Smaller forests of a grid predict as the stored first trees of the largest do, tree by tree."""
    from monthloom.operators.models import first_trees
    from monthloom.sources.store import scratch_path

    data = planted["regr"].where("split = 'train'").withColumnRenamed("features", "inputs")
    forest = make_models(False, 3, pca=(None,), trees=(12,), max_depth=4)["RF_12"].forest(12).fit(data)
    path = scratch_path(spark, "forest")
    forest.save(path)
    some = first_trees(path, 5, False, spark)
    assert some.getNumTrees == 5 and [t.toDebugString.split("\n", 1)[1] for t in some.trees] == [
        t.toDebugString.split("\n", 1)[1] for t in forest.trees[:5]]
    vector = data.first()["inputs"]
    assert abs(some.predict(vector) - sum(t.predict(vector) for t in forest.trees[:5]) / 5) < 1e-9


def test_grid_with_and_without_components(spark, planted):
    models = make_models(True, 3, pca=(2, 3, None), trees=(3, 8), max_depth=4)
    predictions, table = evaluate_models(planted["clf"], models, True)
    n = planted["clf"].where("split = 'val'").count()
    assert list(predictions) == ["PCA_2-RF_3", "PCA_2-RF_8", "PCA_3-RF_3", "PCA_3-RF_8", "RF_3", "RF_8"]
    assert all(p.count() == n for p in predictions.values()) and table.count() == 6


def test_components_of_awkward_features(spark):
    """Constant, repeated, tiny and huge features converge and match the covariance."""
    import numpy as np
    from pyspark.ml.functions import array_to_vector
    from monthloom.operators.pca import fit_components, project

    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 8)) * np.array([1e6, 1, 0.05, 0, 3, 3, 1e-4, 10])
    x[:, 5] = x[:, 4]
    x[:, 7] = x[:, 0] / 1e5 + 5
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>").select(
        "id", array_to_vector("v").alias("features"))
    fitted = fit_components(df)
    cov = np.cov(x.T)
    assert np.allclose(fitted.axes.T @ fitted.axes, np.eye(8), atol=1e-10)
    assert np.allclose(fitted.axes * fitted.variances @ fitted.axes.T, cov, atol=1e-9 * np.abs(cov).max())
    got = np.array([r.components for r in project(df, fitted).orderBy("id").collect()])
    assert np.allclose(got, (x - x.mean(axis=0)) @ fitted.axes, atol=1e-6)
    few = fit_components(df.limit(2), 5)  # rank one
    assert few.axes.shape == (8, 5) and (few.variances[1:] <= 1e-9 * few.variances[0]).all()
    with pytest.raises(ValueError):
        fit_components(df.limit(0))

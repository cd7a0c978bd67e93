"""Sources, sinks and the resume logic."""

from pyspark.sql import functions as F

from helpers import rows
from monthloom.model import PANEL_COLUMNS
from monthloom.operators.targets import task_matrix
from monthloom.sources.driver_tables import orders_panel
from monthloom.sources.panel_io import read_extracts, read_panel, write_extracts, write_panel
from monthloom.sources.store import ResultStore, cut_lineage, input_digest, scratch_path, shared_dir


def test_extract_roundtrip(spark, sf_dir):
    panel = orders_panel(spark, sf_dir)
    path = scratch_path(spark, "x")
    write_extracts(panel, path)
    back = read_extracts(spark, path)
    assert back.dtypes == panel.select(*PANEL_COLUMNS).dtypes
    assert rows(back) == rows(panel.select(*PANEL_COLUMNS))


def test_rewriting_a_month_keeps_the_others(spark, sf_dir):
    panel = orders_panel(spark, sf_dir)
    path = scratch_path(spark, "p")
    write_panel(panel, path)
    month = panel.where("year = 2000 and mon = 3").withColumn("rat", F.lit(1))
    write_panel(month, path)
    back = read_panel(spark, path)
    assert back.count() == panel.count()
    assert rows(back.where("year = 2000 and mon = 3").select("rat").distinct()) == [(1,)]
    assert back.where("rat = 1").count() == month.count()


def test_metrics_store_and_resume(spark):
    store = ResultStore(spark, scratch_path(spark, "s"))
    tasks = spark.createDataFrame([(t.name,) for t in task_matrix(2019)], "task string")
    assert store.pending(tasks).count() == 9 and store.metrics().count() == 0
    store.save_metrics(spark.createDataFrame([("PCA_2-RF_50", 0.5, 0.6)], "name string, auc double, accuracy double"), "clf_1")
    store.save_metrics(spark.createDataFrame([("PCA_2-RF_50", 3.0, 0.1)], "name string, rmse double, pearson_r double"), "regr_1")
    assert rows(store.metrics().select("task", "auc", "rmse")) == [("clf_1", 0.5, None), ("regr_1", None, 3.0)]
    assert "clf_1" not in {r[0] for r in store.pending(tasks).collect()} and store.pending(tasks).count() == 7
    store.save_metrics(spark.createDataFrame([("again", 0.7, 0.6)], "name string, auc double, accuracy double"), "clf_1")
    assert rows(store.metrics().where("task = 'clf_1'").select("name")) == [("again",)]
    csv = scratch_path(spark, "csv")
    store.export_metrics_csv(csv)
    assert spark.read.option("header", True).csv(csv).count() == 2


def test_datasets_and_predictions(spark):
    store = ResultStore(spark, scratch_path(spark, "s"))
    assert store.dataset("clf_6") is None
    store.save_dataset(spark.range(3), "clf_6")
    assert store.dataset("clf_6").count() == 3
    store.save_predictions(spark.range(2), "clf_6", "m1")
    store.save_predictions(spark.range(4), "clf_6", "m2")
    assert rows(store.predictions().groupBy("task", "model").count()) == [("clf_6", "m1", 2), ("clf_6", "m2", 4)]


def test_a_task_counts_as_done_by_its_commit_alone(spark):
    store = ResultStore(spark, scratch_path(spark, "s"))
    tasks = spark.createDataFrame([("clf_6",), ("regr_6",)], "task string")
    metrics = spark.createDataFrame([("m1", 0.5, 0.6)], "name string, auc double, accuracy double")
    for task in ("clf_6", "regr_6"):
        store.begin(task)
        store.save_dataset(spark.range(3), task)
        store.save_predictions(spark.range(2), task, "m1")
    store.save_metrics(metrics, "clf_6")
    assert store.commits().count() == 0 and store.predictions(committed=True).count() == 0
    store.commit("clf_6", "x")
    assert rows(store.pending(tasks, "x")) == [("regr_6",)]
    assert rows(store.pending(tasks, "y")) == [("clf_6",), ("regr_6",)]  # made from other inputs
    assert rows(store.predictions(committed=True).select("task").distinct()) == [("clf_6",)]
    assert rows(store.commits().select("task", "n_rows", "models")) == [("clf_6", 3, ["m1"])]
    store.begin("regr_6")  # what the ended run has left goes
    assert store.dataset("regr_6") is None and rows(store.predictions().select("task").distinct()) == [("clf_6",)]
    store.begin("clf_6")
    assert store.commits().count() == 0 and store.metrics().count() == 0


def test_input_digest(spark):
    table = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "id long, t string")
    same = input_digest(table, "s", 1)
    assert same == input_digest(table.repartition(3), "s", 1) == input_digest(table.orderBy(F.desc("id")), "s", 1)
    assert len({same, input_digest(table.distinct(), "s", 1), input_digest(table, "s", 2),
                input_digest(table.withColumnRenamed("t", "u"), "s", 1), input_digest(table.limit(0), "s", 1)}) == 5


def test_a_run_killed_before_its_metrics_begins_the_task_anew(spark, sf_dir, monkeypatch):
    """Between predictions and metrics: nothing counts, and the next run leaves no prediction of the first."""
    import pytest
    from monthloom.operators.clean import CleaningRules
    from monthloom.plans.tasks import run_tasks

    store = ResultStore(spark, scratch_path(spark, "run"))
    args = (cut_lineage(orders_panel(spark, sf_dir), "run-panel"), CleaningRules(2000), store, 2000, (1995, 1), (2001, 8))
    small = dict(periods=((12, 12),), kinds=("regr",), trees=(2,), max_depth=2)
    with monkeypatch.context() as m:
        m.setattr(store, "save_metrics", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            run_tasks(*args, pca=(2,), **small)
    assert store.predictions().count() > 0 and store.predictions(committed=True).count() == 0
    assert store.metrics(committed=True).count() == 0
    done = run_tasks(*args, pca=(3,), **small)
    assert done.where("type = 'predicted'").count() == 1
    assert rows(store.predictions(committed=True).select("task", "model").distinct()) == [("regr_12", "PCA_3-RF_2")]
    assert store.predictions().count() == store.predictions(committed=True).count()


def test_cut_lineage_reads_from_the_shared_folder(spark):
    cut = cut_lineage(spark.range(5), "cut")
    assert "/cut-" in cut.inputFiles()[0] and shared_dir(spark).split("/")[-1] in cut.inputFiles()[0]
    assert cut.count() == 5

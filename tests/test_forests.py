"""Deep forests grown in tasks: splits by brute force, nodes split in both ways, and next to Spark's own forests."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import rows
from monthloom.operators.encode import assemble
from monthloom.operators.forests import BINS, alike, bin_edges, descend, draws, forest_votes, grow
from monthloom.operators.metrics import regression_metrics
from monthloom.operators.models import ForestModel, evaluate_models, make_models
from monthloom.operators.split import split_panel
from monthloom.sources.store import cut_lineage, freed_shuffles


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = np.c_[rng.standard_normal((300, 2)), rng.integers(0, 3, 300), np.ones(300)]
    y = 10 * x[:, 0] + x[:, 2] + rng.standard_normal(300)
    data = [(i, int(i * 7919 % 1009), float(y[i]), i % 5 == 0, x[i].tolist()) for i in range(300)]
    return cut_lineage(spark.createDataFrame(data, "row long, key long, label double, scored boolean, inputs array<double>"), "forest-test")


def some(k):
    return 2


def test_a_tree_splits_best_and_to_the_end():
    rng = np.random.default_rng(5)
    bins, label = rng.integers(0, BINS, (4, 200)).astype(np.uint8), rng.standard_normal(200)
    weight = rng.integers(1, 4, 200).astype(float)
    bins[3] = 7  # constant
    tree = grow(bins, label, weight, 1, 30, 4, 0, 42)

    def loss(mask):
        return sum(np.sum(weight[m] * (label[m] - np.average(label[m], weights=weight[m])) ** 2) for m in (mask, ~mask) if m.any())
    best = min((loss(bins[f] <= c), f, c) for f in range(4) for c in range(BINS))
    assert (tree["feature"][0], tree["cut"][0]) == best[1:]
    assert np.allclose(descend(tree, bins), label)  # no two rows are alike
    stump = grow(bins, label, weight, 1, 1, 4, 0, 42)
    assert len(stump["feature"]) == 3 and abs(stump["value"][0] - np.average(label, weights=weight)) < 1e-12
    assert len(grow(bins, np.full(200, 0.1), weight, 1, 30, 4, 0, 42)["feature"]) == 1  # nothing to gain


def test_dense_and_sorted_splits_agree(monkeypatch):
    import monthloom.operators.forests as forests

    rng = np.random.default_rng(6)
    bins, label, weight = rng.integers(0, BINS, (5, 400)).astype(np.uint8), rng.standard_normal(400), rng.integers(1, 4, 400).astype(float)
    found = []
    for dense in (0, 10 ** 9):
        monkeypatch.setattr(forests, "DENSE", dense)
        found.append(grow(bins, label, weight, 1, 30, 3, 0, 42))
    assert all(np.allclose(found[0][c], found[1][c]) for c in ("feature", "cut", "child", "value"))


def test_only_tried_features_are_counted(monkeypatch):
    """A level takes as many counts as a node tries features, not as there are features."""
    import monthloom.operators.forests as forests

    rng = np.random.default_rng(7)
    bins, label, weight = rng.integers(0, BINS, (16, 2000)).astype(np.uint8), rng.standard_normal(2000), np.ones(2000)
    counted = []
    monkeypatch.setattr(forests, "split_counts", lambda *h, f=forests.split_counts: counted.append(len(h[0])) or f(*h))
    grow(bins, label, weight, 1, 4, 4, 0, 42)
    assert len(counted) == 4 * 4 and sum(counted) <= 4 * (1 + 2 + 4 + 8)


def test_bootstrap_weights():
    n = draws(np.arange(100000, dtype=np.uint64), 3, 42)
    assert abs(n.mean() - 1) < 0.02 and abs(n.var() - 1) < 0.03 and abs((n == 0).mean() - np.exp(-1)) < 0.01
    assert abs(np.corrcoef(n, draws(np.arange(100000, dtype=np.uint64), 4, 42))[0, 1]) < 0.02


def test_bins_of_few_and_many_values(table):
    edges = bin_edges(table)
    assert [len(e) for e in edges[2:]] == [2, 0] and list(edges[2]) == [0.0, 1.0]
    assert all(BINS - 4 < len(e) < BINS for e in edges[:2])


@pytest.mark.parametrize("is_clf", [True, False])
def test_large_nodes_are_split_over_tasks(table, is_clf):
    """Nodes split by counts of all tasks and nodes grown in one task make the same forest."""
    data = cut_lineage(table.withColumn("label", (F.col("label") > 0).cast("double")) if is_clf else table, "forest-test")
    whole = rows(forest_votes(data, [3, 8], 30, some, 42))
    parted = rows(forest_votes(data.repartition(5), [3, 8], 30, some, 42, most=25))
    assert len(whole) == 60 and [r[0] for r in whole] == [r[0] for r in parted]
    assert np.allclose(np.array(whole), np.array(parted))
    first = rows(forest_votes(data, [3], 30, some, 42))
    assert np.allclose(np.array(whole)[:, :2], np.array(first))  # the first trees are a forest of their own


def test_upper_leaves(table):
    """Nodes above the size of a group that end as leaves: by depth, and by labels that are all the same."""
    for data, depth in ((table, 1), (table.withColumn("label", F.lit(4.0)), 30)):
        data = cut_lineage(data, "forest-test")
        assert np.allclose(np.array(rows(forest_votes(data, [4], depth, some, 42, most=25))),
                           np.array(rows(forest_votes(data, [4], depth, some, 42))))


def test_odd_labels_and_rows(spark, table):
    for label in (None, float("nan")):
        with pytest.raises(ValueError):
            forest_votes(table.withColumn("label", F.lit(label).cast("double")), [2], 30, some, 42)
    with pytest.raises(ValueError):
        forest_votes(table.where("scored"), [2], 30, some, 42)
    one = cut_lineage(table.where("scored OR row = 1"), "forest-test")
    label = table.where("row = 1").first()["label"]
    assert all(abs(r["s0"] - 5 * label) < 1e-6 for r in forest_votes(one, [5], 30, some, 42).collect())


def test_deep_forests_grow_in_tasks(spark, monkeypatch):
    """The grid's depth never fits a forest of Spark's, which the driver would hold; its metrics are as good."""
    raw = cut_lineage(spark.range(600).select("id", *[F.rand(s).alias(f"x{s}") for s in range(5)], F.lit(0.0).alias("baseline")), "deep")
    data = cut_lineage(split_panel(raw.withColumn("label", 10 * F.col("x0") + F.col("x1"))), "deep")
    data = assemble(data, {})
    train, val = (data.where(f"split = '{s}'").withColumnRenamed("features", "inputs") for s in ("train", "val"))
    plain = regression_metrics(ForestModel(False, None, 20).forest(20).fit(train).transform(val)).first()["rmse"]

    def refuse(self, trees):
        raise AssertionError("grown on the driver")
    monkeypatch.setattr(ForestModel, "forest", refuse)
    predictions, metrics = evaluate_models(data, make_models(False, 5, pca=(None, 5), trees=(10, 20)), False)
    got = {r["name"]: r["rmse"] for r in metrics.collect()}
    assert got["RF_20"] < 1.15 * plain and set(got) == {"RF_10", "RF_20", "PCA_5-RF_10", "PCA_5-RF_20"}
    assert all(rows(p.select("id")) == rows(val.select("id")) for p in predictions.values())


def test_rows_with_the_same_bins_grow_as_one():
    """Trees from one row for each set of equal bins are those from all rows."""
    rng = np.random.default_rng(8)
    bins, weight = rng.integers(0, 6, (2, 500)).astype(np.uint8), rng.integers(1, 4, 500).astype(float)
    first, own = alike(bins)
    assert len(first) == len({tuple(c) for c in bins.T}) and (bins[:, first][:, own] == bins).all()
    for label in (rng.standard_normal(500), (rng.random(500) < 0.3) - 0.3):
        w, y, yy = (np.bincount(own, x) for x in (weight, weight * label, weight * label ** 2))
        one = grow(bins[:, first], y / w, w, 1, 30, 1, 0, 42, yy / w)
        assert np.allclose(descend(one, bins), descend(grow(bins, label, weight, 1, 30, 1, 0, 42), bins))
    assert alike(np.arange(64, dtype=np.uint8).reshape(2, 32) % BINS) is None  # no two alike
    assert alike(np.zeros((13, 40), np.uint8)) is None  # too many features for one number
    assert alike(np.zeros((2, 0), np.uint8)) is None


def test_predicted_rows_do_not_pass_the_driver(spark, monkeypatch):
    """Votes join their rows once a forest, whatever the number of models, and without a broadcast."""
    import monthloom.operators.models as models

    raw = cut_lineage(spark.range(200).select("id", *[F.rand(s).alias(f"x{s}") for s in range(3)], F.lit(0.0).alias("baseline")), "votes")
    data = assemble(cut_lineage(split_panel(raw.withColumn("label", (F.col("x0") > 0.5).cast("double"))), "votes"), {})
    plans = []

    def plan(df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return df
    monkeypatch.setattr(models, "cut_lineage", lambda df, name, store=models.cut_lineage: store(plan(df), name))
    predictions, metrics = evaluate_models(data, make_models(True, 3, pca=(None, 2), trees=(3, 5)), True)
    for df in (*predictions.values(), metrics):
        plan(df)
    assert not any("Broadcast" in p for p in plans)
    assert sum(p.count("SortMergeJoin") for p in plans) == 2  # one a forest
    val = rows(data.where("split = 'val'").select("id", "split", "label", "baseline"))
    assert all(rows(p.drop("pred")) == val and p.columns == ["id", "split", "label", "baseline", "pred"] for p in predictions.values())


def test_rows_are_not_copied_for_groups_of_trees(spark, table, monkeypatch):
    """Each task reads the stored bins; what is shuffled are votes, not rows to learn from."""
    import monthloom.operators.forests as forests

    plans = {}

    def store(df, name, own=forests.cut_lineage):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return own(df, name)
    monkeypatch.setattr(forests, "cut_lineage", store)
    forest_votes(table, [3, 30], 30, some, 42)
    plan = plans["forest-votes"]
    assert "Generate" not in plan and "InArrow" in plan
    assert "hashpartitioning(row" in plan and plan.count("Exchange") == 1


def test_copies_are_on_disk_for_a_round_of_trees(spark, table, monkeypatch):
    """Rows of nodes that are split over tasks are dealt some trees at a time, and one table of sums is kept."""
    import monthloom.operators.forests as forests

    made, gone = [], []
    monkeypatch.setattr(forests, "scratch_path", lambda s, name, own=forests.scratch_path: made.append(own(s, name)) or made[-1])
    monkeypatch.setattr(forests, "remove", lambda s, path, own=forests.remove: gone.append(path) or own(s, path))
    step = max(1, 3 * spark.sparkContext.defaultParallelism * 25 // 240)
    parted = rows(forest_votes(table, [2, 3 * step], 30, some, 42, most=25))
    assert len(made) == 3 and gone == made[:-1]
    assert np.allclose(np.array(parted), np.array(rows(forest_votes(table, [2, 3 * step], 30, some, 42))))


def test_parts_of_a_tree_grow_by_turns(monkeypatch):
    """Subtrees grown one after another make the tree that grows level by level."""
    import monthloom.operators.forests as forests

    rng = np.random.default_rng(9)
    bins, label, weight = rng.integers(0, BINS, (5, 3000)).astype(np.uint8), rng.standard_normal(3000), rng.integers(1, 4, 3000).astype(float)
    for n_tried in (2, 5):
        whole = descend(grow(bins, label, weight, 1, 30, n_tried, 0, 42), bins)
        monkeypatch.setattr(forests, "PART", 100)
        small, largest = [], forests._Sorter.__init__
        monkeypatch.setattr(forests._Sorter, "__init__", lambda self, node, *x: small.append(len(node)) or largest(self, node, *x))
        parted = descend(grow(bins, label, weight, 1, 30, n_tried, 0, 42), bins)
        monkeypatch.undo()
        assert np.allclose(whole, parted) and max(small) <= 100
    key = np.arange(1000, dtype=np.uint64)
    monkeypatch.setattr(forests, "PART", 7)
    cut = draws(key, 3, 42)
    monkeypatch.undo()
    assert (cut == draws(key, 3, 42)).all()


def test_shuffle_files_do_not_pile_up(spark):
    """Inside, a stored table leaves no shuffle files; the setting is as before afterwards."""
    import time

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    disk, before = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager(), spark.conf.get(name, None)

    def blocks():
        found = disk.getAllBlocks()
        return {str(found.apply(i)) for i in range(found.size())}
    known = blocks()
    with freed_shuffles(spark):
        stored = cut_lineage(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), "freed")
        for _ in range(50):  # they go a moment later
            left = {b for b in blocks() - known if b.startswith("shuffle")}
            if not left:
                break
            time.sleep(0.2)
    assert not left and stored.count() == 10 and spark.conf.get(name, None) == before


def test_tables_made_on_the_way_are_removed(spark, monkeypatch):
    """Components and bins go once the predictions are stored; those can still be read."""
    import monthloom.operators.forests as forests
    import monthloom.operators.models as models

    raw = cut_lineage(spark.range(200).select("id", *[F.rand(s).alias(f"x{s}") for s in range(3)], F.lit(0.0).alias("baseline")), "votes")
    data = assemble(cut_lineage(split_panel(raw.withColumn("label", (F.col("x0") > 0.5).cast("double"))), "votes"), {})
    made = {}

    def store(df, name, own=cut_lineage):
        made.setdefault(name, []).append(own(df, name))
        return made[name][-1]
    for module in (forests, models):
        monkeypatch.setattr(module, "cut_lineage", store)
    predictions, metrics = evaluate_models(data, make_models(True, 3, pca=(2, 3), trees=(3, 5)), True)
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def there(df):
        path = root(df.inputFiles()[0])
        return path.getFileSystem(conf).exists(path)
    assert [sum(map(there, made[n])) for n in ("model-inputs", "forest-bins", "forest-predictions")] == [0, 0, 2]
    assert metrics.count() == 4 and all(p.count() > 0 for p in predictions.values())

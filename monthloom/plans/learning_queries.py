"""Splits, metrics, models and the task store."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.functions.periods import PeriodSpec
from monthloom.operators.encode import category_columns, category_dictionary, learned_vectors
from monthloom.operators.features import FeatureSpec, wide_features
from monthloom.operators.metrics import (baseline_metrics, classification_metrics, confusion_matrix, misclassified,
                                         regression_metrics, stack_metrics, tagged)
from monthloom.operators.models import (FINAL_MODEL, FOREST_SIZES, PCA_SIZES, evaluate_models, make_models, vector_size)
from monthloom.operators.pca import fit_components, project
from monthloom.operators.split import split_panel, split_sizes
from monthloom.plans.feature_queries import TASKS, dataset_of, features_of
from monthloom.plans.registry import query, rounded
from monthloom.plans.sql_blocks import (PANEL, clf_metrics_sql, dataset_ctes, ordinals, reg_metrics_sql, split_ctes, suffix,
                                        target_of)
from monthloom.sources.driver_tables import PANEL_REF_YEAR, label_predictions, orders_panel, table
from monthloom.sources.store import ResultStore, cut_lineage, freed_shuffles, input_digest, scratch_path


def split_dataset(spark, sf, name: str, bins="groups"):
    """A task's dataset, stored and split."""
    task = TASKS[name]
    stored = cut_lineage(dataset_of(spark, sf, task, bins=bins), f"dataset-{name}")
    return split_panel(stored, stratify="label" if task.is_clf else None)


# ---- splits ------------------------------------------------------------------------


@query("split_sizes", dataset_ctes(6, "regr") + split_ctes(False) + "SELECT split, count(*) AS n FROM splits GROUP BY split")
def unstratified_sizes(spark, sf):
    return split_sizes(split_dataset(spark, sf, "regr_6")).select("split", "n")


@query("split_assignment", dataset_ctes(6, "regr") + split_ctes(False) + "SELECT id, split FROM splits")
def split_assignment(spark, sf):
    return split_dataset(spark, sf, "regr_6").select("id", "split")


@query("split_stratified", dataset_ctes(6, "clf") + split_ctes(True)
       + "SELECT split, count(*) AS n, CAST(sum(label) AS BIGINT) AS positive FROM splits GROUP BY split")
def split_stratified(spark, sf):
    return split_sizes(split_dataset(spark, sf, "clf_6"))


@query("split_stratified_assignment", dataset_ctes(6, "clf") + split_ctes(True) + "SELECT id, label, split FROM splits")
def split_stratified_assignment(spark, sf):
    return split_dataset(spark, sf, "clf_6").select("id", "label", "split")


# ---- metrics -------------------------------------------------------------------------

_LABELLED = "WITH p AS (SELECT doc_id, quality AS label, 1 - toxic AS pred FROM labels)\n"
_HALVES = PANEL + """, halves AS (
  SELECT id, avg(CASE WHEN year = 2000 AND mon <= 6 THEN rat END) AS pred, avg(CASE WHEN year = 2000 AND mon > 6 THEN rat END) AS label
  FROM panel GROUP BY id),
p AS (SELECT * FROM halves WHERE pred IS NOT NULL AND label IS NOT NULL)
"""


def half_year_predictions(spark, sf):
    """The second half of the last full year predicted by the first."""
    period = PeriodSpec(6)
    halves = [period.ordinal(PANEL_REF_YEAR, start) for start in (0, 6)]
    wide = wide_features(orders_panel(spark, sf), [FeatureSpec("rat", "mean")], period, halves)
    return wide.select("id", F.col("rat_mean_2000_0").alias("pred"), F.col("rat_mean_2000_6").alias("label")).dropna()


@query("clf_metrics", _LABELLED + f"SELECT {clf_metrics_sql()} FROM p")
def clf_metrics(spark, sf):
    return rounded(classification_metrics(label_predictions(spark, sf)))


@query("confusion_matrix", _LABELLED + """SELECT CAST(a.v AS INT) AS label, CAST(b.v AS INT) AS pred, count(p.doc_id) AS n
FROM range(2) a(v) CROSS JOIN range(2) b(v) LEFT JOIN p ON p.label = a.v AND p.pred = b.v GROUP BY 1, 2""")
def confusion(spark, sf):
    return confusion_matrix(label_predictions(spark, sf))


@query("misclassified", _LABELLED + """SELECT p.doc_id, label, pred, lang, source, n_chars FROM p JOIN documents d
ON p.doc_id = d.doc_id WHERE label <> pred""")
def misclassified_rows(spark, sf):
    wrong = misclassified(label_predictions(spark, sf))
    return wrong.join(table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")


@query("reg_metrics", _HALVES + f"SELECT {reg_metrics_sql()} FROM p")
def reg_metrics(spark, sf):
    return rounded(regression_metrics(half_year_predictions(spark, sf)))


@query("baseline_metrics", dataset_ctes(6, "clf") + split_ctes(True)
       + f"SELECT split, {clf_metrics_sql('baseline')} FROM splits WHERE split <> 'train' GROUP BY split")
def baseline_clf(spark, sf):
    return rounded(baseline_metrics(split_dataset(spark, sf, "clf_6"), True))


@query("baseline_metrics_regr", dataset_ctes(6, "regr") + split_ctes(False)
       + f"SELECT split, {reg_metrics_sql('baseline')} FROM splits WHERE split <> 'train' GROUP BY split")
def baseline_regr(spark, sf):
    return rounded(baseline_metrics(split_dataset(spark, sf, "regr_6"), False))


@query("baseline_metrics_regrdiff", dataset_ctes(12, "regrdiff") + split_ctes(False)
       + f"SELECT split, {reg_metrics_sql('baseline')} FROM splits WHERE split <> 'train' GROUP BY split")
def baseline_regrdiff(spark, sf):
    return rounded(baseline_metrics(split_dataset(spark, sf, "regrdiff_12"), False))


_UNION_SQL = (_HALVES.replace("p AS (", "r AS (")
              + ", c AS (SELECT quality AS label, 1 - toxic AS pred, 0 AS zero FROM labels)\n"
              + " UNION ALL ".join([
                  f"SELECT 'clf' AS family, 'labels' AS name, 'predicted' AS type, {clf_metrics_sql()}, "
                  "CAST(NULL AS DOUBLE) AS rmse, CAST(NULL AS DOUBLE) AS pearson_r FROM c",
                  f"SELECT 'clf', 'labels', 'baseline', {clf_metrics_sql('zero')}, NULL, NULL FROM c",
                  f"SELECT 'regr', 'half_years', 'predicted', NULL, NULL, {reg_metrics_sql()} FROM r",
                  f"SELECT 'regr', 'half_years', 'baseline', NULL, NULL, {reg_metrics_sql('0')} FROM r",
              ]))


@query("metrics_union", _UNION_SQL)
def metrics_union(spark, sf):
    labels, halves = label_predictions(spark, sf), half_year_predictions(spark, sf)
    zero = F.lit(0)
    return rounded(stack_metrics([
        tagged(classification_metrics(labels), "labels", "predicted", "clf"),
        tagged(classification_metrics(labels.withColumn("pred", zero)), "labels", "baseline", "clf"),
        tagged(regression_metrics(halves), "half_years", "predicted", "regr"),
        tagged(regression_metrics(halves.withColumn("pred", zero)), "half_years", "baseline", "regr"),
    ]))


@query("matrix_maxima", dataset_ctes(6, "clf") + """SELECT max(gms_sum_2000_0) AS gms_sum_2000_0, max(rat_mean_2000_0) AS rat_mean_2000_0,
       max(tit_max_2000_0) AS tit_max_2000_0, CAST(sum(label) AS BIGINT) AS positive FROM dataset""")
def matrix_maxima(spark, sf):
    dataset = dataset_of(spark, sf, TASKS["clf_6"])
    columns = ["gms_sum_2000_0", "rat_mean_2000_0", "tit_max_2000_0"]
    return rounded(dataset.agg(*[F.max(c).alias(c) for c in columns], F.sum("label").cast("long").alias("positive")))


# ---- task store -----------------------------------------------------------------------------


def _stored_baselines(spark, sf, names):
    """Baseline metrics of some tasks, written to a fresh store."""
    store = ResultStore(spark, scratch_path(spark, "results"))
    for name in names:
        task = TASKS[name]
        metrics = baseline_metrics(split_dataset(spark, sf, name), task.is_clf)
        store.save_metrics(tagged(metrics, name, "baseline", task.kind), name)
    return store


_BASELINE_ROWS = " UNION ALL ".join(
    f"SELECT * FROM ({ctes} SELECT '{task}' AS task, '{kind}' AS family, 'baseline' AS type, '{task}' AS name, split, {values} "
    "FROM splits WHERE split <> 'train' GROUP BY split)"
    for task, kind, ctes, values in [
        ("clf_6", "clf", dataset_ctes(6, "clf") + split_ctes(True),
         clf_metrics_sql("baseline") + ", CAST(NULL AS DOUBLE) AS rmse, CAST(NULL AS DOUBLE) AS pearson_r"),
        ("regr_6", "regr", dataset_ctes(6, "regr") + split_ctes(False),
         "CAST(NULL AS DOUBLE) AS auc, CAST(NULL AS DOUBLE) AS accuracy, " + reg_metrics_sql("baseline")),
    ])


@query("metrics_roundtrip", _BASELINE_ROWS)
def metrics_roundtrip(spark, sf):
    return rounded(_stored_baselines(spark, sf, ["clf_6", "regr_6"]).metrics())


@query("task_resume", f"""WITH done AS ({_BASELINE_ROWS}),
tasks AS (SELECT kind || '_' || n AS task FROM (VALUES ('clf'), ('regr'), ('regrdiff')) k(kind), (VALUES (1), (6), (12)) v(n))
SELECT task FROM tasks WHERE task NOT IN (SELECT task FROM done)""")
def task_resume(spark, sf):
    store = _stored_baselines(spark, sf, ["clf_6", "regr_6"])
    return store.pending(spark.createDataFrame([(name,) for name in TASKS], "task string"))


@query("task_commits", f"""SELECT * FROM ({dataset_ctes(6, "clf")} SELECT 'clf_6' AS task, count(*) AS n_rows, true AS done FROM dataset)
UNION ALL SELECT * FROM ({dataset_ctes(6, "regr")} SELECT 'regr_6', count(*), false FROM dataset)""")
def task_commits(spark, sf):
    """Two tasks of which one ends before its commit: rows stored, and whether the task counts as done."""
    store = ResultStore(spark, scratch_path(spark, "results"))
    inputs = input_digest(orders_panel(spark, sf), "task_commits")
    stored = {}
    for name in ("clf_6", "regr_6"):
        store.begin(name)
        stored[name] = store.save_dataset(dataset_of(spark, sf, TASKS[name]), name).agg(F.count("*").alias("n_rows"))
    store.commit("clf_6", inputs)
    names = spark.createDataFrame([(name,) for name in stored], "task string")
    left = store.pending(names, inputs).withColumn("left", F.lit(True))
    rows = reduce(DataFrame.union, [n.select(F.lit(name).alias("task"), "n_rows") for name, n in stored.items()])
    return rows.join(left, "task", "left").select("task", "n_rows", F.col("left").isNull().alias("done"))


# ---- models -----------------------------------------------------------------------------------


def vectors(spark, sf, name: str, bins="groups", shared: dict | None = None):
    """Split dataset of a task with its one-hot encoded feature vector, stored once.

    ``shared`` keeps what tasks of the same period have in common, the wide features and their vectors, so that each is
    made once. Tasks of a period differ in label, baseline and split only, which join the vectors by id.
    """
    with freed_shuffles(spark):
        return _vectors(spark, sf, name, bins, shared)


def _vectors(spark, sf, name, bins, shared):
    task = TASKS[name]
    n, stratify = task.n_months, "label" if task.is_clf else None
    if shared is None:
        features = features_of(spark, sf, n)
    else:
        if ("features", n) not in shared:
            shared["features", n] = cut_lineage(features_of(spark, sf, n), f"features-{n}")
        features = shared["features", n]
        if (n, bins) in shared:
            own = cut_lineage(dataset_of(spark, sf, task, features, bins).select("id", "label", "baseline"), f"labels-{name}")
            own, known = split_panel(own, stratify=stratify), shared[n, bins].select(F.col("id").alias("_id"), "features")
            joined = own.join(known, F.col("id").eqNullSafe(F.col("_id")))
            return cut_lineage(joined.select("id", "split", "label", "baseline", "features"), f"vectors-{name}")
    stored = cut_lineage(dataset_of(spark, sf, task, features, bins), f"dataset-{name}")
    columns = category_columns(stored)
    found = learned_vectors(split_panel(stored, stratify=stratify), columns, dictionary=category_dictionary(stored, columns))
    if shared is not None:
        shared[n, bins] = found
    return found


def _grid(spark, sf, name: str):
    """Validation metrics of all models of a task; their predictions are stored on the way."""
    task, data = TASKS[name], vectors(spark, sf, name)
    store = ResultStore(spark, scratch_path(spark, "results"))
    models = make_models(task.is_clf, vector_size(data))
    return evaluate_models(data, models, task.is_clf, family=task.kind,
                           keep_predictions=lambda p, model: store.save_predictions(p, name, model))[1]


@query("rf_grid_clf")
def rf_grid_clf(spark, sf):
    return _grid(spark, sf, "clf_6")


@query("rf_grid_regr")
def rf_grid_regr(spark, sf):
    return _grid(spark, sf, "regr_6")


def _predicted(spark, sf, names, on: str, models_of):
    """Stored predictions of some models of some tasks; the wide features of each period are stored once."""
    store, shared = ResultStore(spark, scratch_path(spark, "results")), {} if len(names) > 1 else None
    for name in names:
        task, data = TASKS[name], vectors(spark, sf, name, shared=shared)
        evaluate_models(data, models_of(task, vector_size(data)), task.is_clf, on=on, family=task.kind,
                        keep_predictions=lambda p, model, name=name: store.save_predictions(p, name, model))
    return (store.predictions().groupBy("task", F.col("model").alias("name"), "split")
            .agg(F.count("pred").alias("n"), F.round(F.sum("label"), 3).alias("labels"), F.round(F.sum("baseline"), 3).alias("baselines")))


def _predicted_sql(tasks, on: str, models) -> str:
    rows = " UNION ALL ".join(
        f"SELECT * FROM ({dataset_ctes(TASKS[t].n_months, TASKS[t].kind)}{split_ctes(TASKS[t].is_clf)} SELECT '{t}' AS task, split, "
        "count(*) AS n, round(sum(label), 3) AS labels, round(sum(baseline), 3) AS baselines "
        f"FROM splits WHERE split = '{on}' GROUP BY split)" for t in tasks)
    names = ", ".join(f"('{name}')" for name in models)
    return f"SELECT r.task, m.name, r.split, r.n, r.labels, r.baselines FROM ({rows}) r, (VALUES {names}) m(name)"


def _grid_of(task: str):
    """Every model of the grid on a task, by the validation rows it predicted."""
    sql = _predicted_sql([task], "val", [f"PCA_{k}-RF_{n}" for k in PCA_SIZES for n in FOREST_SIZES])

    @query(f"rf_grid_{task}", sql)
    def run(spark, sf):
        return _predicted(spark, sf, [task], "val", lambda t, size: make_models(t.is_clf, size))
    return run


for _task in TASKS:  # with the two above, whose metrics they give, all nine
    if _task not in ("clf_6", "regr_6"):
        _grid_of(_task)


@query("final_model_all", _predicted_sql(TASKS, "test", [FINAL_MODEL]))
def final_model_all(spark, sf):
    """The chosen model on every task, by the test rows it predicted."""
    return _predicted(spark, sf, TASKS, "test", lambda t, size: {FINAL_MODEL: make_models(t.is_clf, size)[FINAL_MODEL]})


@query("plain_forest")
def plain_forest(spark, sf):
    """Forests on the features as they are, next to one on components."""
    data = vectors(spark, sf, "clf_6")
    return evaluate_models(data, make_models(True, vector_size(data), pca=(None, 10), trees=(50, 100)), True)[1]


_SPECTRUM = [f"{f}_{suffix(6, o)}" for f in ("rat_mean", "gms_sum") for o in ordinals(6) if o < target_of(6)]
_SQUARES = " + ".join(f"{1 if a == b else 2} * power(covar_samp({a}, {b}), 2)"
                      for i, a in enumerate(_SPECTRUM) for b in _SPECTRUM[i:])


@query("pca_spectrum", dataset_ctes(6, "regr") + f"""SELECT {len(_SPECTRUM)} AS n_features,
       round(ln({" + ".join(f"var_samp({c})" for c in _SPECTRUM)}), 6) AS ln_variance,
       round(ln({_SQUARES}), 6) AS ln_squares, CAST(0 AS DOUBLE) AS error FROM dataset""")
def pca_spectrum(spark, sf):
    """Sum and sum of squares of all component variances, and how far the first components' values are from theirs."""
    dataset = cut_lineage(dataset_of(spark, sf, TASKS["regr_6"]).select(*_SPECTRUM), "spectrum")
    data = VectorAssembler(inputCols=_SPECTRUM, outputCol="features").transform(dataset).select("features")
    fitted = fit_components(data, 3)
    errors = [F.abs(F.var_samp(F.col("components")[i]) / float(fitted.variances[i]) - 1) for i in range(3)]
    return rounded(project(data, fitted).agg(F.greatest(*errors).alias("error")).select(
        F.lit(len(_SPECTRUM)).alias("n_features"), F.log(F.lit(float(fitted.variances.sum()))).alias("ln_variance"),
        F.log(F.lit(float((fitted.variances ** 2).sum()))).alias("ln_squares"), "error"))


@query("final_model")
def final_model(spark, sf):
    """The chosen model of each half-year task on the test split, next to the baseline."""
    store = ResultStore(spark, scratch_path(spark, "results"))
    rows, shared = [], {}
    for name in ("clf_6", "regr_6", "regrdiff_6"):
        task, data = TASKS[name], vectors(spark, sf, name, shared=shared)
        chosen = {name: make_models(task.is_clf, vector_size(data))[FINAL_MODEL]}
        rows.append(evaluate_models(data, chosen, task.is_clf, on="test", family=task.kind,
                                    keep_predictions=lambda p, model: store.save_predictions(p, model, FINAL_MODEL))[1])
        base = baseline_metrics(data, task.is_clf).where(F.col("split") == "test")
        rows.append(tagged(base, name, "baseline", task.kind))
    return stack_metrics(rows)


@query("bin_scheme_compare")
def bin_scheme_compare(spark, sf):
    """The chosen classifier with fixed age groups and with equal-width age bins."""
    rows, shared = [], {}
    for bins in ("groups", "equal"):
        data = vectors(spark, sf, "clf_6", bins, shared)
        chosen = {f"{FINAL_MODEL} {bins}": make_models(True, vector_size(data))[FINAL_MODEL]}
        rows.append(evaluate_models(data, chosen, True)[1])
    return stack_metrics(rows)

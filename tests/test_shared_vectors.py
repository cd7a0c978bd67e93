"""Tasks of one period share their wide features and the dictionary of their categories."""

from helpers import rows
from monthloom.plans import learning_queries


def test_tasks_of_a_period_make_their_features_once(spark, sf_dir, monkeypatch):
    made, real = [], learning_queries.features_of
    monkeypatch.setattr(learning_queries, "features_of", lambda spark, sf, n: made.append(n) or real(spark, sf, n))
    shared = {}
    learning_queries.vectors(spark, sf_dir, "clf_6", shared=shared)
    second = learning_queries.vectors(spark, sf_dir, "regr_6", shared=shared)
    assert made == [6]
    alone = learning_queries.vectors(spark, sf_dir, "regr_6")
    assert made == [6, 6] and rows(second) == rows(alone)
    assert second.schema["features"].metadata == alone.schema["features"].metadata


def test_a_task_alone_stores_no_wide_features(spark, sf_dir, monkeypatch):
    stored, store = [], learning_queries.cut_lineage
    monkeypatch.setattr(learning_queries, "cut_lineage", lambda df, name: stored.append(name) or store(df, name))
    learning_queries.vectors(spark, sf_dir, "clf_12")
    assert stored == ["dataset-clf_12"]


def test_tasks_of_a_period_are_encoded_once(spark, sf_dir, monkeypatch):
    """The second task of a period joins its labels with the vectors of the first."""
    made, stored = [], []
    encode, store = learning_queries.learned_vectors, learning_queries.cut_lineage
    monkeypatch.setattr(learning_queries, "learned_vectors", lambda *a, **b: made.append(a) or encode(*a, **b))
    monkeypatch.setattr(learning_queries, "cut_lineage", lambda df, name: stored.append(name) or store(df, name))
    shared = {}
    for task in ("regr_12", "clf_12"):
        got = learning_queries.vectors(spark, sf_dir, task, shared=shared)
    assert len(made) == 1 and stored.count("features-12") == 1
    alone = learning_queries.vectors(spark, sf_dir, "clf_12")
    assert got.columns == alone.columns and rows(got) == rows(alone)
    assert got.schema["features"].metadata == alone.schema["features"].metadata

"""Learned one-hot encoding against encoding with listed categories."""

import pytest
from pyspark.sql import functions as F

from helpers import rows
from monthloom.operators.encode import assemble, category_dictionary, learn_categories, learned_vectors
from monthloom.operators.models import vector_size
from monthloom.sources.store import cut_lineage


@pytest.fixture(scope="module")
def data(spark):
    made = [(i, "FM"[i % 2], (10, 20, 40)[i % 3], ("", "i", None)[i % 3], i / 4 - 1, i, float(i % 2)) for i in range(40)]
    return cut_lineage(spark.createDataFrame(made, "id long, sex string, k int, flag string, `x y` double, n int, label double"), "encode")


def dense(df):
    return rows(df.select("id", "label", "features").rdd.map(lambda r: (r[0], r[1], tuple(r[2].toArray().tolist()))).toDF())


def test_dictionary(data):
    got = {(r["column"], r["value"]): (r["n"], r["slot"]) for r in category_dictionary(data, ["k", "sex", "flag"]).collect()}
    assert got == {("k", "10"): (14, 0), ("k", "20"): (13, 1), ("k", "40"): (13, 2), ("sex", "F"): (20, None), ("sex", "M"): (20, 3),
                   ("flag", ""): (14, 4), ("flag", "i"): (13, 5), ("flag", None): (13, 6)}


def test_vectors_equal_listed_categories(data):
    columns = ["sex", "k", "flag"]
    want = assemble(data, learn_categories(data, columns))
    got = learned_vectors(data, columns)
    assert vector_size(got) == vector_size(want) == 9 and got.columns == ["id", "label", "features"]
    assert dense(got) == dense(want)


def test_numbers_are_ordered_as_numbers(spark):
    df = spark.createDataFrame([(1, 9), (2, 10), (3, -3), (4, None), (5, 100)], "id long, k int")
    got = sorted((r["slot"], r["value"]) for r in category_dictionary(df, ["k"]).collect())
    assert got == [(0, "-3"), (1, "9"), (2, "10"), (3, "100"), (4, None)]


def test_no_columns_and_no_rows(spark, data):
    plain = learned_vectors(data.select("id", "label", "n"), [])
    assert vector_size(plain) == 1 and plain.where("id = 7").first()["features"].toArray().tolist() == [7.0]
    empty = learned_vectors(data.drop("flag").limit(0), ["sex"])
    assert vector_size(empty) == 3 and empty.count() == 0  # three numbers


def test_values_outside_the_dictionary_have_no_slot(data):
    known = category_dictionary(data.where("k < 40"), ["k", "sex"])
    got = learned_vectors(data.drop("flag"), ["k", "sex"], dictionary=known)
    assert got.where("id = 2").first()["features"].toArray().tolist() == [0.0, 0.0, -0.5, 2.0]


def test_bad_rows_fail(data):
    from pyspark.errors import PySparkException
    with pytest.raises(PySparkException, match="key repeated"):
        learned_vectors(data.unionAll(data.limit(1)), ["k", "sex", "flag"]).count()
    with pytest.raises(PySparkException, match="NULL"):
        learned_vectors(data.select("id", "sex", F.nullif("n", F.lit(3)).alias("n")), ["sex"]).count()


def test_a_hundred_thousand_categories(spark):
    """A third of the rows hold one value; the others are all different."""
    df = spark.range(150_000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.format_string("v%06d", "id")).alias("name"),
                                     (F.col("id") % 2).cast("double").alias("label"))
    df = cut_lineage(df.repartition(16), "many")
    known = category_dictionary(df, ["name"])
    assert known.agg(F.count("*"), F.countDistinct("slot"), F.min("slot"), F.max("slot"), F.max("n")).first()[:] == (100_001, 100_001, 0, 100_000, 50_000)
    assert known.where("value <> 'hot' AND slot >= 1").count() == 100_000
    got = learned_vectors(df, ["name"], dictionary=known)
    assert vector_size(got) == 100_001 and got.count() == 150_000
    row = got.where("id = 1").first()["features"]
    assert row.indices.tolist() == [1] and row.values.tolist() == [1.0]  # "hot" comes first

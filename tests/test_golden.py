"""Hand-derived results on a twelve-row panel."""

import pytest
from pyspark.sql import functions as F

from helpers import rows
from monthloom.functions.periods import PeriodSpec, parse_label
from monthloom.functions.scalars import longer_of
from monthloom.operators import checks
from monthloom.operators.clean import CleaningRules, clean_panel, drop_sex_changes
from monthloom.operators.features import (DEFAULT_FEATURES, FeatureSpec, feature_table, fill_missing, long_features,
                                          reference_labels)
from monthloom.operators.metrics import classification_metrics, confusion_matrix, regression_metrics
from monthloom.operators.targets import build_dataset, select_columns, target_labels

HALF = PeriodSpec(6)
SPAN = HALF.span((2018, 12), (2019, 12))
TARGET = HALF.ordinal(2019, 6)


@pytest.fixture(scope="module")
def features(golden, rules):
    return feature_table(golden, rules, HALF, SPAN).cache()


def test_reader_aligns_layout_and_reads_empty_as_null(golden):
    assert golden.count() == 12
    assert golden.where("fed is null and otit is null").count() == 12
    assert golden.where("flag is null").count() == 7


def test_clean_keeps_expected_rows(golden, rules):
    got = clean_panel(golden, rules).groupBy("id").agg(F.count("*"), F.min("age"), F.max("age"))
    assert rows(got) == [(1, 4, 39, 39), (2, 2, 24, 24), (4, 2, 18, 18), (6, 1, 18, 18)]


def test_as_coded_birth_fix_loses_the_zero_row(golden):
    got = clean_panel(golden, CleaningRules(2019, birth_fix="as_coded")).groupBy("id").count()
    assert rows(got) == [(1, 4), (2, 2), (4, 1), (6, 1)]


def test_women_title_source(golden):
    own = clean_panel(golden, CleaningRules(2019, wtit_source="wtit_code")).where("id = 2").select("tit", "wtit")
    assert rows(own) == [(0, 2), (0, 2)]


def test_sex_changes(golden):
    assert rows(checks.sex_changes(golden).select("id")) == [(3,)]
    assert drop_sex_changes(golden).where("id = 3").count() == 0


def test_wide_features(features):
    filled = fill_missing(features, DEFAULT_FEATURES, HALF, SPAN)
    cells = {r["id"]: r for r in filled.collect()}

    def of(i, name):
        return [cells[i][f"{name}_{HALF.suffix(o)}"] for o in SPAN]

    assert sorted(cells) == [1, 2, 4, 6]
    assert [of(i, "rat_mean") for i in (1, 2, 4, 6)] == [[2000, 2020, 2050], [0, 1800, 1805], [0, 1700, 1690], [0, 0, 1100]]
    assert [of(i, "gms_sum") for i in (1, 2, 4, 6)] == [[5, 3, 7], [0, 0, 4], [0, 2, 2], [0, 0, 9]]
    assert [of(i, "flag_str") for i in (1, 2, 4, 6)] == [["", "i", ""], ["i", "i", ""], ["i", "", ""], ["i", "i", ""]]
    assert [of(i, "tit_max") for i in (1, 2, 4, 6)] == [[2, 2, 3], [0, 0, 0], [0, 1, 1], [0, 0, 0]]
    assert [of(i, "wtit_max") for i in (1, 2, 4, 6)] == [[0, 0, 0], [0, 2, 2], [0, 0, 0], [0, 0, 0]]
    assert [(cells[i]["sex"], cells[i]["k"], cells[i]["age"]) for i in (1, 2, 4, 6)] == [
        ("M", 20, 39), ("F", 40, 24), ("M", 20, 18), ("M", 40, 18)]


@pytest.mark.parametrize("kind, labels, baselines", [
    ("clf", [1, 0, 0, 1], [0, 0, 0, 0]),
    ("regr", [2050, 1805, 1690, 1100], [2020, 1800, 1700, 0]),
    ("regrdiff", [30, 5, -10, 1100], [0, 0, 0, 0]),
])
def test_targets(features, kind, labels, baselines):
    got = build_dataset(features, HALF, SPAN, TARGET, kind).orderBy("id").collect()
    assert [r["age_bin"] for r in got] == ["(35, 50]", "(18, 25]", "(5, 18]", "(5, 18]"]
    assert [r["label"] for r in got] == labels
    assert [r["baseline"] for r in got] == baselines
    assert not [c for c in got[0].asDict() if c.endswith("2019_6")]


def test_require_prev_drops_new_entrants(features):
    got = build_dataset(features, HALF, SPAN, TARGET, "clf", require_prev=True)
    assert rows(got.select("id")) == [(1,), (2,), (4,)]


def test_baseline_metrics(features):
    def scored(kind):
        return build_dataset(features, HALF, SPAN, TARGET, kind).withColumn("pred", F.col("baseline"))

    assert rows(classification_metrics(scored("clf"))) == [(0.5, 0.5)]
    assert rows(confusion_matrix(scored("clf"))) == [(0, 0, 2), (0, 1, 0), (1, 0, 2), (1, 1, 0)]
    rmse, r = rows(regression_metrics(scored("regr")))[0]
    assert rmse == pytest.approx(550.2329052320) and r == pytest.approx(0.9719763962)
    assert rows(regression_metrics(scored("regrdiff")))[0][1] is None


def test_labels(spark, features):
    assert HALF.label("Rat:mean", TARGET) == "Rat:mean/2019/6/6"
    assert PeriodSpec(12).label("Rat:mean", 2019) == "Rat:mean/2019//yearly"
    assert PeriodSpec(1).label("Rat:mean", PeriodSpec(1).ordinal(2019, 11)) == "Rat:mean/2019/11/1"
    assert target_labels(HALF, TARGET) == ("rat:mean/2019/6/6", "rat:mean/2019/0/6")
    assert target_labels(PeriodSpec(1), PeriodSpec(1).ordinal(2019, 0))[1] == "rat:mean/2018/11/1"
    named = reference_labels(features, DEFAULT_FEATURES, HALF, SPAN)
    assert "rat:mean/2019/0/6" in named.columns
    kept = select_columns(named, lambda c: "/" not in c or "/2018/" in c)
    assert kept.columns[:4] == ["id", "sex", "k", "age"] and len(kept.columns) == 4 + len(DEFAULT_FEATURES)
    year, start = parse_label()
    text = spark.createDataFrame([("a:b/2019/6/6",), ("a:b/2019//yearly",)], "label string")
    assert rows(text.select(year, start)) == [(2019, 6), (2019, None)]


def test_buckets(spark):
    quarter = PeriodSpec(3)
    assert [quarter.of_month(2018, m) - quarter.ordinal(2018) for m in (2, 4)] == [0, 1]
    months = spark.range(1, 13).selectExpr("2018 as year", "cast(id as int) as mon")
    for n in range(1, 13):
        period = PeriodSpec(n)
        got = {r["mon"]: r["o"] for r in months.select("mon", period.ordinal_column().alias("o")).collect()}
        assert got == {m: period.of_month(2018, m) for m in range(1, 13)}


@pytest.mark.parametrize("n", [0, -1, 13])
def test_invalid_periods(n):
    with pytest.raises(ValueError):
        PeriodSpec(n)


def test_observed_span(golden):
    assert HALF.observed_span(golden) == SPAN


def test_longest_string_ties(spark):
    panel = spark.createDataFrame([(1, 2019, 1, "ab"), (1, 2019, 2, "ba"), (1, 2019, 3, "z")],
                                  "id long, year int, mon int, foa string")
    assert rows(long_features(panel, [FeatureSpec("foa", "str")], PeriodSpec(12)).select("foa_str")) == [("ba",)]


def test_unknown_aggregate(golden):
    with pytest.raises(ValueError, match="unknown aggregate"):
        long_features(golden, [FeatureSpec("rat", "median of five")], HALF)


def test_longer_of(spark):
    df = spark.createDataFrame([("ab", "cd"), ("a", "bc"), ("", "")], "x string, y string")
    assert [r[0] for r in df.select(longer_of(F.col("x"), F.col("y"))).collect()] == ["ab", "bc", ""]


def test_name_scopes(spark):
    panel = spark.createDataFrame(
        [(1, "A", 2019, 1), (1, "B", 2019, 2), (2, "B", 2019, 1), (3, "C", 2019, 1), (3, "D", 2019, 5)],
        "id long, name string, year int, mon int")
    assert rows(checks.name_changes(panel)) == [(1, "B"), (3, "D")]
    assert rows(checks.name_changes(panel, scope="global")) == [(3, "D")]

"""Relations that must hold on any panel."""

import math
import random

import pytest
from pyspark.sql import functions as F

from helpers import rows
from monthloom.functions.binning import bin_equal_width, bin_right_closed
from monthloom.functions.periods import PeriodSpec
from monthloom.model import AGE_GROUP_EDGES
from monthloom.operators.clean import CleaningRules, clean_panel
from monthloom.operators.dedup import first_per_key, mark_repeats, repeated_groups
from monthloom.operators.encode import learn_categories, one_hot
from monthloom.operators.features import (DEFAULT_FEATURES, STRATEGIES, entity_base, feature_table, wide_features)
from monthloom.operators import quantiles
from monthloom.operators.quantiles import box_stats, exact_quantiles
from monthloom.operators.split import split_panel
from monthloom.operators.targets import build_dataset
from monthloom.plans.registry import rounded
from monthloom.sources.driver_tables import orders_panel

RULES = CleaningRules(2000)
FIRST, LAST = (1995, 1), (2001, 8)


@pytest.fixture(scope="module")
def panel(spark, sf_dir):
    return orders_panel(spark, sf_dir).cache()


@pytest.mark.parametrize("n", [1, 5, 6, 12])
def test_strategies_agree(panel, n):
    period = PeriodSpec(n)
    cleaned = clean_panel(panel, RULES)
    tables = [rows(rounded(wide_features(cleaned, DEFAULT_FEATURES, period, period.span(FIRST, LAST), s)))
              for s in (STRATEGIES if n > 1 else STRATEGIES[:3])]
    assert all(t == tables[0] for t in tables)


@pytest.mark.parametrize("keep", ["first", "last"])
def test_fused_table_equals_cleaning_first(panel, keep):
    period = PeriodSpec(6)
    span = period.span(FIRST, LAST)
    cleaned = clean_panel(panel, RULES)
    apart = entity_base(cleaned, keep=keep).join(wide_features(cleaned, DEFAULT_FEATURES, period, span), "id")
    fused = feature_table(panel, RULES, period, span, keep=keep)
    assert rows(rounded(fused)) == rows(rounded(apart.select(fused.columns)))


def test_row_order_and_partitioning_do_not_matter(panel):
    period = PeriodSpec(6)
    span = period.span(FIRST, LAST)
    shuffled = panel.repartition(7, F.rand(3)).sortWithinPartitions(F.desc("rat"))
    assert rows(rounded(feature_table(shuffled, RULES, period, span))) == rows(
        rounded(feature_table(panel, RULES, period, span)))
    assert rows(first_per_key(shuffled, ["id"])) == rows(first_per_key(panel, ["id"]))


def test_yearly_sum_is_sum_of_halves(panel):
    half, year = PeriodSpec(6), PeriodSpec(12)
    spec = [s for s in DEFAULT_FEATURES if s.name == "gms_sum"]
    h = wide_features(panel, spec, half, half.span(FIRST, LAST)).na.fill(0)
    y = wide_features(panel, spec, year, year.span(FIRST, LAST)).na.fill(0)
    bad = h.join(y, "id").where(F.col("gms_sum_2000") != F.col("gms_sum_2000_0") + F.col("gms_sum_2000_6"))
    assert bad.count() == 0


def test_label_means_improvement(panel):
    period = PeriodSpec(6)
    span = period.span(FIRST, LAST)
    features = feature_table(panel, RULES, period, span)
    clf = build_dataset(features, period, span, 4001, "clf").select("id", F.col("label").alias("up"))
    diff = build_dataset(features, period, span, 4001, "regrdiff").select("id", "label")
    assert clf.join(diff, "id").where((F.col("up") == 1) != (F.col("label") > 10)).count() == 0


@pytest.mark.parametrize("n, stratify", [(1, None), (10, None), (997, None), (1000, "label"), (37, "label")])
def test_split_sizes_and_order(spark, n, stratify):
    df = spark.range(n).select("id", ((F.col("id") % 7) == 0).cast("int").alias("label"))
    got = split_panel(df, stratify=stratify).collect()
    assert sorted(r["id"] for r in got) == list(range(n))

    import hashlib
    groups = {}
    for r in got:
        groups.setdefault(r["label"] if stratify else 0, []).append((hashlib.md5(f"42:{r['id']}".encode()).hexdigest(), r["split"]))
    for members in groups.values():
        members.sort()
        n_test = math.ceil(0.2 * len(members))
        n_val = math.ceil(0.125 * (len(members) - n_test))
        want = ["test"] * n_test + ["val"] * n_val
        want += ["train"] * (len(members) - len(want))
        assert [s for _, s in members] == want


def _numpy_quantiles(values, probs):
    import numpy as np
    return [float(x) for x in np.quantile(values, probs)]


@pytest.mark.parametrize("cells", [2, 16, 4096])
@pytest.mark.parametrize("categories", ["abcde", None])
def test_exact_quantiles(spark, monkeypatch, cells, categories):
    monkeypatch.setattr(quantiles, "CELLS", cells)
    rng = random.Random(5)
    data = [("a", rng.gauss(0, 1)) for _ in range(3000)] + [("b", float(rng.randrange(4))) for _ in range(2000)]
    data += [("c", 7.0)] + [("d", 1.0), ("d", 2.0)] + [("a", None), ("a", float("nan"))]
    data += [("e", 10.0 ** rng.randrange(-9, 9)) for _ in range(300)]
    data += [("skip", 1.0), ("skip", 3.0)] if categories else [(None, 4.0), (None, 8.0)]
    df = spark.createDataFrame(data, "g string, x double").repartition(5)
    got = {r["g"]: r for r in exact_quantiles(df, "x", "g", categories, (0.01, 0.25, 0.5, 0.75, 0.99)).collect()}
    assert set(got) == set("abcde") | (set() if categories else {None})
    for g in got:
        values = [x for k, x in data if k == g and x is not None and x == x]
        assert got[g]["n"] == len(values)
        want = _numpy_quantiles(values, (0.01, 0.25, 0.5, 0.75, 0.99))
        assert [got[g][f"q{i}"] for i in range(1, 6)] == pytest.approx(want, rel=1e-12, abs=1e-12)


def test_extreme_numbers(spark):
    values = [-float("inf"), -1.7e308, -5e-324, 0.0, 5e-324, 1e-323, 1.7e308, float("inf"), 1.0]
    df = spark.createDataFrame([("a", v) for v in values], "g string, x double")
    r = exact_quantiles(df, "x", "g", ["a"], (0.25, 0.5, 0.75)).first()
    assert (r["q1"], r["q2"], r["q3"]) == (-5e-324, 5e-324, 1.0)
    assert exact_quantiles(df.limit(0), "x", "g", None, (0.5,)).collect() == []


def test_rows_that_are_ranked_do_not_grow(spark):
    """What leaves a pass is bounded by the cells: the same for a hundred times the rows."""
    sizes = []
    for n in (10 ** 5, 10 ** 7):
        data = spark.range(n).select(F.lit("x").alias("c"), (F.xxhash64("id") / 1e10).alias("v"))
        low, high = data.agg(F.min("v"), F.max("v")).first()
        spans = spark.createDataFrame([("x", [(low, high)])], "c string, spans array<struct<low: double, high: double>>")
        sizes.append(quantiles.histograms(data, spans, ["x"]).select(F.size("hist")).first()[0])
    assert sizes == [quantiles.CELLS] * 2


def test_box_stats_outliers(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 5, 100]], "g string, x double")
    r = box_stats(df, "x", "g", ["a"]).first()
    assert (r["q1"], r["median"], r["q3"], r["whisker_low"], r["whisker_high"], r["outliers"]) == (2.25, 3.5, 4.75, 1, 5, 1)


def test_right_closed_bins(spark):
    ages = spark.createDataFrame([(a,) for a in (5, 6, 18, 19, 110, 111, None)], "age int")
    got = [r[0] for r in ages.select(bin_right_closed(F.col("age"), AGE_GROUP_EDGES)).collect()]
    assert got == [None, "(5, 18]", "(5, 18]", "(18, 25]", "(75, 110]", None, None]


@pytest.mark.parametrize("values, bins", [([6, 7, 50, 90, 96], 10), ([1, 2, 3, 4], 3), ([5, 5, 5], 4), ([0, 0], 2)])
def test_equal_width_bins_match_pandas(spark, values, bins):
    import pandas as pd
    want = [int(c) + 1 for c in pd.cut(pd.Series(values), bins, labels=False)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x int")
    got = [r["b"] for r in bin_equal_width(df, "x", bins, "b").orderBy("i").collect()]
    assert got == want


def test_duplicates(spark):
    df = spark.createDataFrame([(1, 2, "x"), (1, 1, "y"), (2, 5, "z")], "id int, at int, v string")
    assert rows(first_per_key(df, ["id"], ["at"])) == [(1, 1, "y"), (2, 5, "z")]
    assert rows(first_per_key(df, ["id"], ["at"], keep="last")) == [(1, 2, "x"), (2, 5, "z")]
    assert rows(mark_repeats(df, ["id"], ["at"]).where("repeat").select("v")) == [("x",)]
    assert rows(repeated_groups(df, ["id"]).select("v")) == [("x",), ("y",)]


def test_one_hot(spark):
    df = spark.createDataFrame([(1, "F", 40, 0.5), (2, "M", 10, 1.5), (3, "M", 20, 2.5), (4, None, 20, 3.5)],
                               "id long, sex string, k int, x double")
    known = df.where("sex is not null")
    cats = learn_categories(known, ["sex", "k"])
    assert cats == {"sex": ["F", "M"], "k": ["10", "20", "40"]}
    got = one_hot(known, cats)
    assert got.columns == ["sex=M", "k=10", "k=20", "k=40", "id", "x"]
    assert rows(got)[0] == (0.0, 0.0, 0.0, 1.0, 1, 0.5)
    assert learn_categories(df, ["sex"]) == {"sex": ["F", "M", None]}
    with pytest.raises(ValueError, match="too many"):
        learn_categories(df, ["id"], limit=2)


def test_chains_are_numbered_across_partitions(spark):
    """Against plain Python: one chain over many partitions, ties, nulls, no month, and an entity without an id."""
    from monthloom.functions.periods import PeriodSpec
    from monthloom.operators.features import composite_chain
    data = [(1, 2019, 1 + i % 12, i % 7 if i % 5 else None, "x" * (i % 3)) for i in range(3000)]
    data += [(2, 2019, 3, 5, "b"), (2, 2019, 3, 5, "a"), (2, 2019, 3, 5, "a"), (None, 2019, 8, 1, "n"), (3, None, 1, 1, "z"), (2, 2019, 9, 1, None)]
    df = spark.createDataFrame(data, "id long, year int, mon int, rat int, foa string").repartition(7)
    period = PeriodSpec(6)
    want, at = [], {}
    null_first = lambda t: [(v is not None, v) for v in t]
    for i, year, mon, rat, foa in sorted((d for d in data if d[1]), key=lambda t: [(v is not None, v or 0 if not isinstance(v, str) else v) for v in t]):
        group = (i, period.ordinal(year, (mon - 1) // 6 * 6))
        for name, value in (("rat", rat), ("foa", foa)):
            at[group] = at.get(group, 0) + 1
            want.append((*group, at[group], name, None if value is None else str(value)))
    for split in ("3", "16"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        try:
            spark.conf.set("spark.sql.shuffle.partitions", split)
            got = composite_chain(df, ["rat", "foa"], period)
            assert sorted(map(tuple, got.collect()), key=null_first) == sorted(want, key=null_first)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    assert composite_chain(df.limit(0), ["rat", "foa"], period).collect() == []

"""Period features, wide tables and prediction datasets."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from monthloom.functions.aggregates import register_aggregate
from monthloom.functions.binning import bin_equal_width, bin_right_closed
from monthloom.functions.periods import PeriodSpec
from monthloom.model import AGE_GROUP_EDGES, FLAGS
from monthloom.operators.clean import clean_panel
from monthloom.operators.encode import category_columns, category_dictionary, learned_vectors, one_hot
from monthloom.operators.features import (DEFAULT_FEATURES, FeatureSpec, composite_chain, composite_max, composite_values, entity_base,
                                          feature_table, labelled_features, long_features, wide_features)
from monthloom.operators.targets import Task, build_dataset, task_matrix, x_y_split
from monthloom.plans.panel_queries import AS_CODED, RULES
from monthloom.plans.registry import query, rounded
from monthloom.plans.sql_blocks import (CLEAN, PANEL, age_group, cells, dataset_ctes, dictionary_ctes, equal_bin, feature_ctes,
                                        period_sql, target_of)
from monthloom.sources.driver_tables import PANEL_FIRST, PANEL_LAST, PANEL_REF_YEAR, orders_panel
from monthloom.sources.store import cut_lineage

TASKS = {t.name: t for t in task_matrix(PANEL_REF_YEAR)}


def span(n: int) -> list[int]:
    return PeriodSpec(n).span(PANEL_FIRST, PANEL_LAST)


def features_of(spark, sf, n: int):
    return feature_table(orders_panel(spark, sf), RULES, PeriodSpec(n), span(n))


def dataset_of(spark, sf, task: Task, features=None, bins="groups"):
    features = features_of(spark, sf, task.n_months) if features is None else features
    return build_dataset(features, task.period, span(task.n_months), task.target, task.kind, bins=bins)


# ---- long features -----------------------------------------------------------------


def _long(name: str, n: int, spec: FeatureSpec, expression: str):
    """One aggregate of the cleaned panel by entity and period."""
    sql = CLEAN + f"SELECT id, CAST({period_sql(n)} AS INT) AS period_ord, {expression} AS {spec.name} FROM clean GROUP BY 1, 2"

    @query(name, sql)
    def run(spark, sf):
        return rounded(long_features(clean_panel(orders_panel(spark, sf), RULES), [spec], PeriodSpec(n)))
    return run


register_aggregate("spread", lambda c: F.max(c) - F.min(c))

_long("mean_rating_yearly", 12, FeatureSpec("rat", "mean"), "round(avg(rat), 6)")
_long("mean_rating_half", 6, FeatureSpec("rat", "mean"), "round(avg(rat), 6)")
_long("monthly_mean_rating", 1, FeatureSpec("rat", "mean"), "round(avg(rat), 6)")
_long("sum_games_half", 6, FeatureSpec("gms", "sum"), "CAST(sum(gms) AS BIGINT)")
_long("sum_games_yearly", 12, FeatureSpec("gms", "sum"), "CAST(sum(gms) AS BIGINT)")
_long("max_title_yearly", 12, FeatureSpec("tit", "max"), "max(tit)")
_long("longest_flag_half", 6, FeatureSpec("flag", "str", domain=FLAGS), "max(flag)")
_long("longest_foa_five_months", 5, FeatureSpec("foa", "str"), "arg_max(foa, length(foa) || foa)")
_long("custom_aggregate_half", 6, FeatureSpec("rat", "spread"), "max(rat) - min(rat)")


@query("composite_max", CLEAN + f"""SELECT id, period_ord, rat, gms FROM (
  SELECT id, CAST({period_sql(6)} AS INT) AS period_ord, rat, gms,
         row_number() OVER (PARTITION BY id, {period_sql(6)} ORDER BY rat DESC, gms DESC) AS rn FROM clean) WHERE rn = 1""")
def composite(spark, sf):
    return composite_max(clean_panel(orders_panel(spark, sf), RULES), ["rat", "gms"], PeriodSpec(6))


@query("composite_values", CLEAN + " UNION ALL ".join(
    f"""SELECT id, CAST({period_sql(6)} AS INT) AS period_ord, '{c}' AS "column", CAST({c} AS VARCHAR) AS value FROM clean"""
    for c in ("rat", "foa")))
def composite_rows(spark, sf):
    return composite_values(clean_panel(orders_panel(spark, sf), RULES), ["rat", "foa"], PeriodSpec(6))


@query("composite_chain", CLEAN + f""", placed AS (
  SELECT id, CAST({period_sql(6)} AS INT) AS period_ord, rat, foa, row_number() OVER (
    PARTITION BY id, {period_sql(6)} ORDER BY year, mon, rat NULLS FIRST, foa NULLS FIRST) AS rn FROM clean)
""" + " UNION ALL ".join(
    f"""SELECT id, period_ord, 2 * (rn - 1) + {i} AS position, '{c}' AS "column", CAST({c} AS VARCHAR) AS value FROM placed"""
    for i, c in enumerate(("rat", "foa"), 1)))
def chained_rows(spark, sf):
    return composite_chain(clean_panel(orders_panel(spark, sf), RULES), ["rat", "foa"], PeriodSpec(6))


# ---- wide features -----------------------------------------------------------------


def _wide(name: str, n: int, specs, strategy: str = "preaggregate"):
    @query(name, CLEAN + f"SELECT id, {cells(n, [s.name for s in specs])} FROM clean GROUP BY id")
    def run(spark, sf):
        cleaned = clean_panel(orders_panel(spark, sf), RULES)
        return rounded(wide_features(cleaned, specs, PeriodSpec(n), span(n), strategy))
    return run


RATING, FLAG = DEFAULT_FEATURES[3], DEFAULT_FEATURES[0]
_wide("pivot_rating_half", 6, [RATING])
_wide("pivot_rating_half_cluster", 6, [RATING], "cluster")
_wide("pivot_rating_half_conditional", 6, [RATING], "conditional")
_wide("pivot_flag_half", 6, [FLAG])
_wide("wide_features_joined", 6, DEFAULT_FEATURES, "joined")


def _table(name: str, n: int):
    @query(name, feature_ctes(n) + "SELECT * FROM wide")
    def run(spark, sf):
        return rounded(features_of(spark, sf, n))
    return run


_table("feature_table_half", 6)
_table("feature_table_year", 12)
_table("feature_table_month", 1)


@query("feature_table_half_cluster", feature_ctes(6) + "SELECT * FROM wide")
def feature_table_half_cluster(spark, sf):
    return rounded(feature_table(orders_panel(spark, sf), RULES, PeriodSpec(6), span(6), strategy="cluster"))


@query("feature_table_half_as_coded", feature_ctes(6, as_coded=True) + "SELECT * FROM wide")
def feature_table_half_as_coded(spark, sf):
    return rounded(feature_table(orders_panel(spark, sf), AS_CODED, PeriodSpec(6), span(6)))


@query("entity_base", CLEAN + """SELECT id, arg_min(sex, year * 12 + mon) AS sex, arg_min(k, year * 12 + mon) AS k,
       arg_min(age, year * 12 + mon) AS age FROM clean GROUP BY id""")
def base(spark, sf):
    return entity_base(clean_panel(orders_panel(spark, sf), RULES))


# ---- bins -----------------------------------------------------------------------------


@query("age_groups", CLEAN + f"SELECT id, year, mon, age, {age_group()} AS age_bin FROM clean")
def age_groups(spark, sf):
    return clean_panel(orders_panel(spark, sf), RULES).select(
        "id", "year", "mon", "age", bin_right_closed(F.col("age"), AGE_GROUP_EDGES).alias("age_bin"))


@query("age_equal_bins", feature_ctes(12) + f"SELECT id, age, {equal_bin('age', 'wide', 10)} AS age_bin FROM wide")
def age_equal_bins(spark, sf):
    return bin_equal_width(features_of(spark, sf, 12).select("id", "age"), "age", 10, "age_bin")


@query("age_custom_bins", CLEAN + """SELECT id, year, mon, CASE WHEN age > 5 AND age <= 40 THEN '(5, 40]'
       WHEN age > 40 AND age <= 60 THEN '(40, 60]' END AS age_bin FROM clean""")
def age_custom_bins(spark, sf):
    return clean_panel(orders_panel(spark, sf), RULES).select(
        "id", "year", "mon", bin_right_closed(F.col("age"), (5, 40, 60)).alias("age_bin"))


# ---- datasets -----------------------------------------------------------------------------


def _dataset(task: Task):
    unit = {1: "month", 6: "half", 12: "year"}[task.n_months]

    @query(f"dataset_{task.kind}_{unit}", dataset_ctes(task.n_months, task.kind) + "SELECT * FROM dataset")
    def run(spark, sf):
        return rounded(dataset_of(spark, sf, task))
    return run


for _task in TASKS.values():
    _dataset(_task)


@query("dataset_returning_half", dataset_ctes(6, "clf").replace("  FROM wide)", "  FROM wide WHERE rat_mean_2000_0 IS NOT NULL)")
       + "SELECT * FROM dataset")
def dataset_returning_half(spark, sf):
    """Only entities seen in the period before the target."""
    task = TASKS["clf_6"]
    return rounded(build_dataset(features_of(spark, sf, 6), task.period, span(6), task.target, "clf", require_prev=True))


@query("xy_split_half", CLEAN + f""", c AS (
  SELECT id, {period_sql(6)} AS o, year, CASE WHEN mon <= 6 THEN 0 ELSE 6 END AS start, avg(rat) AS rat FROM clean GROUP BY ALL)
SELECT 'rat:mean/' || year || '/' || start || '/6' AS label, CASE WHEN o < {target_of(6)} THEN 'x' ELSE 'y' END AS side,
       count(*) AS n, round(sum(rat), 4) AS total FROM c GROUP BY 1, 2""")
def xy_split_half(spark, sf):
    period = PeriodSpec(6)
    found = labelled_features(long_features(clean_panel(orders_panel(spark, sf), RULES), [RATING], period), [RATING], period)
    x, y = x_y_split(found, TASKS["clf_6"].target)
    both = x.withColumn("side", F.lit("x")).unionByName(y.withColumn("side", F.lit("y")))
    return rounded(both.groupBy("label", "side").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 4)


HALVES = [PeriodSpec(6).suffix(o) for o in span(6) if o < TASKS["clf_6"].target]
CATEGORIES = {
    "age_bin": ["(5, 18]", "(18, 25]", "(25, 35]", "(35, 50]", "(50, 65]", "(65, 75]", "(75, 110]"],
    "sex": ["F", "M"],
    "k": ["10", "20", "40"],
    **{f"flag_str_{s}": ["", "i"] for s in HALVES},
}


def _one_hot_sql() -> str:
    flags = ", ".join(f"""CAST({c} = '{v}' AS DOUBLE) AS "{c}={v}" """ for c, vs in CATEGORIES.items()
                      for v in (vs[1:] if len(vs) == 2 else vs))
    numeric = [f"{f}_{s}" for f in ("gms_sum", "gms_mean", "rat_mean", "tit_max", "wtit_max")
               for s in HALVES]
    return dataset_ctes(6, "clf") + f"SELECT id, {flags}, {', '.join(numeric)}, label, baseline FROM dataset"


@query("onehot_matrix", _one_hot_sql())
def onehot_matrix(spark, sf):
    return rounded(one_hot(dataset_of(spark, sf, TASKS["clf_6"]), CATEGORIES))


ENCODED = ("tit_code", "wtit_code", "otit", "foa", "sex", "k", "fed", "name")


@query("category_slots", PANEL + dictionary_ctes("panel", ENCODED) + 'SELECT col AS "column", value, n, slot FROM dictionary')
def category_slots(spark, sf):
    """Learned one-hot slots of titles, sexes, federations and names: values are as many as the panel holds."""
    return category_dictionary(orders_panel(spark, sf), ENCODED).select("column", "value", "n", "slot")


def _learned_sql() -> str:
    numeric = [f"{f}_{s}" for f in ("gms_sum", "gms_mean", "rat_mean", "tit_max", "wtit_max") for s in HALVES]
    numbers = " UNION ALL ".join(f"SELECT id, {i} + (SELECT max(slot) + 1 FROM dictionary) AS slot, CAST({c} AS DOUBLE) AS value FROM dataset"
                                 for i, c in enumerate(numeric))
    return dataset_ctes(6, "clf") + dictionary_ctes("dataset", list(CATEGORIES)) + f"""SELECT id, CAST(slot AS INT) AS slot, round(value, 6) AS value FROM (
  SELECT id, slot, CAST(1 AS DOUBLE) AS value FROM entries e JOIN dictionary d ON e.place = d.place AND e.value IS NOT DISTINCT FROM d.value
  UNION ALL {numbers}) WHERE value <> 0 AND slot IS NOT NULL"""


@query("onehot_learned", _learned_sql())
def onehot_learned(spark, sf):
    """Non-zero places of a dataset's feature vectors, categories learned from the data."""
    dataset = dataset_of(spark, sf, TASKS["clf_6"])
    found = learned_vectors(cut_lineage(dataset, "dataset"), category_columns(dataset))
    places = found.select("id", F.posexplode(vector_to_array("features")).alias("slot", "value"))
    return rounded(places.where("value <> 0"))

"""Shape of the physical plans, and behaviour when one entity holds most rows."""

import re

from pyspark.sql import functions as F

from helpers import rows
from monthloom.functions.periods import PeriodSpec
from monthloom.operators.clean import CleaningRules, clean_panel, cleaning_exceptions
from monthloom.operators.features import feature_table, wide_features, DEFAULT_FEATURES
from monthloom.operators.quantiles import box_stats
from monthloom.operators.skew import heavy_keys, salted_join
from monthloom.operators.split import split_panel
from monthloom.plans.registry import QUERIES, rounded
from monthloom.sources.driver_tables import orders_panel
from monthloom.sources.panel_io import read_panel, write_panel
from monthloom.sources.store import cut_lineage, scratch_path
import __spark_entry__  # noqa: F401

RULES = CleaningRules(2000)
HALF = PeriodSpec(6)
SPAN = HALF.span((1995, 1), (2001, 8))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stored_panel(spark, sf_dir):
    path = scratch_path(spark, "plan-panel")
    write_panel(orders_panel(spark, sf_dir), path)
    return read_panel(spark, path)


def test_feature_table_is_two_narrow_shuffles(spark, sf_dir):
    text = plan(feature_table(stored_panel(spark, sf_dir), RULES, HALF, SPAN))
    assert len(re.findall(r"\bExchange\b", text)) == 2
    assert "Join" not in text and "Window" not in text and "SortAggregate" not in text
    schema = re.search(r"ReadSchema: (\S+)", text).group(1)
    assert "name" not in schema and "fed" not in schema and "foa" not in schema


def test_cluster_strategy_is_one_shuffle(spark, sf_dir):
    cleaned = stored_panel(spark, sf_dir)
    specs = [s for s in DEFAULT_FEATURES if s.column in ("rat", "gms")]
    assert len(re.findall(r"\bExchange\b", plan(wide_features(cleaned, specs, HALF, SPAN, "cluster")))) == 1


def test_months_are_pruned(spark, sf_dir):
    panel = stored_panel(spark, sf_dir)
    text = plan(wide_features(panel, [DEFAULT_FEATURES[3]], HALF, [4000, 4001]))
    assert re.search(r"year#\d+ >= 2000", text.split("PartitionFilters: [")[1].split("]")[0])


def test_stored_exceptions_are_broadcast_by_size(spark, sf_dir):
    panel = stored_panel(spark, sf_dir)
    exceptions = cut_lineage(cleaning_exceptions(panel, RULES), "exceptions")
    text = plan(clean_panel(panel, RULES, exceptions))
    assert "BroadcastHashJoin" in text and not re.search(r"(?<!Broadcast)\bExchange\b", text)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" in plan(clean_panel(panel, RULES, exceptions))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_python_and_no_cross_join_in_queries(spark, sf_dir):
    for name in ("feature_table_half", "clean_panel", "dataset_clf_half", "age_equal_bins", "rating_box_men", "yoy_diff",
                 "title_counts", "numeric_summary", "split_stratified", "metrics_union", "next_diff_label"):
        text = plan(QUERIES[name](spark, sf_dir))
        assert "Python" not in text and "Pandas" not in text, name
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def hot(panel, entity):
    """A third of all rows belong to one entity, many of them in the same months."""
    n = panel.count()
    one = panel.where(F.col("id") == entity).limit(1)
    copies = one.crossJoin(panel.sparkSession.range(n // 2).withColumnRenamed("id", "copy"))
    spread = copies.withColumns({"rat": F.lit(1000) + (F.col("copy") % 700).cast("int"),
                                 "year": F.lit(1999) + (F.col("copy") % 2).cast("int"),
                                 "mon": (F.col("copy") % 12 + 1).cast("int")}).drop("copy")
    return panel.unionByName(spread)


def test_hot_entity_reaches_the_shuffle_combined(spark, sf_dir):
    usual = orders_panel(spark, sf_dir)
    entity = clean_panel(usual, RULES).agg(F.min("id")).first()[0]
    panel = cut_lineage(hot(usual, entity).repartition(4), "hot")
    got = feature_table(panel, RULES, HALF, SPAN)
    text = plan(got)
    # The first exchange sits above a partial aggregate, the second carries finished cells.
    first = text.rindex("Exchange")
    assert "HashAggregate" in text[first:] and "partial_" in text[first:]
    want = panel.where(F.col("id") == entity).where("year = 2000 and mon <= 6").agg(F.avg("rat"), F.sum("gms")).first()
    row = got.where(F.col("id") == entity).first()
    assert (round(row["rat_mean_2000_0"], 6), row["gms_sum_2000_0"]) == (round(want[0], 6), want[1])
    assert rows(rounded(wide_features(clean_panel(panel, RULES), DEFAULT_FEATURES, HALF, SPAN))) == rows(
        rounded(got.drop("sex", "k", "age")))


def test_salted_join_equals_plain_join(spark, sf_dir):
    panel = cut_lineage(orders_panel(spark, sf_dir), "even")
    entity = panel.select("id").first()[0]
    # one entity with two rows of three; its months are many
    hot = cut_lineage(panel.unionByName(panel.withColumn("id", F.lit(entity).cast("long")))
                      .unionByName(panel.withColumn("id", F.lit(entity).cast("long"))), "hot")
    facts = panel.groupBy("id").agg(F.max("rat").alias("top")).where("top > 2000")
    heavy = heavy_keys(hot, "id")
    assert heavy_keys(panel, "id") == {} and list(heavy) == [spark.range(1).select(F.xxhash64(F.lit(entity).cast("long"))).first()[0]]
    for table in (panel, hot):
        for how in ("left", "left_anti", "left_semi", "inner"):
            assert rows(salted_join(table, facts, "id", how)) == rows(table.join(facts, "id", how)), how
    narrow = facts.withColumn("id", F.col("id").cast("int"))  # the same ids as another type
    assert rows(salted_join(hot, narrow, "id", "inner")) == rows(hot.join(narrow, "id", "inner"))
    # the planner may broadcast small facts, as the sizes it has seen so far suggest; here it is the other join that counts
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plain, salted = (plan(salted_join(t, facts, "id", "left").groupBy("id").agg(F.sum("top"))) for t in (panel, hot))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert re.search(r"hashpartitioning\(id#\w+, salt#\w+", salted) and "partial_sum" in salted
    assert "salt#" not in plain and "Generate explode" not in plain


def test_heavy_keys_are_all_found(spark):
    """Against plain counts: every key above its share, with as many tasks as its rows fill."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    data = spark.range(0, 60_000, 1, 40).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 10 < 4, None).otherwise(F.col("id")).alias("k"))
    n = {r.k: r["count"] for r in data.groupBy("k").count().where(f"count > {60_000 // parts}").collect()}
    of = {r.h: r.k for r in data.select("k", F.xxhash64("k").alias("h")).distinct().where("k IS NULL OR k = 7").collect()}
    found = heavy_keys(data, "k")
    assert {of[h] for h in found} == set(n) == {7, None}
    assert all(abs(tasks - n[of[h]] * parts / 60_000) <= 1.01 for h, tasks in found.items())
    assert heavy_keys(data.limit(0), "k") == {}


def test_hot_category_is_not_gathered(spark, sf_dir):
    """No window ranks a category, and rows are combined by cell before they are shuffled."""
    from monthloom.operators.quantiles import histograms
    data = cut_lineage(orders_panel(spark, sf_dir).selectExpr("sex AS c", "CAST(rat AS DOUBLE) AS v"), "plan-values")
    spans = spark.createDataFrame([("F", [(0.0, 3000.0)]), ("M", [(0.0, 3000.0)])], "c string, spans array<struct<low: double, high: double>>")
    text = plan(histograms(data, spans, ("F", "M")))
    first = text[text.rindex("Exchange hashpartitioning"):]
    assert "SortMergeJoin" not in text and "HashAggregate" in first and "partial_count" in first
    assert "Window" not in plan(box_stats(orders_panel(spark, sf_dir), "rat", "sex", ("F", "M")))


def test_split_moves_no_dataset_rows(spark, sf_dir):
    stored = stored_panel(spark, sf_dir).where("year = 2000 and mon = 1").select("id", "rat", "gms")
    stored = cut_lineage(stored, "split-input")
    text = plan(split_panel(stored))
    top = text[:text.index("BroadcastExchange")]
    assert not re.search(r"(?<!Broadcast)\bExchange\b", top)


def test_every_order_is_in_the_panel(spark, sf_dir):
    from monthloom.functions.periods import PeriodSpec
    from monthloom.sources.driver_tables import PANEL_FIRST, PANEL_LAST, table
    panel = orders_panel(spark, sf_dir)
    games = table(spark, sf_dir, "orders").selectExpr("sum(o_orderkey % 23)").first()[0]
    assert panel.selectExpr("sum(gms)").first()[0] == games
    assert PeriodSpec(1).observed_span(panel) == PeriodSpec(1).span(PANEL_FIRST, PANEL_LAST)


def test_salt_reads_no_further_columns(spark, sf_dir):
    from monthloom.operators.clean import clean_panel
    text = plan(clean_panel(stored_panel(spark, sf_dir), RULES).groupBy("id").agg(F.avg("rat")))
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", text):
        assert "name:" not in schema and "fed:" not in schema

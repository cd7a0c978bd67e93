"""Panels derived from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: First and last month of ``orders``; tests hold them against the table. Column names depend on them.
PANEL_FIRST = (1995, 1)
PANEL_LAST = (2001, 8)
#: The last year with all its months.
PANEL_REF_YEAR = PANEL_LAST[0] if PANEL_LAST[1] == 12 else PANEL_LAST[0] - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly panel of customers over all orders: the last order of a month supplies the attributes, all its
    orders the games."""
    monthly = (table(spark, sf_dir, "orders")
               .groupBy(F.expr("o_custkey AS id"), F.expr("year(o_orderdate) AS year"), F.expr("month(o_orderdate) AS mon"))
               .agg(F.expr("""max(struct(o_orderdate AS d, o_orderkey AS ok, o_orderstatus AS st,
                                         o_orderpriority AS pr, o_totalprice AS tp)) AS last"""),
                    F.expr("sum(o_orderkey % 23) AS games"))
               .select("id", "year", "mon", "games", "last.*"))
    people = (table(spark, sf_dir, "customer")
              .join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
              .selectExpr("c_custkey AS id", "c_name", "n_name"))
    return (monthly.join(people, "id")
            .selectExpr(
                "*",
                "CASE WHEN id % 40 = 0 AND ok % 2 = 0 THEN 'M' WHEN id % 10 = 0 THEN 'F' ELSE 'M' END AS sex",
                """CASE pr WHEN '1-URGENT' THEN 'GM' WHEN '2-HIGH' THEN 'IM' WHEN '3-MEDIUM' THEN 'FM'
                           WHEN '4-NOT SPECIFIED' THEN 'CM' END AS t""",
                "CAST(1000 + floor(tp) % 1800 AS INT) AS rat")
            .selectExpr(
                "id",
                "CASE WHEN id % 60 = 0 AND ok % 2 = 0 THEN c_name || ' jr' ELSE c_name END AS name",
                "CASE WHEN id % 45 = 0 AND ok % 2 = 0 THEN 'OTHER' ELSE n_name END AS fed",
                "sex",
                """CAST(CASE WHEN id % 25 = 0 AND ok % 3 = 0 THEN 0 WHEN id % 97 = 0 THEN 1880
                             WHEN id % 35 = 0 AND ok % 2 = 0 THEN 1971 ELSE 2000 - (4 + id % 90) END AS INT) AS birth_year""",
                "CASE WHEN sex = 'F' AND id % 20 = 0 THEN 'W' || t ELSE t END AS tit_code",
                "CASE WHEN sex = 'F' THEN 'W' || t END AS wtit_code",
                "CASE WHEN id % 11 = 0 THEN 'IA' END AS otit",
                "CASE ok % 5 WHEN 1 THEN 'A' WHEN 2 THEN 'AB' WHEN 3 THEN 'ABC' WHEN 4 THEN 'B' END AS foa",
                "rat",
                "CAST(games AS INT) AS gms",
                "CAST(CASE WHEN rat >= 2400 THEN 10 WHEN id % 3 = 0 THEN 40 ELSE 20 END AS INT) AS k",
                "CASE WHEN st = 'F' THEN CASE WHEN sex = 'F' THEN 'wi' ELSE 'i' END WHEN sex = 'F' THEN 'w' END AS flag",
                "year", "mon"))


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily panel of users; ``active`` is 0 on days with errors only."""
    ok = (F.col("event_type") != "error").cast("int")
    return (table(spark, sf_dir, "events")
            .groupBy(F.col("user_id").alias("id"), F.dayofmonth("ts").cast("int").alias("day"))
            .agg(F.count("*").alias("gms"), F.max("value").alias("rat"),
                 F.max(F.coalesce(ok, F.lit(0))).alias("active")))


def label_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document labels read as a classifier's output: quality against not-toxic."""
    return table(spark, sf_dir, "labels").select(
        "doc_id", F.col("quality").alias("label"), (1 - F.col("toxic")).alias("pred"))

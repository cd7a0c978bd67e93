"""Scans, scalar expressions, cleaning and consistency checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from monthloom.functions.periods import PeriodSpec, month_label, parse_label
from monthloom.functions.scalars import active_indicator, is_active, or_none, recode_flag, title_rank
from monthloom.model import TITLES, WOMEN_TITLES
from monthloom.operators import checks, profile
from monthloom.operators.clean import (CleaningRules, clean_panel, cleaning_exceptions, drop_sex_changes,
                                       fix_birth_years)
from monthloom.operators.dedup import first_per_key
from monthloom.operators.features import FeatureSpec, labelled_features, long_features
from monthloom.plans.registry import query
from monthloom.plans.sql_blocks import (ACTIVE, CLEAN, PANEL, PLAUSIBLE, RECODED_FLAG, REF, clean_ctes, period_sql,
                                        rank_of)
from monthloom.sources import panel_io
from monthloom.sources.driver_tables import PANEL_REF_YEAR, orders_panel
from monthloom.sources.store import cut_lineage, scratch_path

RULES = CleaningRules(PANEL_REF_YEAR)
AS_CODED = CleaningRules(PANEL_REF_YEAR, birth_fix="as_coded")


# ---- scans -----------------------------------------------------------------


@query("scan_panel_csv", PANEL + "SELECT * FROM panel")
def scan_panel_csv(spark, sf):
    path = scratch_path(spark, "extracts")
    panel_io.write_extracts(orders_panel(spark, sf), path)
    return panel_io.read_extracts(spark, path)


@query("scan_drifted_extracts", PANEL + """SELECT id, name, fed, sex, birth_year, tit_code, wtit_code,
       CASE WHEN year < 2000 THEN otit END AS otit, CASE WHEN year < 2000 THEN foa END AS foa,
       rat, gms, k, flag, year, mon FROM panel""")
def scan_drifted_extracts(spark, sf):
    """Two layouts: the later one lacks two columns and orders the rest differently."""
    panel = orders_panel(spark, sf)
    old, new = scratch_path(spark, "extracts-old"), scratch_path(spark, "extracts-new")
    panel_io.write_extracts(panel.where("year < 2000"), old)
    later = panel.where("year >= 2000").drop("otit", "foa")
    panel_io.write_extracts(later.select(*reversed(later.columns)), new)
    return panel_io.read_extracts(spark, old, new)


_REORDERED = ("mon", "year", "flag", "k", "gms", "rat", "wtit_code", "tit_code", "birth_year", "sex", "fed", "name", "id")


def _mixed_extracts(spark, sf):
    """Two layouts under one glob; the later one's ratings and months are spoilt in some lines."""
    panel, path = orders_panel(spark, sf), scratch_path(spark, "extracts-mixed")
    panel_io.write_extracts(panel.where("year < 2000"), f"{path}/old")
    spoilt = panel.where("year >= 2000").withColumns({
        "rat": F.when(F.col("id") % 7 == 3, F.concat(F.lit("?"), "rat")).otherwise(F.col("rat").cast("string")),
        "mon": F.when(F.col("id") % 11 != 4, F.col("mon"))})
    panel_io.write_extracts(spoilt.select(*_REORDERED), f"{path}/new")
    return panel_io.read_mixed_extracts(spark, f"{path}/*")


@query("scan_mixed_extracts", PANEL + """SELECT id, name, fed, sex, birth_year, tit_code, wtit_code,
       CASE WHEN year < 2000 THEN otit END AS otit, CASE WHEN year < 2000 THEN foa END AS foa,
       rat, gms, k, flag, year, mon FROM panel WHERE year < 2000 OR id % 7 <> 3 AND id % 11 <> 4""")
def scan_mixed_extracts(spark, sf):
    return _mixed_extracts(spark, sf)[0]


@query("quarantined_lines", PANEL + f""", spoilt AS (SELECT * REPLACE (CASE WHEN id % 7 = 3 THEN '?' ELSE '' END || rat AS rat,
       CASE WHEN id % 11 <> 4 THEN mon END AS mon) FROM panel WHERE year >= 2000 AND (id % 7 = 3 OR id % 11 = 4))
SELECT concat_ws(', ', CASE WHEN mon IS NULL THEN 'mon' END, CASE WHEN id % 7 = 3 THEN 'rat' END) AS reason,
       {" || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in _REORDERED)} AS line FROM spoilt""")
def quarantined_lines(spark, sf):
    return _mixed_extracts(spark, sf)[1].select("reason", "line")


@query("scan_panel_parquet", PANEL + "SELECT * FROM panel")
def scan_panel_parquet(spark, sf):
    path = scratch_path(spark, "panel")
    panel_io.write_panel(orders_panel(spark, sf), path)
    return panel_io.read_panel(spark, path)


@query("preview_rows", PANEL + "SELECT * FROM panel ORDER BY id, year, mon LIMIT 10")
def preview_rows(spark, sf):
    return panel_io.preview(orders_panel(spark, sf), 10)


@query("entity_history", PANEL + "SELECT * FROM panel WHERE id = 120 ORDER BY year, mon")
def entity_history(spark, sf):
    return panel_io.entity_history(orders_panel(spark, sf), 120)


@query("monthly_label", PANEL + "SELECT id, year, mon, year || ' / ' || lpad(CAST(mon AS VARCHAR), 2, '0') AS ym FROM panel")
def monthly_label(spark, sf):
    return orders_panel(spark, sf).select("id", "year", "mon", month_label().alias("ym"))


@query("distinct_entities", PANEL + "SELECT count(DISTINCT id) AS n FROM panel")
def distinct_entities(spark, sf):
    return profile.distinct_entities(orders_panel(spark, sf))


@query("distinct_values", PANEL + "SELECT DISTINCT foa FROM panel")
def distinct_values(spark, sf):
    return profile.distinct_values(orders_panel(spark, sf), "foa")


# ---- scalar expressions -------------------------------------------------------


@query("recode_flag", PANEL + f"SELECT id, year, mon, {RECODED_FLAG} AS flag FROM panel")
def recoded(spark, sf):
    return orders_panel(spark, sf).select("id", "year", "mon", recode_flag(F.col("flag")).alias("flag"))


@query("active_flag", PANEL + f"""SELECT id, year, mon, {ACTIVE} AS active,
       CAST(CASE WHEN {RECODED_FLAG} IS NOT DISTINCT FROM 'i' THEN 0 ELSE 1 END AS INT) AS active_01 FROM panel""")
def active_flag(spark, sf):
    flag = F.col("flag")
    return orders_panel(spark, sf).select(
        "id", "year", "mon", is_active(flag).alias("active"), active_indicator(recode_flag(flag)).alias("active_01"))


@query("title_ordinal", PANEL + f"""SELECT id, year, mon, {rank_of('tit_code')} AS tit, {rank_of('tit_code', 'W')} AS wtit,
       {rank_of('wtit_code', 'W')} AS wtit_own FROM panel""")
def title_ordinal(spark, sf):
    return orders_panel(spark, sf).select(
        "id", "year", "mon", title_rank(F.col("tit_code"), TITLES).alias("tit"),
        title_rank(F.col("tit_code"), WOMEN_TITLES).alias("wtit"),
        title_rank(F.col("wtit_code"), WOMEN_TITLES).alias("wtit_own"))


@query("fill_missing_text", PANEL + """SELECT id, year, mon, coalesce(otit, '') AS otit, coalesce(foa, '') AS foa,
       coalesce(tit_code, 'None') AS tit_filled, coalesce(wtit_code, 'None') AS wtit_filled FROM panel""")
def fill_missing_text(spark, sf):
    return (orders_panel(spark, sf)
            .select("id", "year", "mon", "otit", "foa", or_none(F.col("tit_code")).alias("tit_filled"),
                    or_none(F.col("wtit_code")).alias("wtit_filled"))
            .na.fill("", ["otit", "foa"]))


LABEL_SPECS = [FeatureSpec("rat", "mean"), FeatureSpec("gms", "sum")]


def _labels(spark, sf):
    panel = orders_panel(spark, sf)
    parts = []
    for n in (6, 12):
        period = PeriodSpec(n)
        cells = long_features(panel, LABEL_SPECS, period)
        parts.append(labelled_features(cells, LABEL_SPECS, period).groupBy("label").agg(F.count("value").alias("n")))
    return parts[0].unionByName(parts[1])


_LABELS_SQL = PANEL + f""", cells AS (
  SELECT id, year, CASE WHEN mon <= 6 THEN 0 ELSE 6 END AS start FROM panel GROUP BY ALL),
years AS (SELECT id, year FROM panel GROUP BY ALL),
labels_found AS (
  SELECT f || '/' || year || '/' || start || '/6' AS label, year, start, count(*) AS n
  FROM cells, (VALUES ('rat:mean'), ('gms:sum')) v(f) GROUP BY ALL
  UNION ALL
  SELECT f || '/' || year || '//yearly', year, NULL, count(*) FROM years, (VALUES ('rat:mean'), ('gms:sum')) v(f) GROUP BY ALL)
"""


@query("feature_labels", _LABELS_SQL + "SELECT label, n FROM labels_found")
def feature_labels(spark, sf):
    return _labels(spark, sf)


@query("parse_feature_label", _LABELS_SQL + """SELECT label, CAST(year AS INT) AS year, CAST(start AS INT) AS start, n
FROM labels_found""")
def parse_feature_label(spark, sf):
    year, start = parse_label()
    return _labels(spark, sf).select("label", year.alias("year"), start.alias("start"), "n")


# ---- cleaning ---------------------------------------------------------------------


@query("birth_year_fix", CLEAN + f"""SELECT id, year, mon, birth_year, CAST({REF} - birth_year AS INT) AS age FROM fixed""")
def birth_year_fix(spark, sf):
    return fix_birth_years(orders_panel(spark, sf), RULES).select(
        "id", "year", "mon", "birth_year", (F.lit(REF) - F.col("birth_year")).alias("age"))


@query("birth_year_fix_as_coded", clean_ctes(True) + "SELECT id, year, mon, birth_year FROM fixed")
def birth_year_fix_as_coded(spark, sf):
    return fix_birth_years(orders_panel(spark, sf), AS_CODED).select("id", "year", "mon", "birth_year")


@query("drop_sex_changes", PANEL + """SELECT * FROM panel WHERE id NOT IN (
  SELECT id FROM panel GROUP BY id HAVING count(DISTINCT sex) > 1)""")
def drop_changed_sex(spark, sf):
    return drop_sex_changes(orders_panel(spark, sf))


@query("clean_panel", CLEAN + "SELECT * FROM clean")
def cleaned(spark, sf):
    return clean_panel(orders_panel(spark, sf), RULES)


@query("clean_panel_staged", CLEAN + "SELECT * FROM clean")
def cleaned_staged(spark, sf):
    """Exceptions stored first, so that their size decides the join."""
    panel = orders_panel(spark, sf)
    return clean_panel(panel, RULES, cut_lineage(cleaning_exceptions(panel, RULES), "exceptions"))


@query("clean_panel_as_coded", clean_ctes(True) + "SELECT * FROM clean")
def cleaned_as_coded(spark, sf):
    return clean_panel(orders_panel(spark, sf), AS_CODED)


# ---- consistency checks ---------------------------------------------------------------


@query("first_row_per_entity", PANEL + """SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY year, mon) AS rn FROM panel) WHERE rn = 1""")
def first_row_per_entity(spark, sf):
    return first_per_key(orders_panel(spark, sf), ["id"])


@query("name_changes", PANEL + """, firsts AS (SELECT id, arg_min(name, year * 12 + mon) AS name FROM panel GROUP BY id)
SELECT DISTINCT p.id, p.name FROM panel p JOIN firsts f ON p.id = f.id WHERE p.name <> f.name""")
def name_changes(spark, sf):
    return checks.name_changes(orders_panel(spark, sf))


_LATER = "WHERE year <> 1998 AND NOT (year = 1999 AND mon = 1)"


@query("name_changes_global", PANEL + f""", later AS (SELECT * FROM panel {_LATER}),
firsts AS (SELECT arg_min(name, year * 12 + mon) AS name FROM later GROUP BY id)
SELECT DISTINCT id, name FROM later WHERE name NOT IN (SELECT name FROM firsts)""")
def name_changes_global(spark, sf):
    later = checks.since(orders_panel(spark, sf), 1998, (1999, 1))
    return checks.name_changes(later, scope="global")


@query("name_change_examples", PANEL + """, firsts AS (SELECT id, arg_min(name, year * 12 + mon) AS name FROM panel GROUP BY id),
changed AS (SELECT DISTINCT p.id FROM panel p JOIN firsts f ON p.id = f.id WHERE p.name <> f.name ORDER BY p.id LIMIT 5)
SELECT DISTINCT id, name FROM panel WHERE id IN (SELECT id FROM changed)""")
def name_change_examples(spark, sf):
    panel = orders_panel(spark, sf)
    return checks.name_change_examples(panel, checks.name_changes(panel), 5)


@query("changed_names_count", PANEL + """SELECT id, count(DISTINCT name) AS n_values FROM panel GROUP BY id
HAVING count(DISTINCT name) > 1""")
def changed_names_count(spark, sf):
    return checks.changed_entities(orders_panel(spark, sf), "name")


@query("sex_changes", PANEL + """, v AS (SELECT id, sex, count(*) AS n FROM panel GROUP BY id, sex)
SELECT id, sex, n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sex) AS rn FROM v) WHERE rn > 1""")
def sex_changes(spark, sf):
    return checks.sex_changes(orders_panel(spark, sf))


def _variants_sql(*attributes: str) -> str:
    cols = ", ".join(attributes)
    return PANEL + f""", v AS (
  SELECT id, {cols}, min(year * 12 + mon - 1) AS seen FROM panel GROUP BY id, {cols})
SELECT id, {cols}, CAST(seen // 12 AS INT) AS first_year, CAST(seen % 12 + 1 AS INT) AS first_mon FROM (
  SELECT *, count(*) OVER (PARTITION BY id) AS m FROM v) WHERE m > 1"""


@query("birth_year_changes", _variants_sql("birth_year"))
def birth_year_changes(spark, sf):
    return checks.attribute_changes(orders_panel(spark, sf), ["birth_year"])


@query("country_changes", _variants_sql("fed", "sex"))
def country_changes(spark, sf):
    return checks.attribute_changes(orders_panel(spark, sf), ["fed", "sex"])


@query("implausible_birth_years", PANEL + """SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY year, mon) AS rn FROM panel
  WHERE id IN (SELECT id FROM panel WHERE birth_year > 0 AND birth_year < 1910)) WHERE rn = 1""")
def implausible_birth_years(spark, sf):
    return checks.implausible_birth_years(orders_panel(spark, sf))


@query("flag_sex_crosstab", PANEL + "SELECT flag, sex, count(*) AS n FROM panel GROUP BY flag, sex")
def flag_sex_crosstab(spark, sf):
    return checks.flag_sex_crosstab(orders_panel(spark, sf))


@query("flag_implies_sex", PANEL + "SELECT DISTINCT sex FROM panel WHERE flag = 'wi'")
def flag_implies_sex(spark, sf):
    return checks.flag_implies_sex(orders_panel(spark, sf), "wi")


@query("attribute_cardinality", PANEL + "SELECT id, fed, sex, count(name) AS n FROM panel GROUP BY id, fed, sex")
def attribute_cardinality(spark, sf):
    return checks.attribute_cardinality(orders_panel(spark, sf))


@query("plausible_birth_years", PANEL + f"SELECT id, year, mon, birth_year FROM panel WHERE {PLAUSIBLE}")
def plausible_birth_years(spark, sf):
    return orders_panel(spark, sf).where(RULES.plausible(F.col("birth_year"))).select("id", "year", "mon", "birth_year")


@query("panel_periods", PANEL + f"""SELECT CAST({period_sql(3)} AS INT) AS period_ord, count(*) AS n,
       count(DISTINCT id) AS entities FROM panel GROUP BY 1""")
def panel_periods(spark, sf):
    quarter = PeriodSpec(3).ordinal_column().alias("period_ord")
    return orders_panel(spark, sf).groupBy(quarter).agg(F.count("*").alias("n"), F.count_distinct("id").alias("entities"))

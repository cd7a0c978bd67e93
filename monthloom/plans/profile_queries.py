"""Profiles and year-over-year changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from monthloom.functions.periods import PeriodSpec, month_label
from monthloom.model import TITLES, WOMEN_TITLES
from monthloom.operators import panel_diff, profile
from monthloom.operators.features import FeatureSpec, long_features
from monthloom.operators.quantiles import box_stats, numeric_summary
from monthloom.operators.skew import salted_join
from monthloom.plans.registry import query, rounded
from monthloom.plans.sql_blocks import ACTIVE, EVENTS_PANEL, PANEL, REF, box_sql, equal_bin
from monthloom.sources.driver_tables import events_panel, orders_panel


@query("country_counts", PANEL + "SELECT fed, count(DISTINCT id) AS n FROM panel GROUP BY fed ORDER BY n DESC, fed")
def country_counts(spark, sf):
    return profile.country_counts(orders_panel(spark, sf))


@query("country_big", PANEL + "SELECT fed, count(DISTINCT id) AS n FROM panel GROUP BY fed HAVING count(DISTINCT id) > 55")
def country_big(spark, sf):
    return profile.country_counts(orders_panel(spark, sf), min_entities=55)


@query("country_counts_by_sex", PANEL + "SELECT sex, fed, count(DISTINCT id) AS n FROM panel GROUP BY sex, fed")
def country_counts_by_sex(spark, sf):
    return profile.country_counts(orders_panel(spark, sf), by_sex=True)


@query("country_size_box", PANEL + ", sizes AS (SELECT sex, fed, count(DISTINCT id) AS n_ids FROM panel GROUP BY sex, fed)"
       + box_sql("sizes", "n_ids", "sex"))
def country_size_box(spark, sf):
    sizes = profile.country_counts(orders_panel(spark, sf), by_sex=True).withColumnRenamed("n", "n_ids")
    return rounded(box_stats(sizes, "n_ids", "sex"))


@query("birth_year_hist", PANEL + """, y AS (SELECT DISTINCT id, birth_year FROM panel WHERE birth_year BETWEEN 1920 AND 2010),
c AS (SELECT least((birth_year - 1920) // 5, 17) AS bin, count(*) AS n FROM y GROUP BY 1)
SELECT CAST(r.bin AS BIGINT) AS bin, CAST(1920 + 5 * r.bin AS BIGINT) AS bin_start, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM range(18) r(bin) LEFT JOIN c ON c.bin = r.bin""")
def birth_year_hist(spark, sf):
    return profile.birth_year_histogram(orders_panel(spark, sf))


@query("sex_counts", PANEL + "SELECT sex, count(DISTINCT id) AS n FROM panel GROUP BY sex")
def sex_counts(spark, sf):
    return profile.sex_counts(orders_panel(spark, sf))


_MONTHS = "SELECT sex, months, count(*) AS n FROM m GROUP BY sex, months"


@query("active_months_dist", PANEL + f", m AS (SELECT id, sex, count(*) AS months FROM panel WHERE {ACTIVE} GROUP BY id, sex) {_MONTHS}")
def active_months_dist(spark, sf):
    return profile.active_months_distribution(orders_panel(spark, sf))


@query("registered_months_dist", PANEL + f", m AS (SELECT id, sex, count(*) AS months FROM panel GROUP BY id, sex) {_MONTHS}")
def registered_months_dist(spark, sf):
    return profile.active_months_distribution(orders_panel(spark, sf), only_active=False)


@query("weighted_months", PANEL + """, m AS (SELECT id, sex, count(*) AS months FROM panel GROUP BY id, sex)
SELECT sex, CAST(sum(months) AS BIGINT) AS n FROM m GROUP BY sex""")
def weighted_months(spark, sf):
    return profile.weighted_counts(profile.active_months(orders_panel(spark, sf), False), "sex", "months")


@query("registered_active", PANEL + f"""SELECT year, mon, year || ' / ' || lpad(CAST(mon AS VARCHAR), 2, '0') AS ym,
       count(id) AS registered, CAST(sum(CASE WHEN {ACTIVE} THEN 1 ELSE 0 END) AS BIGINT) AS active
FROM panel GROUP BY year, mon""")
def registered_active(spark, sf):
    return profile.registered_and_active(orders_panel(spark, sf)).drop("active_share")


@query("active_share", PANEL + f"""SELECT year, mon, round(avg(CASE WHEN {ACTIVE} THEN 1 ELSE 0 END), 6) AS active_share
FROM panel GROUP BY year, mon""")
def active_share(spark, sf):
    return rounded(profile.registered_and_active(orders_panel(spark, sf)).select("year", "mon", "active_share"))


@query("events_daily_activity", EVENTS_PANEL + """SELECT day, count(id) AS registered, CAST(sum(active) AS BIGINT) AS active,
       round(avg(active), 6) AS active_share FROM days GROUP BY day""")
def events_daily_activity(spark, sf):
    return rounded(events_panel(spark, sf).groupBy("day").agg(
        F.count("id").alias("registered"), F.sum("active").alias("active"), F.avg("active").alias("active_share")))


@query("games_hist", PANEL + "SELECT gms, count(*) AS n FROM panel WHERE gms > 0 AND gms < 22 GROUP BY gms")
def games_hist(spark, sf):
    return profile.games_histogram(orders_panel(spark, sf))


_TITLES = PANEL + """, t AS (
  SELECT id, coalesce(wtit_code, 'None') AS wtit, coalesce(tit_code, 'None') AS tit, arg_min(sex, year * 12 + mon) AS sex
  FROM panel GROUP BY 1, 2, 3)
"""


def _title_count_sql() -> str:
    views = [("F", "wtit", WOMEN_TITLES), ("M", "tit", TITLES), ("F", "tit", TITLES)]
    return _TITLES + " UNION ALL ".join(
        f"SELECT '{s}' AS sex, '{c}' AS scale, '{t}' AS title, count(*) AS n FROM t WHERE sex = '{s}' AND {c} = '{t}'"
        for s, c, scale in views for t in scale)


@query("title_counts", _title_count_sql())
def title_counts(spark, sf):
    return profile.title_counts(orders_panel(spark, sf))


@query("title_share", _TITLES + """SELECT sex, round(avg(CASE WHEN tit <> 'None' THEN 1 ELSE 0 END), 2) AS tit_share,
       round(avg(CASE WHEN wtit <> 'None' THEN 1 ELSE 0 END), 2) AS wtit_share FROM t GROUP BY sex""")
def title_share(spark, sf):
    return profile.title_share(orders_panel(spark, sf))


def _group_sql(sex: str, column: str) -> str:
    return PANEL + f""", ratings AS (
  SELECT id, coalesce({column}, 'None') AS title, avg(rat) AS rat FROM panel WHERE sex = '{sex}' GROUP BY 1, 2)
"""


@query("group_rating", _group_sql("M", "tit_code") + "SELECT id, title, round(rat, 6) AS rat FROM ratings")
def group_rating(spark, sf):
    return rounded(profile.group_rating(orders_panel(spark, sf).where("sex = 'M'"), "tit_code"))


@query("rating_box_men", _group_sql("M", "tit_code") + box_sql("ratings", "rat", "title"))
def rating_box_men(spark, sf):
    men = profile.group_rating(orders_panel(spark, sf).where("sex = 'M'"), "tit_code")
    return rounded(box_stats(men, "rat", "title", ("None", *TITLES)))


@query("rating_box_women", _group_sql("F", "wtit_code") + box_sql("ratings", "rat", "title"))
def rating_box_women(spark, sf):
    women = profile.group_rating(orders_panel(spark, sf).where("sex = 'F'"), "wtit_code")
    return rounded(box_stats(women, "rat", "title", ("None", *WOMEN_TITLES)))


@query("max_k_counts", PANEL + """, m AS (SELECT id, max(k) AS k FROM panel GROUP BY id),
o AS (SELECT * FROM (VALUES (0, 10), (1, 20), (2, 40)) v(position, k))
SELECT CAST(o.position AS INT) AS position, CAST(o.k AS INT) AS k, count(m.id) AS n
FROM o LEFT JOIN m ON m.k = o.k GROUP BY o.position, o.k""")
def max_k_counts(spark, sf):
    return profile.k_factor_counts(orders_panel(spark, sf))


@query("k_counts", PANEL + "SELECT k, count(mon) AS n FROM panel GROUP BY k")
def k_counts(spark, sf):
    return orders_panel(spark, sf).groupBy("k").agg(F.count("mon").alias("n"))


_NUMERIC = ("id", "rat", "gms", "k", "birth_year", "year", "mon")


@query("numeric_summary", PANEL + " UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean,
       round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont({c}, 0.25), 6) AS q1,
       round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q3, CAST(max({c}) AS DOUBLE) AS max
FROM panel""" for c in _NUMERIC))
def summary(spark, sf):
    return rounded(numeric_summary(orders_panel(spark, sf), _NUMERIC))


@query("top_games_row", PANEL + "SELECT * FROM panel ORDER BY gms DESC, id, year, mon LIMIT 1")
def top_games_row(spark, sf):
    return profile.top_rows(orders_panel(spark, sf))


@query("always_active", EVENTS_PANEL + "SELECT id, count(*) AS active_periods FROM days WHERE active = 1 GROUP BY id HAVING count(*) >= 27")
def always_active(spark, sf):
    return profile.always_active(events_panel(spark, sf), 27, F.col("active") == 1)


@query("always_active_diff", EVENTS_PANEL + """, ids AS (SELECT id FROM days WHERE active = 1 GROUP BY id HAVING count(*) >= 20)
SELECT a.id, a.active, round(z.rat - a.rat, 6) AS diff FROM days a JOIN days z ON a.id = z.id
WHERE a.day = 1 AND z.day = 30 AND a.id IN (SELECT id FROM ids)""")
def always_active_diff(spark, sf):
    days = events_panel(spark, sf)
    ids = profile.always_active(days, 20, F.col("active") == 1)
    members = salted_join(days, ids, "id", "left_semi")
    return rounded(profile.first_last_difference(members, "day", 1, 30, "rat", carry=["active"]))


_HALVES = PANEL + """, halves AS (
  SELECT id, CAST(year * 2 + (mon - 1) // 6 AS INT) AS period_ord, avg(rat) AS rat_mean, max(sex) AS sex FROM panel GROUP BY 1, 2),
diffs AS (SELECT a.id, a.sex, z.rat_mean - a.rat_mean AS diff FROM halves a JOIN halves z ON a.id = z.id
          WHERE a.period_ord = (SELECT min(period_ord) FROM halves) AND z.period_ord = (SELECT max(period_ord) FROM halves))
"""


def _half_year_diffs(spark, sf):
    panel, period = orders_panel(spark, sf), PeriodSpec(6)
    observed = period.observed_span(panel)
    halves = long_features(panel, [FeatureSpec("rat", "mean")], period, extra=[F.max("sex").alias("sex")])
    return profile.first_last_difference(halves, "period_ord", observed[0], observed[-1], "rat_mean", carry=["sex"])


@query("first_last_diff", _HALVES + "SELECT id, sex, round(diff, 6) AS diff FROM diffs")
def first_last_diff(spark, sf):
    return rounded(_half_year_diffs(spark, sf))


@query("rating_change_box", _HALVES + box_sql("diffs", "diff", "sex"))
def rating_change_box(spark, sf):
    return rounded(box_stats(_half_year_diffs(spark, sf), "diff", "sex"))


@query("rating_by_month", PANEL + """SELECT year || ' / ' || lpad(CAST(mon AS VARCHAR), 2, '0') AS ym, count(*) AS n,
       round(avg(rat), 6) AS rat FROM panel WHERE sex = 'F' AND year = 2000 GROUP BY 1""")
def rating_by_month(spark, sf):
    rows = orders_panel(spark, sf).where((F.col("sex") == "F") & (F.col("year") == 2000))
    return rounded(rows.groupBy(month_label().alias("ym")).agg(F.count("*").alias("n"), F.avg("rat").alias("rat")))


# ---- year over year ---------------------------------------------------------------

_STRINGS = panel_diff.TITLE_COLUMNS
_LONGEST = ", ".join(f"arg_max(coalesce({c}, ''), lpad(CAST(length(coalesce({c}, '')) AS VARCHAR), 4, '0') || coalesce({c}, '')) AS {c}"
                     for c in _STRINGS)
_YEARLY = PANEL + f""", yearly AS (
  SELECT id, year, sex, birth_year, avg(rat) AS "rat:mean", CAST(sum(gms) AS BIGINT) AS "gms:sum", avg(gms) AS "gms:mean", {_LONGEST}
  FROM panel GROUP BY id, year, sex, birth_year),
aged AS (SELECT *, {REF} - birth_year AS age FROM yearly WHERE {REF} - birth_year > 0 AND {REF} - birth_year < 100),
binned AS (SELECT *, {equal_bin("age", "aged", 3)} AS age_bin FROM aged)
"""


def _diff_cte(name: str, year: int) -> str:
    cols = ", ".join(f'a."{m}" - b."{m}" AS "{m}"' for m in panel_diff.MEASURES)
    return f""", {name} AS (SELECT a.id, a.sex, a.age_bin, {cols} FROM binned a JOIN binned b
  ON a.id = b.id AND a.sex = b.sex AND a.age_bin = b.age_bin WHERE a.year = {year} AND b.year = {year - 1})
"""


_ROUND_MEASURES = 'round("rat:mean", 6) AS "rat:mean", "gms:sum", round("gms:mean", 6) AS "gms:mean"'
_DIFFS = _YEARLY + _diff_cte("d1", 1999) + _diff_cte("d2", 2000)


def _year_cells(spark, sf, years, strings=()):
    return panel_diff.yearly_cells(orders_panel(spark, sf), REF, years, strings)


@query("yearly_multi_agg", _YEARLY + f"SELECT id, year, sex, birth_year, {_ROUND_MEASURES}, {', '.join(_STRINGS)} FROM yearly")
def yearly_multi_agg(spark, sf):
    return rounded(panel_diff.yearly_aggregates(orders_panel(spark, sf)))


@query("yoy_diff", _DIFFS + f"SELECT id, sex, age_bin, {_ROUND_MEASURES} FROM d2")
def yoy_diff(spark, sf):
    return rounded(panel_diff.changes(_year_cells(spark, sf, (1999, 2000)), 2000))


def _longer_sql(x_year: int, y_year: int, diff: str) -> str:
    longer = ", ".join(f"CASE WHEN length(x.{c}) >= length(y.{c}) THEN x.{c} ELSE y.{c} END AS {c}" for c in _STRINGS)
    return _DIFFS + f"""SELECT d.id, d.sex, d.age_bin, {_ROUND_MEASURES.replace('"rat', 'd."rat', 1).replace('"gms:sum"', 'd."gms:sum"')
                        .replace('round("gms:mean"', 'round(d."gms:mean"')}, {longer}
FROM {diff} d JOIN binned x ON d.id = x.id AND x.year = {x_year} JOIN binned y ON d.id = y.id AND y.year = {y_year}"""


@query("longer_title_merge", _longer_sql(2000, 1999, "d2"))
def longer_title_merge(spark, sf):
    return rounded(panel_diff.changes_with_strings(_year_cells(spark, sf, (1999, 2000), _STRINGS), 2000, 2000, 1999))


@query("longer_title_merge_earlier", _longer_sql(1998, 1999, "d1"))
def longer_title_merge_earlier(spark, sf):
    return rounded(panel_diff.changes_with_strings(_year_cells(spark, sf, (1998, 1999), _STRINGS), 1999, 1998, 1999))


_LONGER = ", ".join(f"CASE WHEN length(x.{c}) >= length(y.{c}) THEN x.{c} ELSE y.{c} END AS {c}" for c in _STRINGS)
_LABELLED_TITLES = _DIFFS + f""", j AS (SELECT d1.*, {_LONGER}, d2."rat:mean" AS nxt
  FROM d1 JOIN binned x ON d1.id = x.id AND x.year = 1998 JOIN binned y ON d1.id = y.id AND y.year = 1999 JOIN d2 ON d1.id = d2.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sex, age_bin, "rat:mean", "gms:sum", "gms:mean",
    {", ".join(_STRINGS)}, nxt) AS rn FROM j)
SELECT id, sex, age_bin, {_ROUND_MEASURES}, {", ".join(_STRINGS)}, CAST(CASE WHEN nxt > 5 THEN 1 ELSE 0 END AS INT) AS label
FROM r WHERE rn = 1"""


@query("next_diff_label", _DIFFS + """, j AS (SELECT d1.*, d2."rat:mean" AS nxt, row_number() OVER (PARTITION BY d1.id
    ORDER BY d1.sex, d1.age_bin, d1."rat:mean", d1."gms:sum", d1."gms:mean", d2."rat:mean") AS rn
  FROM d1 JOIN d2 ON d1.id = d2.id)
SELECT id, sex, age_bin, round("rat:mean", 6) AS "rat:mean", "gms:sum", round("gms:mean", 6) AS "gms:mean",
       CAST(CASE WHEN nxt > 5 THEN 1 ELSE 0 END AS INT) AS label FROM j WHERE rn = 1""")
def next_diff_label(spark, sf):
    return rounded(panel_diff.next_change_label(_year_cells(spark, sf, (1998, 1999, 2000)), 1999))


@query("next_diff_titles", _LABELLED_TITLES)
def next_diff_titles(spark, sf):
    """The labelled changes with the longer titles of the years they span."""
    cells = _year_cells(spark, sf, (1998, 1999, 2000), _STRINGS)
    return rounded(panel_diff.next_change_label(cells, 1999, strings=_STRINGS))


@query("diff_histogram", _DIFFS + """SELECT sex, age_bin, CAST(floor("rat:mean" / 20.0) AS BIGINT) AS bin, count(*) AS n
FROM d2 GROUP BY 1, 2, 3""")
def diff_histogram(spark, sf):
    found = panel_diff.changes(_year_cells(spark, sf, (1999, 2000)), 2000)
    return profile.grouped_histogram(found, "`rat:mean`", 20, "sex", "age_bin")


#: The bin width of each measure's histogram.
_WIDTHS = {"rat:mean": 20, "gms:sum": 20, "gms:mean": 5}


@query("diff_histograms", _DIFFS + " UNION ALL ".join(
    f"""SELECT CAST({year} AS INT) AS year, '{m}' AS measure, sex, age_bin, CAST(floor(CAST("{m}" AS DOUBLE) / {w}) AS BIGINT) AS bin,
       count(*) AS n FROM {diff} GROUP BY 1, 2, 3, 4, 5""" for year, diff in ((1999, "d1"), (2000, "d2")) for m, w in _WIDTHS.items()))
def diff_histograms(spark, sf):
    """Every measure's changes over both pairs of years."""
    return panel_diff.change_histograms(_year_cells(spark, sf, (1998, 1999, 2000)), (1999, 2000), _WIDTHS)

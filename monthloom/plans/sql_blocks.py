"""Shared pieces of the oracle SQL."""

from __future__ import annotations

REF = 2000
FIRST, LAST = (1995, 1), (2001, 8)

PANEL = """WITH src AS (
  SELECT o.o_custkey AS id, o.o_orderkey AS ok, o.o_orderdate AS d, o.o_orderstatus AS st,
         o.o_orderpriority AS pr, o.o_totalprice AS tp, c.c_name AS cname, n.n_name AS nat,
         row_number() OVER (PARTITION BY o.o_custkey, year(o.o_orderdate), month(o.o_orderdate)
                            ORDER BY o.o_orderdate DESC, o.o_orderkey DESC) AS rn,
         sum(o.o_orderkey % 23) OVER (PARTITION BY o.o_custkey, year(o.o_orderdate), month(o.o_orderdate)) AS games
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey),
b AS (
  SELECT *, CASE WHEN id % 40 = 0 AND ok % 2 = 0 THEN 'M' WHEN id % 10 = 0 THEN 'F' ELSE 'M' END AS sex,
         CASE pr WHEN '1-URGENT' THEN 'GM' WHEN '2-HIGH' THEN 'IM' WHEN '3-MEDIUM' THEN 'FM'
                 WHEN '4-NOT SPECIFIED' THEN 'CM' END AS t,
         1000 + CAST(floor(tp) AS BIGINT) % 1800 AS rat
  FROM src WHERE rn = 1),
panel AS (
  SELECT id,
       CASE WHEN id % 60 = 0 AND ok % 2 = 0 THEN cname || ' jr' ELSE cname END AS name,
       CASE WHEN id % 45 = 0 AND ok % 2 = 0 THEN 'OTHER' ELSE nat END AS fed,
       sex,
       CAST(CASE WHEN id % 25 = 0 AND ok % 3 = 0 THEN 0 WHEN id % 97 = 0 THEN 1880
                 WHEN id % 35 = 0 AND ok % 2 = 0 THEN 1971 ELSE 2000 - (4 + id % 90) END AS INT) AS birth_year,
       CASE WHEN sex = 'F' AND id % 20 = 0 THEN 'W' || t ELSE t END AS tit_code,
       CASE WHEN sex = 'F' THEN 'W' || t END AS wtit_code,
       CASE WHEN id % 11 = 0 THEN 'IA' END AS otit,
       CASE ok % 5 WHEN 1 THEN 'A' WHEN 2 THEN 'AB' WHEN 3 THEN 'ABC' WHEN 4 THEN 'B' END AS foa,
       CAST(rat AS INT) AS rat,
       CAST(games AS INT) AS gms,
       CAST(CASE WHEN rat >= 2400 THEN 10 WHEN id % 3 = 0 THEN 40 ELSE 20 END AS INT) AS k,
       CASE WHEN st = 'F' THEN CASE WHEN sex = 'F' THEN 'wi' ELSE 'i' END WHEN sex = 'F' THEN 'w' END AS flag,
       CAST(year(d) AS INT) AS year, CAST(month(d) AS INT) AS mon
  FROM b)
"""

EVENTS_PANEL = """WITH days AS (
  SELECT user_id AS id, CAST(day(ts) AS INT) AS day, count(*) AS gms, max(value) AS rat,
         max(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS active
  FROM events GROUP BY user_id, day(ts))
"""

RECODED_FLAG = "CASE flag WHEN 'wi' THEN 'i' WHEN 'w' THEN '' ELSE flag END"
ACTIVE = "NOT coalesce(flag LIKE '%i%', false)"


def rank_of(column: str, prefix: str = "") -> str:
    cases = " ".join(f"WHEN '{prefix}{t}' THEN {i}" for i, t in enumerate(("CM", "FM", "IM", "GM"), 1))
    return f"CAST(CASE {column} {cases} ELSE 0 END AS INT)"


PLAUSIBLE = f"(birth_year IS NOT NULL AND {REF} - birth_year > 5 AND {REF} - birth_year < 110)"


def clean_ctes(as_coded: bool = False) -> str:
    """Adds ``facts``, ``fixed`` and ``clean`` to the panel."""
    if as_coded:
        own, donor = f"(birth_year IS NOT NULL AND {REF} - birth_year > 5)", "birth_year"
    else:
        own, donor = PLAUSIBLE, f"CASE WHEN {PLAUSIBLE} THEN birth_year END"
    return PANEL + f""", facts AS (
  SELECT id, count(DISTINCT sex) AS n_sex, max({donor}) AS known FROM panel GROUP BY id),
fixed AS (
  SELECT p.id, p.name, p.fed, p.sex, CAST(CASE WHEN {own} THEN birth_year ELSE known END AS INT) AS birth_year,
         p.tit_code, p.wtit_code, p.otit, p.foa, p.rat, p.gms, p.k, p.flag, p.year, p.mon, n_sex
  FROM panel p JOIN facts f ON p.id = f.id),
clean AS (
  SELECT id, coalesce(name, '') AS name, fed, sex, birth_year, coalesce(tit_code, '') AS tit_code,
         coalesce(wtit_code, '') AS wtit_code, coalesce(otit, '') AS otit, coalesce(foa, '') AS foa, rat, gms, k,
         coalesce({RECODED_FLAG}, '') AS flag, year, mon, CAST({REF} - birth_year AS INT) AS age,
         {rank_of('tit_code')} AS tit, {rank_of('tit_code', 'W')} AS wtit
  FROM fixed WHERE n_sex <= 1 AND {REF} - birth_year > 5 AND {REF} - birth_year < 110)
"""


CLEAN = clean_ctes()


def period_sql(n: int) -> str:
    per_year = -(-12 // n)
    return "year" if n == 12 else f"(year * {per_year} + (mon - 1) // {n})"


def ordinals(n: int) -> list[int]:
    per_year = -(-12 // n)
    at = lambda y, m: y if n == 12 else y * per_year + (m - 1) // n
    return list(range(at(*FIRST), at(*LAST) + 1))


def suffix(n: int, o: int) -> str:
    per_year = -(-12 // n)
    return str(o) if n == 12 else f"{o // per_year}_{o % per_year * n}"


def at_period(n: int, o: int, column: str) -> str:
    return f"CASE WHEN {period_sql(n)} = {o} THEN {column} END"


# feature name -> (aggregate over the cell, fill value)
FEATURES = {
    "flag_str": (lambda n, o: f"max({at_period(n, o, 'flag')})", "'i'"),
    "gms_sum": (lambda n, o: f"CAST(sum({at_period(n, o, 'gms')}) AS BIGINT)", "0"),
    "gms_mean": (lambda n, o: f"round(avg({at_period(n, o, 'gms')}), 6)", "0"),
    "rat_mean": (lambda n, o: f"round(avg({at_period(n, o, 'rat')}), 6)", "0"),
    "tit_max": (lambda n, o: f"max({at_period(n, o, 'tit')})", "0"),
    "wtit_max": (lambda n, o: f"max({at_period(n, o, 'wtit')})", "0"),
}


def cells(n: int, names=tuple(FEATURES)) -> str:
    return ",\n         ".join(f"{FEATURES[f][0](n, o)} AS {f}_{suffix(n, o)}" for f in names for o in ordinals(n))


def feature_ctes(n: int, as_coded: bool = False) -> str:
    """Adds ``wide``: base attributes of the earliest row, and every feature cell."""
    return clean_ctes(as_coded) + f""", wide AS (
  SELECT id, arg_min(sex, year * 12 + mon) AS sex, arg_min(k, year * 12 + mon) AS k,
         arg_min(age, year * 12 + mon) AS age,
         {cells(n)}
  FROM clean GROUP BY id)
"""


AGE_EDGES = (5, 18, 25, 35, 50, 65, 75, 110)


def age_group(column: str = "age") -> str:
    whens = " ".join(f"WHEN {column} > {a} AND {column} <= {b} THEN '({a}, {b}]'" for a, b in zip(AGE_EDGES, AGE_EDGES[1:]))
    return f"CASE {whens} END"


def equal_bin(column: str, source: str, bins: int) -> str:
    lo = f"(SELECT CAST(min({column}) AS DOUBLE) FROM {source})"
    step = f"((SELECT CAST(max({column}) AS DOUBLE) FROM {source}) - {lo}) / {bins}"
    edges = " + ".join(f"CASE WHEN CAST({column} AS DOUBLE) > {float(i)} * ({step}) + {lo} THEN 1 ELSE 0 END" for i in range(1, bins))
    return f"CAST(1 + {edges} AS INT)"


def dictionary_ctes(source: str, columns, numeric=("k",)) -> str:
    """Adds ``entries`` and ``dictionary``: the rows and the one-hot slot of every value of some columns."""
    rows = " UNION ALL ".join(f"SELECT id, {i} AS place, '{c}' AS col, CAST({c} AS VARCHAR) AS value FROM {source}"
                              for i, c in enumerate(columns))
    number = f"CASE WHEN col IN ({', '.join(repr(c) for c in numeric)}) THEN TRY_CAST(value AS DOUBLE) END"
    return f""", entries AS ({rows}),
counted AS (SELECT place, col, value, count(*) AS n FROM entries GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY value IS NULL, {number}, value) - 1 AS r,
                  count(*) OVER (PARTITION BY place) AS n_values FROM counted),
starts AS (SELECT place, sum(CASE WHEN n_values = 2 THEN 1 ELSE n_values END) OVER (ORDER BY place)
                  - CASE WHEN n_values = 2 THEN 1 ELSE n_values END AS start FROM (SELECT DISTINCT place, n_values FROM ranked)),
dictionary AS (SELECT r.place, col, value, n, CAST(CASE WHEN n_values = 2 THEN CASE WHEN r = 1 THEN start END ELSE start + r END AS INT) AS slot
               FROM ranked r JOIN starts USING (place))
"""


def target_of(n: int) -> int:
    per_year = -(-12 // n)
    start = {1: 11, 6: 6, 12: 0}[n]
    return REF if n == 12 else REF * per_year + start // n


def dataset_ctes(n: int, kind: str, diff: int = 10) -> str:
    """Adds ``dataset`` with X cells, ``label`` and ``baseline``."""
    t = target_of(n)
    x = [(f, o) for f in FEATURES for o in ordinals(n) if o < t]
    xs = ",\n         ".join(f"coalesce({f}_{suffix(n, o)}, {FEATURES[f][1]}) AS {f}_{suffix(n, o)}" for f, o in x)
    curr, prev = (f"coalesce(rat_mean_{suffix(n, o)}, 0)" for o in (t, t - 1))
    label = {"clf": f"CAST(CASE WHEN {curr} > {prev} + {diff} THEN 1 ELSE 0 END AS DOUBLE)",
             "regr": f"CAST({curr} AS DOUBLE)", "regrdiff": f"round({curr} - {prev}, 6)"}[kind]
    baseline = f"CAST({prev} AS DOUBLE)" if kind == "regr" else "CAST(0 AS DOUBLE)"
    return feature_ctes(n) + f""", dataset AS (
  SELECT id, sex, k, {age_group()} AS age_bin,
         {xs},
         {label} AS label, {baseline} AS baseline
  FROM wide)
"""


def split_ctes(stratify: bool) -> str:
    """Adds ``splits`` to a dataset: id, label, baseline, split."""
    part = "PARTITION BY label" if stratify else ""
    return f""", ordered AS (
  SELECT id, label, baseline, row_number() OVER ({part} ORDER BY md5('42:' || CAST(id AS VARCHAR)), id) AS r,
         count(*) OVER ({part}) AS n
  FROM dataset),
sized AS (SELECT *, ceil(CAST(0.2 AS DOUBLE) * n) AS n_test FROM ordered),
splits AS (
  SELECT id, label, baseline,
         CASE WHEN r <= n_test THEN 'test'
              WHEN r <= n_test + ceil(CAST(0.125 AS DOUBLE) * (n - n_test)) THEN 'val' ELSE 'train' END AS split
  FROM sized)
"""


def clf_metrics_sql(pred: str = "pred") -> str:
    return f"""round((avg(CASE WHEN label = 1 THEN CASE WHEN {pred} = 1 THEN 1.0 ELSE 0.0 END END)
       + avg(CASE WHEN label = 0 THEN CASE WHEN {pred} = 0 THEN 1.0 ELSE 0.0 END END)) / 2, 6) AS auc,
       round(avg(CASE WHEN label = {pred} THEN 1 ELSE 0 END), 6) AS accuracy"""


def reg_metrics_sql(pred: str = "pred") -> str:
    return f"""round(sqrt(avg((label - {pred}) * (label - {pred}))), 6) AS rmse,
       round(covar_pop(label, {pred}) / nullif(stddev_pop(label) * stddev_pop({pred}), 0), 6) AS pearson_r"""


def box_sql(source: str, value: str, by: str) -> str:
    """Quartiles, whiskers and outliers of ``value`` per ``by``."""
    return f""", quartiles AS (
  SELECT {by} AS c, count({value}) AS n, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS median,
         quantile_cont({value}, 0.75) AS q3 FROM {source} WHERE {value} IS NOT NULL GROUP BY {by}),
fenced AS (
  SELECT q.*, s.{value} AS v, s.{value} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
  FROM {source} s JOIN quartiles q ON s.{by} = q.c WHERE s.{value} IS NOT NULL)
SELECT c AS {by}, n, round(CAST(q1 AS DOUBLE), 6) AS q1, round(CAST(median AS DOUBLE), 6) AS median,
       round(CAST(q3 AS DOUBLE), 6) AS q3,
       round(CAST(min(CASE WHEN inside THEN v END) AS DOUBLE), 6) AS whisker_low,
       round(CAST(max(CASE WHEN inside THEN v END) AS DOUBLE), 6) AS whisker_high,
       CAST(count(CASE WHEN NOT inside THEN 1 END) AS BIGINT) AS outliers
FROM fenced GROUP BY c, n, q1, median, q3"""

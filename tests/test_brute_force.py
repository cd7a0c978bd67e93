"""Cleaning, features and targets against a plain pandas computation on random panels."""

import random

import pandas as pd
import pytest

from monthloom.functions.periods import PeriodSpec
from monthloom.model import PANEL_SCHEMA
from monthloom.operators.clean import CleaningRules
from monthloom.operators.features import feature_table
from monthloom.operators.targets import build_dataset

EDGES = [5, 18, 25, 35, 50, 65, 75, 110]
TIT = ["None", "CM", "FM", "IM", "GM"]
WTIT = ["None", "WCM", "WFM", "WIM", "WGM"]


def random_panel(seed, n_ids=40):
    rng = random.Random(seed)
    out = []
    for i in range(n_ids):
        sex, born = rng.choice("MF"), rng.choice([1880, 1950, 1985, 2001, 2013, 2014, 0])
        for t in rng.sample(range(25), rng.randint(1, 25)):
            year, mon = 2017 + (t + 11) // 12, (t + 11) % 12 + 1
            s = rng.choice("MF") if rng.random() < 0.01 else sex
            out.append((i, f"N{i}", "XX", s, rng.choice([born, born, born, 0, None]), rng.choice([None, "CM", "FM", "GM", "WIM"]),
                        None, None, None, rng.randint(1000, 2800), rng.randint(0, 20), rng.choice([10, 20, 40]),
                        rng.choice([None, "i", "w", "wi"]), year, mon))
    rng.shuffle(out)
    return out


def expected(raw, n, diff):
    df = pd.DataFrame(raw, columns=PANEL_SCHEMA.fieldNames()).sort_values(["id", "year", "mon"])
    df = df[df.groupby("id")["sex"].transform("nunique") <= 1]
    ok = df["birth_year"].between(2019 - 109, 2019 - 6)
    best = df["birth_year"].where(ok).groupby(df["id"]).transform("max")
    df = df.assign(age=2019 - df["birth_year"].where(ok, best)).dropna(subset=["age"])
    df["age"] = df["age"].astype(int)
    df["flag"] = df["flag"].replace({"wi": "i", "w": ""}).fillna("")
    df["tit"] = [TIT.index(t) if t in TIT else 0 for t in df["tit_code"]]
    df["wtit"] = [WTIT.index(t) if t in WTIT else 0 for t in df["tit_code"]]
    per_year = -(-12 // n)
    df["o"] = df["year"] * per_year + (df["mon"] - 1) // n
    base = df.groupby("id").first()[["sex", "k", "age"]]
    groups = df.groupby(["id", "o"])
    cells = pd.DataFrame({"flag_str": groups["flag"].agg(lambda x: max(x, key=len)), "gms_sum": groups["gms"].sum(),
                          "gms_mean": groups["gms"].mean(), "rat_mean": groups["rat"].mean(),
                          "tit_max": groups["tit"].max(), "wtit_max": groups["wtit"].max()})
    target = 2019 * per_year + per_year - 1
    rows = {}
    for i, b in base.iterrows():
        row = {"sex": b["sex"], "k": b["k"], "age_bin": str(pd.cut([b["age"]], EDGES)[0])}

        def cell(name, o):
            return cells[name].get((i, o), "i" if name == "flag_str" else 0)

        period = PeriodSpec(n)
        for name in cells.columns:
            for o in range(2017 * per_year + 11 // n, target):
                row[f"{name}_{period.suffix(o)}"] = cell(name, o)
        row["label"] = float(cell("rat_mean", target) > cell("rat_mean", target - 1) + diff)
        rows[i] = row
    return rows


@pytest.mark.parametrize("seed, n", [(1, 6), (2, 12), (3, 4), (4, 1)])
def test_dataset(spark, seed, n):
    raw = random_panel(seed)
    panel = spark.createDataFrame(raw, PANEL_SCHEMA).repartition(5)
    period = PeriodSpec(n)
    span = period.span((2017, 12), (2019, 12))
    features = feature_table(panel, CleaningRules(2019), period, span)
    got = {r["id"]: r.asDict() for r in build_dataset(features, period, span, span[-1], "clf").collect()}
    want = expected(raw, n, 10)
    assert sorted(got) == sorted(want)
    for i, row in want.items():
        for c, v in row.items():
            assert got[i][c] == (pytest.approx(v) if isinstance(v, float) else v), (i, c)

"""Year-over-year changes against pandas joins, and the shape of their plans."""

import itertools
import random
import re

import pytest

from helpers import rows
from monthloom.operators import panel_diff
from monthloom.sources.driver_tables import orders_panel
from monthloom.sources.panel_io import read_panel, write_panel
from monthloom.sources.store import cut_lineage, scratch_path

COLUMNS = "id long, year int, mon int, sex string, birth_year int, rat int, gms int, tit_code string, foa string"
STRINGS = ("tit_code", "foa")


@pytest.fixture(scope="module")
def panel(spark):
    """Entities with several sexes and birth years, missing ids, sexes, years and titles, repeated rows."""
    draw = random.Random(5)
    data = [(draw.choice([1, 2, 3, 4, 5, None]), draw.choice([1998, 1999, 2000]), draw.randint(1, 12), draw.choice(["F", "M", None]),
             draw.choice([1970, 1971, 1920, 1880, None]), draw.randint(1000, 1100), draw.randint(0, 50),
             draw.choice(["GM", "IM", "", None]), draw.choice(["A", "AB", None])) for _ in range(150)]
    return cut_lineage(spark.createDataFrame(data + data[:5], COLUMNS), "diff-panel")


def joined(panel, year):
    """The changes by plain joins over the yearly aggregates, as (id, sex, age bin, three changes)."""
    yearly = panel_diff.with_age_bins(panel_diff.yearly_aggregates(panel, STRINGS), 2000, panel=panel).collect()
    out = [(a["id"], a["sex"], a["age_bin"], *[a[m] - b[m] for m in panel_diff.MEASURES])
           for a, b in itertools.product(yearly, yearly)
           if a["year"] == year and b["year"] == year - 1 and None not in (a["id"], a["sex"])
           and (a["id"], a["sex"], a["age_bin"]) == (b["id"], b["sex"], b["age_bin"])]
    return out, yearly


def longer(x, y):
    return tuple(x[c] if len(x[c]) >= len(y[c]) else y[c] for c in STRINGS)


def test_changes_equal_joins(panel):
    cells = panel_diff.yearly_cells(panel, 2000, (1998, 1999, 2000), STRINGS)
    for year in (1999, 2000):
        want, yearly = joined(panel, year)
        assert want and rows(panel_diff.changes(cells, year)) == sorted(want, key=repr)
        titled = [(*d, *longer(x, y)) for d in want for x in yearly for y in yearly
                  if x["id"] == y["id"] == d[0] and x["year"] == year and y["year"] == year - 1]
        assert rows(panel_diff.changes_with_strings(cells, year, year, year - 1, STRINGS)) == sorted(titled, key=repr)


def test_labels_keep_the_smallest_row(panel):
    cells = panel_diff.yearly_cells(panel, 2000, (1998, 1999, 2000), STRINGS)
    (first, yearly), (second, _) = joined(panel, 1999), joined(panel, 2000)
    best = {}
    for d in first:
        for n in second:
            for x, y in itertools.product(yearly, yearly):
                if n[0] == d[0] == x["id"] == y["id"] and x["year"] == 1998 and y["year"] == 1999:
                    row = (*d, *longer(x, y), n[3])
                    best[d[0]] = min(best.get(d[0], row), row)
    want = [(*r[:-1], int(r[-1] > 5)) for r in best.values()]
    assert want and rows(panel_diff.next_change_label(cells, 1999, strings=STRINGS)) == sorted(want, key=repr)
    plain = rows(panel_diff.next_change_label(cells, 1999))
    assert plain == sorted(((*r[:6], r[-1]) for r in want), key=repr)


def test_histograms_count_every_change(panel):
    cells = panel_diff.yearly_cells(panel, 2000, (1998, 1999, 2000))
    got = panel_diff.change_histograms(cells, (1999, 2000), {"rat:mean": 20, "gms:sum": 7})
    want = {}
    for year in (1999, 2000):
        for d in joined(panel, year)[0]:
            for m, value, width in (("rat:mean", d[3], 20), ("gms:sum", d[4], 7)):
                key = (year, m, d[1], d[2], int(value // width))
                want[key] = want.get(key, 0) + 1
    assert rows(got) == sorted(((*k, n) for k, n in want.items()), key=repr)


def test_empty_panel(panel):
    cells = panel_diff.yearly_cells(panel.limit(0), 2000, (1998, 1999, 2000), STRINGS)
    assert rows(panel_diff.changes(cells, 2000)) == [] == rows(panel_diff.next_change_label(cells, 1999, strings=STRINGS))


def test_years_meet_in_two_shuffles(spark, sf_dir):
    path = scratch_path(spark, "diff-plan")
    write_panel(orders_panel(spark, sf_dir), path)
    stored = read_panel(spark, path)
    cells = panel_diff.yearly_cells(stored, 2000, (1999, 2000), panel_diff.TITLE_COLUMNS)
    got = panel_diff.changes_with_strings(cells, 2000, 2000, 1999)
    text = got._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 2 and "Join" not in text and "Window" not in text
    assert re.search(r"PartitionFilters: \[[^\]]*year#\d+ IN \(1999,2000\)", text)

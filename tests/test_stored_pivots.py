"""Joins of wide tables read stored pivots: no task holds the rows of several aggregations at once."""

import pytest

from helpers import rows
from monthloom.functions.periods import PeriodSpec
from monthloom.operators.clean import CleaningRules, clean_panel
from monthloom.operators.features import DEFAULT_FEATURES, entity_base, feature_table, wide_features

HALF = PeriodSpec(6)
SPAN = HALF.span((2018, 7), (2019, 12))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joined_pivots_are_stored(golden):
    panel = clean_panel(golden, CleaningRules(2019))
    found = wide_features(panel, DEFAULT_FEATURES, HALF, SPAN, "joined")
    assert "Aggregate" not in plan(found) and "Join" in plan(found)
    assert rows(found) == rows(wide_features(panel, DEFAULT_FEATURES, HALF, SPAN))


@pytest.mark.parametrize("keep", ["first", "last"])
def test_as_coded_sides_are_stored(golden, keep):
    rules = CleaningRules(2019, birth_fix="as_coded")
    found = feature_table(golden, rules, HALF, SPAN, keep=keep)
    assert "Aggregate" not in plan(found)
    panel = clean_panel(golden, rules)
    assert rows(found) == rows(entity_base(panel, keep=keep).join(wide_features(panel, DEFAULT_FEATURES, HALF, SPAN), "id", "left"))

"""Helpers of the tests, in a module whose name no test folder repeats."""

from __future__ import annotations


def rows(df):
    """Rows as sorted tuples, for order-free comparison."""
    return sorted((tuple(r) for r in df.collect()), key=repr)

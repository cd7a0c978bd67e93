from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows and an id with two texts."""
    line = "the same line of text that is longer than forty characters"
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", None, "a", 0), (3, " \t\n\x0b ", "en", None, 5),
            (4, "one", "en", "b", 3), (5, "one two", "fr", "b", 7), (6, "word " * 30_000, "en", "b", 150_000),
            (None, "a text without an id, a second line\n" + line, "en", "a", 1)]
    rows += [(10 + i, f"own line number {i}\n{line}\n  {line.upper()} ", "en", "a", 9) for i in range(6)]
    rows += [(20, "twice the very same row of words in a table", "en", "c", 1)] * 2
    rows += [(21, "first text of an id", "en", "c", 1), (21, "second text of an id", "de", "c", 1)]
    return table(spark, rows).cache()


@pytest.fixture(scope="session")
def none(spark):
    return table(spark, [])


@pytest.fixture(scope="session")
def clashing(odd):
    """Extra columns named like results and helpers."""
    from pyspark.sql import functions as F
    names = ("n_lines n_dropped keep did th size target taken shard ids secrets kept component_id c h w "
             "lang_pred score held_out start n_email text_md5 edited place").split()
    return odd.withColumns({n: F.lit("x") for n in names})


@pytest.fixture(scope="session")
def small(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()

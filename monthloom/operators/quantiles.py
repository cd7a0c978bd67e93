"""Exact quantiles and box statistics by category, without gathering a category in one task.

Ranks are refined: the rows inside a bracket are counted in a fixed number of equal sub-ranges, and only the
sub-range that holds a wanted rank becomes the next bracket, drawn tight to its least and greatest value. All brackets of
all categories go down together in one pass. Histograms add up map-side, so what is shuffled and ranked does not
grow with the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom.sources.store import cut_lineage

#: Sub-ranges of a bracket; a bracket of that many adjacent integers is settled in one pass.
CELLS = 4096
LARGEST = 1.7976931348623157e308


def _values(df: DataFrame, value: str, by: str, categories: Sequence | None) -> DataFrame:
    """``c, v``: category and number of every row with one, stored, since each pass reads them again.

    NaN counts as missing; infinities as the largest numbers.
    """
    kept = df if categories is None else df.where(F.col(by).isin(list(categories)))
    v = F.col(value).cast("double")
    return cut_lineage(kept.where(F.col(value).isNotNull() & ~F.isnan(v))
                       .select(F.col(by).alias("c"), F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), v)).alias("v")), "quantile-values")


def _matched(data: DataFrame, small: DataFrame, categories: Sequence | None) -> DataFrame:
    """Rows with their category's columns of ``small`` (``b`` instead of ``c``). Listed categories bound what is
    broadcast; otherwise the planner decides by the stored size."""
    small = small.withColumnRenamed("c", "b")
    return data.join(small if categories is None else F.broadcast(small), F.col("c").eqNullSafe(F.col("b"))).drop("b")


def cell_of(v: Column, low: Column, high: Column) -> Column:
    """Sub-range of ``v``: never falls as ``v`` grows, whatever the rounding, and differs between both ends.

    Halves keep the width finite; where it rounds to nothing, the least value has a cell of its own.
    """
    width = high / 2 - low / 2
    share = (v / 2 - low / 2) / F.when(width > 0, width)
    return F.when(width > 0, F.least(F.floor(share * CELLS), F.lit(CELLS - 1))).when(v > low, CELLS - 1).otherwise(0).cast("int")


def histograms(data: DataFrame, brackets: DataFrame, categories: Sequence | None) -> DataFrame:
    """``c, low, hist``: of each bracket (``c, spans``: arrays of low and high) its cells in order, as
    ``cell, n, least, most``. At most ``CELLS`` rows a bracket leave a task or meet in one."""
    v = F.col("v")
    inside = (_matched(data, brackets, categories)
              .withColumn("span", F.explode(F.filter("spans", lambda s: v.between(s["low"], s["high"]))))
              .select("c", "v", F.col("span.low").alias("low"), F.col("span.high").alias("high")))
    counted = (inside.groupBy("c", "low", cell_of(v, F.col("low"), F.col("high")).alias("cell"))
               .agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")))
    return (counted.groupBy("c", "low").agg(F.array_sort(F.collect_list(F.struct("cell", "n", "least", "most"))).alias("hist")))


def exact_order_statistics(data: DataFrame, ranks: DataFrame, categories: Sequence | None) -> DataFrame:
    """``c, rank, q``: the value at each rank (from 0) of each category of stored ``data`` (``c, v``).

    ``ranks`` holds ``c, rank, low, high, below``: a bracket sure to contain the rank, and how many rows lie
    below it. Every pass divides the width of each open bracket by ``CELLS``, until it holds one value.
    """
    settled = F.col("low") == F.col("high")
    state = cut_lineage(ranks, "quantile-brackets")
    done = state.where(settled).select("c", "rank", F.col("low").alias("q"))
    state = state.where(~settled)
    while not state.isEmpty():
        spans = state.groupBy("c").agg(F.collect_set(F.struct("low", "high")).alias("spans"))  # two a rank at most
        found = histograms(data, spans, categories).select(F.col("c").alias("hc"), F.col("low").alias("hl"), "hist")
        start = F.struct(F.col("below").alias("below"), F.col("low").alias("low"), F.col("high").alias("high"), F.lit(False).alias("hit"))

        def step(at, cell):
            """Pass over the cells below the rank; stop at the one that holds it."""
            here = ~at["hit"] & (F.col("rank") < at["below"] + cell["n"])
            return F.struct(F.when(at["hit"] | here, at["below"]).otherwise(at["below"] + cell["n"]).alias("below"),
                            F.when(here, cell["least"]).otherwise(at["low"]).alias("low"),
                            F.when(here, cell["most"]).otherwise(at["high"]).alias("high"), (at["hit"] | here).alias("hit"))
        moved = (state.join(found, F.col("c").eqNullSafe(F.col("hc")) & (F.col("low") == F.col("hl")))
                 .withColumn("at", F.aggregate("hist", start, step)).select("c", "rank", "at.low", "at.high", "at.below"))
        state = cut_lineage(moved, "quantile-brackets")
        done = done.unionByName(state.where(settled).select("c", "rank", F.col("low").alias("q")))
        state = state.where(~settled)
    return done


def _quantiles(data: DataFrame, ends: DataFrame, by: str, categories: Sequence | None, probs: Sequence[float]) -> DataFrame:
    """``by, n, q1, …`` from stored values and ``ends`` (``c, n, low, high``)."""
    probs = sorted(probs)
    h = [F.lit(float(p)) * (F.col("n") - 1) for p in probs]
    wanted = F.array_distinct(F.array(*[f(x).cast("long") for x in h for f in (F.floor, F.ceil)]))
    ranks = ends.select("c", F.explode(wanted).alias("rank"), "low", "high", F.lit(0).cast("long").alias("below"))
    found = (exact_order_statistics(data, ranks, categories)
             .groupBy(F.col("c").alias("g")).agg(F.map_from_entries(F.collect_list(F.struct("rank", "q"))).alias("at")))  # two a probability
    low = [F.col("at")[F.floor(x).cast("long")] for x in h]
    high = [F.col("at")[F.ceil(x).cast("long")] for x in h]
    return (ends.select("c", "n").join(found, F.col("c").eqNullSafe(F.col("g")))
            .select(F.col("c").alias(by), "n", *[(a + (x - F.floor(x)) * (b - a)).alias(f"q{i + 1}")
                                                 for i, (x, a, b) in enumerate(zip(h, low, high))]))


_ENDS = (F.count, "n"), (F.min, "low"), (F.max, "high")


def exact_quantiles(df: DataFrame, value: str, by: str, categories: Sequence | None, probs: Sequence[float]) -> DataFrame:
    """``by, n, q1, q2, …``: linearly interpolated quantiles for each category in ``categories``, or for each
    observed one, rows without a category among them, if None."""
    data = _values(df, value, by, categories)
    ends = cut_lineage(data.groupBy("c").agg(*[f("v").alias(name) for f, name in _ENDS]), "quantile-ends")
    return _quantiles(data, ends, by, categories, probs)


def box_stats(df: DataFrame, value: str, by: str, categories: Sequence | None = None) -> DataFrame:
    """Box-plot numbers: quartiles, whiskers at the last values within 1.5 IQR, outlier count."""
    data = _values(df, value, by, categories)
    ends = cut_lineage(data.groupBy("c").agg(*[f("v").alias(name) for f, name in _ENDS]), "quantile-ends")
    quartiles = cut_lineage(_quantiles(data, ends, "c", categories, (0.25, 0.5, 0.75)), "quantile-quartiles")
    iqr = F.col("q3") - F.col("q1")
    fences = quartiles.select("c", "n", "q1", F.col("q2").alias("median"), "q3",
                              (F.col("q1") - 1.5 * iqr).alias("lo"), (F.col("q3") + 1.5 * iqr).alias("hi"))
    v = F.col("v")
    inside = v.between(F.col("lo"), F.col("hi"))
    return (_matched(data, fences, categories).groupBy(F.col("c").alias(by), "n", "q1", "median", "q3")
            .agg(F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"),
                 F.count_if(~inside).alias("outliers")))


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max, one row per column; all columns are refined together."""
    cells = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("p")).select("p.*")
    data = _values(cells, "value", "column", columns)
    moments = cut_lineage(data.groupBy("c").agg(*[f("v").alias(name) for f, name in _ENDS], F.avg("v").alias("mean"),
                                                F.stddev_samp("v").alias("std")), "quantile-ends")
    quartiles = _quantiles(data, moments.select("c", "n", "low", "high"), "q", columns, (0.25, 0.5, 0.75)).drop("n")
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return (every.join(F.broadcast(moments), F.col("column") == F.col("c"), "left")
            .join(F.broadcast(quartiles), F.col("column") == F.col("q"), "left")
            .select("column", F.coalesce("n", F.lit(0)).alias("count"), "mean", "std", F.col("low").alias("min"), "q1",
                    F.col("q2").alias("median"), "q3", F.col("high").alias("max")))

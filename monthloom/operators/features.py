"""Per-entity, per-period features: long, then wide."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from monthloom.functions.aggregates import aggregate, earliest, latest
from monthloom.functions.periods import PeriodSpec, month_index
from monthloom.functions.scalars import age_in, domain_value, fingerprint, strict_rank
from monthloom.model import FLAGS, SEXES
from monthloom.operators.clean import CleaningRules, clean_panel, recode_rows
from monthloom.operators.skew import salted_join
from monthloom.sources.store import cut_lineage


@dataclass(frozen=True)
class FeatureSpec:
    """One aggregated column.

    ``domain`` lists the values a string column can take, shortest first. Such columns travel as
    small integers, which keeps the aggregation hash-based; another value fails the query. Without a domain
    any string can come. ``missing`` fills periods without rows.
    """

    column: str
    agg: str
    domain: tuple[str, ...] | None = None
    missing: object = 0

    @property
    def name(self) -> str:
        return f"{self.column}_{self.agg}"

    @property
    def title(self) -> str:
        return f"{self.column}:{self.agg}"

    def builder(self):
        if self.domain and self.agg == "str":
            return lambda c: F.max(strict_rank(c, self.domain, self.column))
        return aggregate(self.agg)

    def decode(self, cell: Column) -> Column:
        return domain_value(cell, self.domain) if self.domain else cell

    def cell_name(self, period: PeriodSpec, ordinal: int) -> str:
        return f"{self.name}_{period.suffix(ordinal)}"


# The feature set used when none is given.
DEFAULT_FEATURES = (
    FeatureSpec("flag", "str", domain=FLAGS, missing="i"),
    FeatureSpec("gms", "sum"),
    FeatureSpec("gms", "mean"),
    FeatureSpec("rat", "mean"),
    FeatureSpec("tit", "max"),
    FeatureSpec("wtit", "max"),
)

STRATEGIES = ("preaggregate", "cluster", "conditional", "joined")


def long_features(panel: DataFrame, specs: Sequence[FeatureSpec], period: PeriodSpec,
                  extra: Sequence[Column] = (), decode: bool = True) -> DataFrame:
    """One row per entity and period with all features computed in a single aggregation."""
    cells = (panel.where(F.col("year").isNotNull() & F.col("mon").isNotNull())
             .groupBy("id", period.ordinal_column().alias("period_ord"))
             .agg(*[s.builder()(F.col(s.column)).alias(s.name) for s in specs], *extra))
    if decode:
        cells = cells.withColumns({s.name: s.decode(F.col(s.name)) for s in specs if s.domain})
    return cells


def labelled_features(cells: DataFrame, specs: Sequence[FeatureSpec], period: PeriodSpec) -> DataFrame:
    """``id, label, value`` rows for numeric features, labelled ``what:agg/year/start/n``."""
    stacked = F.explode(F.array(*[
        F.struct(F.lit(s.title).alias("feature"), F.col(s.name).cast("double").alias("value"))
        for s in specs])).alias("c")
    return (cells.select("id", "period_ord", stacked)
            .select("id", "period_ord", period.label_column(F.col("c.feature")).alias("label"), "c.value"))


def composite_max(panel: DataFrame, columns: Sequence[str], period: PeriodSpec) -> DataFrame:
    """Lexicographic maximum of several columns taken together."""
    best = F.max(F.struct(*columns))
    return (panel.groupBy("id", period.ordinal_column().alias("period_ord")).agg(best.alias("best"))
            .select("id", "period_ord", *[F.col(f"best.{c}").alias(c) for c in columns]))


def composite_values(panel: DataFrame, columns: Sequence[str], period: PeriodSpec) -> DataFrame:
    """The values a composite sum would chain together, one row each.

    Chaining tuples concatenates them; keeping the elements as rows gives the same content without
    growing one cell with the number of rows in its group.
    """
    pieces = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    return (panel.select("id", period.ordinal_column().alias("period_ord"), pieces.alias("p"))
            .select("id", "period_ord", "p.column", "p.value"))


def composite_chain(panel: DataFrame, columns: Sequence[str], period: PeriodSpec) -> DataFrame:
    """The chained tuples of a composite sum in order: ``id, period_ord, position, column, value``.

    Tuples of an entity and period follow one another by month, those of one month by their values (null first);
    position counts the chain's elements from 1. Rows are range-partitioned and numbered as they lie, so that a
    chain of any length may go over many partitions; a row's place less that of its chain's first row is its position.
    Rows without a month have no place in a chain.
    """
    order = ["id", "period_ord", "year", "mon", *columns]
    # values of which two have one name, as a column asked for may be a key
    tuples = (panel.where(F.col("year").isNotNull() & F.col("mon").isNotNull())
              .select("id", period.ordinal_column().alias("period_ord"), "year", "mon", *[c for c in columns if c not in ("id", "year", "mon")]))
    sort = list(dict.fromkeys(order))
    laid = cut_lineage(tuples.repartitionByRange(*sort).sortWithinPartitions(*sort)
                       .withColumn("at", F.monotonically_increasing_id()), "chain")
    part = F.shiftright("at", 33).alias("part")
    # one row for each partition of the sort
    sizes = laid.groupBy(part).agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    placed = (laid.withColumn("part", part).join(F.broadcast(before), "part")
              .withColumn("place", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("part", "before", "at"))
    starts = placed.groupBy("id", "period_ord").agg(F.min("place").alias("start"))
    tuple_at = (F.col("place") - F.col("start")) * len(columns)
    # null ids make chains too, which an equality of keys would not join
    joined = salted_join(placed.withColumn("key", F.xxhash64(F.col("id").isNull(), "id", "period_ord")), starts.select(
        F.xxhash64(F.col("id").isNull(), "id", "period_ord").alias("key"), F.col("id").alias("sid"), F.col("period_ord").alias("speriod"), "start"), "key", "inner", spread=["place"])
    joined = joined.where(F.col("id").eqNullSafe(F.col("sid")) & (F.col("period_ord") == F.col("speriod")))
    pieces = F.explode(F.array(*[
        F.struct((tuple_at + i + 1).alias("position"), F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
        for i, c in enumerate(columns)])).alias("p")
    return joined.select("id", "period_ord", pieces).select("id", "period_ord", "p.position", "p.column", "p.value")


# ---- wide ----------------------------------------------------------------


def _cell_map(specs) -> Column:
    """Aggregate: the entity's cells keyed by period. Holds at most one entry per period."""
    return F.map_from_entries(F.collect_list(F.struct("period_ord", F.struct(*[s.name for s in specs]))))


def _cells_from_map(specs, period, ordinals) -> list[str]:
    return [f"try_element_at(cells, {o}).`{s.name}` AS `{s.cell_name(period, o)}`" for s in specs for o in ordinals]


def _pivot(cells: DataFrame, specs, period, ordinals) -> DataFrame:
    """Spread cells over the listed periods; naming them spares the job that would look for them."""
    names = [s.name for s in specs]
    wide = cells.groupBy("id").pivot("period_ord", list(ordinals)).agg(*[F.max(n).alias(n) for n in names])
    single = len(names) == 1  # Spark then leaves the aggregate's name out
    return wide.selectExpr("id", *[
        f"`{o if single else f'{o}_{s.name}'}` AS `{s.cell_name(period, o)}`" for s in specs for o in ordinals])


def _decode_wide(wide: DataFrame, specs, period, ordinals) -> DataFrame:
    coded = {s.cell_name(period, o): s for s in specs if s.domain for o in ordinals}
    return wide.withColumns({c: s.decode(F.col(c)) for c, s in coded.items()}) if coded else wide


def _within(panel: DataFrame, period: PeriodSpec, ordinals: Sequence[int]) -> DataFrame:
    """Rows of the wanted periods; plain year bounds come along so month folders are pruned."""
    years = [period.start(o)[0] for o in (min(ordinals), max(ordinals))]
    o = period.ordinal_column()
    return panel.where(F.col("year").between(*years) & o.between(min(ordinals), max(ordinals)))


def wide_features(panel: DataFrame, specs: Sequence[FeatureSpec], period: PeriodSpec,
                  ordinals: Sequence[int], strategy: str = "preaggregate") -> DataFrame:
    """One row per entity, one column per feature and period.

    The strategies return the same table:

    * ``preaggregate`` (default): aggregate per (entity, period) with map-side combine, then move
      the finished cells by entity. An entity contributes at most one row per period to the second
      exchange, whatever its number of panel rows.
    * ``cluster``: one exchange by entity, both aggregations on top of it. For panels known to be
      unique per entity and month.
    * ``conditional``: one conditional aggregation. For few cells.
    * ``joined``: one pivot per feature, joined on the entity. The cells and each pivot are stored, so that a task
      holds the rows of one pivot, or of the join, and never those of all pivots at once.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    rows = _within(panel, period, ordinals)
    if strategy == "conditional":
        o = period.ordinal_column()
        wide = rows.groupBy("id").agg(*[
            s.builder()(F.when(o == p, F.col(s.column))).alias(s.cell_name(period, p))
            for s in specs for p in ordinals])
    elif strategy == "joined":
        cells = cut_lineage(long_features(rows, specs, period, decode=False), "cells")
        blocks = [cut_lineage(_pivot(cells.select("id", "period_ord", s.name).repartition("id"), [s], period, ordinals), f"pivot-{s.name}")
                  for s in specs]
        wide = reduce(lambda a, b: a.join(b, "id"), blocks)
    else:
        if strategy == "cluster":
            cells = long_features(rows.repartition("id"), specs, period, decode=False)
        else:
            cells = long_features(rows, specs, period, decode=False).repartition("id")
        wide = _pivot(cells, specs, period, ordinals)
    return _decode_wide(wide, specs, period, ordinals)


def entity_base(panel: DataFrame, attributes: Sequence[str] = ("sex", "k", "age"), keep: str = "first") -> DataFrame:
    """Attributes of each entity's earliest row (``keep='last'``: latest, which may look past a target)."""
    order = month_index()
    packed = F.struct(order.alias("at"), *attributes)
    pick = F.min(packed) if keep == "first" else F.max(packed)
    return panel.groupBy("id").agg(pick.alias("row")).select("id", *[F.col(f"row.{a}").alias(a) for a in attributes])


def feature_table(panel: DataFrame, rules: CleaningRules, period: PeriodSpec, ordinals: Sequence[int],
                  specs: Sequence[FeatureSpec] = DEFAULT_FEATURES, keep: str = "first",
                  strategy: str = "preaggregate", sexes: Sequence[str] | None = SEXES) -> DataFrame:
    """Clean a raw panel and build its wide feature table: ``id, sex, k, age`` and the cells.

    With the documented birth-year repair every cleaning decision is about a whole entity, so the
    evidence for it is gathered by the same aggregation as the features and applied afterwards:
    no join, no window over an entity's rows. The other repair decides row by row and goes
    through :func:`clean_panel`; cleaned rows, attributes and cells are stored in turn, so that no task sorts and
    pivots for both sides of their join at once. ``strategy`` is ``preaggregate`` or ``cluster`` as in
    :func:`wide_features`. A sex outside ``sexes`` fails the query; with None any can come. Rows without a
    month take no part. All cleaned entities are kept, also those without rows in ``ordinals``.
    """
    if strategy not in ("preaggregate", "cluster"):
        raise ValueError(f"unknown strategy {strategy!r}")
    if rules.birth_fix != "documented":
        columns = dict.fromkeys(["id", "year", "mon", "sex", "k", "age", *[s.column for s in specs]])
        cleaned = cut_lineage(clean_panel(panel, rules).select(*columns), "cleaned")
        base = cut_lineage(entity_base(cleaned, keep=keep), "base")
        return base.join(cut_lineage(wide_features(cleaned, specs, period, ordinals, strategy), "wide"), "id", "left")

    pick = earliest if keep == "first" else latest
    at = month_index()
    b = F.col("birth_year")
    donor = rules.donor(b)
    sex = F.col("sex") if sexes is None else strict_rank(F.col("sex"), sexes, "sex")
    rows = recode_rows(panel, rules).withColumn("sex_code", sex)
    evidence = [
        F.min(fingerprint(F.col("sex"))).alias("sex_low"),
        F.max(fingerprint(F.col("sex"))).alias("sex_high"),
        F.max(donor).alias("known_birth"),
        (F.min(at) if keep == "first" else F.max(at)).alias("at"),
        pick(F.col("sex_code"), at).alias("sex_code"),
        pick(F.col("k"), at).alias("k"),
        pick(donor, at).alias("own_birth"),
    ]
    if strategy == "cluster":
        cells = long_features(rows.repartition("id"), specs, period, extra=evidence, decode=False)
    else:
        cells = long_features(rows, specs, period, extra=evidence, decode=False).repartition("id")
    # Cleaning looks at all months, also at those outside ``ordinals``.
    wide = (cells.groupBy("id")
            .agg(F.coalesce(F.min("sex_low") != F.max("sex_high"), F.lit(False)).alias("sex_conflict"),
                 pick(F.col("sex_code"), F.col("at")).alias("sex_code"),
                 pick(F.col("k"), F.col("at")).alias("k"),
                 pick(F.col("own_birth"), F.col("at")).alias("own_birth"),
                 F.max("known_birth").alias("known_birth"),
                 _cell_map(specs).alias("cells"))
            .where(~F.col("sex_conflict") & F.col("known_birth").isNotNull()))
    age = age_in(rules.ref_year, F.coalesce("own_birth", "known_birth"))
    shaped = (wide.withColumns({"sex": F.col("sex_code") if sexes is None else domain_value(F.col("sex_code"), sexes), "age": age})
              .selectExpr("id", "sex", "k", "age", *_cells_from_map(specs, period, ordinals)))
    return _decode_wide(shaped, specs, period, ordinals)


def fill_missing(wide: DataFrame, specs: Sequence[FeatureSpec], period: PeriodSpec,
                 ordinals: Sequence[int]) -> DataFrame:
    """Cells of periods without rows take each feature's ``missing`` value."""
    return wide.na.fill({s.cell_name(period, o): s.missing for s in specs for o in ordinals})


def reference_labels(wide: DataFrame, specs: Sequence[FeatureSpec], period: PeriodSpec,
                     ordinals: Sequence[int]) -> DataFrame:
    """Rename cells to ``what:agg/year/start/n``."""
    return wide.withColumnsRenamed({
        s.cell_name(period, o): period.label(s.title, o) for s in specs for o in ordinals})

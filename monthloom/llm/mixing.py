"""Mix sources to target weights by Sainte-Laguë apportionment of equal word blocks.

Every source is dealt into shards of about ``shard_docs`` documents in a seeded order. The words of a shard,
in that order, form equal blocks; seats of one block each go to the sources by highest quotients
``target / (2k + 1)``. A source's seats go on to its shards by their words, rounded cumulatively, so that each
shard is within one seat of its part and none is lost however many shards there are. A shard's quota is then
taken as whole passes over the shard plus evenly spaced blocks from a seeded start. Blocks are never rows: how
many taken words fall into a document follows from its place in the shard by integer arithmetic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from monthloom.llm.common import word_count
from monthloom.sources.store import cut_lineage

GRID = 64


def seeded(*parts: Column | str) -> Column:
    """60 bits of an MD5 digest, as a number: the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """Add ``target`` to one row per source (``source``, ``source_size``).

    Weights repeat over the sources by code point, null last. Targets share all words by weight and stop at
    ``most`` times a source's size; the excess is shared again by weight until none is above.
    """
    # one row per distinct source is ranked, never the documents
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = cut_lineage(sources.withColumn("weight", F.get(table, (place % len(weights)).cast("int"))), "mix-sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        # sources whose share at this level reaches their cap are full; the others share what is left
        capped = F.col("weight") * level >= most * F.col("source_size")
        row = ranked.agg(F.count_if(capped), F.sum(F.when(capped, most * F.col("source_size")).otherwise(0)),
                         F.sum(F.when(~capped, F.col("weight")))).first()
        if row[0] == full or row[2] is None:
            break
        full, level = row[0], (total - (row[1] or 0)) / row[2]
    return ranked.withColumn("target", F.least(F.col("weight") * level, (most * F.col("source_size")).cast("double")))


def apportion(cells: DataFrame, seats: int) -> DataFrame:
    """Add ``quota`` to rows of (``source``, ``shard``, ``votes``): ``seats`` awarded by highest quotients.

    The quotients are not listed: the lowest winning one is searched, ``GRID`` trial values per pass, and
    seats are counted above it. Quotients equal to it go by source and shard until all seats are given.
    """
    votes = F.col("votes")

    def won(threshold):
        return F.floor((votes / threshold + 1) / 2)

    top = cells.agg(F.max("votes")).first()[0] or 0.0
    if seats <= 0 or top <= 0:
        return cells.withColumn("quota", F.lit(0).cast("long"))
    high, low = float(top) * 2, 0.0  # nobody wins above high; low gives at least all seats
    while True:
        step = (high - low) / GRID
        trials = [low + step * i for i in range(1, GRID)]
        if not all(low < t < high for t in trials):
            break
        sums = cells.agg(*[F.sum(won(t)).alias(f"s{i}") for i, t in enumerate(trials)]).first()
        enough = [t for t, s in zip(trials, sums) if s >= seats]
        fewer = [t for t, s in zip(trials, sums) if s < seats]
        low, high = max([low, *enough]), min([high, *fewer])
        if seats in list(sums):
            high = max(t for t, s in zip(trials, sums) if s == seats)
            break
    sure = cells.withColumn("quota", won(high).cast("long"))
    left = seats - (sure.agg(F.sum("quota")).first()[0] or 0)
    if left <= 0:
        return sure
    extra = (sure.orderBy((votes / (2 * F.col("quota") + 1)).desc(), F.col("source").asc_nulls_last(), "shard")
             .limit(int(left)).select(F.col("source").alias("_s"), F.col("shard").alias("_h"), F.lit(1).alias("_one")))
    return (sure.join(extra, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_h")), "left")
            .withColumn("quota", F.col("quota") + F.coalesce("_one", F.lit(0))).drop("_s", "_h", "_one"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: str = "mix",
                shard_docs: int = 4096, least_blocks: int = 256) -> DataFrame:
    """Per row of ``docs``: ``doc_id, source, size, source_size, target, taken, text_md5``.

    ``size`` counts words (null text: 0). ``taken`` is how many of the row's words the mix holds, repeats
    counted: at most ``most`` times its size. A block is so small that every source's target has
    ``least_blocks`` of them for each of its shards (one word at least). Repeated rows each count; a null source is a source, a
    null id an id. No documents or no words: nothing is taken. Reruns give the same rows.
    """
    sized = cut_lineage(docs.select("doc_id", "source", word_count().alias("size"),
                                    F.md5(F.coalesce("text", F.lit(""))).alias("text_md5")), "mix-sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs"))
    targets = cut_lineage(source_targets(per_source, weights, most), "mix-targets")
    shards = F.ceil(F.col("source_docs") / shard_docs)
    # what rounding to blocks can lose in a shard is a fixed part of it, so the block does not grow with the input
    bounds = targets.agg(F.sum("source_size"), F.min(F.when(F.col("target") > 0, F.col("target") / shards))).first()
    total, block = bounds[0] or 0, max(1, int((bounds[1] or 0) / least_blocks))

    known = targets.select(F.col("source").alias("_s"), "source_size", "target", "source_docs")
    shard = F.pmod(seeded(F.lit(seed), F.lit("shard"), F.col("doc_id").cast("string")), shards)
    placed = (sized.join(known, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
              .withColumn("shard", shard))
    votes = F.col("source_size") * F.col("target") / F.col("source_size")  # in the oracle's order of operations
    seats = apportion(targets.where("source_size > 0").select("source", F.lit(0).alias("shard"), "source_size", votes.alias("votes")),
                      int(total / block + 0.5)).select(F.col("source").alias("_s"), "source_size", "quota")
    cells = placed.groupBy("source", "shard").agg(F.sum("size").alias("cell_size")).where("cell_size > 0")
    # one row per shard, never per document
    so_far = F.sum("cell_size").over(Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))

    def given(words: str) -> str:
        """Seats of a source's first ``words`` words; the product may pass 64 bits."""
        return f"CAST({words} AS DECIMAL(19, 0)) * CAST(quota AS DECIMAL(19, 0)) div CAST(source_size AS DECIMAL(19, 0))"
    dealt = (cells.withColumn("so_far", so_far).join(seats, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
             .selectExpr("source", "shard", "cell_size", f"({given('so_far')}) - ({given('so_far - cell_size')}) AS quota"))
    quotas = (cut_lineage(dealt, "mix-quotas")
              .select(F.col("source").alias("_s"), F.col("shard").alias("_h"), "cell_size",
                      F.least(F.col("quota") * block, most * F.col("cell_size")).alias("words"))
              .selectExpr("*", "words div cell_size AS passes", f"(cell_size + {block - 1}) div {block} AS blocks")
              .withColumn("picked", F.floor((F.col("words") - F.col("passes") * F.col("cell_size")) / block + 0.5))
              .withColumn("picked", F.least("picked", "blocks"))
              .withColumn("start", F.pmod(seeded(F.lit(seed), F.lit("start"), F.coalesce("_s", F.lit("")),
                                                 F.col("_h").cast("string")), F.col("blocks"))))
    order = Window.partitionBy("source", "shard").orderBy(
        seeded(F.lit(seed), F.lit("order"), F.col("doc_id").cast("string")), "doc_id", "text_md5")
    laid = (placed.withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .join(quotas, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_h")), "left"))

    def before(k: str) -> str:
        """How many of the first k blocks are picked."""
        return f"(({k}) * picked + start) div blocks"

    def inside(x: str) -> str:
        """Words of picked blocks among the first x words of the shard."""
        k = f"(({x}) div {block})"
        return f"({before(k)} * {block} + ({before(k + ' + 1')} - {before(k)}) * (({x}) % {block}))"

    taken = f"coalesce(passes * size + {inside('upto')} - {inside('upto - size')}, 0)"
    return laid.selectExpr("doc_id", "source", "size", "source_size", "target", f"CAST({taken} AS BIGINT) AS taken",
                           "text_md5")

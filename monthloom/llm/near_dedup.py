"""Near duplicates by MinHash bands, odd sketches and exact confirmation.

One pass over the texts hashes each document's shingles, takes ``BANDS * rows`` MinHash samples and folds the
same samples into an odd sketch: a bitmap holding, for every bit, the parity of the samples that fall on it.
The exclusive or of two sketches is the sketch of the samples that differ, and its population count gives
the similarity, precisely so where it is high. Equal sets fall together first. Band collisions link each
document with the smallest of its bucket; candidates whose sketches are too far apart are dropped and the rest
confirmed on the full sets. What is left are pairs of different components within a bucket. Small buckets
propose them directly; the members of large ones are compared in bounded blocks, each pair once and across
components only, sketch first and then full set, and only links leave the block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.llm.common import NULL_ID, frugal, id_key, ship, slices, utf8_view
from monthloom.llm.components import component_roots
from monthloom.llm.shingles import mix, shingle_sets
from monthloom.sources.store import cut_lineage

BANDS = 40
SKETCH_WORDS = 8  # 512 bits
BITS = SKETCH_WORDS * 64
#: A pair at the threshold shares no band with at most this probability.
MISSED = 1e-9
#: How far below the threshold a sketch's estimate may lie for the pair still to be confirmed exactly.
MARGIN = 0.25
CENTRE_SHARE = 256
#: Bytes of text hashed at once.
SLICE = 1 << 20
FILTER_BITS = 1 << 26
#: Larger buckets are compared in blocks of at most so many rows and shingles.
SMALL, BLOCK_ROWS, BLOCK_SHINGLES = 64, 4096, 500_000


def band_rows(percent: int) -> int:
    """The most MinHash values per band that keep misses below ``MISSED``."""
    t = percent / 100
    return max(r for r in range(1, 17) if r == 1 or (1 - t ** r) ** BANDS <= MISSED)


def sketch_distance(percent: int) -> int:
    """Population count at the threshold less the margin: estimate J = 1 + N/(4K) ln(1 - 2 count/N)."""
    samples = BANDS * band_rows(percent)
    return math.ceil(BITS / 2 * (1 - math.exp(-4 * samples * (1 - percent / 100 + MARGIN) / BITS)))


def _signatures(shingle: int, rows: int):
    samples = BANDS * rows
    rng = np.random.default_rng(7)
    factors = rng.integers(0, 1 << 62, samples, dtype=np.uint64) * np.uint64(4) + np.uint64(1)
    shifts = rng.integers(0, 1 << 63, samples, dtype=np.uint64)
    salts = mix(np.arange(1, samples + 1, dtype=np.uint64))
    bands = mix(np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(32))

    def sign(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        least = np.full(samples, np.iinfo(np.uint64).max)
        for at in range(0, len(hashes), 256):
            block = (hashes[at:at + 256, None] ^ shifts) * factors
            np.minimum(least, block.min(axis=0), out=least)
        values = mix(least ^ salts)
        keys = bands.copy()
        for column in values.reshape(BANDS, rows).T:
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + column)
        odd = np.bincount((values >> np.uint64(55)).astype(np.int64), minlength=BITS) & 1
        return keys.view(np.int64), np.packbits(odd.astype(np.uint8)).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                sizes, digests, keys, odds = [], [], [], []
                for s in shingle_sets(*utf8_view(part.column("text")), shingle):
                    sizes.append(len(s))
                    one = np.bitwise_xor.reduce(mix(s)) if len(s) else np.uint64(0)
                    two = np.add.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D))) if len(s) else np.uint64(0)
                    digests.append((one, two))
                    k, o = sign(s) if len(s) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                    keys.append(k)
                    odds.append(o)
                d = np.array(digests, np.uint64).view(np.int64).reshape(-1, 2)

                def lists(parts):
                    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
                    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("did"), pa.array(np.array(sizes, np.int64)), pa.array(d[:, 0]), pa.array(d[:, 1]),
                     lists(keys), lists(odds)], ["did", "n", "d1", "d2", "bands", "odd"])
    return run


def signatures(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``did, n, d1, d2, bands, odd`` per row: set size, set digest, band keys and odd sketch."""
    return docs.select(id_key().alias("did"), "text").mapInArrow(
        frugal(_signatures(shingle, band_rows(percent))), "did long, n long, d1 long, d2 long, bands array<long>, odd array<long>")


def _in_play(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``did, text`` of the documents whose id may be among ``ids`` (``did``): all that are, and few others.

    A bitmap of ``FILTER_BITS`` hashed ids, at most 8 MB whatever the input, is sent to all tasks, so that
    texts without any candidate need not be shuffled. With very many ids it lets all through, no more.
    """
    place = F.pmod(F.xxhash64("did"), F.lit(FILTER_BITS)) + 1
    number, position = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    bitmaps = cut_lineage(ids.groupBy(number.alias("part")).agg(F.bitmap_construct_agg(position).alias("bits")), "near-filter")
    byte = F.conv(F.hex(F.expr("substring(bits, CAST(at div 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    return (docs.select(id_key().alias("did"), "text").where(F.col("text").isNotNull())
            .withColumns({"part": number, "at": position}).join(F.broadcast(bitmaps), "part")
            .where(F.getbit(byte, (F.col("at") % 8).cast("int")) == 1).select("did", "text"))


def _confirm(shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, centres = None, []
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, centre, salt, role = (part.column(c).to_numpy().tolist() for c in ("did", "c", "salt", "role"))
                us, vs = [], []
                for i, s in enumerate(shingle_sets(*utf8_view(part.column("text")), shingle)):
                    if (centre[i], salt[i]) != group:
                        group, centres = (centre[i], salt[i]), []
                    if role[i] == 0:
                        centres.append(s)
                    else:
                        for other in centres:
                            common = np.intersect1d(s, other, assume_unique=True).size
                            if common and 100 * common >= percent * (len(s) + len(other) - common):
                                us.append(ids[i])
                                vs.append(centre[i])
                                break
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])
    return run


def confirmed(texts: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (``u, v``) whose full sets reach the threshold.

    The texts of ``u`` travel to ``v``, whose own text is sent once for each ``CENTRE_SHARE`` of them, so a
    frequent ``v`` is spread over tasks and a task holds one set of ``v`` at a time.
    """
    shares = pairs.groupBy("v").agg(F.ceil(F.count("*") / CENTRE_SHARE).cast("int").alias("shares"))
    members = pairs.join(shares, "v").select(
        F.col("u").alias("did"), F.col("v").alias("c"), F.pmod(F.xxhash64("u"), F.col("shares")).cast("int").alias("salt"),
        F.lit(1).alias("role"))
    centres = shares.select(F.col("v").alias("did"), F.col("v").alias("c"),
                            F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("salt"), F.lit(0).alias("role"))
    # one plan at every size: a broadcast of pairs would only do for few
    return (members.unionByName(centres).join(texts.hint("merge"), "did").repartition("c", "salt")
            .sortWithinPartitions("c", "salt", "role").mapInArrow(frugal(_confirm(shingle, percent)), "u long, v long")
            .distinct())


def _groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each key, from batches sorted by it."""
    held, key = [], None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in names], axis=1)
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)]):
            if held and tuple(keys[s]) != key:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(s, e - s))
            key = tuple(keys[s])
    if held:
        yield pa.Table.from_batches(held)


def _pairs(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])


def _sketches(rows: pa.Table) -> np.ndarray:
    return rows.column("odd").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH_WORDS)


def _propose(limit: int):
    """Pairs of a bucket in different components whose sketches are near enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for rows in _groups(batches, ("bk",)):
            ids, root, odd = rows.column("rep").to_numpy(), rows.column("root").to_numpy(), _sketches(rows)
            far = np.bitwise_count(odd[:, None, :] ^ odd[None, :, :]).sum(axis=2)
            i, j = np.nonzero(np.triu((far <= limit) & (root[:, None] != root[None, :]), 1))
            us.append(ids[i])
            vs.append(ids[j])
            if len(us) > 4096:
                yield _pairs(np.concatenate(us), np.concatenate(vs))
                us, vs = us[:1], vs[:1]
        yield _pairs(np.concatenate(us), np.concatenate(vs))
    return run


def _bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A row of bits for each set, over the hashes that more than one set holds."""
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, counts = np.unique(values, return_inverse=True, return_counts=True)
    shared = counts > 1
    column = (np.cumsum(shared) - 1)[place]
    keep = shared[place]
    bits = np.zeros((len(sets), int(shared.sum()) // 64 + 1), np.uint64)
    np.bitwise_or.at(bits, (owner[keep], column[keep] >> 6), np.uint64(1) << (column[keep] & 63).astype(np.uint64))
    return bits


def _compare(shingle: int, percent: int, limit: int):
    """Links between components within a block, or between two: one for each row and other component."""
    def links(rows: pa.Table) -> pa.RecordBatch:
        ids, root, side = (rows.column(c).to_numpy() for c in ("rep", "root", "side"))
        root, odd, us, vs = root.copy(), _sketches(rows), [], []
        sets = list(shingle_sets(*utf8_view(rows.column("text")), shingle))
        size, bits = np.array([len(s) for s in sets]), _bitmaps(sets)
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # side 2: a block against itself
        for i in left.tolist():
            rest = right[root[right] != root[i]]
            rest = rest[np.bitwise_count(odd[rest] ^ odd[i]).sum(axis=1) <= limit]
            common = np.bitwise_count(bits[rest] & bits[i]).sum(axis=1).astype(np.int64)
            rest = rest[100 * common >= percent * (size[rest] + size[i] - common)]
            for r in np.unique(root[rest]).tolist():
                us.append(ids[i])
                vs.append(ids[rest[root[rest] == r][0]])
                root[root == r] = root[i]
        return _pairs(np.array(us, np.int64), np.array(vs, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ("g", "p", "q")):
            yield links(rows)
    return run


def _left_over(texts: DataFrame, members: DataFrame, reps: DataFrame, roots: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links between different components of a bucket that its smallest member did not settle."""
    limit = sketch_distance(percent)
    rooted = (members.join(roots.select(F.col("u").alias("rep"), "root"), "rep", "left")
              .withColumn("root", F.coalesce("root", "rep")))
    open_keys = cut_lineage(
        rooted.groupBy("bk").agg(F.count("*").alias("size"), F.min("root").alias("a"), F.max("root").alias("b"))
        .where("a != b AND size > 2").select("bk", "size"), "near-open")
    open_rows = rooted.join(open_keys, "bk")
    small = (open_rows.where(F.col("size") <= SMALL).where("rep != c").select("bk", "rep", "root")
             .join(reps.select("rep", "odd"), "rep").repartition("bk").sortWithinPartitions("bk"))
    pairs = cut_lineage(small.mapInArrow(frugal(_propose(limit)), "u long, v long").distinct(), "near-proposed")
    links = confirmed(texts, pairs, shingle, percent)

    large = cut_lineage(open_rows.where(F.col("size") > SMALL).select("rep", "c", "root"), "near-large")
    if large.isEmpty():
        return links
    # rows that meet in any large bucket fall into one group, so each pair is compared once
    groups = component_roots(large.where("rep != c").select(F.col("rep").alias("u"), F.col("c").alias("v")).distinct())
    grouped = (large.select("rep", "root").distinct()
               .join(groups.select(F.col("u").alias("rep"), F.col("root").alias("g")), "rep", "left")
               .withColumn("g", F.coalesce("g", "rep")).join(reps.select("rep", "odd", "n"), "rep"))
    blocks = grouped.groupBy("g").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES))
                                      .cast("int").alias("blocks"))
    rows = (grouped.join(blocks, "g").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
            .join(texts.withColumnRenamed("did", "rep").hint("merge"), "rep")
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("g", "rep", "root", "odd", "text", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"),
                    F.expr("CASE WHEN block = other THEN 2 WHEN block < other THEN 0 ELSE 1 END").alias("side")))
    found = (rows.repartition("g", "p", "q").sortWithinPartitions("g", "p", "q")
             .mapInArrow(frugal(_compare(shingle, percent, limit)), "u long, v long"))
    return links.unionByName(found)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Two documents are linked where 100 * common shingles >= ``percent`` * shingles of either. ``component_id``
    is the smallest id reachable, ``kept`` marks it. Null, empty and blank texts are linked with nothing.
    Rows sharing an id are one document, linked by any of its texts. Rows without an id stay: their component
    is null. Only ``doc_id`` and ``text`` are read.
    """
    ship(docs.sparkSession)
    signed = cut_lineage(signatures(docs, shingle, percent), "near-signatures")
    live = signed.where(f"n > 0 AND did != {NULL_ID}")
    reps = cut_lineage(live.groupBy("d1", "d2").agg(F.min("did").alias("rep"), F.first("bands").alias("bands"),
                                                    F.first("odd").alias("odd"), F.first("n").alias("n")), "near-sets")
    banded = reps.select("rep", F.explode("bands").alias("bk"))
    shared = banded.groupBy("bk").agg(F.min("rep").alias("c"), F.count("*").alias("size")).where("size > 1")
    members = cut_lineage(banded.join(shared.drop("size"), "bk"), "near-members")
    sketches = reps.select("rep", "odd")
    limit = sketch_distance(percent)
    pairs = members.where("rep != c").select(F.col("rep").alias("u"), F.col("c").alias("v")).distinct()
    far = "aggregate(zip_with(a.odd, b.odd, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    near = (pairs.join(sketches.alias("a"), F.expr("u = a.rep")).join(sketches.alias("b"), F.expr("v = b.rep"))
            .where(F.expr(far) <= limit).select("u", "v"))
    texts = _in_play(docs, members.select(F.col("rep").alias("did")))
    links = cut_lineage(confirmed(texts, cut_lineage(near, "near-pairs"), shingle, percent), "near-links")
    # rows of one id with several texts, and sets already known equal
    same = live.join(reps.select("d1", "d2", "rep"), ["d1", "d2"]).select("did", "n", "d1", "d2", "rep")
    owners = cut_lineage(same, "near-owners")
    split = (owners.groupBy("did").agg(F.min("rep").alias("v"), F.max("rep").alias("u")).where("u != v")
             .select("u", "v"))
    links = links.unionByName(split)
    roots = component_roots(links)
    more = cut_lineage(_left_over(texts, members, reps, roots, shingle, percent), "near-left-over")
    if not more.isEmpty():
        roots = component_roots(roots.select("u", F.col("root").alias("v")).unionByName(more))
    placed = (owners.join(roots.select(F.col("u").alias("rep"), "root"), "rep", "left")
              .select("did", "n", F.coalesce("root", "rep").alias("component_id")))
    alone = signed.where(f"n = 0 OR did = {NULL_ID}").select("did", "n", F.col("did").alias("component_id"))

    def id_of(c: str):
        return F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
    return (placed.unionByName(alone)
            .select(id_of("did").alias("doc_id"), F.col("n").alias("n_shingles"), id_of("component_id"),
                    (F.col("did") == F.col("component_id")).alias("kept")))

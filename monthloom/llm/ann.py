"""Nearest vectors by cosine along several shifted Hilbert curves.

Each curve orders unit vectors by the Hilbert key of a random projection with a random shift. Quantiles of its
keys cut a curve into slabs of equally many rows. Every row lies in one slab of each curve; a query is compared
with the slabs within its window on every curve, the best of each are merged and ranked by the exact cosine.
Windows are a share of the curve, so recall does not fall as the table grows; slabs and queries are split into
parts of bounded size, so a task holds two blocks at a time, also where very many vectors are alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from monthloom.llm.common import ship
from monthloom.sources.store import cut_lineage

CURVES, DIMS, BITS = 8, 4, 10
#: A curve has so many slabs, each of at least ``LEAST_ROWS`` rows; a window is a query's slab and so many on each side.
SLABS, SIDE, LEAST_ROWS = 40, 4, 256
PART_ROWS, PART_QUERIES = 20_000, 5_000


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of each row of ``cells`` (integers below 2**bits)."""
    x = cells.astype(np.int64).T.copy()
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:  # undo the turns of each level, from the coarsest
        for i in range(n):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(turned, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), top
    while q > 1:
        flip ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | x[i] >> b & 1
    return key


def _curves(length: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Projection and shift of each curve; projections are orthogonal as long as dimensions last."""
    rng, made, basis = np.random.default_rng(seed), [], np.zeros((length, 0))
    dims = min(DIMS, length)
    for _ in range(CURVES):
        if basis.shape[1] < dims:
            basis = np.linalg.qr(rng.normal(size=(length, length)))[0]
        made.append((basis[:, :dims] * np.sqrt(length), rng.uniform(-0.1, 0.1, dims)))
        basis = basis[:, dims:]
    return made


def _units(vectors: pa.Array, length: int) -> np.ndarray:
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=1e-300)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _keys(length: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        curves = _curves(length, seed)
        for batch in batches:
            unit = _units(batch.column("vec"), length)
            keys = np.empty((len(unit), CURVES), np.int64)
            for c, (project, shift) in enumerate(curves):
                spread = np.clip(unit @ project / 6 + 0.5 + shift, 0, 1 - 1e-9)
                keys[:, c] = hilbert_keys((spread * (1 << BITS)).astype(np.int64), BITS)
            ends = pa.array(np.arange(len(unit) + 1) * CURVES, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vec"),
                                              pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))], ["vec_id", "vec", "keys"])
    return run


def _running_sum(x: np.ndarray) -> np.ndarray:
    """Row sums added strictly from left to right, so that equal rows have equal sums anywhere."""
    return np.cumsum(x, axis=1)[:, -1]


def _compare(length: int, k: int):
    def run(key, queries: pa.Table, rows: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if queries.num_rows == 0 or rows.num_rows == 0:
            return none
        ids, asked = rows.column("vec_id").to_numpy(), queries.column("q_vec_id").to_numpy()
        vectors, wanted = rows.column("vec").combine_chunks(), queries.column("q_vec").combine_chunks()
        unit, aim = _units(vectors, length), _units(wanted, length)
        x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)
        q = wanted.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)
        x_norm, q_norm = np.sqrt(_running_sum(x * x)), np.sqrt(_running_sum(q * q))
        out = []
        for at in range(0, len(aim), 128):
            near = aim[at:at + 128] @ unit.T
            near[asked[at:at + 128, None] == ids[None, :]] = -2
            for i, row in enumerate(near):
                if len(row) > k:
                    least = np.partition(row, len(row) - k)[len(row) - k] - 1e-12
                    hit = np.flatnonzero((row >= least) & (row > -1.5))
                else:
                    hit = np.flatnonzero(row > -1.5)
                score = _running_sum(x[hit] * q[at + i]) / (x_norm[hit] * q_norm[at + i])
                best = np.lexsort((ids[hit], -score))[:k]
                out.append((np.full(len(best), asked[at + i]), ids[hit][best], score[best]))
        return pa.table(dict(zip(none.column_names, map(np.concatenate, zip(*out))))) if out else none
    return run


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, and every component a finite number."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
            seed: int = 11) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for every query row, but itself.

    Score is the cosine in double precision; ties go to the smaller id. Rows without an id, unusable vectors
    and vectors of another length than the most common one (of equally common ones, the longest) take no
    part. Rows sharing an id are one vector at the best of their scores. With fewer than k candidates all are
    returned; a table without usable vectors gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    good = (vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vec"), is_query.alias("asks"))
            .where(F.col("vec_id").isNotNull() & usable(F.col("vec"))))
    lengths = good.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    length, total = (lengths.n, lengths["count"]) if lengths else (1, 0)
    kept = good.where(F.size("vec") == length).select("vec_id", "vec")
    element = kept.schema["vec"].dataType.simpleString()
    keyed = cut_lineage(kept.mapInArrow(_keys(length, seed), f"vec_id long, vec {element}, keys array<long>"), "ann-keys")

    slabs = max(1, min(SLABS, total // LEAST_ROWS))
    shares = [i / slabs for i in range(1, slabs)]
    cuts = keyed.agg(*[F.percentile_approx(F.col("keys")[c], shares or [0.5], 10_000).alias(f"c{c}") for c in range(CURVES)]).first()
    table = [[int(v) for v in (cuts[c] or [])] if shares else [] for c in range(CURVES)]

    def slab(c: int) -> Column:
        passed = F.filter(F.array(*map(F.lit, table[c])).cast("array<bigint>"), lambda v: v < F.col("keys")[c])
        return F.size(passed) if table[c] else F.lit(0)
    places = F.array(*[F.struct(F.lit(c).alias("curve"), slab(c).alias("slab")) for c in range(CURVES)])
    rows = keyed.select("vec_id", "vec", F.inline(places))
    queries = (keyed.join(good.where("asks").select("vec_id").distinct(), "vec_id", "left_semi")
               .select("vec_id", "vec", F.inline(places))
               .withColumn("slab", F.explode(F.sequence(F.greatest(F.col("slab") - SIDE, F.lit(0)),
                                                        F.least(F.col("slab") + SIDE, F.lit(slabs - 1))))))
    # at most CURVES * SLABS rows each
    row_parts = rows.groupBy("curve", "slab").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    query_parts = queries.groupBy("curve", "slab").agg(F.ceil(F.count("*") / PART_QUERIES).cast("int").alias("asks"))
    sizes = F.broadcast(row_parts.join(F.broadcast(query_parts), ["curve", "slab"]))

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def own(n: str) -> Column:
        return F.pmod(F.xxhash64("vec_id", F.lit("part")), F.col(n)).cast("int")
    key = ["curve", "slab", "part", "ask"]
    left = queries.join(sizes, ["curve", "slab"]).withColumn("ask", own("asks")).withColumn("part", every("parts"))
    right = rows.join(sizes, ["curve", "slab"]).withColumn("part", own("parts")).withColumn("ask", every("asks"))
    asking = left.select(*key, "vec_id", "vec").toDF(*[f"q_{c}" for c in (*key, "vec_id", "vec")])
    found = (asking.groupBy(*[f"q_{c}" for c in key]).cogroup(right.select(*key, "vec_id", "vec").groupBy(*key))
             .applyInArrow(_compare(length, k), "query_id long, vec_id long, score double"))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))

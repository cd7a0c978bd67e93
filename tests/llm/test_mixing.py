import collections

import pytest
from pyspark.sql import functions as F

from monthloom.llm.mixing import apportion, mix_sources


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = sum(weight[s] for s in sizes if s not in capped)
        over = {s for s in sizes if s not in capped and rest * weight[s] / free >= most * sizes[s]} if free else set()
        if not over:
            return {s: most * sizes[s] if s in capped else rest * weight[s] / free for s in sizes}
        capped |= over


@pytest.mark.parametrize("which", ["odd", "clashing", "small", "none"])
def test_targets_and_caps(which, request):
    rows = mix_sources(request.getfixturevalue(which)).collect()
    sizes, taken = collections.Counter(), collections.Counter()
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r["size"]
    if rows:
        target = brute_targets(sizes)
        for r in rows:
            assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        for s in sizes:
            assert abs(taken[s] - target[s]) <= max(2, 0.02 * target[s])


def test_reruns_agree(small):
    a, b = (sorted(map(tuple, mix_sources(small.repartition(n)).collect())) for n in (3, 7))
    assert a == b


def test_quotas_are_the_highest_quotients(spark):
    votes = [("a", 0, 53.0), ("a", 1, 24.0), ("b", 0, 23.0), (None, 0, 0.5), ("b", 1, 24.0)]
    for seats in (0, 1, 2, 7, 50, 1001):
        cells = spark.createDataFrame(votes, "source string, shard long, votes double")
        got = {(r.source, r.shard): r.quota for r in apportion(cells, seats).collect()}
        quotients = sorted(((-v / (2 * k + 1), s is None, s or "", h, s) for s, h, v in votes for k in range(seats)))[:seats]
        want = collections.Counter((q[4], q[3]) for q in quotients)
        assert got == {(s, h): want[(s, h)] for s, h, _ in votes}


def test_shards_hold_a_hot_source(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("w x y z v").alias("text"), F.lit("hot").alias("source"))
    rows = rows.unionByName(spark.range(3000, 3300).select(F.col("id").alias("doc_id"), F.lit("p q r").alias("text"), F.lit("cold").alias("source")))
    got = {r.source: (r.taken, r.target) for r in mix_sources(rows, shard_docs=100).groupBy("source").agg(
        F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()}
    for taken, target in got.values():
        assert taken == pytest.approx(target, rel=0.01)


@pytest.mark.parametrize("shard_docs", [2, 10])
def test_very_many_shards_keep_every_target(spark, shard_docs):
    docs = spark.range(12_000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7 + 20).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, "s01").otherwise(F.format_string("s%02d", F.pmod(F.xxhash64("id"), F.lit(20)))).alias("source"))
    rows = mix_sources(docs, shard_docs=shard_docs, least_blocks=16).groupBy("source").agg(
        F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") / F.col("size")).alias("most")).collect()
    assert len(rows) == 20
    for r in rows:
        assert r.taken == pytest.approx(r.target, rel=0.02) and r.most <= 3

import numpy as np
import pytest
from pyspark.sql import functions as F

from monthloom.llm.ann import hilbert_keys, nearest


def brute(rows, k=5, every=50):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    out = []
    for q in (i for i in good if i % every == 0):
        scored = sorted((-(good[q] @ v) / np.linalg.norm(good[q]) / np.linalg.norm(v), i) for i, v in good.items() if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def found(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in nearest(df, F.col("vec_id") % 50 == 0).collect())


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype("float32").tolist()) for i in range(200)]
    rows += [(300, None), (350, [0.0] * 8), (400, [float("nan")] * 8), (450, [None] + [1.0] * 7), (500, [float("inf")] + [0.0] * 7), (550, []),
             (None, [1.0] * 8)]
    rows += [(600 + i, rows[0][1]) for i in range(9)]  # ties
    got, want = found(frame(spark, rows)), brute(rows)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-12)


def test_few_and_none(spark):
    assert found(frame(spark, [])) == []
    assert found(frame(spark, [(0, [1.0, 0.0])])) == []
    assert [r[2] for r in found(frame(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])]))] == [1, 2]
    assert len(found(frame(spark, [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 1.0])]))) == 1


def test_recall(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 64))
    vectors = base[rng.integers(0, 60, 12_000)] + 2 * rng.normal(size=(12_000, 64))
    vectors[4000:8000] = vectors[4000] + 1e-3 * rng.normal(size=(4000, 64))  # a third all but alike
    rows = [(i, v) for i, v in enumerate(vectors.astype("float32").tolist())]
    got = {(r[0], r[2]) for r in found(frame(spark, rows))}
    unit = np.array([r[1] for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, 12_000, 50):
        score = unit @ unit[q]
        score[q] = -2
        best = np.argsort(-score)[:5]
        hits, total = hits + sum((q, int(i)) in got for i in best), total + 5
    assert hits >= 0.9 * total


@pytest.mark.parametrize("dims", [2, 3])
def test_neighbours_on_the_curve_are_neighbours(dims):
    bits = 3
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()

import numpy as np
import pytest

from monthloom.llm.whitening import inertia_above, interval_for, leading_components, whiten

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(vectors):
    x = np.floor(np.array(vectors, float) * 1024).astype(np.int64) + 100_000
    n, total = len(x), x.sum(axis=0)
    centred = x - total / n
    values, components = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    return x, n, total, values[order], components[:, order], centred


def matrices():
    rng = np.random.default_rng(1)
    for size in (1, 2, 3, 8, 30, 64):
        for kind in range(6):
            q, _ = np.linalg.qr(rng.standard_normal((size, size)))
            values = {0: rng.random(size) * 100, 1: np.r_[np.full(size // 2, 5.0), np.linspace(1, 4, size - size // 2)],
                      2: np.r_[1e6, np.full(size - 1, 1e-3)], 3: np.r_[np.linspace(1, 2, (size + 1) // 2), np.zeros(size // 2)],
                      4: np.r_[2e5, np.linspace(16_000, 16_600, size - 1)], 5: np.r_[1e8, 1 + 1e-3 * rng.random(size - 1)]}[kind]
            yield (q * values) @ q.T, np.sort(values)[::-1]


def test_inertia_counts_eigenvalues():
    for matrix, values in matrices():
        for a, b in zip(values[:-1], values[1:]):
            if a - b > 1e-9 * values[0]:
                assert inertia_above(matrix, (a + b) / 2) == (values > (a + b) / 2).sum()
        assert inertia_above(matrix, values[0] * 1.01) == 0 and inertia_above(matrix, -1.0) == len(matrix)


def test_no_component_is_missed():
    for matrix, values in matrices():
        for wanted in (1, 3, 8):
            low, high, count = interval_for(matrix, min(wanted, len(matrix)))
            assert count >= min(wanted, len(matrix)) and count == ((values > low) & (values <= high)).sum()
            found, vectors = leading_components(matrix, wanted)
            want = values[:wanted][values[:wanted] > 1e-13 * values.sum()]
            assert np.allclose(found, want, rtol=1e-10, atol=1e-12 * values[0])
            assert np.abs(vectors.T @ vectors - np.eye(len(found))).max(initial=0) < 1e-12
            assert np.abs(matrix @ vectors - vectors * found).max(initial=0) < 1e-12 * values[0] * len(matrix)


def test_against_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = {r.vec_id: r.embedding for r in table.collect()}
    ids = sorted(rows)
    x, n, total, values, components, centred = brute([rows[i] for i in ids])
    got = {(r.vec_id, r.component): r for r in whiten(table).collect()}
    assert set(got) == {(i, c) for i in ids for c in range(1, 9)}
    for c in range(1, 9):
        mine = np.array([got[i, c].whitened for i in ids])
        want = centred @ components[:, c - 1] / np.sqrt(values[c - 1])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-7
        assert abs(got[ids[0], c].explained / (values[c - 1] / values.sum()) - 1) < 1e-9
    for k, i in enumerate(ids):
        r = got[i, 1]
        assert r.n == n and r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[k], total))
        assert r.identity_error < 1e-8


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 3), float(i % 5), 0.5 * i]) for i in range(20)]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [nan, 1.0, 1.0]), (103, [inf, 0.0, 0.0]), (104, [1.0, -inf, 0.0])]
    twice = [good[3], (None, [1.0, 2.0, 3.0]), (200, []), (201, [4.0])]
    df = spark.createDataFrame([(i, v, None) for i, v in good + bad + twice], SCHEMA)
    for extra in (df, df.selectExpr("*", "'x' AS component", "'y' AS n", "'z' AS v")):
        got = whiten(extra).collect()
        assert sorted({(r.vec_id is None, r.vec_id or 0) for r in got}) == [(False, i) for i in [*range(20), 200, 201]] + [(True, 0)]
        assert len(got) == 24 * 3 and {r.n for r in got} == {24}
        assert {r.component for r in got} == {1, 2, 3} and all(r.identity_error < 1e-9 for r in got)
    _, _, _, values, components, centred = brute([v + [0.0] * (3 - len(v)) for _, v in good + twice])
    mine = {r.vec_id: r.whitened for r in got if r.component == 1}
    want = centred[:, 0:3] @ components[:, 0] / np.sqrt(values[0])
    assert min(max(abs(s * mine[i] - want[i]) for i in range(20)) for s in (1, -1)) < 1e-9


def test_nothing_to_scale(spark):
    assert whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    same = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(5)], SCHEMA)
    assert whiten(same).collect() == []
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0], 0) for i in range(5)], SCHEMA)
    assert {r.component for r in whiten(line).collect()} == {1}
    with pytest.raises(ValueError):
        whiten(spark.createDataFrame([(1, [1e30], 0)], SCHEMA))

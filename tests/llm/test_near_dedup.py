import random
import re
import string

import pytest

import numpy as np
import pyarrow as pa
from monthloom.llm import near_dedup
from monthloom.llm.common import utf8_view
from monthloom.llm.components import component_roots
from monthloom.llm.near_dedup import near_duplicates
from monthloom.llm.shingles import shingle_sets

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)}


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    ids = sorted({i for i, _ in rows if i is not None})
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a in range(len(rows)):
        for b in range(a):
            i, j = rows[a][0], rows[b][0]
            if i is None or j is None or i == j:
                continue
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    out = []
    for (i, _), s in zip(rows, sets):
        c = None if i is None else find(i)
        out.append((i, len(s), c, c == i if i is not None else True))
    return sorted(out, key=repr)


def check(df, k, percent):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, k, percent).collect()), key=repr)
    assert got == brute(rows, k, percent)


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_odd(odd, none, clashing, k, percent):
    check(odd, k, percent)
    check(none, k, percent)
    check(clashing, k, percent)


def test_documents(small):
    check(small, 3, 85)


def near_copies(n, words, edits, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(4000)}" for _ in range(words)]
    rows = []
    for i in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits)):
            copy[rng.randrange(words)] = f"e{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(copy)))
    return rows


@pytest.mark.parametrize("small_bucket", [64, 4])
def test_group_of_near_copies(spark, monkeypatch, small_bucket):
    """Copies that are linked only over others; with few rows a block, they meet across blocks."""
    monkeypatch.setattr(near_dedup, "SMALL", small_bucket)
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 16)
    monkeypatch.setattr(near_dedup, "CENTRE_SHARE", 8)
    check(spark.createDataFrame(near_copies(150, 120, 9, 1), "doc_id long, text string"), 3, 85)


def test_sketch_estimates():
    rng = np.random.default_rng(1)
    sign = near_dedup._signatures(3, 5)
    rows = []
    for same in (50, 85, 95):
        base = rng.integers(0, 10 ** 9, 1000)
        other = base.copy()
        other[:round(1000 * (1 - 2 * same / (100 + same)) + 0.5)] += 10 ** 9
        rows += [" ".join(map(str, base)), " ".join(map(str, other))]
    # single-word shingles would need another operator: compare true set similarity with the estimate
    batch = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array(rows)], ["did", "text"])
    odd = [np.array(v, np.int64).view(np.uint64) for v in next(sign([batch])).column("odd").to_pylist()]
    sets = list(shingle_sets(*utf8_view(pa.array(rows)), 3))
    for i in (0, 2, 4):
        true = np.intersect1d(sets[i], sets[i + 1]).size / np.union1d(sets[i], sets[i + 1]).size
        count = int(np.bitwise_count(odd[i] ^ odd[i + 1]).sum())
        estimate = 1 + 512 / (4 * 200) * np.log(max(1e-9, 1 - 2 * count / 512))
        assert abs(estimate - true) < 0.15


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (105, 101), (7, 7)]
    got = {r.u: r.root for r in component_roots(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 105: 100}

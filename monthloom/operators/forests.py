"""Deep random forests, grown where their rows are.

Rows become bins, at most ``BINS`` a feature. Nodes of more than ``MOST`` rows are split level by level: every task
counts its rows by tree, node, feature and bin, the counts add up by node, and only the chosen splits reach the driver,
about one for each ``MOST`` rows. Below them each node's rows meet in one group, which grows the whole subtree and
sends the rows to be predicted down it; a round of trees at a time, so that the copies of the rows on disk do not grow with the
number of trees. Up to ``READ * MOST`` rows nothing is copied: a task reads the stored bins and grows some trees. No grown tree leaves its task: what leaves are the sums of the trees' votes, by row.

Splits follow Spark's forests: bootstrap weights from a Poisson distribution, weighted variance (twice of which is the
Gini impurity of 0/1 labels), features tried anew for each node, a leaf where no split gains. Weights and tried features
come from hashes of row, tree and node, so a forest does not depend on how rows lie, and its first trees are a forest too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.sources.store import cut_lineage, discard, remove, scratch_path

BINS = 32
#: Rows of a node that one task grows to the end, and bytes of their bins.
MOST, MOST_BYTES = 1 << 20, 1 << 27
#: A task that reads the stored bins itself, as plain arrays, has room for so many times as many rows.
READ = 4
#: Gains below this share of the labels' squares are rounding.
LEAST_GAIN = 1e-10
#: Scores this close, by share, are equal: the first feature and bin count, in whatever order numbers were added.
EQUAL = 1e-10
#: Rows a node from which counting by bin is quicker than sorting.
DENSE = 16
#: Rows whose subtree is grown at a time, so that they stay in the processor's cache.
PART = 1 << 16
_DRAWN = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)])


def _mix(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def _salt(*numbers: int) -> np.ndarray:
    h = np.zeros(1, np.uint64)
    for n in numbers:
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + np.array([n & (1 << 64) - 1], np.uint64))
    return h


def draws(key: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree's bootstrap sample holds each row: Poisson with mean 1."""
    found, salt = np.empty(len(key)), _salt(seed, tree)
    for i in range(0, len(key), PART):
        share = (_mix(key[i:i + PART] ^ salt) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        found[i:i + PART] = np.searchsorted(_DRAWN, share, side="right")
    return found


def tried(nodes: np.ndarray, k: int, n: int, tree: int, seed: int) -> np.ndarray:
    """The ``n`` of ``k`` features each node may split by, as a row of flags."""
    if n >= k:
        return np.ones((len(nodes), k), bool)
    order = _mix(_mix(nodes ^ _salt(seed, tree, 1))[:, None] + np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    flags = np.zeros((len(nodes), k), bool)
    np.put_along_axis(flags, np.argpartition(order, n - 1, axis=1)[:, :n], True, axis=1)
    return flags


# ---- bins ----------------------------------------------------------------------------------


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By feature the distinct values of a partition, or null if more than ``BINS``."""
    seen: dict[int, np.ndarray | None] = {}
    for batch in batches:
        values = _matrix(batch.column("inputs"))
        for f in range(values.shape[1]):
            if seen.get(f, True) is not None:
                own = np.unique(np.r_[seen.get(f, values[:0, f]), values[:, f]])
                seen[f] = own if len(own) <= BINS else None
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.list_(pa.float64()))], ["f", "v"])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def bin_edges(train: DataFrame) -> list[np.ndarray]:
    """Greatest values of all bins but the last, by place in the array ``inputs``: all distinct values if there are
    at most ``BINS``, else quantiles of all rows."""
    distinct = train.select("inputs").mapInArrow(_distinct, "f int, v array<double>").groupBy("f").agg(
        F.max(F.col("v").isNull()).alias("many"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("v")))).alias("v"))  # BINS a task
    few = {r["f"]: r["v"] for r in distinct.select(
        "f", F.when(~F.col("many") & (F.size("v") <= BINS), F.col("v")).alias("v")).collect()}
    shares = [i / BINS for i in range(BINS + 1)]
    wide = [f for f, v in few.items() if v is None]
    cuts = (train.select(F.posexplode("inputs").alias("f", "x")).where(F.col("f").isin(wide)).groupBy("f")
            .agg(F.percentile_approx("x", shares, 10000).alias("v"))) if wide else None
    few |= {r["f"]: r["v"] for r in cuts.collect()} if wide else {}
    return [np.unique(few[f])[:-1][-(BINS - 1):] for f in range(len(few))]


def binned(rows: DataFrame, edges: Sequence[np.ndarray]) -> DataFrame:
    """Stored ``row, key, label, scored, bins``: a byte for each feature."""
    def run(batches):
        for batch in batches:
            values = _matrix(batch.column("inputs"))
            out = np.zeros((len(values), len(edges)), np.uint8)
            for f, cuts in enumerate(edges):
                if len(values):
                    out[:, f] = np.searchsorted(cuts, values[:, f])
            ends = np.arange(len(out) + 1, dtype=np.int32) * len(edges)
            data = pa.Array.from_buffers(pa.binary(), len(out), [None, pa.py_buffer(ends), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "key", "label", "scored")), data],
                                             ["row", "key", "label", "scored", "bins"])
    return cut_lineage(rows.mapInArrow(run, "row long, key long, label double, scored boolean, bins binary"), "forest-bins")


def _bins(column: pa.Array | pa.ChunkedArray, k: int) -> np.ndarray:
    """A row for each feature."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = [np.frombuffer(c.buffers()[2], np.uint8)[np.frombuffer(c.buffers()[1], np.int32)[c.offset]:][:len(c) * k].reshape(-1, k)
             for c in chunks if len(c)]
    return np.ascontiguousarray(np.concatenate(parts).T) if parts else np.zeros((k, 0), np.uint8)


def _numbers(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def alike(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """A row for each set of rows with the same bins, and the set of every row; None if most rows differ."""
    k, n = bins.shape
    if not k or not n or k * 5 > 63:  # a bin takes 5 bits
        return None
    packed = np.zeros(n, np.int64)
    for own in bins:
        packed = packed * BINS + own
    _, first, own = np.unique(packed, return_index=True, return_inverse=True)
    return (first, own) if 2 * len(first) <= n else None


# ---- splits --------------------------------------------------------------------------------


def _gains(lw, ly, tw, ty):
    """Sum over both sides of squared label sums by weight; -inf where a side is empty."""
    with np.errstate(divide="ignore", invalid="ignore"):
        score = ly * ly / lw + (ty - ly) ** 2 / (tw - lw)
    return np.where((lw > 0) & (lw < tw), score, -np.inf)


def split_counts(hw: np.ndarray, hy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best score of each node and the last bin of its left side, from weights and label sums by bin (``nodes, BINS``)."""
    lw, ly = hw.cumsum(1), hy.cumsum(1)
    score = _gains(lw[:, :-1], ly[:, :-1], lw[:, -1:], ly[:, -1:])
    top = score.max(1)
    return top, (score >= (top - EQUAL * np.abs(top))[:, None]).argmax(1)


class _Sorter:
    """The same from single rows of ``m`` nodes with few of them, which come sorted by node; what does not depend on the
    feature is found once."""

    def __init__(self, node, w, wy, tw, ty, m):
        self.node, self.w, self.wy, self.tw, self.ty, self.m = node, w, wy, tw, ty, m
        self.bits = np.int64(max(1, len(node)).bit_length())
        self.base = (node * BINS << self.bits) | np.arange(len(node))
        self.within = node[1:] == node[:-1]
        self.first = np.flatnonzero(np.r_[True, ~self.within])

    def split(self, cell) -> tuple[np.ndarray, np.ndarray]:
        """-inf for nodes without two bins."""
        best, cut = np.full(self.m, -np.inf), np.zeros(self.m, np.int64)
        packed = np.sort(self.base + (cell.astype(np.int64) << self.bits))
        place, cell = packed & ((np.int64(1) << self.bits) - 1), packed >> self.bits
        at = np.flatnonzero((cell[1:] != cell[:-1]) & self.within)
        if len(at):
            cw, cy = np.cumsum(self.w.take(place)), np.cumsum(self.wy.take(place))
            owner, ends = self.node.take(at), self.first[1:] - 1
            lw, ly = cw.take(at) - np.r_[0, cw.take(ends)].take(owner), cy.take(at) - np.r_[0, cy.take(ends)].take(owner)
            score = _gains(lw, ly, self.tw.take(owner), self.ty.take(owner))
            begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            top = np.maximum.reduceat(score, begin)
            hit = np.flatnonzero(score >= np.repeat(top - EQUAL * top, np.diff(np.r_[begin, len(owner)])))[::-1]
            best[owner[begin]] = top
            cut[owner[hit]] = cell.take(at.take(hit)) & (BINS - 1)
        return best, cut


def grow(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, root: int, max_depth: int, n_tried: int, tree: int,
         seed: int, square: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """A tree over the rows of positive weight: ``feature`` (-1: leaf), ``cut``, ``child``, ``value`` by node. Nodes of more
    than ``PART`` rows are split one by one. ``root`` is the place of its first node in the whole tree, children of i being 2 i and 2 i + 1. A row may stand
    for several with the same bins, by the mean of their labels; ``square`` is then the mean of the labels' squares."""
    k, made, found = len(bins), 1, []

    def squared(rows):
        return label[rows] ** 2 if square is None else square[rows]

    def split_one(node, rows):
        """The node of many rows, a part of them at a time: feature, last bin of the left side, value."""
        parts, sums = [rows[i:i + PART] for i in range(0, len(rows), PART)], np.zeros(3)
        for part in parts:
            w = weight[part]
            sums += w.sum(), (w * label[part]).sum(), (w * squared(part)).sum()
        parent, floor = sums[1] ** 2 / sums[0], LEAST_GAIN * sums[2]
        top, feature, cut = parent + floor, -1, 0
        if node.bit_length() - 1 < max_depth and sums[2] - parent > floor:
            choice = np.flatnonzero(tried(np.array([node], np.uint64), k, n_tried, tree, seed)[0])
            counts = np.zeros((2, len(choice), BINS))
            for part in parts:
                w = weight[part]
                wy = w * label[part]
                for j, f in enumerate(choice):
                    b = bins[f].take(part)
                    counts[0, j] += np.bincount(b, w, BINS)
                    counts[1, j] += np.bincount(b, wy, BINS)
            for f, score, place in zip(choice, *split_counts(*counts)):
                if score > top + EQUAL * top:
                    top, feature, cut = score, f, place
        return feature, cut, sums[1] / sums[0]

    def keep(ids, feature, cut, child, value):
        found.append((ids.astype(np.int32), feature.astype(np.int16), cut.astype(np.uint8), child.astype(np.int32), value))
    # what is still to do: a node's rows, its place and its number
    todo = [(np.flatnonzero(weight).astype(np.int32), root, 0)]
    while todo:
        rows, node, number = todo.pop()
        if len(rows) <= PART:
            made = _grow_few(*(np.ascontiguousarray(x) for x in (bins[:, rows], label[rows], weight[rows], squared(rows))),
                             node, number, made, max_depth, n_tried, tree, seed, keep)
            continue
        feature, cut, value = split_one(node, rows)
        keep(*(np.array([x]) for x in (number, feature, cut, made if feature >= 0 else 0, value)))
        if feature >= 0:
            right = bins[feature].take(rows) > cut
            todo += (rows[~right], 2 * node, made), (rows[right], 2 * node + 1, made + 1)
            made += 2
    out = {name: np.empty(made, kind) for name, kind in (("feature", np.int16), ("cut", np.uint8), ("child", np.int32), ("value", np.float64))}
    while found:
        ids, *parts = found.pop()
        for name, part in zip(out, parts):
            out[name][ids] = part
    return out


def _grow_few(bins, label, weight, square, node, number, made, max_depth, n_tried, tree, seed, keep) -> int:
    """The subtree of a node of few rows, level by level, handed to ``keep``; returns the number of nodes made so far."""
    k, rows, at, level = len(bins), np.arange(len(label)), np.zeros(len(label), np.int64), node.bit_length() - 1
    nodes, ids = np.array([node], np.uint64), np.array([number])
    cells = np.ascontiguousarray(bins.T).ravel() if n_tried < k else None
    while len(nodes):
        m = len(nodes)
        w = weight[rows]
        wy = w * label[rows]
        tw, ty, squares = (np.bincount(at, x, m) for x in (w, wy, w * square[rows]))
        parent, floor = ty * ty / tw, LEAST_GAIN * squares
        best, feature, cut = parent + floor, np.full(m, -1), np.zeros(m, np.int64)
        impure = squares - parent > floor
        if level < max_depth and impure.any():
            kept = np.flatnonzero(impure)
            mine = impure[at]
            r, rw, ry = rows[mine], w[mine], wy[mine]
            a, n = (np.cumsum(impure) - 1)[at[mine]], len(kept)  # every kept node has rows
            top, which, where = best[kept], feature[kept], cut[kept]
            dense = len(r) >= DENSE * m
            sorter, base = None if dense else _Sorter(a, rw, ry, tw[kept], ty[kept], n), a * BINS
            # the features a node tries, first to last; what it doesn't try is not counted
            choice = np.nonzero(tried(nodes[kept], k, n_tried, tree, seed))[1].reshape(n, -1)
            for j in range(choice.shape[1]):
                own = choice[:, j]
                b = bins[j].take(r) if cells is None else cells.take(r * k + own.take(a))
                if dense:
                    cell = base + b
                    score, place = split_counts(np.bincount(cell, rw, n * BINS).reshape(n, BINS), np.bincount(cell, ry, n * BINS).reshape(n, BINS))
                else:
                    score, place = sorter.split(b)
                better = score > top + EQUAL * top
                top, which, where = np.where(better, score, top), np.where(better, own, which), np.where(better, place, where)
            best[kept], feature[kept], cut[kept] = top, which, where
        split = feature >= 0
        keep(ids, feature, cut, np.where(split, made + 2 * (np.cumsum(split) - 1), 0), ty / tw)
        inner = split[at]
        rows, at = rows[inner], at[inner]
        at = 2 * (np.cumsum(split) - 1)[at] + (bins[feature[at], rows] > cut[at])
        order = np.argsort(at, kind="stable")
        rows, at = rows[order], at[order]
        nodes = np.repeat(nodes[split] * np.uint64(2), 2) + np.tile(np.array([0, 1], np.uint64), int(split.sum()))
        ids = np.arange(made, made + len(nodes))
        made += len(nodes)
        level += 1
    return made


def descend(tree: dict[str, np.ndarray], bins: np.ndarray) -> np.ndarray:
    """The value of the leaf each row ends in."""
    at, rows = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
    while len(rows):
        node = at[rows]
        rows, node = (x[tree["feature"][node] >= 0] for x in (rows, node))
        at[rows] = tree["child"][node] + (bins[tree["feature"][node], rows] > tree["cut"][node])
    return tree["value"][at]


class Upper:
    """The split nodes of a tree from its root, by place, and leaves among them with their value."""

    def __init__(self):
        self.splits: dict[int, tuple[int, int]] = {}
        self.leaves: dict[int, float] = {}

    def places(self, bins: np.ndarray) -> np.ndarray:
        """The place below all splits that each row comes to."""
        at = np.ones(bins.shape[1], np.uint64)
        if not self.splits:
            return at
        known = np.array(sorted(self.splits), np.uint64)
        feature, cut = np.array([self.splits[int(i)] for i in known]).T
        rows = np.arange(len(at))
        while len(rows):
            i = np.minimum(np.searchsorted(known, at[rows]), len(known) - 1)
            hit = known[i] == at[rows]
            rows, i = rows[hit], i[hit]
            at[rows] = at[rows] * np.uint64(2) + (bins[feature[i], rows] > cut[i]).astype(np.uint64)
        return at


def _upper(train: DataFrame, k: int, trees: int, mean: float, most: int, max_depth: int, n_tried: int, seed: int) -> list[Upper]:
    """The upper nodes of all trees, down to nodes of at most ``most`` drawn rows."""
    spark = train.sparkSession
    upper, wanted = [Upper() for _ in range(trees)], {t: [1] for t in range(trees)}
    while wanted:
        shared = spark.sparkContext.broadcast((upper, wanted))

        def count(batches):
            parts = [(_numbers(b.column("key")).view(np.uint64), _numbers(b.column("label")) - mean, _bins(b.column("bins"), k)) for b in batches]
            if not parts:
                return
            key, label, bins = (np.concatenate(x, axis=-1) for x in zip(*parts))
            upper, wanted = shared.value
            for t, nodes in wanted.items():
                w = draws(key, t, seed)
                own = np.flatnonzero(w)
                place, node = upper[t].places(bins[:, own]), np.array(sorted(nodes), np.uint64)
                i = np.minimum(np.searchsorted(node, place), len(node) - 1)
                hit = node[i] == place
                own, i = own[hit], i[hit]
                counts = np.zeros((len(node), k, 2, BINS))
                squares = np.bincount(i, w[own] * label[own] ** 2, len(node))
                for f in range(k):
                    cell = i * BINS + bins[f, own]
                    for j, x in enumerate((w[own], w[own] * label[own])):
                        counts[:, f, j] = np.bincount(cell, x, len(node) * BINS).reshape(-1, BINS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t] * len(node), pa.int32()), pa.array(node.astype(np.int64)), pa.array(squares, pa.float64()),  # bincount of nothing has integers
                     pa.array([c.tobytes() for c in counts], pa.binary())], ["tree", "node", "squares", "counts"])

        def choose(key, table):
            tree, node = (x.as_py() for x in key)
            counts, squares = np.zeros((k, 2, BINS)), 0.0
            for part, own in zip(table["counts"], table["squares"]):  # one a task
                counts += np.frombuffer(part.as_buffer(), np.float64).reshape(k, 2, BINS)
                squares += own.as_py()
            w, y = counts[0].sum(1)
            flags = tried(np.array([node], np.uint64), k, n_tried, tree, seed)[0]
            score, cuts = split_counts(counts[:, 0], counts[:, 1])
            score = np.where(flags, score, -np.inf)
            f = int((score >= score.max() - EQUAL * np.abs(score.max())).argmax())
            gains = flags[f] and node.bit_length() - 1 < max_depth and score[f] > y * y / w + LEAST_GAIN * squares
            left = counts[f, 0, :cuts[f] + 1].sum()
            return pa.Table.from_arrays(
                [pa.array([x], kind) for x, kind in ((tree, pa.int32()), (node, pa.int64()), (f if gains else -1, pa.int32()),
                                                     (int(cuts[f]), pa.int32()), (left, pa.float64()), (w, pa.float64()), (y / w, pa.float64()))],
                ["tree", "node", "feature", "cut", "left", "all", "value"])
        found = (train.mapInArrow(count, "tree int, node long, squares double, counts binary").groupBy("tree", "node")
                 .applyInArrow(choose, "tree int, node long, feature int, cut int, left double, all double, value double"))
        wanted = {}
        for r in found.collect():  # a row for each node of more than `most` rows
            if r["feature"] < 0:
                upper[r["tree"]].leaves[r["node"]] = r["value"]
                continue
            upper[r["tree"]].splits[r["node"]] = (r["feature"], r["cut"])
            wanted.setdefault(r["tree"], []).extend(
                2 * r["node"] + i for i, n in enumerate((r["left"], r["all"] - r["left"])) if n > most)
        wanted = {t: nodes for t, nodes in wanted.items() if nodes}
    return upper


def forest_votes(rows: DataFrame, sizes: Sequence[int], max_depth: int, n_tried, seed: int, most: int = MOST) -> DataFrame:
    """Stored ``row, s0, s1, …``: sums of the leaf means that the first ``sizes[i]`` trees of a forest give each scored row.

    ``rows`` is a stored table of ``row`` (unique), ``key`` (drawn by), ``label``, ``scored`` (to be predicted, else
    to learn from) and the array ``inputs``. ``n_tried`` tells how many of so many features a node tries.
    """
    spark, trees = rows.sparkSession, max(sizes)
    learned = rows.where("NOT scored")
    edges = bin_edges(learned)
    k = len(edges)
    n_tried, most = n_tried(k), min(most, MOST_BYTES // max(1, k))
    data = binned(rows, edges)
    train = data.where("NOT scored")
    n, mean, bad = train.agg(F.count("*"), F.avg("label"), F.count_if(F.col("label").isNull() | F.isnan("label"))).first()
    if bad or not n:
        raise ValueError("no rows to learn from" if not n else "labels to learn from are NULL or NaN")
    cores, names = spark.sparkContext.defaultParallelism, [f"s{j}" for j in range(len(sizes))]
    schema = ", ".join(["row long", *(f"{s} double" for s in names)])

    def sums(ids, label, learned, asked, some, node, leaf_of):
        """What ``some`` trees, from their place ``node``, give the rows asked, added up for each size."""
        total, same = np.zeros((len(sizes), asked.shape[1])), alike(learned)
        few = np.ascontiguousarray(learned[:, same[0]]) if same else None
        for t in some:
            leaf = leaf_of(t)
            if leaf is None:
                w = draws(ids, t, seed)
                own = np.flatnonzero(w)
                if not len(own):  # very few rows may all be left out
                    own, w = np.arange(len(ids)), np.ones(len(ids))
                if same:  # one row for all with the same bins, which no split can part
                    w, y, yy = (np.bincount(same[1][own], x, few.shape[1]) for x in (w[own], w[own] * label[own], w[own] * label[own] ** 2))
                    own = np.flatnonzero(w)
                    one = grow(np.ascontiguousarray(few[:, own]), y[own] / w[own], w[own], node, max_depth, n_tried, t, seed, yy[own] / w[own])
                else:
                    one = grow(learned, label, w, node, max_depth, n_tried, t, seed)
                values = descend(one, asked) + mean
            else:
                values = leaf + mean
            for j, size in enumerate(sizes):
                total[j] += values if t < size else 0
        return total

    def added(votes):
        return votes.groupBy("row").agg(*[F.sum(s).alias(s) for s in names])

    if n <= min(READ * most, MOST_BYTES // max(1, k)):
        m = data.where("scored").count()
        per = -(-trees // (3 * cores))  # some trees share a task, which reads all rows once

        def read(batches):
            block, at, asked_at = None, 0, 0
            ids, label, learned = np.empty(n, np.int64), np.empty(n), np.empty((k, n), np.uint8)
            row, asked = np.empty(m, np.int64), np.empty((k, m), np.uint8)
            for batch in batches:
                if not len(batch):
                    continue
                block, scored, bins = batch.column("block")[0].as_py(), _numbers(batch.column("scored")).astype(bool), _bins(batch.column("bins"), k)
                end, asked_end = at + int((~scored).sum()), asked_at + int(scored.sum())
                ids[at:end], label[at:end] = (_numbers(batch.column(c))[~scored] for c in ("key", "label"))
                learned[:, at:end], asked[:, asked_at:asked_end] = bins[:, ~scored], bins[:, scored]
                row[asked_at:asked_end] = _numbers(batch.column("row"))[scored]
                at, asked_at = end, asked_end
            if block is None:
                return
            order = np.argsort(ids, kind="stable")
            for own in (ids, label, *learned):
                own[:] = own[order]
            label -= mean
            total = sums(ids.view(np.uint64), label, learned, asked, range(block * per, min(trees, (block + 1) * per)), 1, lambda t: None)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (row, *total)], ["row", *names])
        one = data.select("row", "key", "label", "scored", "bins").coalesce(1)
        # a union of single partitions alone would be a single one
        apart = spark.createDataFrame(spark.sparkContext.emptyRDD(), one.withColumn("block", F.lit(0)).schema)
        dealt = reduce(DataFrame.union, [apart, *(one.withColumn("block", F.lit(b)) for b in range(-(-trees // per)))])
        votes = added(dealt.mapInArrow(read, schema))
    else:
        shared = spark.sparkContext.broadcast(_upper(train, k, trees, mean, most, max_depth, n_tried, seed))

        def place(first, last):
            def run(batches):
                for batch in batches:
                    key, bins = _numbers(batch.column("key")).view(np.uint64), _bins(batch.column("bins"), k)
                    scored = _numbers(batch.column("scored")).astype(bool)
                    for t in range(first, last):
                        tree = shared.value[t]
                        at = tree.places(bins)
                        kept = np.flatnonzero(scored | (draws(key, t, seed) > 0) & ~np.isin(at, np.array(list(tree.leaves), np.uint64)))
                        part = batch.take(pa.array(kept))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kept), t, np.int32)), pa.array(at[kept].astype(np.int64)), *part.columns],
                                                         ["tree", "node", *part.schema.names])
            return run

        def grown(key, table):
            tree, node = (x.as_py() for x in key)
            table = table.sort_by("key")
            scored, bins = _numbers(table["scored"]).astype(bool), _bins(table["bins"], k)
            ids, label = _numbers(table["key"]).view(np.uint64)[~scored], _numbers(table["label"])[~scored] - mean
            learned, asked = np.ascontiguousarray(bins[:, ~scored]), np.ascontiguousarray(bins[:, scored])
            total = sums(ids, label, learned, asked, [tree], node, lambda t: shared.value[t].leaves.get(node))
            return pa.Table.from_arrays([table["row"].filter(pa.array(scored)), *(pa.array(s) for s in total)], ["row", *names])
        step, path = max(1, 3 * cores * most // n), None  # a few groups a core
        for first in range(0, trees, step):
            dealt = data.mapInArrow(place(first, min(trees, first + step)),
                                    "tree int, node long, row long, key long, label double, scored boolean, bins binary")
            votes = dealt.groupBy("tree", "node").applyInArrow(grown, schema)
            if path:
                votes = votes.unionByName(spark.read.schema(schema).parquet(path))
            before, path = path, scratch_path(spark, "forest-sums")
            added(votes).write.parquet(path)
            if before:
                remove(spark, before)
        votes = spark.read.schema(schema).parquet(path)
    # sums of doubles differ in the last digits with their order
    found = cut_lineage(votes.select("row", *[F.round(s, 8).alias(s) for s in names]), "forest-votes")
    discard(data)
    return found

"""Histogram gradient boosting of many binary classifiers at once (folds, repeats, feature sets).

All fits share one stored matrix of binned features. One pass over its blocks adds up, for every fit, the histograms (count, gradient,
hessian per bin) of the nodes that the fit waits for, and finds their best splits where the sums are; the driver sees splits only.
Of at most ``FEW`` fits the driver adds up the tasks' sums itself, keeps them for the tree and finds the splits: such a pass needs no shuffle, and only the
smaller of two siblings is counted, the larger is the parent less the smaller. Of more fits both children are counted and splits are found in tasks.
A node of at most ``SMALL`` rows (of large fits a quarter of the rows, at most ``MOST``) is not counted any further. When a tree has no larger nodes left to count, the rows of all its small ones are dealt
evenly to tasks, each node's rows to one task, which grows everything that the tree may need below it. So a tree moves its rows once, and takes as many passes as it
has levels of larger nodes, and one. Every fit goes its own pace: one may grow its tenth tree while another still splits its ninth.

A fit of at most ``WHOLE`` rows needs no passes at all: its rows meet in one task, which grows all its trees; other fits do so in other tasks beside it.
Where more than ``FEW`` fits keep the tasks busy, the bound is ``SHARE`` times as large. Beyond it passes take over, so no task's share grows with the table.

Trees grow best-first under a leaf limit: the leaf of greatest gain is split next. Gains do not depend on the order of splits, so a pass works on the
children of every leaf that the order known so far would split; a tree is done when the order no longer asks for unknown children.

Gradients and hessians are rounded to multiples of 2**-30 and summed as integers, so the sums, and with them the trees, do not depend on the
order of blocks or on retries. Fits of more than ``EARLY_ROWS`` rows hold out a tenth of them and stop when its loss no longer falls.
"""
from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.rdd import portable_hash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.operators.prefix import exact_quantiles
from cohortlab.session import materialize

#: The reference learner's defaults.
LEARNING_RATE, ITERATIONS, LEAVES, LEAF_ROWS, LEAF_HESSIAN, BINS = 0.1, 100, 31, 20, 1e-3, 255
EARLY_ROWS, EARLY_SHARE, EARLY_PATIENCE, EARLY_TOLERANCE = 10_000, 10, 10, 1e-7
#: Rows of a block, of a node that one task finishes, and of a fit that one task grows where there are few fits; passes after which the scores are
#: brought up to date and kept.
ROWS, SMALL, WHOLE, KEEP = 1 << 16, 1 << 20, 1 << 20, 8
#: Most cells of a table in which features are counted together (codes are 16 bits); most fits whose sums the driver adds up itself.
BUNDLE, FEW = 1 << 14, 4
#: Of a large fit a task finishes nodes of up to this share of the rows, as smaller ones are mostly leaves and would take passes in vain; never more rows than MOST.
SHARE, MOST = 4, 1 << 22
UNIT = float(1 << 30)


# ------------------------------------------------------------------ bins, blocks


def bin_edges(rows: DataFrame, n_features: int, bins: int = BINS) -> list[np.ndarray]:
    """Upper edges of the bins of every feature of ``x``: midpoints of its values, or of the order statistics next to exact quantiles."""
    long = materialize(rows.select(F.posexplode("x").alias("feature", "value")).groupBy("feature", "value").agg(F.count("*").alias("n")), "bin-cells")
    few = {r["feature"]: r["d"] for r in long.groupBy("feature").agg(F.count("*").alias("d")).collect()}
    small = [f for f, d in few.items() if d <= bins]
    values: dict[int, list[float]] = {}
    for r in long.where(F.col("feature").isin(small)).select("feature", "value").collect():  # n_features x bins values at most
        values.setdefault(r["feature"], []).append(r["value"])
    edges = {f: _midpoints(v) for f, v in values.items()}
    large = [f for f, d in few.items() if d > bins]
    if large:
        cells = rows.select(F.posexplode("x").alias("feature", "value")).where(F.col("feature").isin(large))
        q = exact_quantiles(cells, "value", [i / bins for i in range(1, bins)], ["feature"]).select("feature", "value").collect()
        for f in large:
            edges[f] = np.unique([r["value"] for r in q if r["feature"] == f])
    return [edges.get(f, np.empty(0)) for f in range(n_features)]


def _midpoints(values: Iterable[float]) -> np.ndarray:
    v = np.sort(np.array(list(values), dtype=float))
    return (v[1:] + v[:-1]) / 2


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin b of a feature holds edges[b - 1] < x <= edges[b]."""
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.uint8)


def packed(rows: DataFrame, edges: list[np.ndarray] | None, width: int, n_folds: int) -> DataFrame:
    """rows (key long, label int, x array<double>, folds array<int>) in stored blocks of ROWS rows: block, keys, y, x, folds as bytes.

    With ``edges`` x becomes bins, one byte each; without it stays as doubles, nulls as NaN.
    """
    cuts = None if edges is None else [e.tolist() for e in edges]

    def run(batches):
        from pyspark import TaskContext
        own = None if cuts is None else [np.array(e) for e in cuts]
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block(parts):
            keys, y, x, folds = (np.concatenate(c) for c in zip(*parts))
            return pa.record_batch([pa.array([(part << 32) + number], pa.int64()), *[pa.array([c.tobytes()], pa.binary()) for c in (keys, y, x, folds)]], ["block", "keys", "y", "x", "folds"])

        for batch in batches:
            n = batch.num_rows
            x = batch.column(2).flatten().fill_null(math.nan).to_numpy().reshape(n, width)
            folds = batch.column(3).flatten().to_numpy().astype(np.uint8).reshape(n, n_folds) if n_folds else np.zeros((n, 0), dtype=np.uint8)
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.uint8), x if own is None else binned(x, own), folds))
            size += n
            if size >= ROWS:
                yield block(held)
                number, held, size = number + 1, [], 0
        if size:
            yield block(held)

    return materialize(rows.select("key", "label", "x", "folds").mapInArrow(run, "block long, keys binary, y binary, x binary, folds binary"), "binned")


# ------------------------------------------------------------------ fits and trees


@dataclass(frozen=True)
class Fit:
    """Which features a fit may use and which rows it learns from: those whose ``repeat``-th fold is not ``fold`` (None: all)."""

    features: tuple[int, ...]
    repeat: int | None = None
    fold: int | None = None
    iterations: int = ITERATIONS

    def rows(self, folds: np.ndarray) -> np.ndarray:
        return np.ones(len(folds), dtype=bool) if self.repeat is None else folds[:, self.repeat] != self.fold


@dataclass
class Tree:
    """Nodes as arrays; a leaf points to itself. Rows whose bin is at most ``cut`` go left."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """The node at which each row ends."""
        out = np.zeros(len(x), dtype=np.int64)
        for node, rows in self.parts(x, np.arange(len(x))):
            out[rows] = node
        return out

    def parts(self, x: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The nodes at which some of ``rows`` end, with these rows."""
        columns = {f: np.ascontiguousarray(x[:, f]) for f in np.unique(self.feature).tolist()}  # no copies where x lies by columns
        waiting = [(0, rows)]
        while waiting:
            node, own = waiting.pop()
            if self.left[node] == node:
                yield node, own
                continue
            right = np.take(columns[int(self.feature[node])], own) > self.cut[node]
            for child, part in ((self.right[node], _where(right, own)), (self.left[node], _where(~right, own))):
                if len(part):
                    waiting.append((int(child), part))


@dataclass
class Ensemble:
    """A fitted classifier: probability = sigmoid(base + sum of leaf values)."""

    base: float
    trees: list[Tree]
    edges: list[np.ndarray]

    def probability(self, x: Column) -> Column:
        """Of the rows' feature arrays."""

        @F.pandas_udf("double")
        def score(rows: pd.Series) -> pd.Series:
            raw = self.raw(np.vstack(rows.to_numpy())) if len(rows) else np.empty(0)
            return pd.Series(1 / (1 + np.exp(-raw)))

        return score(x)

    def raw(self, x: np.ndarray) -> np.ndarray:
        own, out = binned(x, self.edges), np.full(len(x), self.base)
        for t in self.trees:
            out += t.value[t.nodes(own)]
        return out

    def curves(self, x: np.ndarray, feature: int, bins: np.ndarray) -> np.ndarray:
        """bins x rows: ``raw`` of the rows of x, with ``feature`` in each of the ascending ``bins`` instead of its own.

        Rows walk every tree once; a cut of the feature parts the bins, not the rows.
        """
        own = np.asfortranarray(binned(x, self.edges))
        out = np.full((len(bins), len(x)), self.base)
        for t in self.trees:
            cuts = np.unique(np.searchsorted(bins, t.cut[(t.feature == feature) & (t.left != np.arange(len(t.left)))], side="right"))
            ends = np.unique(np.concatenate([[0], cuts, [len(bins)]]))  # between two of these the tree has one value
            value = np.empty((len(ends) - 1, len(x)))
            waiting = [(0, np.arange(len(x)), 0, len(ends) - 1)]
            while waiting:
                node, rows, a, b = waiting.pop()
                left, right = int(t.left[node]), int(t.right[node])
                if left == node:
                    for i in range(a, b):
                        value[i, rows] = t.value[node]
                elif t.feature[node] == feature:
                    c = int(np.searchsorted(ends, np.searchsorted(bins, t.cut[node], side="right")))
                    waiting += [(child, rows, *part) for child, part in ((left, (a, min(b, c))), (right, (max(a, c), b))) if part[0] < part[1]]
                else:
                    over = np.take(own[:, t.feature[node]], rows) > t.cut[node]
                    waiting += [(child, part, a, b) for child, part in ((left, _where(~over, rows)), (right, _where(over, rows))) if len(part)]
            for i in range(len(ends) - 1):
                out[ends[i] : ends[i + 1]] += value[i]
        return out


def _where(mask: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.take(rows, np.flatnonzero(mask))  # much faster than rows[mask]


def held_out(keys: np.ndarray, salt: int) -> np.ndarray:
    """A tenth of the rows, by a hash of the key."""
    h = (keys.astype(np.uint64) + np.uint64(salt + 1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(33)) % np.uint64(EARLY_SHARE) == 0


def gradients(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian of the log loss, in whole units of 2**-30."""
    p = 1 / (1 + np.exp(-raw))
    return np.rint((p - y) * UNIT), np.rint(p * (1 - p) * UNIT)


@dataclass
class Layout:
    """Where the bins of a fit's features lie in one histogram row."""

    features: tuple[int, ...]
    sizes: list[int]

    def __post_init__(self):
        self.first = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        self.total = int(sum(self.sizes))
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.start = self.first[self.owner]
        self.last = np.zeros(self.total, dtype=bool)
        self.last[np.cumsum(self.sizes) - 1] = True
        self.bundles: list[list[int]] = []  # features counted together, by their places here
        for j in sorted(range(len(self.sizes)), key=lambda j: -self.sizes[j]):
            fit = next((b for b in self.bundles if math.prod(self.sizes[i] for i in b) * self.sizes[j] <= BUNDLE), None)
            if fit is None:
                self.bundles.append([j])
            else:
                fit.append(j)
        self.cells = sum(math.prod(self.sizes[i] for i in b) for b in self.bundles)

    def codes(self, x: np.ndarray, rows: np.ndarray | None = None) -> list[np.ndarray]:
        """One number per row (of ``rows``) and bundle, which stands for the bins of its features."""
        out = []
        for bundle in self.bundles:
            code = np.zeros(len(x) if rows is None else len(rows), dtype=np.uint16)
            for j in bundle:
                column = x[:, self.features[j]]
                code *= self.sizes[j]
                code += column if rows is None else np.take(column, rows)
            out.append(code)
        return out

    def counted(self, codes: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """(count, gradient, hessian) x bins, from one table per bundle."""
        out = np.empty((3, self.total), dtype=np.int64)
        for bundle, code in zip(self.bundles, codes):
            at, shape = code.astype(np.intp), [self.sizes[j] for j in bundle]
            for i, weights in enumerate((None, g, h)):
                table = np.bincount(at, weights, math.prod(shape)).reshape(shape)
                for axis, j in enumerate(bundle):
                    out[i, self.first[j] : self.first[j] + self.sizes[j]] = table.sum(axis=tuple(a for a in range(len(bundle)) if a != axis))
        return out

    def of_rows(self, x: np.ndarray, rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """(count, gradient, hessian) x bins of some rows of x, whose g and h these are; many rows by bundles."""
        return self.histograms(x, None, 1, g, h, rows)[0] if len(rows) < self.cells else self.counted(self.codes(x, rows), g, h)

    def histograms(self, x: np.ndarray, slot: np.ndarray | None, n: int, g: np.ndarray, h: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """n x (count, gradient, hessian) x bins of the rows of x (or of ``rows`` among them, whose g and h these are), by slot (of one slot: None)."""
        out = np.empty((n, 3, self.total), dtype=np.int64)
        for feature, size, first in zip(self.features, self.sizes, self.first):
            at = (x[:, feature] if rows is None else np.take(x[:, feature], rows)).astype(np.intp)
            if n > 1:
                at += slot * size
            for i, weights in enumerate((None, g, h)):
                out[:, i, first : first + size] = np.bincount(at, weights, n * size).reshape(n, size)
        return out

    def best_splits(self, cells: np.ndarray) -> list[tuple]:
        """(gain, bin place, the left side's and the node's (count, gradient, hessian)) of the best split of each node; gain 0 if none.

        Of equal gains the first feature's lowest cut wins.
        """
        run = np.cumsum(cells, axis=2)
        before = np.where(self.start[None, None, :] > 0, np.take(run, np.maximum(self.start - 1, 0), axis=2), 0)
        left = run - before
        whole = cells[:, :, : self.sizes[0]].sum(axis=2)[:, :, None]
        right = whole - left
        (nl, gl, hl), (nr, gr, hr) = (np.moveaxis(s, 1, 0).astype(float) for s in (left, right))
        _, g, h = np.moveaxis(whole, 1, 0).astype(float)
        fits = (nl >= LEAF_ROWS) & (nr >= LEAF_ROWS) & (hl >= LEAF_HESSIAN * UNIT) & (hr >= LEAF_HESSIAN * UNIT) & ~self.last[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(fits, (gl * gl / hl + gr * gr / hr - g * g / h) / UNIT, 0.0)
        place = gain.argmax(axis=1)
        row = np.arange(len(cells))
        return list(zip(gain[row, place].tolist(), place.tolist(), map(tuple, left[row, :, place].tolist()), map(tuple, whole[:, :, 0].tolist())))


def by_column(x: np.ndarray) -> np.ndarray:
    """x with each column in one piece of memory."""
    return x if x.strides[0] == x.itemsize else np.asfortranarray(x)


def finished(layout: Layout, x: np.ndarray, g: np.ndarray, h: np.ndarray, room: int, codes: list[np.ndarray] | None = None) -> list[tuple]:
    """Best-first growth of one node in memory by at most ``room`` splits: (gain, place, left sums, sums, children) by node, 0 first.

    ``codes``: the layout's codes of x, where they are at hand.
    """

    x, g, h = by_column(x), g.astype(float, copy=False), h.astype(float, copy=False)

    codes = layout.codes(x) if codes is None else codes

    def cells(rows):
        own = np.take(g, rows), np.take(h, rows)
        return layout.histograms(x, None, 1, *own, rows)[0] if len(rows) < layout.cells else layout.counted([np.take(c, rows) for c in codes], *own)

    rows = {0: np.arange(len(x))}
    sums = {0: layout.counted(codes, g, h)}
    nodes = [(*layout.best_splits(sums[0][None])[0], None)]
    heap = [(-nodes[0][0], 0)]
    while heap and room and heap[0][0] < 0:
        _, node = heapq.heappop(heap)
        room -= 1
        place = nodes[node][1]
        o = layout.owner[place]
        own, whole = rows.pop(node), sums.pop(node)
        left = np.take(x[:, layout.features[o]], own) <= place - layout.first[o]
        parts = _where(left, own), _where(~left, own)
        small = 0 if len(parts[0]) <= len(parts[1]) else 1
        counted = cells(parts[small])
        both = (counted, whole - counted) if small == 0 else (whole - counted, counted)
        a = len(nodes)
        nodes[node] = (*nodes[node][:4], (a, a + 1))
        for i, split in enumerate(layout.best_splits(np.stack(both))):
            nodes.append((*split, None))
            if split[0] > 0:
                rows[a + i], sums[a + i] = parts[i], both[i]
                heapq.heappush(heap, (-split[0], a + i))
    return nodes


class Growth:
    """The tree that a fit is growing, and those that it has finished."""

    def __init__(self, fit: Fit, layout: Layout, number: int):
        self.fit, self.layout, self.number = fit, layout, number
        self.trees: list[Tree] = []
        self.base, self.early, self.done, self.n = 0.0, False, False, 0
        self.losses: list[float] = []
        self.kept = 0  # finished trees that the kept scores contain
        self._plant()

    def _plant(self):
        self.sums: list = [None]      # count, gradient, hessian of each node
        self.split: list = [None]     # gain, place and left sums of each node
        self.children: list = [None]
        self.depth = [0]
        self.parent: list = [None]
        self.wanted = [0]
        self.waiting: list[int] = []           # small nodes, which are finished when no others are left to count
        self.cells: dict[int, np.ndarray] = {}  # histograms of counted nodes, where the driver adds them up

    def partial(self) -> Tree:
        """The tree as far as its children are numbered."""
        return self._tree({i for i, c in enumerate(self.children) if c is not None})

    def _tree(self, inner: set[int]) -> Tree:
        n = len(self.sums)
        own = np.arange(n)
        feature, cut, left, right, value, cover = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), own.copy(), own.copy(), np.zeros(n), np.zeros(n)
        for i in range(n):
            if self.sums[i] is not None:
                cover[i] = self.sums[i][0]
            if i in inner:
                place = self.split[i][1]
                o = self.layout.owner[place]
                feature[i], cut[i] = self.layout.features[o], place - self.layout.first[o]
                left[i], right[i] = self.children[i]
            elif self.sums[i] is not None and self.sums[i][2] > 0:
                value[i] = -LEARNING_RATE * self.sums[i][1] / self.sums[i][2]
        return Tree(feature, cut, left, right, value, cover)

    def rows(self, node: int) -> int:
        return self.n if node == 0 else int(self.sums[node][0])

    def small(self, node: int) -> bool:
        """Whether one task finishes the node."""
        return self.rows(node) <= max(SMALL, min(self.n // SHARE, MOST))

    def grow(self, found: dict[int, list[tuple]]):
        """Record (gain, place, left sums, sums, children) of new nodes and of those below, then ask for children or finish the tree."""
        for node, below in found.items():
            at = {0: node}
            for i, (gain, place, left, whole, children) in enumerate(below):
                self.sums[at[i]], self.split[at[i]] = whole, (gain, place, left)
                if children is not None:
                    at[children[0]], at[children[1]] = self._part(at[i])
        order, heap = [], [(-self.split[0][0], 0)]
        asked = []
        while heap and len(order) < LEAVES - 1:
            gain, node = heapq.heappop(heap)
            if gain >= 0:
                break
            order.append(node)
            if self.children[node] is None:
                asked.append((len(order), node))
            else:
                for c in self.children[node]:
                    if self.split[c] is not None:  # else a child that no order can reach
                        heapq.heappush(heap, (-self.split[c][0], c))
        open_ = [node for place, node in asked if place < LEAVES - 1]
        new = [c for node in open_ for c in self._part(node)]
        self.waiting += [c for c in new if self.small(c)]
        self.wanted = [c for c in new if not self.small(c)]
        if not self.wanted:
            self.wanted, self.waiting = self.waiting, []
        if not self.wanted:
            for _, node in asked:
                self._part(node)
            self._finish(set(order))

    def to_count(self, few: bool) -> list[int]:
        """The nodes that a pass counts: with ``few`` the smaller child of every parent, as the larger is the parent less the smaller."""
        large = [node for node in self.wanted if not self.small(node)]
        if not few or large == [0]:
            return large
        return [min(self.children[p], key=self.rows) for p in dict.fromkeys(self.parent[node] for node in large)]

    def counted(self, counted: list[int], cells: np.ndarray) -> dict[int, list[tuple]]:
        """Best splits of the large wanted nodes from the sums of the counted ones."""
        self.cells.update(zip(counted, cells))
        large = [node for node in self.wanted if not self.small(node)]
        for node in large:
            if node not in self.cells:
                self.cells[node] = self.cells[self.parent[node]] - self.cells[sum(self.children[self.parent[node]]) - node]
        return {node: [(*split, None)] for node, split in zip(large, self.layout.best_splits(np.stack([self.cells[node] for node in large])))}

    def _part(self, node: int) -> tuple[int, int]:
        left = self.split[node][2]
        right = tuple(a - b for a, b in zip(self.sums[node], left))
        a = len(self.sums)
        self.sums += [left, right]
        self.split += [None, None]
        self.children += [None, None]
        self.depth += [self.depth[node] + 1] * 2
        self.parent += [node] * 2
        self.children[node] = (a, a + 1)
        return a, a + 1

    def _finish(self, inner: set[int]):
        whole = self._tree(inner)
        reach, order = [0], []
        while reach:
            i = reach.pop()
            order.append(i)
            if i in inner:
                reach += [int(whole.right[i]), int(whole.left[i])]
        at = {node: i for i, node in enumerate(order)}
        pick = np.array(order)
        self.trees.append(Tree(whole.feature[pick], whole.cut[pick], np.array([at[int(c)] for c in whole.left[pick]]), np.array([at[int(c)] for c in whole.right[pick]]), whole.value[pick], whole.cover[pick]))
        self._plant()
        self.done = len(self.trees) >= self.fit.iterations

    def heard(self, loss: float):
        """The held-out loss with all finished trees; stops when the last ones no longer lower it."""
        self.losses.append(loss)
        if len(self.losses) > EARLY_PATIENCE:
            reference = self.losses[-EARLY_PATIENCE - 1] - EARLY_TOLERANCE
            self.done = self.done or all(x > reference for x in self.losses[-EARLY_PATIENCE:])


def loss_sum(raw: np.ndarray, y: np.ndarray) -> int:
    """Log loss of the rows, in whole units of 2**-30 each."""
    return int(np.rint((np.logaddexp(0, raw) - y * raw) * UNIT).astype(np.int64).sum())


def grown(growth: Growth, x: np.ndarray, y: np.ndarray, aside: np.ndarray) -> Growth:
    """All trees of a fit whose rows are at hand; ``aside``: the held-out rows among them."""
    n = int(len(y) - aside.sum())
    order = np.argsort(aside, kind="stable")  # held-out rows last, so that the others are a view
    x, y = np.take(x.T, order, axis=1).T, np.take(y, order)
    del order
    raw, codes = np.full(len(y), growth.base), growth.layout.codes(x[:n])
    while not growth.done:
        if n < len(y):
            growth.heard(loss_sum(raw[n:], y[n:]) / UNIT / (len(y) - n))
            if growth.done:
                break
        growth.grow({0: finished(growth.layout, x[:n], *gradients(raw[:n], y[:n]), LEAVES - 1, codes)})
        tree = growth.trees[-1]
        for node, rows in tree.parts(x, np.arange(len(y))):
            raw[rows] += tree.value[node]
    return growth


# ------------------------------------------------------------------ passes


@dataclass
class Order:
    """What a pass is to do for one fit."""

    fit: Fit
    layout: Layout
    early: bool
    base: float
    pending: list[Tree]
    tree: Tree | None
    #: Nodes whose histograms are asked for; nodes that one task finishes, and the splits that are left for each.
    count: list[int] = field(default_factory=list)
    room: dict[int, int] = field(default_factory=dict)


def dealt(blocks: DataFrame, n_fits: int, n_folds: int, kind: type = np.uint8) -> RDD:
    """(numbers of fits, block): one task a block, or several with fits of their own where there are fewer blocks than cores."""
    sc = blocks.sparkSession.sparkContext
    n_blocks = blocks.count()
    lanes = max(1, min(n_fits, sc.defaultParallelism // max(n_blocks, 1)))
    numbers = list(range(n_fits))
    if lanes == 1:
        return blocks.rdd.map(lambda row: (numbers, _unpacked(row, n_folds, kind)))
    place = {r["block"]: i for i, r in enumerate(blocks.select("block").collect())}  # fewer than cores
    spread = blocks.rdd.flatMap(lambda row: [(place[row["block"]] * lanes + lane, row) for lane in range(lanes)]).partitionBy(max(1, n_blocks) * lanes, lambda k: k)
    return spread.map(lambda r: (numbers[r[0] % lanes :: lanes], _unpacked(r[1], n_folds, kind)))


def _unpacked(row, n_folds: int, kind: type) -> dict:
    keys = np.frombuffer(row["keys"], dtype=np.int64)
    return {"keys": keys, "y": np.frombuffer(row["y"], dtype=np.uint8).astype(float), "x": np.frombuffer(row["x"], dtype=kind).reshape(len(keys), -1),
            "folds": np.frombuffer(row["folds"], dtype=np.uint8).reshape(len(keys), n_folds)}


def _up_to_date(block: dict, fit: int, order: Order) -> np.ndarray:
    """Scores of all rows of the block with the fit's finished trees."""
    raw = block["raw"][fit] if fit in block["raw"] else np.full(len(block["y"]), order.base)
    for t in order.pending:
        raw = raw + np.take(t.value, t.nodes(block["x"]))
    return raw


def _counted(block: dict, fit: int, order: Order):
    """(("count", fit), histograms) of the nodes to count and (("rows", fit, node), rows) of those that one task finishes; with a new
    tree also (("loss", fit), held-out loss and rows)."""
    raw, use = _up_to_date(block, fit, order), order.fit.rows(block["folds"])
    if order.early:
        aside = block["aside"][fit] if fit in block["aside"] else held_out(block["keys"], fit) & use
        use &= ~aside
        if order.tree is None and aside.any():
            yield ("loss", fit), np.array([loss_sum(raw[aside], block["y"][aside]), aside.sum()])
    x, at = block["x"], np.flatnonzero(use)
    place = {node: i for i, node in enumerate(order.count)}
    cells = np.zeros((len(place), 3, order.layout.total), dtype=np.int64)
    for node, own in [(0, at)] if order.tree is None else order.tree.parts(x, at):
        if node in place:
            cells[place[node]] = order.layout.of_rows(x, own, *gradients(np.take(raw, own), np.take(block["y"], own)))
        elif node in order.room and len(own):
            g, h = gradients(np.take(raw, own), np.take(block["y"], own))
            yield ("rows", fit, node), [(np.take(x.T, own, axis=1), g.astype(np.int32), h.astype(np.int32))]
    if place:
        yield ("count", fit), cells


def _split(key: tuple, value, order: Order, few: bool):
    """The found splits of one key's sums or rows; with ``few`` the sums as they are."""
    if key[0] == "rows":
        x, g, h = zip(*value)
        return finished(order.layout, np.concatenate(x, axis=1).T, np.concatenate(g), np.concatenate(h), order.room[key[2]])
    if key[0] == "count" and not few:
        return [[(*split, None)] for split in order.layout.best_splits(value)]
    return value


def dealt_evenly(sizes: dict[tuple, int], n: int) -> dict[tuple, int]:
    """A place below ``n`` for every key, the largest first to the place that has least."""
    heap, place = [(0, i) for i in range(n)], {}
    for key in sorted(sizes, key=lambda k: (-sizes[k], k)):
        held, place[key] = heapq.heappop(heap)
        heapq.heappush(heap, (held + sizes[key], place[key]))
    return place


class Boosting:
    """Runs the passes of all fits over the blocks of one matrix."""

    def __init__(self, blocks: DataFrame, edges: list[np.ndarray], fits: list[Fit], n_folds: int):
        sizes = [len(e) + 1 for e in edges]
        self.edges = edges
        layouts = {f.features: Layout(f.features, [sizes[j] for j in f.features]) for f in fits}
        self.fits = [Growth(f, layouts[f.features], i) for i, f in enumerate(fits)]
        self.few = len(fits) <= FEW
        self.n_blocks, self.tasks = blocks.count(), blocks.sparkSession.sparkContext.defaultParallelism
        # as many blocks in every task, and their features column by column
        even = blocks.repartition(min(self.n_blocks, 2 * self.tasks)) if self.n_blocks > self.tasks else blocks
        self.state = dealt(even, len(fits), n_folds).map(lambda s: (s[0], s[1] | {"x": np.asfortranarray(s[1]["x"]), "raw": {}, "aside": {}})).persist(StorageLevel.MEMORY_AND_DISK)

    def _added(self, found: RDD, rows: dict[tuple, int] | None = None) -> RDD:
        """Sums by key; one block has nothing to add up. ``rows``: how many rows come under keys that gather them; tasks get about as many each."""
        if self.n_blocks <= 1:
            return found
        place = dealt_evenly(rows or {}, self.tasks)
        return found.reduceByKey(lambda a, b: a + b, self.tasks, lambda key: place[key] if key in place else portable_hash(key))

    def _base(self):
        fits = [g.fit for g in self.fits]

        def sums(s):
            mine, b = s
            for k in mine:
                use = fits[k].rows(b["folds"])
                aside = held_out(b["keys"], k) & use
                yield k, np.array([use.sum(), b["y"][use].sum(), aside.sum(), b["y"][aside].sum()])

        for k, (n, pos, n_aside, pos_aside) in self._added(self.state.flatMap(sums)).collect():
            g = self.fits[k]
            g.early = n > EARLY_ROWS
            if g.early:
                n, pos = n - n_aside, pos - pos_aside
            g.done, g.n = n == 0, int(n)
            share = min(max(pos / n, 1e-9), 1 - 1e-9) if n else 0.5
            g.base = math.log(share / (1 - share))

    def _whole(self):
        """Fits of at most WHOLE rows (SHARE times as many beside enough others): a task for each, which gets the fit's rows and grows all its trees."""
        most = WHOLE if self.few else SHARE * WHOLE
        fits = {g.number: g for g in self.fits if not g.done and g.n <= most}
        if not fits:
            return
        place = {k: i for i, k in enumerate(fits)}

        def rows(s):
            mine, b = s
            for k in mine:
                if k in fits:
                    use = np.flatnonzero(fits[k].fit.rows(b["folds"]))
                    aside = held_out(b["keys"][use], k) if fits[k].early else np.zeros(len(use), dtype=bool)
                    yield k, (np.take(b["x"], use, axis=0), b["y"][use].astype(np.uint8), aside)

        def grow(found):
            pieces: dict[int, list] = {}
            for k, piece in found:
                pieces.setdefault(k, []).append(piece)
            for k in list(pieces):
                x, y, aside = (np.concatenate(c) for c in zip(*pieces.pop(k)))
                done = grown(fits[k], x, y, aside)
                yield k, done.trees, done.losses

        for k, trees, losses in self.state.flatMap(rows).partitionBy(len(fits), lambda k: place[k]).mapPartitions(grow).collect():
            self.fits[k].trees, self.fits[k].losses, self.fits[k].done = trees, losses, True

    def _orders(self) -> dict[int, Order]:
        out = {}
        for g in self.fits:
            if not g.done:
                room = {node: LEAVES - 1 - g.depth[node] for node in g.wanted if g.small(node)}
                out[g.number] = Order(g.fit, g.layout, g.early, g.base, g.trees[g.kept:], None if g.wanted == [0] else g.partial(), g.to_count(self.few), room)
        return out

    def _keep(self):
        """Bring the kept scores up to date; a lost block is computed again from the matrix and the trees."""
        orders = {g.number: Order(g.fit, g.layout, g.early, g.base, g.trees[g.kept:], None) for g in self.fits if len(g.trees) > g.kept}
        old = self.state

        def kept(s):
            mine, b = s
            own = [k for k in mine if k in orders]
            aside = {k: held_out(b["keys"], k) & orders[k].fit.rows(b["folds"]) for k in own if orders[k].early and k not in b["aside"]}
            return mine, b | {"raw": b["raw"] | {k: _up_to_date(b, k, orders[k]) for k in own}, "aside": b["aside"] | aside}

        self.state = old.map(kept).persist(StorageLevel.MEMORY_AND_DISK)
        self.state.count()
        old.unpersist()
        for g in self.fits:
            g.kept = len(g.trees)

    def run(self) -> list[Ensemble]:
        self._base()
        self._whole()
        passes = 0
        while orders := self._orders():
            self._answer(self._splits(orders))
            passes += 1
            if passes % KEEP == 0:
                self._keep()
        return [Ensemble(g.base, g.trees, self.edges) for g in self.fits]

    def _splits(self, orders: dict[int, Order]) -> list[tuple]:
        """Keys and found splits (or held-out loss) of one pass."""
        few = self.few
        rows = {("rows", k, node): self.fits[k].rows(node) for k, order in orders.items() for node in order.room}

        def sums(states):
            """A task's sums, added up over its blocks."""
            held: dict[tuple, np.ndarray] = {}
            for mine, b in states:
                for k in mine:
                    for key, value in _counted(b, k, orders[k]) if k in orders else ():
                        held[key] = held[key] + value if key in held else value
            yield from held.items()

        if few and not rows:  # a stage less; the driver gets a sum per task
            out: dict[tuple, np.ndarray] = {}
            for key, value in self.state.mapPartitions(sums).collect():
                out[key] = out[key] + value if key in out else value
            return list(out.items())
        found = self._added(self.state.flatMap(lambda s: [x for k in s[0] if k in orders for x in _counted(s[1], k, orders[k])]), rows)
        return found.map(lambda x: (x[0], _split(x[0], x[1], orders[x[0][1]], few))).collect()

    def _answer(self, got: list[tuple]):
        by: dict[int, dict] = {}
        for key, value in got:
            g = self.fits[key[1]]
            if key[0] == "loss":
                g.heard(int(value[0]) / UNIT / int(value[1]))
            elif key[0] == "rows":
                by.setdefault(key[1], {})[key[2]] = value
            elif self.few:
                by.setdefault(key[1], {}).update(g.counted(g.to_count(True), value))
            else:
                by.setdefault(key[1], {}).update(zip(g.to_count(False), value))
        for k, found in by.items():
            if not self.fits[k].done:
                self.fits[k].grow(found)

    def out_of_fold(self) -> DataFrame:
        """fit, key, label, score of the rows that each fit left out."""
        fits = [(g.fit, g.base, g.trees[g.kept:]) for g in self.fits]

        def rows(s):
            mine, b = s
            for k in mine:
                fit, base, pending = fits[k]
                out = np.flatnonzero(~fit.rows(b["folds"]))
                x, raw = np.take(b["x"], out, axis=0), b["raw"][k][out] if k in b["raw"] else np.full(len(out), base)
                for t in pending:
                    raw = raw + np.take(t.value, t.nodes(x))
                yield k, b["keys"][out].tobytes(), b["y"][out].astype(np.uint8).tobytes(), (1 / (1 + np.exp(-raw))).tobytes()

        return scores(self.state.flatMap(rows))

    def release(self):
        self.state.unpersist()


def scores(blocks: RDD) -> DataFrame:
    """(fit, keys, labels, scores as bytes) -> fit, key, label, score."""

    def unpack(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                keys = np.frombuffer(batch.column(1)[i].as_py(), dtype=np.int64)
                yield pa.record_batch([pa.array(np.full(len(keys), batch.column(0)[i].as_py(), dtype=np.int32)), pa.array(keys),
                                       pa.array(np.frombuffer(batch.column(2)[i].as_py(), dtype=np.uint8).astype(np.int32)),
                                       pa.array(np.frombuffer(batch.column(3)[i].as_py(), dtype=float))], ["fit", "key", "label", "score"])

    rows = SparkSession.active().createDataFrame(blocks, "fit int, keys binary, y binary, scores binary")
    return rows.mapInArrow(unpack, "fit int, key long, label int, score double")

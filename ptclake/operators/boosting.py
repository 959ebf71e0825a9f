"""Boosted trees grown by Spark, the models of all folds in the same passes.

Rows are packed once as bins, a byte a value, in blocks of one fold. A level of a tree is a pass over the blocks in which each task adds up counts and
residuals by node, feature and bin; Spark adds up the tasks' sums, and only those come to the driver. Trees follow pyspark.ml's boosting (log loss, the
first tree fitted to the labels, later ones to the residuals), but bins come from all rows, and sums are whole numbers, so that between the same bins trees
depend on neither partitions nor the order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ptclake.operators.trees import Forest
from ptclake.sources.scratch import written

#: Bins of a column; a bin is a byte.
BINS = 64
#: Rows of a block.
BLOCK = 1 << 16
#: Rows that are sorted at once for the cuts of bins, and the values that stand for them where there are more.
CHUNK, POINTS = 1 << 19, 1024
#: Residuals and losses are added up as whole multiples of 1 / UNIT.
UNIT = 1 << 20


def bin_cuts(df: DataFrame, columns: list[str]) -> list[np.ndarray]:
    """Of each column the values that its bins end with, all but the last bin: at quantiles of all rows, which at most 1/POINTS of the rows can shift.

    Each CHUNK of rows is sorted and stands for itself by its values where they are few, else by POINTS of them in equal steps.
    """

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def of_chunk() -> Iterator[pa.RecordBatch]:
            for c, x in enumerate(np.sort(np.concatenate(held, axis=1), axis=1)):
                x = x[: len(x) - np.isnan(x).sum()]
                first = np.flatnonzero(np.diff(x, prepend=np.nan) != 0)
                values, rows = x[first], np.diff(first, append=len(x)).astype(np.float64)
                if len(values) > POINTS:
                    values, rows = x[(2 * np.arange(POINTS) + 1) * len(x) // (2 * POINTS)], np.full(POINTS, len(x) / POINTS)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), c, np.int32)), pa.array(values), pa.array(rows)], names=["column", "value", "rows"])
            held.clear()

        for b in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns]))
            if sum(x.shape[1] for x in held) >= CHUNK:
                yield from of_chunk()
        if held:
            yield from of_chunk()

    def cut(key, g):
        import pandas as pd

        g = g.groupby("value", sort=True)["rows"].sum()
        values, rows, at = g.index.to_numpy(), g.to_numpy(), np.zeros(0, np.int64)
        for _ in range(2):  # the second time of the values that the first cuts leave out
            rest = np.setdiff1d(np.arange(len(values) - 1), at)
            free = BINS - 1 - len(at)
            if len(rest) <= free:
                at = np.concatenate([at, rest])
            elif free:
                upto = rows[rest].cumsum()
                at = np.union1d(at, rest[np.searchsorted(upto, upto[-1] * np.arange(1, free + 1) / (free + 1))])
        return pd.DataFrame({"column": key[0], "cut": values[np.sort(at)]})

    summary = df.select(*[F.col(f"`{c}`").cast("double") for c in columns]).mapInArrow(points, "column int, value double, rows double")
    # at most 63 rows for each column
    rows = summary.groupBy("column").applyInPandas(cut, "column int, cut double").collect()
    return [np.array(sorted(r["cut"] for r in rows if r["column"] == c)) for c in range(len(columns))]


@dataclass
class Packed:
    """Blocks (fold, y, x: bytes by column and row) and the cuts of their columns. Model k has the columns of ``own[k]`` and is grown on the rows of other folds than k."""

    blocks: DataFrame
    cuts: list[np.ndarray]
    own: list[list[int]]

    def grown(self, max_iter: int = 20, max_depth: int = 4, rate: float = 0.1) -> list[Forest]:
        """The forest of each model: ``max_iter`` trees of 2^``max_depth`` leaves at most."""
        models, features = len(self.own), len(self.own[0])
        inner = (1 << max_depth) - 1
        trees: list[Trees] = []
        for t in range(max_iter):
            tree = Trees.empty(models, max_depth)
            for level in range(max_depth):
                n, s = self._sums(trees, tree, level, features)
                tree.split(level, n, s)
            tree.close(1.0 if t == 0 else rate)
            trees.append(tree)
        return [self._forest(k, trees, inner) for k in range(models)]

    def _sums(self, trees: list[Trees], tree: Trees, level: int, features: int) -> tuple[np.ndarray, np.ndarray]:
        """[model, node, feature, bin]: rows, and the sum of their residuals."""
        own, nodes = self.own, 1 << level
        shape = (len(own), nodes, features, BINS)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, s = np.zeros(shape, np.int64), np.zeros(shape)
            for fold, y, x in _blocks(batches):
                sign = 2.0 * y - 1
                for k, columns in enumerate(own):
                    if fold == k:
                        continue
                    bins = x[columns]
                    margin = sum(each.margins(k, bins) for each in trees)
                    residual = np.rint(4 * UNIT * sign / (1 + np.exp(2 * sign * margin))) if trees else UNIT * sign
                    at = tree.places(k, bins, level).astype(np.int64) * BINS
                    for f in range(features):
                        cell = at + bins[f]
                        n[k, :, f] += np.bincount(cell, minlength=nodes * BINS).reshape(nodes, BINS)
                        s[k, :, f] += np.bincount(cell, residual, nodes * BINS).reshape(nodes, BINS)
            there = np.flatnonzero(n)
            if len(there):
                yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(n.ravel()[there]), pa.array(s.ravel()[there].astype(np.int64))], names=["cell", "n", "s"])

        # a row for each model, node, feature and bin
        rows = self.blocks.mapInArrow(add, "cell long, n long, s long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
        n, s = np.zeros(shape), np.zeros(shape)
        if rows:
            cell, n_there, s_there = map(np.array, zip(*rows, strict=True))
            n.ravel()[cell], s.ravel()[cell] = n_there, s_there / UNIT
        return n, s

    def _forest(self, k: int, trees: list[Trees], inner: int) -> Forest:
        nodes: list[tuple] = []  # feature, threshold, left, right, value, cover, gain

        def add(tree: Trees, node: int) -> int:
            at, f = len(nodes), int(tree.feature[k, node]) if node < inner else -1
            if f < 0:
                nodes.append((-1, np.nan, -1, -1, tree.weight * tree.mean[k, node], tree.count[k, node], -1.0))
                return at
            nodes.append(())
            left, right = add(tree, 2 * node + 1), add(tree, 2 * node + 2)
            nodes[at] = (f, self.cuts[self.own[k][f]][tree.cut[k, node]], left, right, 0.0, tree.count[k, node], tree.gain[k, node])
            return at

        roots = [add(tree, 0) for tree in trees]
        feature, threshold, left, right, value, cover, gain = map(np.array, zip(*nodes, strict=True))
        return Forest(feature, threshold.astype(np.float64), left, right, value, cover, gain, {}, np.array(roots))

    def losses(self, forests: list[Forest]) -> list[list[float]]:
        """Of each model the mean log loss by its number of first trees, over the rows of the fold that it leaves out; none without such rows."""
        own, cuts = self.own, self.cuts

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {}
            for k, y, x in _blocks(batches):
                if k >= 0:
                    # a bin's stand-in is the value that it ends with
                    ends = np.stack([np.append(cuts[c], np.inf)[x[c]] for c in own[k]], axis=1)
                    margins = np.cumsum(forests[k].values(ends), axis=1)
                    loss = np.rint(np.logaddexp(0, np.where(y == 1, -2.0, 2.0)[:, None] * margins) * UNIT).sum(0).astype(np.int64)
                    before, n = total.get(k, (0, 0))
                    total[k] = before + loss, n + len(y)
            for k, (loss, n) in total.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(loss), k)), pa.array(np.arange(len(loss))), pa.array(loss), pa.array(np.full(len(loss), n))], names=["model", "tree", "loss", "n"])

        # a row for each model and tree
        rows = self.blocks.mapInArrow(add, "model long, tree long, loss long, n long").groupBy("model", "tree").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n")).orderBy("model", "tree").collect()
        return [[r["loss"] / UNIT / r["n"] for r in rows if r["model"] == k] for k in range(len(own))]


def packed(df: DataFrame, columns: list[str], own: list[list[int]], label: str, fold: str | None = None) -> Packed:
    """The labelled rows of a written table as blocks; labels are 0 or 1, and without a ``fold`` every model is grown on all rows."""
    known = df.filter(F.col(f"`{label}`").isNotNull())
    cuts = bin_cuts(known, columns)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        size: dict[int, int] = {}

        def block(k: int) -> pa.RecordBatch:
            y, x = (np.concatenate(z, axis=-1) for z in zip(*held.pop(k), strict=True))
            size.pop(k)
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([y.tobytes()]), pa.array([x.tobytes()])], names=["fold", "y", "x"])

        for b in batches:
            folds, y = (b.column(i).to_numpy() for i in (0, 1))
            if not np.isin(y, (0, 1)).all():
                raise ValueError("labels must be 0 or 1")
            y = y.astype(np.uint8)
            x = np.stack([np.searchsorted(c, b.column(i).to_numpy(zero_copy_only=False)).astype(np.uint8) for i, c in enumerate(cuts, 2)])
            for k in np.unique(folds).tolist():
                rows = folds == k
                held.setdefault(k, []).append((y[rows], x[:, rows]))
                size[k] = size.get(k, 0) + int(rows.sum())
                if size[k] >= BLOCK:
                    yield block(k)
        for k in list(held):
            yield block(k)

    rows = known.select((F.col(f"`{fold}`") if fold else F.lit(-1)).cast("int"), F.col(f"`{label}`").cast("double"), *[F.col(f"`{c}`").cast("double") for c in columns])
    return Packed(written(rows.mapInArrow(pack, "fold int, y binary, x binary"), "blocks"), cuts, own)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for b in batches:
        for fold, y, x in zip(*(c for c in b.columns), strict=True):
            labels = np.frombuffer(y.as_buffer(), np.uint8)
            yield fold.as_py(), labels, np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, len(labels))


@dataclass
class Trees:
    """A tree of each model as heaps [model, node]: feature (-1 without a split), last bin of the left side, gain a row, rows and mean; ``values`` [model, place] are the leaves'."""

    feature: np.ndarray
    cut: np.ndarray
    gain: np.ndarray
    count: np.ndarray
    mean: np.ndarray
    values: np.ndarray
    depth: int
    weight: float = 1.0

    @staticmethod
    def empty(models: int, depth: int) -> Trees:
        inner, leaves = (1 << depth) - 1, 1 << depth
        return Trees(np.full((models, inner), -1), np.zeros((models, inner), np.int64), np.zeros((models, inner)), np.zeros((models, inner + leaves)), np.zeros((models, inner + leaves)), np.zeros((models, leaves)), depth)

    def places(self, k: int, bins: np.ndarray, level: int) -> np.ndarray:
        """The rows' nodes in a level, from 0; all rows of a node without a split go left."""
        small = np.min_scalar_type((1 << level) - 1)

        def below(node: int, levels: int):
            if levels == 0:
                return small.type(0)
            left = below(2 * node + 1, levels - 1)
            if self.feature[k, node] < 0:
                return left
            to_right = (bins[self.feature[k, node]] > int(self.cut[k, node])).view(np.uint8).astype(small, copy=False)
            if levels == 1:
                return to_right
            right = below(2 * node + 2, levels - 1) | small.type(1 << (levels - 1))
            return left ^ ((left ^ right) & np.negative(to_right))  # all bits or none

        return np.broadcast_to(below(0, level), bins.shape[1])

    def margins(self, k: int, bins: np.ndarray) -> np.ndarray:
        return self.values[k].take(self.places(k, bins, self.depth))

    def split(self, level: int, n: np.ndarray, s: np.ndarray) -> None:
        """Splits the level's nodes where the squared error falls most, the first of equal features and bins."""
        first = (1 << level) - 1
        if level == 0:
            self.count[:, 0], total = n[:, 0, 0].sum(-1), s[:, 0, 0].sum(-1)
            if not self.count[:, 0].all():
                raise ValueError("a model without labelled rows to grow on")
            self.mean[:, 0] = total / self.count[:, 0]
        rows = self.count[:, first : 2 * first + 1, None, None]  # none below a node without a split
        nl, sl = n.cumsum(-1), s.cumsum(-1)
        nr, sr, whole = rows - nl, sl[..., -1:] - sl, sl[..., -1:]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where((nl > 0) & (nr > 0), (sl * sl / nl + sr * sr / nr - whole * whole / rows) / rows, 0.0)
        flat = gain.reshape(*gain.shape[:2], -1)
        best = flat.argmax(-1)
        for k, j in zip(*np.nonzero(flat.max(-1) > 1e-12), strict=True):
            node, (f, b) = first + j, divmod(int(best[k, j]), n.shape[-1])
            self.feature[k, node], self.cut[k, node], self.gain[k, node] = f, b, flat[k, j, best[k, j]]
            for child, rows_of, sum_of in ((2 * node + 1, nl, sl), (2 * node + 2, nr, sr)):
                self.count[k, child], self.mean[k, child] = rows_of[k, j, f, b], sum_of[k, j, f, b] / rows_of[k, j, f, b]

    def close(self, weight: float) -> None:
        """Gives the leaves their values: a node that isn't split is the leftmost leaf below it."""
        self.weight = weight
        for level in range(self.depth + 1):
            first = (1 << level) - 1
            for k, j in np.ndindex(len(self.mean), 1 << level):
                if level == self.depth or self.feature[k, first + j] < 0:
                    if self.count[k, first + j] > 0:
                        self.values[k, j << (self.depth - level)] = weight * self.mean[k, first + j]

"""Boosted trees as arrays: scores of each number of trees, the best of them, importances, and contributions of features.

A fitted model's nodes (their number is the model's, not the data's) are read from its saved form and go to the tasks; rows pass through them in
numpy batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ptclake.sources.scratch import scratch_path

#: Different features on the way to a leaf, at most: a leaf has a table of as many bits.
DEEPEST = 12
#: Rows that go through the trees at once.
ROWS = 1024


@dataclass
class Forest:
    """Nodes of all trees: feature (-1 in a leaf), threshold, children, value (with the tree's weight), rows that came by and gain; ``roots`` by tree.

    A row goes left at a threshold that isn't below its value, and at a category of ``lefts``; a missing value goes right.
    """

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray
    lefts: dict[int, np.ndarray]
    roots: np.ndarray

    def first(self, trees: int) -> Forest:
        """The forest of the first trees."""
        end = int(self.roots[trees]) if trees < len(self.roots) else len(self.feature)
        each = (x[:end] for x in (self.feature, self.threshold, self.left, self.right, self.value, self.cover, self.gain))
        return Forest(*each, {k: v for k, v in self.lefts.items() if k < end}, self.roots[:trees])

    def goes_left(self, node: int, x: np.ndarray) -> np.ndarray:
        own = x[:, self.feature[node]]
        return np.isin(own, self.lefts[node]) if node in self.lefts else own <= self.threshold[node]

    def values(self, x: np.ndarray) -> np.ndarray:
        """[row, tree]: what each tree adds to the margin."""
        out = np.empty((len(x), len(self.roots)))
        for t, root in enumerate(self.roots.tolist()):
            todo = [(root, np.arange(len(x)))]
            while todo:
                node, rows = todo.pop()
                if self.feature[node] < 0:
                    out[rows, t] = self.value[node]
                elif len(rows):
                    left = self.goes_left(node, x[rows])
                    todo += [(int(self.left[node]), rows[left]), (int(self.right[node]), rows[~left])]
        return out

    def importances(self, features: int) -> np.ndarray:
        """Gain times rows of each feature's splits over all trees, as shares of the whole."""
        inner = self.feature >= 0
        total = np.bincount(self.feature[inner], (self.gain * self.cover)[inner], features)
        return total / total.sum() if total.sum() > 0 else total

    @cached_property
    def base(self) -> float:
        """The mean margin by the rows that the leaves were grown on."""
        return sum(float(leaf.weight) * leaf.value for leaf in self.leaves)

    @cached_property
    def leaves(self) -> list[Leaf]:
        out = []
        for root in self.roots.tolist():
            todo: list[tuple[int, list[tuple[int, bool]]]] = [(root, [])]
            while todo:
                node, way = todo.pop()
                if self.feature[node] < 0:
                    out.append(Leaf.of(self, way, float(self.value[node])))
                else:
                    todo += [(int(self.left[node]), [*way, (node, True)]), (int(self.right[node]), [*way, (node, False)])]
        return out

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """[row, feature]: Shapley values of the game in which a feature that isn't known follows both branches by the rows that came by."""
        columns, out = np.asfortranarray(x), np.zeros(x.shape, order="F")
        left = {int(n): self.goes_left(int(n), columns) for n in np.flatnonzero(self.feature >= 0)}
        ways = {(n, to_left): go if to_left else ~go for n, go in left.items() for to_left in (True, False)}
        for leaf in self.leaves:
            mask = np.zeros(len(x), np.min_scalar_type((1 << len(leaf.features)) - 1))
            for bit, steps in enumerate(leaf.steps):
                ok = reduce(np.logical_and, [ways[step] for step in steps])
                mask |= ok.astype(mask.dtype) << mask.dtype.type(bit)
            for f, of_masks in zip(leaf.features, leaf.table.T.copy(), strict=True):
                out[:, f] += of_masks.take(mask)
        return out


@dataclass
class Leaf:
    """A leaf: its different features, the steps of each, the share of rows that reach it, and [met features as bits, feature]: what it gives to each."""

    features: list[int]
    steps: list[list[tuple[int, bool]]]
    weight: float
    value: float
    table: np.ndarray

    @staticmethod
    def of(forest: Forest, way: list[tuple[int, bool]], value: float) -> Leaf:
        by: dict[int, list[tuple[int, bool]]] = {}
        share: dict[int, float] = {}
        for node, to_left in way:
            f = int(forest.feature[node])
            child = forest.left[node] if to_left else forest.right[node]
            by.setdefault(f, []).append((node, to_left))
            share[f] = share.get(f, 1.0) * float(forest.cover[child]) / float(forest.cover[node])
        d = len(by)
        if d > DEEPEST:
            raise ValueError(f"a leaf behind {d} features; at most {DEEPEST} can be explained")
        z = np.array([share[f] for f in by])
        met = (np.arange(1 << d)[:, None] >> np.arange(d)[None, :]) & 1
        table = np.zeros((1 << d, d))
        size = np.ones(d) if d else np.zeros(0)
        for k in range(1, d):  # weight of a coalition of k others: k! (d - 1 - k)! / d!
            size[k] = size[k - 1] * k / (d - k)
        size = size / d if d else size
        for f in range(d):
            ways = np.zeros((1 << d, d))  # of the other features, how much each number of known ones gives
            ways[:, 0] = 1
            for g in range(d):
                if g != f:
                    known = np.concatenate([np.zeros((1 << d, 1)), ways[:, :-1]], axis=1) * met[:, g : g + 1]
                    ways = ways * z[g] + known
            table[:, f] = value * (met[:, f] - z[f]) * (ways @ size)
        return Leaf(list(by), list(by.values()), float(np.prod(z)), value, table)


def forest_of(model) -> Forest:
    """The arrays of a fitted ``GBTClassificationModel``, from its saved form."""
    spark = SparkSession.builder.getOrCreate()
    path = scratch_path(spark, "trees")
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()  # the model's nodes
    weights = list(model.treeWeights)
    roots = [k for k, r in enumerate(rows) if r["id"] == 0]
    base = {rows[k]["treeID"]: k for k in roots}
    lefts = {k: np.array(r["split"]["leftCategoriesOrThreshold"]) for k, r in enumerate(rows) if r["split"]["featureIndex"] >= 0 and r["split"]["numCategories"] >= 0}
    cut = [r["split"]["leftCategoriesOrThreshold"][0] if r["split"]["featureIndex"] >= 0 and k not in lefts else np.nan for k, r in enumerate(rows)]
    child = lambda c: np.array([base[r["treeID"]] + r[c] if r[c] >= 0 else -1 for r in rows])
    return Forest(np.array([r["split"]["featureIndex"] for r in rows]), np.array(cut, np.float64), child("leftChild"), child("rightChild"), np.array([r["prediction"] * weights[r["treeID"]] for r in rows]), np.array([r["rawCount"] for r in rows], np.float64), np.array([r["gain"] for r in rows]), lefts, np.array(roots))


def forest_table(spark: SparkSession, forest: Forest) -> DataFrame:
    """A row for each node of a forest, to be written."""
    nodes = zip(*(x.tolist() for x in (forest.feature, forest.threshold, forest.left, forest.right, forest.value, forest.cover, forest.gain)), strict=True)
    roots = set(forest.roots.tolist())
    rows = [(k, k in roots, *node, forest.lefts[k].tolist() if k in forest.lefts else None) for k, node in enumerate(nodes)]
    return spark.createDataFrame(rows, "node int, root boolean, feature int, threshold double, left int, right int, value double, cover double, gain double, lefts array<double>")


def table_forest(table: DataFrame) -> Forest:
    """The forest of a table of nodes."""
    rows = table.orderBy("node").collect()  # the model's nodes
    of = lambda name: np.array([r[name] for r in rows])
    return Forest(*map(of, ("feature", "threshold", "left", "right", "value", "cover", "gain")), {r["node"]: np.array(r["lefts"]) for r in rows if r["lefts"] is not None}, np.flatnonzero(of("root")))


def _array(df: DataFrame, features: str) -> Column:
    return F.col(features) if df.schema[features].dataType.simpleString().startswith("array") else vector_to_array(features)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from (b.slice(k, ROWS) for k in range(0, len(b), ROWS))


def staged_losses(df: DataFrame, forest: Forest, label: str, features: str = "_features") -> DataFrame:
    """trees (from 1), log_loss and n: the loss of each number of first trees over the rows with a label, from one pass."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(forest.roots)), 0
        for b in _parts(batches):
            margins = np.cumsum(forest.values(_matrix(b.column(0))), axis=1)
            sign = np.where(b.column(1).to_numpy() == 1, -2.0, 2.0)
            total, n = total + np.logaddexp(0, sign[:, None] * margins).sum(0), n + len(b)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, len(total) + 1, dtype=np.int32)), pa.array(total), pa.array(np.full(len(total), n, np.int64))], names=["trees", "loss", "n"])

    rows = df.filter(F.col(label).isNotNull()).select(_array(df, features).alias("x"), F.col(label).cast("int").alias("y"))
    g = rows.mapInArrow(add, "trees int, loss double, n long").groupBy("trees").agg((F.sum("loss") / F.sum("n")).alias("log_loss"), F.sum("n").alias("n"))
    return g.select("trees", "log_loss", "n")


def best_trees(losses: list[float], patience: int) -> int:
    """The number of trees with the least loss, before none is better for ``patience`` more; the fewest of equal ones."""
    best = 0
    for k, loss in enumerate(losses):
        if loss < losses[best]:
            best = k
        elif k - best >= patience:
            break
    return best + 1


def forest_scores(df: DataFrame, forest: Forest | list[Forest], features: str = "_features", name: str = "score", by: str | None = None) -> DataFrame:
    """The probability of label 1 beside each row, by all trees of the forest, or of the one of a list that the number in ``by`` names."""
    forests = forest if by else [forest]

    @F.arrow_udf("double")
    def probability(k: pa.Array, x: pa.Array) -> pa.Array:
        own, rows, out = k.to_numpy(), _matrix(x), np.zeros(len(x))
        for i, f in enumerate(forests):
            for at in _batches(np.flatnonzero(own == i)):
                out[at] = 1 / (1 + np.exp(-2 * f.values(rows[at]).sum(1)))
        return pa.array(out)

    return df.withColumn(name, probability(F.col(by) if by else F.lit(0), _array(df, features)))


def _batches(rows: np.ndarray) -> Iterator[np.ndarray]:
    yield from (rows[k : k + ROWS] for k in range(0, len(rows), ROWS))


def contributions(df: DataFrame, forest: Forest | list[Forest], names: list[str], id_col: str, features: str = "_features", by: str | None = None) -> DataFrame:
    """id, feature, contribution and base: a row for each feature; a row's contributions and the base add up to its margin (half its log-odds).

    With ``by``, a row's forest is the one of a list that the number there names.
    """
    forests = forest if by else [forest]

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = pa.array(names)
        for b in _parts(batches):
            own, x = b.column(2).to_numpy(), _matrix(b.column(1))
            for k, f in enumerate(forests):
                at = np.flatnonzero(own == k)
                if len(at):
                    c = f.contributions(x[at])
                    ids = b.column(0).take(pa.array(np.repeat(at, len(names))))
                    yield pa.RecordBatch.from_arrays([ids, label.take(pa.array(np.tile(np.arange(len(names)), len(at)))), pa.array(c.ravel()), pa.array(np.full(c.size, f.base))], names=[id_col, "feature", "contribution", "base"])

    rows = df.select(f"`{id_col}`", _array(df, features).alias("_x"), (F.col(by) if by else F.lit(0)).alias("_by"))
    return rows.mapInArrow(explain, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, feature string, contribution double, base double")


def contribution_sums(df: DataFrame, forest: Forest | list[Forest], names: list[str], features: str = "_features", by: str | None = None) -> DataFrame:
    """feature, total and n: ``contributions``' absolute values added up in the tasks, a row for each feature and batch, for means over tables of any size."""
    forests = forest if by else [forest]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, x, total = b.column(1).to_numpy(), _matrix(b.column(0)), np.zeros(len(names))
            for k, f in enumerate(forests):
                total += np.abs(f.contributions(x[own == k])).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total), pa.array(np.full(len(names), len(b)))], names=["feature", "total", "n"])

    return df.select(_array(df, features).alias("_x"), (F.col(by) if by else F.lit(0)).alias("_by")).mapInArrow(add, "feature string, total double, n long")

"""Multi-class AdaBoost with class probabilities (the SAMME.R rule) over small weighted trees.

Features are turned into bin numbers once. What a round needs beside them is a row's weight, which
follows from the sum of its log probabilities over the trees so far; trees that are newer than the
last written sum are added up while the rows are read. So a round moves no features, and a level of
its tree is one pass that ends in a histogram of (node, feature, bin, class).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.sql import DataFrame, SparkSession, functions as F

from keyrhythm.operators.stored import Stored
from keyrhythm.operators.voting import most_likely
from keyrhythm.session import settled

SMALLEST = float(np.finfo(float).eps)


def cut_points(rows: DataFrame, vector: str, bins: int) -> list[np.ndarray]:
    """Where each feature may be cut, at most ``bins - 1`` values a feature.

    Midpoints between all values of a feature that has at most ``bins`` of them, else its
    approximate quantiles. A task sends at most ``bins + 1`` values of a feature.
    """
    def some_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            x = _matrix(batch.column(0))
            held = held or [np.empty(0)] * x.shape[1]
            for j in range(x.shape[1]):
                if len(held[j]) <= bins:
                    known = x[~np.isnan(x[:, j]), j]
                    held[j] = np.unique(np.concatenate([held[j], known]))[: bins + 1]
        for j, values in enumerate(held):
            yield pa.RecordBatch.from_pydict({"j": pa.array(np.full(len(values), j), pa.int32()), "v": pa.array(values, pa.float64())})

    width = rows.agg(F.max(F.size(vector))).first()[0]
    seen = rows.select(vector).mapInArrow(some_values, "j int, v double").distinct()
    values = F.sort_array(F.collect_set("v"))
    few = {r["j"]: np.array(r["v"]) for r in seen.groupBy("j").agg(F.slice(values, 1, bins + 1).alias("v")).collect()}
    many = [j for j, v in few.items() if len(v) > bins]
    quantiles = {}
    if many:
        ranks = F.array(*[F.lit((i + 1) / bins) for i in range(bins - 1)])
        known = [F.when(~F.isnan(F.get(vector, F.lit(j))), F.get(vector, F.lit(j))) for j in many]
        told = rows.agg(*[F.percentile_approx(v, ranks, 10_000).alias(str(j)) for j, v in zip(many, known)]).first()
        quantiles = {j: np.unique(told[str(j)]) for j in many}
    halves = {j: (v[1:] + v[:-1]) / 2 for j, v in few.items()}
    return [quantiles.get(j, halves.get(j, np.empty(0))) for j in range(width)]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass
class Tree:
    """A binary tree: ``feature`` is -1 at a leaf, the children of a node are ``left`` and ``left`` + 1."""

    feature: np.ndarray
    cut: np.ndarray
    gain: np.ndarray
    left: np.ndarray
    logs: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row reaches; right of a node are values above its cut."""
        node = np.zeros(len(x), np.int64)
        moving = np.arange(len(x)) if self.feature[0] >= 0 else np.empty(0, np.int64)
        while len(moving):
            at = node[moving]
            at = self.left[at] + (x[moving, self.feature[at]] > self.cut[at])
            node[moving] = at
            moving = moving[self.feature[at] >= 0]
        return node


class AdaBoost(Estimator, HasFeaturesCol, HasLabelCol, Stored):
    """Each round fits a tree on reweighted rows and stops early once no row is wrong.

    A deep tree is right on every training row in the first round, which ends the boosting there; a
    shallow ``maxDepth`` is what makes the rounds useful. The sums of log probabilities are written
    anew every ``settle_every`` rounds, and the table before is given up. The driver holds the trees
    and a histogram (nodes x features x ``bins`` x classes) of at most ``most_cells``; the nodes of a
    level that need more are taken in several passes. Rows without a label take no part; a missing
    feature (NaN) lies left of every cut.
    """

    def __init__(self, rounds: int = 50, rate: float = 0.5, maxDepth: int = 2, featuresCol: str = "features",
                 labelCol: str = "label", bins: int = 64, settle_every: int = 25, most_cells: int = 1 << 22):
        super().__init__()
        self._set(featuresCol=featuresCol, labelCol=labelCol)
        self.rounds, self.rate, self.depth, self.bins = rounds, rate, maxDepth, bins
        self.settle_every, self.most_cells = settle_every, most_cells

    def plain(self) -> dict:
        return {"rounds": self.rounds, "rate": self.rate, "maxDepth": self.depth, "bins": self.bins,
                "settle_every": self.settle_every, "most_cells": self.most_cells}

    def _fit(self, dataset: DataFrame) -> "AdaBoostModel":
        rows = dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("int").alias("label")).where("label IS NOT NULL")
        top = rows.agg(F.max("label")).first()[0]
        if top is None:
            raise ValueError("boosting needs labelled rows")
        classes = max(2, top + 1)
        cuts = cut_points(rows, "x", self.bins)
        state = settled(_binned(rows, cuts, classes))
        tasks = state.rdd.getNumPartitions()
        trees: list[Tree] = []
        fresh: list[Tree] = []
        reference = 0.0
        try:
            for number in range(self.rounds):
                tree, wrong, total = self._round(state, fresh, classes, cuts, reference, tasks)
                trees.append(tree)
                if wrong <= 0 or not math.isfinite(total):
                    break
                fresh.append(tree)
                # Weights are told in relation to the last total, so that they neither vanish nor overflow.
                reference += math.log(total)
                if len(fresh) == self.settle_every and number + 1 < self.rounds:
                    older, state = state, settled(_advanced(state, fresh, classes))
                    older.unpersist()
                    fresh, tasks = [], state.rdd.getNumPartitions()
        finally:
            state.unpersist()
        return AdaBoostModel(_with_values(trees, cuts), classes, len(cuts), self.getFeaturesCol())

    def _round(self, state: DataFrame, fresh: list[Tree], classes: int, cuts: list[np.ndarray], reference: float,
               tasks: int):
        """A tree on the present weights, the weight of the rows it gets wrong, and the total weight."""
        tree = Tree(*(np.full(1, v) for v in (-1, 0.0, 0.0, -1)), np.zeros((1, classes)))
        weights = [np.zeros(classes)]
        at_once = max(1, self.most_cells // (len(cuts) * self.bins * classes))
        active = [0]
        for _ in range(self.depth):
            below: list[int] = []
            for start in range(0, len(active), at_once):
                nodes = active[start : start + at_once]
                cells = _histogram(state, fresh, tree, nodes, classes, len(cuts), self.bins, self.rate, reference, tasks)
                if nodes == [0]:
                    weights[0] = cells[0, 0].sum(axis=0)
                for node, own in zip(nodes, cells):
                    below += _split(tree, weights, node, own, cuts)
            active = below
            if not active:
                break
        tree.logs = np.zeros((len(weights), classes))
        wrong, total = 0.0, float(weights[0].sum())
        for node in np.flatnonzero(tree.feature < 0):
            own = weights[node]
            tree.logs[node] = np.log(np.maximum(own / own.sum() if own.sum() > 0 else 1 / classes, SMALLEST))
            wrong += own.sum() - own.max()
        return tree, wrong if wrong > 1e-12 * total else 0.0, total


def _binned(rows: DataFrame, cuts: list[np.ndarray], classes: int) -> DataFrame:
    """(label, bins, sums): bin b of a feature holds the values above b of its cuts."""
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0))
            x = np.where(np.isnan(x), -np.inf, x)
            bins = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]).astype(np.int16)
            yield pa.RecordBatch.from_arrays([batch.column(1), _lists(bins, pa.int16()), _lists(np.zeros((len(x), classes)), pa.float64())],
                                             names=["label", "bins", "sums"])

    return rows.select("x", "label").mapInArrow(coded, "label int, bins array<smallint>, sums array<double>")


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(values.ravel(), kind))


def _sums(sums: np.ndarray, bins: np.ndarray, fresh: list[Tree]) -> np.ndarray:
    for tree in fresh:
        sums = sums + tree.logs[tree.leaves(bins)]
    return sums


def _advanced(state: DataFrame, fresh: list[Tree], classes: int) -> DataFrame:
    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = _sums(_matrix(batch.column("sums")), _matrix(batch.column("bins")), fresh)
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("bins"), _lists(sums, pa.float64())], names=["label", "bins", "sums"])

    return state.mapInArrow(added, state.schema)


def _histogram(state: DataFrame, fresh: list[Tree], tree: Tree, nodes: list[int], classes: int, features: int, bins: int,
               rate: float, reference: float, tasks: int) -> np.ndarray:
    """Weights by (node, feature, bin, class), summed in the ``tasks`` first; one task's sums are the whole."""
    shape = (len(nodes), features, bins, classes)
    factor = -rate * (classes - 1) / classes
    slot = np.full(len(tree.feature), -1)
    slot[nodes] = np.arange(len(nodes))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(int(np.prod(shape)))
        for batch in batches:
            label, x = batch.column("label").to_numpy(), _matrix(batch.column("bins"))
            logs = _sums(_matrix(batch.column("sums")), x, fresh)
            own = logs[np.arange(len(label)), label]
            weight = np.exp(factor * (own - (logs.sum(axis=1) - own) / (classes - 1)) - reference)
            node = slot[tree.leaves(x)]
            here = np.flatnonzero(node >= 0)
            place = ((node[here, None] * features + np.arange(features)) * bins + x[here]) * classes + label[here, None]
            cells += np.bincount(place.ravel(), np.repeat(weight[here], features), len(cells))
        cell = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(cells[cell])], names=["cell", "w"])

    told = state.mapInArrow(counted, "cell bigint, w double")
    if tasks > 1:
        told = told.groupBy("cell").agg(F.sum("w").alias("w"))
    told = told.toArrow()
    out = np.zeros(int(np.prod(shape)))
    out[told["cell"].to_numpy()] = told["w"].to_numpy()
    return out.reshape(shape)


def _split(tree: Tree, weights: list[np.ndarray], node: int, cells: np.ndarray, cuts: list[np.ndarray]) -> list[int]:
    """Cut a node where the weighted Gini impurity falls most; the first feature and the lowest cut win a tie.

    Returns the children that hold rows of several classes.
    """
    whole = cells[0].sum(axis=0)
    if (whole > 0).sum() < 2:
        return []
    left = np.cumsum(cells, axis=1)[:, :-1]
    right = np.cumsum(cells[:, ::-1], axis=1)[:, ::-1][:, 1:]
    below, above = left.sum(axis=2), right.sum(axis=2)
    # Larger sums of squares over the sides' weights mean purer sides.
    with np.errstate(divide="ignore", invalid="ignore"):
        purity = (left**2).sum(axis=2) / below + (right**2).sum(axis=2) / above
    usable = (below > 0) & (above > 0)
    for j, c in enumerate(cuts):
        usable[j, len(c):] = False
    share = np.where(usable, purity / whole.sum() - (whole**2).sum() / whole.sum() ** 2, 0.0).round(12)
    j, at = np.unravel_index(share.argmax(), share.shape)
    if share[j, at] <= 0:
        return []
    child = len(tree.feature)
    tree.feature[node], tree.cut[node], tree.gain[node], tree.left[node] = j, at, share[j, at] * whole.sum(), child
    for name, empty in (("feature", -1), ("cut", 0.0), ("gain", 0.0), ("left", -1)):
        setattr(tree, name, np.append(getattr(tree, name), [empty, empty]))
    weights += [left[j, at], right[j, at]]
    return [i for i in (child, child + 1) if (weights[i] > 0).sum() > 1]


def _with_values(trees: list[Tree], cuts: list[np.ndarray]) -> list[Tree]:
    """Trees whose cuts are values instead of bin numbers."""
    return [
        Tree(t.feature, np.array([cuts[j][int(c)] if j >= 0 else 0.0 for j, c in zip(t.feature, t.cut)]), t.gain, t.left, t.logs)
        for t in trees
    ]


class AdaBoostModel(Model, HasFeaturesCol, Stored):
    """All trees are walked in one function over a batch of rows, however many there are."""

    def __init__(self, trees: list[Tree], classes: int, width: int, features: str = "features"):
        super().__init__()
        self._set(featuresCol=features)
        self.trees, self.classes, self.width = trees, classes, width

    def plain(self) -> dict:
        return {"classes": self.classes, "width": self.width}

    def tables(self) -> dict[str, DataFrame]:
        nodes = [
            (number, node, int(t.feature[node]), float(t.cut[node]), float(t.gain[node]), int(t.left[node]), [float(v) for v in t.logs[node]])
            for number, t in enumerate(self.trees) for node in range(len(t.feature))
        ]
        kind = "tree int, node int, feature int, cut double, gain double, left int, logs array<double>"
        return {"nodes": SparkSession.active().createDataFrame(nodes, kind)}

    @classmethod
    def restored(cls, plain: dict, tables: dict[str, DataFrame], parts: dict) -> "AdaBoostModel":
        # As large as the model that the driver held when it was fitted.
        nodes = tables["nodes"].orderBy("tree", "node").toPandas()
        trees = [
            Tree(*(part[c].to_numpy() for c in ("feature", "cut", "gain", "left")), np.stack(part["logs"].to_numpy()))
            for _, part in nodes.groupby("tree")
        ]
        return cls(trees, plain["classes"], plain["width"])

    @property
    def featureImportances(self):
        """Mean over the rounds of each feature's share of its tree's gain."""
        shares = np.zeros(self.width)
        for t in self.trees:
            used = t.feature >= 0
            own = np.bincount(t.feature[used], t.gain[used], self.width)
            shares += own / own.sum() if own.sum() > 0 else 0
        return Vectors.dense(shares / shares.sum() if shares.sum() > 0 else shares)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        trees, classes = self.trees, self.classes

        @F.pandas_udf("array<double>")
        def decision(x: pd.Series) -> pd.Series:
            rows = np.stack(x.to_numpy()).astype(float)
            sums = sum(t.logs[t.leaves(rows)] for t in trees) / len(trees)
            return pd.Series(list(sums - sums.mean(axis=1, keepdims=True)))

        told = dataset.withColumn("_decision", decision(vector_to_array(self.getFeaturesCol())))
        raised = F.transform("_decision", lambda s: F.exp(s - F.array_max("_decision")))
        total = F.aggregate("_exp", F.lit(0.0), lambda a, b: a + b)
        return told.withColumn("_exp", raised).select(
            *dataset.columns,
            array_to_vector(F.transform("_exp", lambda e: e / total)).alias("probability"),
            most_likely(F.col("_decision")).alias("prediction"),
        )

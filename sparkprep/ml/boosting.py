"""Gradient boosting over any number of classes, with probabilities.

Each round grows one regression tree per class on the gradients of the
softmax loss (one-hot label minus probability). A tree's levels are found from histograms: tasks sum up
rows, gradients and curvatures per class, node, feature and bin, Spark adds these sums, and
the driver, which gets only the sums, chooses the splits. All classes share a job, so a
round takes as many jobs as its trees have levels. Leaves take a Newton step from the same sums.

Features are cut into bins once (quantiles from one aggregate); rows travel as a byte per feature
beside their raw scores, in a table in the shared checkpoint folder that is written anew every
``ROUNDS_PER_TABLE`` rounds, so that tasks replay only the trees since then.

Defined cases: missing values (NaN) lie above every threshold; a node whose rows
have no better split becomes a leaf; of equal splits the first feature and lowest bin is taken; a
class that is missing between others gets no probability; an empty table raises.
"""

from __future__ import annotations

import json
import math
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import (HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol, HasProbabilityCol,
                                     HasRawPredictionCol, HasStepSize)
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROUNDS_PER_TABLE = 10
#: Gains and curvatures at or below these count as none.
NO_GAIN, NO_CURVATURE = 1e-12, 1e-150
BINNED = "label int, bins binary, scores binary"
SUMS = "cell long, n long, g double, h double"
LOSS = -1


def matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), width)


def bins_of(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin per value: the number of thresholds below it."""
    out = np.empty(values.shape, dtype=np.uint8)
    for f, cut in enumerate(cuts):
        out[:, f] = np.searchsorted(cut, values[:, f], side="left")
    return out


def nodes_of(tree: dict, bins: np.ndarray) -> np.ndarray:
    """The last node that each row reaches."""
    feature, split, left, right = (np.asarray(tree[k]) for k in ("feature", "bin", "left", "right"))
    at, rows = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
    while True:
        inner = feature[at] >= 0
        if not inner.any():
            return at
        f = np.where(inner, feature[at], 0)
        step = np.where(bins[rows, f] <= split[at], left[at], right[at])
        at = np.where(inner, step, at)


def add_trees(scores: np.ndarray, bins: np.ndarray, rounds: list[list[dict]]) -> np.ndarray:
    out = scores.copy()
    for trees in rounds:
        for k, tree in enumerate(trees):
            out[:, k] += np.asarray(tree["value"])[nodes_of(tree, bins)]
    return out


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _binned(cuts: list[np.ndarray], start: np.ndarray):
    def run(batches):
        for batch in batches:
            values = np.array(batch.column(1).to_pylist(), dtype=np.float64).reshape(batch.num_rows, len(cuts))
            bins, scores = bins_of(values, cuts), start.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array([row.tobytes() for row in bins], pa.binary()),
                                              pa.array([scores] * batch.num_rows, pa.binary())], ["label", "bins", "scores"])
    return run


def _scored(n_features: int, n_classes: int, rounds: list):
    def run(batches):
        for batch in batches:
            bins = matrix(batch.column(1), np.uint8, n_features)
            scores = add_trees(matrix(batch.column(2), np.float64, n_classes), bins, rounds)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([row.tobytes() for row in scores], pa.binary())],
                                             ["label", "bins", "scores"])
    return run


def _summed(n_features: int, n_classes: int, n_bins: int, rounds: list, growing: list[dict]):
    """Sums per cell (open node of a class, feature, bin) of what a task reads, and its loss."""
    base = np.cumsum([0] + [len(t["open"]) for t in growing])
    width = n_features * n_bins

    def run(batches):
        total, loss, rows = np.zeros((3, int(base[-1]) * width)), 0.0, 0
        for batch in batches:
            label = batch.column(0).to_numpy()
            bins = matrix(batch.column(1), np.uint8, n_features)
            p = softmax(add_trees(matrix(batch.column(2), np.float64, n_classes), bins, rounds))
            loss -= float(np.log(np.maximum(p[np.arange(len(label)), label], 1e-300)).sum())
            rows += len(label)
            inner = np.arange(n_features) * n_bins + bins
            for k, tree in enumerate(growing):
                place = np.full(len(tree["feature"]), -1)
                place[tree["open"]] = base[k] + np.arange(len(tree["open"]))
                node = place[nodes_of(tree, bins)]
                here = node >= 0
                cell = (node[here, None] * width + inner[here]).ravel()
                g, h = (label == k)[here] - p[here, k], p[here, k] * (1 - p[here, k])
                for i, weight in enumerate((np.ones(len(g)), g, h)):
                    total[i] += np.bincount(cell, np.repeat(weight, n_features), minlength=total.shape[1])
        cells = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(cells, LOSS)), pa.array(np.append(total[0][cells], rows).astype(np.int64)),
                                          pa.array(np.append(total[1][cells], loss)), pa.array(np.append(total[2][cells], 0.0))], ["cell", "n", "g", "h"])
    return run


def best_split(n: np.ndarray, g: np.ndarray) -> tuple[float, int, int]:
    """Gain, feature and last bin on the left of the best split, from sums per feature and bin."""
    n_left, g_left = np.cumsum(n, axis=1)[:, :-1], np.cumsum(g, axis=1)[:, :-1]
    n_all, g_all = n.sum(axis=1, keepdims=True), g.sum(axis=1, keepdims=True)
    n_right, g_right = n_all - n_left, g_all - g_left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = g_left**2 / n_left + g_right**2 / n_right - g_all**2 / n_all
    gain[(n_left < 1) | (n_right < 1)] = -np.inf
    if not gain.size:
        return -np.inf, 0, 0
    f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return float(gain[f, b]), int(f), int(b)


def newton(g: float, h: float, n_classes: int, step: float) -> float:
    """Step of a leaf."""
    return step * (n_classes - 1) / n_classes * g / h if h > NO_CURVATURE else 0.0


class _BoostingParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol, HasMaxIter, HasStepSize):
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits of a tree", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature, up to 256", TypeConverters.toInt)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(maxIter=100, maxDepth=3, stepSize=0.1, maxBins=32)


class SoftmaxBoosting(Estimator, _BoostingParams, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator; the label is a class index from 0."""

    @keyword_only
    def __init__(self, *, maxIter: int = 100, maxDepth: int = 3, stepSize: float = 0.1, maxBins: int = 32,
                 featuresCol: str = "features", labelCol: str = "label"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _cuts(self, rows: DataFrame, n_features: int) -> list[np.ndarray]:
        n_bins = self.getOrDefault("maxBins")
        shares = [i / n_bins for i in range(n_bins + 1)]
        value = lambda f: F.col("x")[f]
        found = rows.agg(*[F.percentile_approx(F.when(~F.isnan(value(f)), value(f)), shares, 100 * n_bins).alias(f"c{f}")
                           for f in range(n_features)]).first()
        # only missing values lie above the last threshold, the largest value
        return [np.unique(np.array(values or [], dtype=np.float64)) for values in found]

    def _fit(self, dataset: DataFrame) -> "SoftmaxBoostingModel":
        rows = dataset.select(F.col(self.getLabelCol()).cast("int").alias("label"), vector_to_array(self.getFeaturesCol()).alias("x"))
        counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
        if not counts:
            raise ValueError("boosting needs rows")
        n_classes, n = max(counts) + 1, sum(counts.values())
        n_features = len(rows.first()["x"])
        cuts = self._cuts(rows, n_features)
        start = np.array([math.log(counts[k] / n) if k in counts else -1e3 for k in range(n_classes)])
        table = cut_lineage(rows.mapInArrow(_binned(cuts, start), BINNED))
        n_bins = max((len(c) for c in cuts), default=0) + 1
        rounds, since, losses, importance = [], [], [], np.zeros(n_features)
        for _ in range(self.getMaxIter()):
            trees = [{"feature": [-1], "bin": [0], "left": [0], "right": [0], "value": [0.0], "open": [0]} for _ in range(n_classes)]
            for level in range(self.getOrDefault("maxDepth")):
                if not any(t["open"] for t in trees):
                    break
                sums = self._sums(table, n_features, n_classes, n_bins, since, trees)
                if level == 0:
                    losses.append(sums.pop(LOSS)[1] / n)
                self._grow(trees, sums, n_features, n_classes, n_bins, importance)
            for t in trees:
                t.pop("open")
            rounds.append(trees)
            since = [*since, trees]
            if len(since) == ROUNDS_PER_TABLE and len(rounds) < self.getMaxIter():
                table, since = cut_lineage(table.mapInArrow(_scored(n_features, n_classes, since), BINNED)), []
        total = importance.sum()
        doc = {"start": start.tolist(), "cuts": [c.tolist() for c in cuts], "rounds": rounds, "losses": losses,
               "importances": (importance / total if total else importance).tolist()}
        model = SoftmaxBoostingModel()
        model._set(trees=json.dumps(doc))
        return self._copyValues(model)

    @staticmethod
    def _sums(table, n_features, n_classes, n_bins, since, trees) -> dict:
        """Cell -> (n, g, h); as many cells as open nodes x features x bins."""
        parts = table.mapInArrow(_summed(n_features, n_classes, n_bins, since, trees), SUMS)
        found = parts.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        return {r["cell"]: (r["n"], r["g"], r["h"]) for r in found}

    def _grow(self, trees, sums, n_features, n_classes, n_bins, importance) -> None:
        """One more level: the open nodes are split where that gains, and their values set."""
        flat = np.zeros((3, sum(len(t["open"]) for t in trees) * n_features * n_bins))
        for cell, values in sums.items():
            if cell >= 0:
                flat[:, cell] = values
        blocks = iter(flat.reshape(3, -1, n_features, n_bins).swapaxes(0, 1))
        step = self.getStepSize()
        for tree in trees:
            opened = []
            for node in tree["open"]:
                n, g, h = next(blocks)
                tree["value"][node] = newton(g[0].sum(), h[0].sum(), n_classes, step)
                gain, f, b = best_split(n, g)
                if gain <= NO_GAIN:
                    continue
                importance[f] += gain
                children = []
                for part in (np.s_[f, :b + 1], np.s_[f, b + 1:]):
                    children.append(len(tree["feature"]))
                    for key, value in (("feature", -1), ("bin", 0), ("left", 0), ("right", 0),
                                       ("value", newton(g[part].sum(), h[part].sum(), n_classes, step))):
                        tree[key].append(value)
                tree["feature"][node], tree["bin"][node], (tree["left"][node], tree["right"][node]) = f, b, children
                opened += children
            tree["open"] = opened


class SoftmaxBoostingModel(Model, _BoostingParams, DefaultParamsReadable, DefaultParamsWritable):
    """The fitted trees, as JSON in a parameter, so that the model is saved and loaded like any stage."""

    trees = Param(Params._dummy(), "trees", "fitted trees", TypeConverters.toString)

    def __init__(self):
        super().__init__()

    @property
    def doc(self) -> dict:
        return json.loads(self.getOrDefault("trees"))

    @property
    def featureImportances(self) -> DenseVector:
        return DenseVector(self.doc["importances"])

    @property
    def losses(self) -> list[float]:
        """Mean training loss before each round."""
        return self.doc["losses"]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        doc = self.doc
        cuts, start, rounds = [np.array(c) for c in doc["cuts"]], np.array(doc["start"]), doc["rounds"]

        @F.pandas_udf("array<double>")
        def raw(features: pd.Series) -> pd.Series:
            values = np.array(features.tolist(), dtype=np.float64).reshape(len(features), len(cuts))
            return pd.Series(list(add_trees(np.tile(start, (len(values), 1)), bins_of(values, cuts), rounds)))

        scored = dataset.withColumn(self.getRawPredictionCol(), raw(vector_to_array(self.getFeaturesCol())))
        scores = F.col(self.getRawPredictionCol())
        e = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
        p = F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))
        return (scored.withColumn(self.getProbabilityCol(), array_to_vector(p))
                .withColumn(self.getPredictionCol(), (F.array_position(scores, F.array_max(scores)) - 1).cast("double"))
                .withColumn(self.getRawPredictionCol(), array_to_vector(scores)))

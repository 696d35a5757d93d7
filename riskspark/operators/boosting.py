"""Boosted trees over many rows.

MLlib's ``GBTClassifier`` walks an object a row at every level of every tree. ``Boosted`` grows the same trees
(its split candidates, variance gains, limits and order of ties, its residuals and tree weights) over blocks of
binned features: a pass sums a level's histograms in numpy, reduced by nodes on the executors, which also find
each node's best split; the driver holds the tree being grown. The model is MLlib's own. Trees are equal but
for splits whose gains differ by less than the rounding of a sum, which MLlib's own order of merging decides as
well. Fits that draw rows or features, and those of few rows, are MLlib's.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.session import ensure_checkpoint_dir

MANY = 1_000_000         # rows from which on blocks are used; below, a level is mostly its job's start
BLOCK = 1 << 18          # rows of a block
AT_A_TIME = 1 << 15      # rows of a block that are worked on at a time: a cache's worth
NODES = 4                # nodes of a level that are reduced together


class Boosted(GBTClassifier):
    """``GBTClassifier``, for many rows too."""

    def _fit(self, dataset: DataFrame):
        if self.getSubsamplingRate() < 1.0 or self.getFeatureSubsetStrategy() not in ("all", "1.0"):
            return super()._fit(dataset)
        if self.isSet("validationIndicatorCol") or self.isSet("weightCol") or self.getMinWeightFractionPerNode() > 0.0 or has_categories(dataset, self.getFeaturesCol()):
            return super()._fit(dataset)
        rows = dataset.select(F.col(self.getLabelCol()).cast("double").alias("label"), vector_to_array(self.getFeaturesCol()).alias("x"))
        n = rows.count()
        return super()._fit(dataset) if n < MANY else self._copyValues(fit_blocks(rows, n, self))


def has_categories(df: DataFrame, features: str) -> bool:
    """Whether the features' metadata name nominal attributes."""
    attrs = df.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
    return any(kind != "numeric" for kind in attrs)


# ---------------------------------------------------------------- split candidates
def thresholds(values: np.ndarray, expected: float, n: int, most: int) -> np.ndarray:
    """MLlib's candidates of one continuous feature: midpoints of neighbouring distinct values, all of
    them or ``most`` at about equal shares of the ``expected`` rows, of which the missing ones are zeros."""
    v, count = np.unique(values[values != 0.0], return_counts=True)
    weight = count.astype(float)
    zeros = expected - weight.sum()
    if zeros > np.finfo(float).eps * n * 100:
        at = np.searchsorted(v, 0.0)
        v, weight = np.insert(v, at, 0.0), np.insert(weight, at, zeros)
    if len(v) < 2:
        return np.empty(0)
    middle = (v[:-1] + v[1:]) / 2.0
    if len(middle) <= most:
        return middle
    stride, out, now = expected / (most + 1), [], weight[0]
    target = stride
    for i in range(1, len(v)):
        before, now = now, now + weight[i]
        if abs(before - target) < abs(now - target):
            out.append(middle[i - 1])
            target += stride
    return np.array(out)


def candidates(rows: DataFrame, n: int, bins: int, seed: int) -> list[np.ndarray]:
    """The thresholds of every feature, read off as many rows as MLlib draws for them, and the same ones."""
    spark, required = rows.sparkSession, max(bins * bins, 10_000)
    share = min(1.0, required / n)
    draw = spark.sparkContext._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
    sampled = rows.select("x")._jdf.javaRDD().sample(False, share, draw)
    drawn = DataFrame(spark._jsparkSession.createDataFrame(sampled, rows.select("x")._jdf.schema()), spark)
    x = np.array([r["x"] for r in drawn.collect()])           # about maxBins^2 rows
    return [thresholds(x[:, j], share * n, int(n), bins - 1) for j in range(x.shape[1])]


# ---------------------------------------------------------------- trees and blocks
@dataclass
class Tree:
    """Nodes by heap number (root 1, children 2i and 2i + 1): bin ``cut`` of ``feature`` and below go left."""

    feature: np.ndarray
    cut: np.ndarray
    split: np.ndarray
    value: np.ndarray

    def reached(self, bins: np.ndarray, steps: int) -> np.ndarray:
        node, at = np.ones(len(bins), np.int64), np.arange(len(bins)) * bins.shape[1]
        flat = bins.ravel()
        for _ in range(steps):
            right = flat[at + self.feature[node]] > self.cut[node]
            node = np.where(self.split[node], 2 * node + right, node)
        return node


def binned(rows: DataFrame, cuts: list[np.ndarray]) -> RDD:
    """Blocks (bins, label as -1 or 1, margin, residual) of all rows; the first residual is the label."""
    kind = np.uint8 if max(map(len, cuts)) < 256 else np.uint16 if max(map(len, cuts)) < 1 << 16 else np.int32

    def of_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def block():
            bins, label = (np.concatenate(c) for c in zip(*held))
            return pa.RecordBatch.from_arrays([pa.array([bins.tobytes()], pa.binary()), pa.array([label.tobytes()], pa.binary())], ["bins", "label"])

        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False)
            if not np.isin(label, (0.0, 1.0)).all():
                raise ValueError("boosted trees need labels 0 and 1")
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(label), -1)
            held.append((np.stack([np.searchsorted(c, x[:, j], "left").astype(kind) for j, c in enumerate(cuts)], axis=1), (2 * label - 1).astype(np.int8)))
            if sum(len(y) for _, y in held) >= BLOCK:
                yield block()
                held.clear()
        if held:
            yield block()

    def block(r):
        label = np.frombuffer(r["label"], np.int8)
        return np.frombuffer(r["bins"], kind).reshape(len(label), -1), label, np.zeros(len(label)), label.astype(float)

    return rows.mapInArrow(of_task, "bins binary, label binary").rdd.map(block)


def advanced(blocks: RDD, tree: Tree, weight: float, depth: int) -> RDD:
    """The blocks with the tree's values added to the margins, and the residuals of these."""
    def step(block):
        bins, label, margin, residual = block
        margin, residual = margin.copy(), residual.copy()
        for a in range(0, len(label), AT_A_TIME):
            part = slice(a, a + AT_A_TIME)
            margin[part] += weight * tree.value[tree.reached(bins[part], depth)]
            residual[part] = 4.0 * label[part] / (1.0 + np.exp(2.0 * label[part] * margin[part]))
        return bins, label, margin, residual

    return blocks.map(step)


def histograms(blocks: Iterable[tuple], tree: Tree, level: int, nodes: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number of a run of ``NODES`` of the level's ``nodes``, (3, nodes, features, bins)): rows, sums and sums of
    squares of the residuals of a task's rows."""
    place = np.full(2 << level, -1, np.int64)
    place[nodes] = np.arange(len(nodes))
    total = None
    for bins, _, _, residual in blocks:
        d = bins.shape[1]
        total = np.zeros((3, d, len(nodes) * width)) if total is None else total
        for a in range(0, len(residual), AT_A_TIME):
            b, r = bins[a:a + AT_A_TIME], residual[a:a + AT_A_TIME]
            at = place[tree.reached(b, level)]
            if (at < 0).any():
                on = at >= 0
                b, r, at = b[on], r[on], at[on]
            at, squares = at * width, r * r
            for j in range(d):
                key = at + b[:, j]
                for i, w in enumerate((None, r, squares)):
                    total[i, j] += np.bincount(key, w, len(nodes) * width)
    if total is not None:
        whole = total.reshape(3, -1, len(nodes), width).transpose(0, 2, 1, 3)
        for run in range(0, len(nodes), NODES):
            yield run // NODES, whole[:, run:run + NODES]


def impurity(n: np.ndarray, total: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """MLlib's variance, 0 without rows."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n == 0.0, 0.0, (squares - total * total / n) / n)


@dataclass
class Best:
    gain: float
    feature: int
    cut: int
    stats: np.ndarray        # rows, sum, sum of squares of the node; of its left and right rows
    left: np.ndarray
    right: np.ndarray


def best_splits(h: np.ndarray, of_parent: np.ndarray, n_cuts: np.ndarray, least: int, min_gain: float) -> list[Best]:
    """The best split of each node of (3, nodes, features, bins); ``of_parent``: the nodes' impurities, NaN of a root."""
    sums = np.cumsum(h, axis=3)
    whole = sums[:, :, :, -1:]
    left, right = sums[:, :, :, :-1], whole - sums[:, :, :, :-1]
    li, ri = impurity(*left), impurity(*right)
    own = impurity(*whole[:, :, 0, 0])
    start = np.where(np.isnan(of_parent), own, of_parent)[:, None, None]
    n = left[0] + right[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = start - left[0] / n * li - right[0] / n * ri
    allowed = (left[0] >= least) & (right[0] >= least) & (np.arange(h.shape[3] - 1) < n_cuts[:, None])
    gain = np.where(allowed & (gain >= min_gain), gain, -np.inf)
    out = []
    for i in range(h.shape[1]):
        f, c = np.unravel_index(int(np.argmax(gain[i])), gain[i].shape)
        out.append(Best(float(gain[i, f, c]), int(f), int(c), whole[:, i, 0, 0], left[:, i, f, c], right[:, i, f, c]))
    return out


# ---------------------------------------------------------------- a fit
@dataclass
class Node:
    stats: np.ndarray
    impurity: float
    valid: bool = True
    gain: float = 0.0
    feature: int = -1
    cut: int = -1


def value_of(stats: np.ndarray) -> float:
    return float(stats[1] / stats[0]) if stats[0] else 0.0


def grow(blocks: RDD, depth: int, n_cuts: np.ndarray, least: int, min_gain: float) -> tuple[dict[int, Node], Tree]:
    """One regression tree of the residuals, a job a level."""
    size, width = 2 << depth, int(n_cuts.max()) + 1
    tree = Tree(np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, bool), np.zeros(size))
    nodes: dict[int, Node] = {}
    active = [1]
    for level in range(depth):
        if not active:
            break
        at, parents = np.array(active), np.array([nodes[i].impurity if i in nodes else np.nan for i in active])
        runs = -(-len(active) // NODES)
        parts = blocks.mapPartitions(lambda b, t=tree, k=level, a=at: histograms(b, t, k, a, width))
        found = dict(parts.reduceByKey(np.add, min(runs, blocks.getNumPartitions())).map(
            lambda kv, p=parents: (kv[0], best_splits(kv[1], p[kv[0] * NODES:kv[0] * NODES + NODES], n_cuts, least, min_gain))).collect())
        best, active = [b for run in range(runs) for b in found[run]], []
        for i, b in zip(at.tolist(), best):
            if i not in nodes:
                nodes[i] = Node(b.stats, float(impurity(*b.stats)))
            nodes[i].valid = b.gain > -np.inf
            if b.gain <= 0.0:
                continue
            nodes[i].gain, nodes[i].feature, nodes[i].cut = b.gain, b.feature, b.cut
            tree.feature[i], tree.cut[i], tree.split[i] = b.feature, b.cut, True
            for child, stats in ((2 * i, b.left), (2 * i + 1, b.right)):
                nodes[child] = Node(stats, float(impurity(*stats)))
                if level + 1 < depth and abs(nodes[child].impurity) >= np.finfo(float).eps:
                    active.append(child)
    if not nodes:                                   # a depth of 0
        raise ValueError("a tree needs a depth of 1 at least")
    for i, node in nodes.items():
        tree.value[i] = value_of(node.stats)
    return nodes, tree


def fit_blocks(rows: DataFrame, n: int, est: GBTClassifier) -> GBTClassificationModel:
    """The model of ``est`` fitted to rows (label, x)."""
    bins = min(est.getMaxBins(), n)
    cuts = candidates(rows, n, bins, est.getSeed())
    n_cuts, depth, trees = np.array([len(c) for c in cuts]), est.getMaxDepth(), []
    blocks = binned(rows, cuts)
    # a task a core: a pass is short, and much of a short task is its start
    blocks = blocks.coalesce(max(2, min(blocks.getNumPartitions(), blocks.context.defaultParallelism))).persist(StorageLevel.MEMORY_AND_DISK)
    for m in range(est.getMaxIter()):
        nodes, tree = grow(blocks, depth, n_cuts, est.getMinInstancesPerNode(), est.getMinInfoGain())
        trees.append(nodes)
        # read from the blocks before, which are dropped as soon as the next tree is grown from these
        after = advanced(blocks, tree, est.getStepSize() if m else 1.0, depth).persist(StorageLevel.MEMORY_AND_DISK)
        if m:
            before.unpersist()                      # noqa: F821 - bound at the end of the round before
        before, blocks = blocks, after
    before.unpersist()
    blocks.unpersist()
    return mllib_model(est, trees, cuts, rows.sparkSession)


NODE = "struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double, " \
       "leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"


def saved_nodes(nodes: dict[int, Node], cuts: list[np.ndarray]) -> list[tuple]:
    """A tree's rows in MLlib's saved form, numbered from the root down; a split whose leaves predict the same is one leaf."""
    same: dict[int, float] = {}          # leaves, and splits that come to one, with what they predict
    for i in sorted(nodes, reverse=True):
        node, a, b = nodes[i], same.get(2 * i), same.get(2 * i + 1)
        if node.feature < 0:
            same[i] = value_of(node.stats)
        elif a is not None and a == b:
            same[i] = a
    out: list[tuple] = []

    def add(i: int) -> int:
        node, number = nodes[i], len(out)
        stats = [float(v) for v in node.stats]
        out.append(())
        if i in same:
            impure = node.impurity if node.valid or node.feature >= 0 else -1.0
            out[number] = (number, same[i], impure, stats, int(stats[0]), -1.0, -1, -1, (-1, [], -1))
        else:
            split = (node.feature, [float(cuts[node.feature][node.cut])], -1)
            left, right = add(2 * i), add(2 * i + 1)
            out[number] = (number, value_of(node.stats), node.impurity, stats, int(stats[0]), node.gain, left, right, split)
        return number

    add(1)
    return out


def mllib_model(est: GBTClassifier, trees: list[dict[int, Node]], cuts: list[np.ndarray], spark: SparkSession) -> GBTClassificationModel:
    """MLlib's model of the grown trees, written in its saved form and loaded."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stored/boosted-{uuid.uuid4().hex}"
    about = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "paramMap": {}, "defaultParamMap": {"impurity": "variance"}}
    whole = {**about, "class": "org.apache.spark.ml.classification.GBTClassificationModel", "uid": est.uid, "numFeatures": len(cuts), "numTrees": len(trees)}
    of_tree = {**about, "class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel"}

    def written(rows: list[tuple], schema: str) -> DataFrame:
        return spark.createDataFrame(rows, schema).coalesce(1)

    written([(json.dumps(whole),)], "value string").write.text(f"{path}/metadata")
    written([(m, json.dumps({**of_tree, "uid": f"dtr_{est.uid}_{m}"}), est.getStepSize() if m else 1.0) for m in range(len(trees))],
            "_1 int, _2 string, _3 double").write.parquet(f"{path}/treesMetadata")
    written([(m, row) for m, nodes in enumerate(trees) for row in saved_nodes(nodes, cuts)], f"treeID int, nodeData {NODE}").write.parquet(f"{path}/data")
    return GBTClassificationModel.load(path)

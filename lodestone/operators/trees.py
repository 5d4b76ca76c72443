"""Gradient-boosted ranking trees (LambdaMART) by distributed histograms.

A task's candidates are one row (binned features and labels), so pairs never leave it. Each level of a tree is one pass: a
row's scores under the trees so far give its lambdas, and gradients and Hessians are summed by (node, feature, bin). These
sums merge over partitions and their number depends on nodes, features and bins only; the driver picks the splits from them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.workspace import checkpointed

BINS = 32


@dataclass
class Tree:
    """A full binary tree: of each inner node the feature and the last bin that goes left, of each leaf its value."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    def nodes(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node of each row after ``depth`` steps, counted within its level; a node without a split sends all left."""
        at = np.zeros(len(bins), np.int64)
        for level in range(depth):
            node = (1 << level) - 1 + at
            feature = self.feature[node]
            right = (feature >= 0) & (bins[np.arange(len(bins)), np.maximum(feature, 0)] > self.bin[node])
            at = 2 * at + right
        return at


def lambdas(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of each candidate of a task with 0/1 labels: pairs of a wanted and another one, weighted by what a swap changes of NDCG."""
    place = np.empty(len(score), np.int64)
    place[np.lexsort((np.arange(len(score)), -score))] = np.arange(len(score))
    gain = 1 / np.log2(place + 2)
    best = (1 / np.log2(np.arange(int(label.sum())) + 2)).sum()
    g, h = np.zeros(len(score)), np.zeros(len(score))
    others = np.flatnonzero(label == 0)
    for i in np.flatnonzero(label > 0):
        p = 1 / (1 + np.exp(np.clip(score[i] - score[others], -35, 35)))
        w = np.abs(gain[i] - gain[others]) / best
        g[i] += (w * p).sum()
        g[others] -= w * p
        h[i] += (w * p * (1 - p)).sum()
        h[others] += w * p * (1 - p)
    return g, h


class LambdaMart:
    """Trees of ``depth`` over binned features; features are binned at quantiles, a null counts as 0 as it does for the batch scorer."""

    def __init__(self, features: Sequence[str], rounds: int = 10, depth: int = 3, rate: float = 0.3, l2: float = 1.0, least_rows: int = 20):
        self.features, self.rounds, self.depth, self.rate, self.l2, self.least_rows = list(features), rounds, depth, rate, l2, least_rows
        self.edges: list[np.ndarray] = []
        self.trees: list[Tree] = []

    def _binned(self, matrix: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, np.nan_to_num(x, nan=-np.inf), side="left") for e, x in zip(self.edges, matrix.T)]) if len(self.edges) else np.zeros((len(matrix), 0), int)

    def predict(self, matrix: np.ndarray) -> np.ndarray:
        return self._scores(self._binned(matrix))

    def _scores(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros(len(bins))
        for tree in self.trees:
            out += self.rate * tree.value[tree.nodes(bins, self.depth)]
        return out

    def scorer(self) -> Callable[[np.ndarray, Sequence[str]], np.ndarray]:
        """For :func:`lodestone.operators.learning.batch_score`."""
        return lambda matrix, names: self.predict(matrix)

    def fit(self, df: DataFrame, task: str, label: str) -> LambdaMart:
        """``df`` has a row a candidate; a task's list is bounded. Tasks without both kinds of label teach nothing. An empty table leaves no tree."""
        m = len(self.features)
        points = [i / BINS for i in range(1, BINS)]
        found = df.agg(*(F.percentile_approx(F.col(f).cast("double"), points, 10_000).alias(f"q{i}") for i, f in enumerate(self.features))).first()
        if found[0] is None:
            return self
        self.edges = [np.unique(np.array(q if q is not None else [], float)) for q in found]
        rows = df.groupBy(task).agg(F.collect_list(F.struct(F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in self.features)).alias("x"), F.col(label).cast("int").alias("y"))).alias("c"))
        rows = checkpointed(rows.where("exists(c, r -> r.y > 0) and exists(c, r -> r.y = 0)").select("c"))

        def sums(tree: Tree, level: int) -> np.ndarray:
            """(node, feature, bin) -> gradient, Hessian, rows; at the last level (node, 0, 0) only."""
            width = (1 << level, m, BINS) if level < self.depth else (1 << level, 1, 1)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros((3, *width))
                for batch in batches:
                    for candidates in batch.column(0).to_pylist():
                        bins = self._binned(np.array([r["x"] for r in candidates]))
                        g, h = lambdas(self._scores(bins), np.array([r["y"] for r in candidates]))
                        node = tree.nodes(bins, level)
                        for f in range(width[1]):
                            cell = node * width[2] + (bins[:, f] if width[2] > 1 else 0)
                            for part, w in enumerate((g, h, None)):
                                total[part, :, f] += np.bincount(cell, w, width[0] * width[2]).reshape(width[0], width[2])
                flat = total.reshape(-1)
                used = np.flatnonzero(flat)
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(flat[used])], ["i", "v"])

            out = np.zeros(3 * int(np.prod(width)))
            for r in rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # at most nodes x features x bins x 3
                out[r["i"]] = r["v"]
            return out.reshape(3, *width)

        for _ in range(self.rounds):
            inner = (1 << self.depth) - 1
            tree = Tree(np.full(inner, -1), np.zeros(inner, np.int64), np.zeros(1 << self.depth))
            for level in range(self.depth):
                g, h, n = (x.cumsum(axis=2) for x in sums(tree, level))
                whole = [x[:, :, -1:] for x in (g, h, n)]
                gain = g**2 / (h + self.l2) + (whole[0] - g) ** 2 / (whole[1] - h + self.l2) - whole[0] ** 2 / (whole[1] + self.l2)
                gain[(n < self.least_rows) | (whole[2] - n < self.least_rows)] = -np.inf
                for node in range(1 << level):
                    f, b = np.unravel_index(int(np.argmax(gain[node])), gain[node].shape)
                    if gain[node, f, b] > 1e-12:
                        tree.feature[(1 << level) - 1 + node], tree.bin[(1 << level) - 1 + node] = f, b
            g, h, _ = sums(tree, self.depth)
            tree.value = (g / (h + self.l2)).reshape(-1)
            self.trees.append(tree)
        return self

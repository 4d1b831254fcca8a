"""Gradient-boosted regression trees over binned features, for composites of factors.

Features are cut at sampled quantiles into at most ``bins`` bins, and rows are kept as blocks of small integers
beside their target and prediction. A level of a tree is one pass: each block adds its rows' residuals to
histograms by (node, feature, bin), which are summed pairwise on the way to the driver, so what arrives is
bounded by nodes times features times bins, whatever the number of rows. The driver picks the splits. A leaf is
split wherever that lowers the squared error, so with room for 2^depth leaves the order of splits, best leaf
first or level by level, gives the same tree. The next pass applies the trees since the last ``REFRESH``;
then predictions are kept anew.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame

REFRESH = 10
#: Partial histograms of more partitions than this are summed by tasks before the driver sees them.
DIRECT = 64


@dataclass(frozen=True)
class Tree:
    """A complete binary tree in breadth-first order: a node without a feature (-1) is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def nodes(self, binned: np.ndarray) -> np.ndarray:
        """The leaf of each row; a bin above the cut goes right."""
        at, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
        for _ in range((len(self.value) + 1).bit_length() - 2):
            f = self.feature[at]
            at = np.where(f >= 0, 2 * at + 1 + (binned[rows, np.maximum(f, 0)] > self.cut[at]), at)
        return at


@dataclass(frozen=True)
class Model:
    base: float
    edges: list[np.ndarray]
    trees: list[Tree]

    def predict(self, x: np.ndarray) -> np.ndarray:
        binned = bin_rows(x, self.edges)
        return self.base + sum((t.value[t.nodes(binned)] for t in self.trees), np.zeros(len(x)))


def bin_rows(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin b of a feature holds what is above edge b - 1 and not above edge b."""
    return np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], axis=1).astype(np.uint8)


def best_splits(sums: np.ndarray, counts: np.ndarray, least: int) -> list[tuple[float, int, int]]:
    """(gain, feature, cut) per node from histograms (node, feature, bin); of equal gains the first."""
    out = []
    left_g, left_n = np.cumsum(sums, axis=2), np.cumsum(counts, axis=2)
    for k in range(len(sums)):
        g, n = left_g[k, 0, -1], left_n[k, 0, -1]
        ln, rn = left_n[k], n - left_n[k]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left_g[k] ** 2 / ln + (g - left_g[k]) ** 2 / rn - g * g / max(n, 1)
        gain = np.where((ln >= least) & (rn >= least), gain, -np.inf)
        at = int(np.argmax(gain))
        out.append((float(gain.flat[at]), at // gain.shape[1], at % gain.shape[1]))
    return out


def _blocks(edges: list[np.ndarray], names: list[str], target: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.stack([b.column(n).to_numpy(zero_copy_only=False) for n in names], axis=1)
                y = b.column(target).to_numpy(zero_copy_only=False).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([bin_rows(x, edges).tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], names=["x", "y"])

    return run


def fit(
    train: DataFrame, names: list[str], target: str, rounds: int = 200, rate: float = 0.05, depth: int = 4, bins: int = 255, columns: float = 0.8, least: int = 20, seed: int = 42,
    edges: list[np.ndarray] | None = None,
) -> Model:
    """Trees for the squared error of ``target``, each on a sample of the feature columns, from complete rows."""
    width = len(names)
    if edges is None:
        cuts = train.approxQuantile(names, [k / bins for k in range(1, bins)], 0.5 / bins**1.5)
        edges = [np.unique(np.array(c, float)) for c in cuts]
    packed = train.select(*names, target).mapInArrow(_blocks(edges, names, target), "x binary, y binary").rdd

    def unpacked(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        y = np.frombuffer(row.y, np.float64)
        return np.frombuffer(row.x, np.uint8).reshape(-1, width), y, np.zeros(len(y))

    held = packed.map(unpacked).persist(StorageLevel.MEMORY_AND_DISK)
    total, n = held.map(lambda b: np.array([b[1].sum(), len(b[1])])).fold(np.zeros(2), operator.add)
    base = total / n
    rng, trees, recent = np.random.default_rng(seed), [], []
    used = max(min(2, width), round(width * columns))
    size = max(len(e) for e in edges) + 1

    def updated(b, recent):
        x, y, p = b
        for t in recent:
            p = p + t.value[t.nodes(x)]
        return x, y, p

    for _ in range(rounds):
        features = np.sort(rng.choice(width, used, replace=False))
        tree = Tree(np.full(2**depth - 1, -1), np.zeros(2**depth - 1, np.int64), np.zeros(2 ** (depth + 1) - 1))
        feature = np.full(2 ** (depth + 1) - 1, -1)
        cut = np.zeros(2 ** (depth + 1) - 1, np.int64)
        open_ = [0]
        for level in range(depth + 1):
            partial = Tree(feature, cut, tree.value)
            place = np.full(len(feature), -1)
            place[open_] = np.arange(len(open_))

            def histograms(blocks, partial=partial, place=place, many=len(open_), features=features, recent=tuple(recent)):
                out = np.zeros((2, many, len(features), size))
                for b in blocks:
                    x, y, p = updated(b, recent)
                    node = place[partial.nodes(x)]
                    on = node >= 0
                    x, node, g = x[on], node[on], (p - y)[on] + base
                    for i, f in enumerate(features):
                        key = node * size + x[:, f]
                        out[0, :, i] += np.bincount(key, g, many * size).reshape(many, size)
                        out[1, :, i] += np.bincount(key, minlength=many * size).reshape(many, size)
                yield out

            parts = held.mapPartitions(histograms)
            sums, counts = parts.reduce(operator.add) if held.getNumPartitions() <= DIRECT else parts.treeReduce(operator.add)
            for k, node in enumerate(open_):
                tree.value[node] = -rate * sums[k, 0].sum() / max(counts[k, 0].sum(), 1)
            if level == depth:
                break
            splits = best_splits(sums, counts, least)
            grown = []
            for node, (gain, f, c) in zip(open_, splits, strict=True):
                if gain > 1e-12:
                    feature[node], cut[node] = features[f], c
                    grown += [2 * node + 1, 2 * node + 2]
            if level == depth - 1:  # the children's sums are in this level's histograms
                for k, (node, (gain, f, c)) in enumerate(zip(open_, splits, strict=True)):
                    if gain > 1e-12:
                        for child, part in ((2 * node + 1, slice(0, c + 1)), (2 * node + 2, slice(c + 1, None))):
                            tree.value[child] = -rate * sums[k, f, part].sum() / max(counts[k, f, part].sum(), 1)
                break
            if not grown:
                break
            open_ = grown
        done = Tree(feature, cut, tree.value)
        trees.append(done)
        recent.append(done)
        if len(recent) == REFRESH:
            newer = held.map(lambda b, recent=tuple(recent): updated(b, recent)).persist(StorageLevel.MEMORY_AND_DISK)
            newer.count()
            held.unpersist()
            held, recent = newer, []
    held.unpersist()
    return Model(float(base), edges, trees)


def transform(model: Model, df: DataFrame, names: list[str], kept: list[str]) -> DataFrame:
    """The kept columns and ``value``, the prediction for complete rows."""
    shape = df.select(*kept).schema.add("value", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(n).to_numpy(zero_copy_only=False) for n in names], axis=1) if b.num_rows else np.empty((0, len(names)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(model.predict(x), pa.float64())], names=[*kept, "value"])

    return df.dropna(subset=names).select(*kept, *[n for n in names if n not in kept]).mapInArrow(run, shape)

"""Random forest on counted cells (i01, i10): MLlib's forest for more rows than it can walk tree by tree.

Trees of binned features only see how many rows of each label are in a
combination of bins, so the rows are counted once and all trees grow on the
counts: a bootstrap sample of n equal rows is a Poisson(n) weight, as MLlib's
Poisson(1) weight of each row.  Bins, feature subsets, Gini gain, depth, pruning,
votes and importances follow ``RandomForestClassifier``; its draws differ.
Blocks of trees are the tasks.  The forest is the table of its votes over all
combinations of bins, which meets the rows to score in a broadcast join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, prod, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.operators.binned import bin_of, cut_points

#: Bins of a feature, MLlib's default.
BINS = 32
#: Combinations of bins up to which the table of votes rides along (a few MB).
MOST_CELLS = 65_536
#: Trees that one task grows side by side.
TREES = 10


@dataclass
class CellForest:
    """``votes``: sum over the trees of P(label 1) for every combination of bins; ``importances`` sum to 1."""

    features: list[str]
    means: list[float]
    cuts: list[list[float]]
    votes: np.ndarray
    n_trees: int
    importances: np.ndarray

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction`` and ``probability_1``; missing features take the mean of the training rows."""
        table = pa.table({"_cell": np.arange(len(self.votes), dtype=np.int32), "prediction": (2 * self.votes > self.n_trees).astype(float),
                          "probability_1": self.votes / self.n_trees})
        cell = cell_of([filled(f, m) for f, m in zip(self.features, self.means)], self.cuts)
        return df.withColumn("_cell", cell).join(F.broadcast(df.sparkSession.createDataFrame(table)), "_cell").drop("_cell")


def filled(feature: str, mean: float) -> Column:
    x = F.col(feature).cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(mean)).otherwise(x)


def cell_of(values: list[Column], cuts: list[list[float]]) -> Column:
    """Number of the combination of bins."""
    cell = F.lit(0)
    for x, c in zip(values, cuts):
        cell = cell * (len(c) + 1) + bin_of(x, c)
    return cell.cast("int")


def split_points(df: DataFrame, features: list[str], about: list[int]) -> list[list[float]]:
    """Rising cut points per feature: between neighbours of at most BINS different values, else quantiles; ``about``
    says how many different values there may be."""
    cuts = cut_points(df, features, BINS)
    for i, f in enumerate(features):
        if about[i] <= 2 * BINS:
            values = sorted(r[0] for r in df.select(f).distinct().collect())
            if len(values) <= BINS:
                cuts[i] = [(a + b) / 2 for a, b in zip(values, values[1:])]
    return cuts


def grow(bins: np.ndarray, train: np.ndarray, n_trees: int, max_depth: int, per_node: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(sum over the trees of P(label 1) per cell, sum over the trees of their importances).

    ``bins``: cells x features, ``train``: rows of label 0 and 1 per cell.  All trees go down a level together; a split
    lowers the Gini impurity most among ``per_node`` random features and leaves a sampled row on both sides."""
    n_cells, n_features = bins.shape
    width = int(bins.max(initial=0)) + 1
    draws = [rng.poisson(np.broadcast_to(train[k], (n_trees, n_cells))).ravel() for k in (0, 1)]
    at = np.flatnonzero(draws[0] + draws[1])
    w0, w1 = (d[at].astype(float) for d in draws)
    cell, node, nodes, first, levels = at % n_cells, at // n_cells, n_trees, 0, []
    for level in range(max_depth + 1):
        n0, n1 = (np.bincount(node, w, nodes) for w in (w0, w1))
        best, feature, cut = 1e-12 * (n0 + n1), np.full(nodes, -1), np.zeros(nodes, np.int64)
        if level < max_depth:
            chosen = np.argsort(rng.random((nodes, n_features)), axis=1) < per_node
            base = (n0 ** 2 + n1 ** 2) / np.maximum(n0 + n1, 1)
            for f in range(n_features):
                key = node * width + bins[cell, f]
                l0, l1 = (np.bincount(key, w, nodes * width).reshape(nodes, width).cumsum(axis=1) for w in (w0, w1))
                r0, r1 = n0[:, None] - l0, n1[:, None] - l1
                left, right = l0 + l1, r0 + r1
                gain = (l0 ** 2 + l1 ** 2) / np.maximum(left, 1) + (r0 ** 2 + r1 ** 2) / np.maximum(right, 1) - base[:, None]
                gain[(left < 1) | (right < 1) | ~chosen[:, f][:, None]] = -1
                k = gain.argmax(axis=1)
                better = gain[np.arange(nodes), k] > best
                best[better], feature[better], cut[better] = gain[np.arange(nodes), k][better], f, k[better]
        split = feature >= 0
        child = first + nodes + 2 * (np.cumsum(split) - 1)
        levels.append((n0, n1, best, feature, cut, child))
        if not split.any():
            break
        on = split[node]
        cell, node, w0, w1 = cell[on], node[on], w0[on], w1[on]
        node = child[node] - first - nodes + (bins[cell, feature[node]] > cut[node])
        first, nodes = first + nodes, 2 * int(split.sum())
    n0, n1, gain, feature, cut, child = (np.concatenate(x) for x in zip(*levels))
    label, end = n1 > n0, len(feature)
    for n in [len(x[0]) for x in levels][::-1]:       # a split into leaves of one prediction is a leaf, from the bottom up
        mine = np.arange(end - n, end)
        mine = mine[feature[mine] >= 0]
        left, right = child[mine], child[mine] + 1
        feature[mine[(feature[left] < 0) & (feature[right] < 0) & (label[left] == label[right])]] = -1
        end -= n
    votes, importances, share = np.zeros(n_cells), np.zeros(n_features), n1 / np.maximum(n0 + n1, 1)
    for tree in range(n_trees):
        node, inner = np.full(n_cells, tree), np.zeros(n_features)
        seen = np.array([tree])
        while True:
            seen = seen[feature[seen] >= 0]
            if not len(seen):
                break
            inner += np.bincount(feature[seen], gain[seen], n_features)
            down = np.flatnonzero(feature[node] >= 0)
            to = node[down]
            node[down] = child[to] + (bins[down, feature[to]] > cut[to])
            seen = np.concatenate([child[seen], child[seen] + 1])
        votes += share[node]
        importances += inner / inner.sum() if inner.sum() > 0 else 0
    return votes, importances


def train_cells(rows: DataFrame, features: list[str], label: str, num_trees: int, max_depth: int, seed: int) -> CellForest | None:
    """The forest, from rows of doubles; None where it takes a fit by rows: labels other than both 0 and 1 (NULL
    included), a feature without values, or more than MOST_CELLS combinations of bins.

    Draws depend on the counts, ``seed`` and the first tree of a block; sums are in the order of the blocks."""
    spark, there = rows.sparkSession, {f: F.when(~F.isnan(f), F.col(f)) for f in features}
    found = rows.agg(F.min(label), F.max(label), F.count_if(F.col(label).isNull() | ~F.col(label).isin(0.0, 1.0)),
                     *[F.avg(x) for x in there.values()], *[F.approx_count_distinct(x) for x in there.values()]).first()
    means, about = found[3:3 + len(features)], found[3 + len(features):]
    if found[:3] != (0.0, 1.0, 0) or None in means:
        return None
    own = rows.select(*[filled(f, m).alias(f) for f, m in zip(features, means)], F.col(label).cast("int").alias("_y"))
    cuts = split_points(own, features, about)
    sizes = [len(c) + 1 for c in cuts]
    if prod(sizes) > MOST_CELLS:
        return None
    counted = own.groupBy(cell_of(features, cuts).alias("_cell"), "_y").agg(F.count("*").alias("n")).toPandas()    # at most 2 x MOST_CELLS rows
    train = np.zeros((2, prod(sizes)))
    train[counted["_y"], counted["_cell"]] = counted["n"]
    data = spark.sparkContext.broadcast((np.stack(np.unravel_index(np.arange(prod(sizes)), sizes), axis=1), train))
    per_node, blocks = ceil(sqrt(len(features))), -(-num_trees // TREES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first in (pdf["id"] * TREES).tolist():
                votes, importances = grow(*data.value, min(TREES, num_trees - first), max_depth, per_node, np.random.default_rng([seed, first]))
                yield pd.DataFrame({"first": [first], "votes": [votes.tobytes()], "importances": [importances.tobytes()]})

    grown = spark.range(0, blocks, 1, blocks).mapInPandas(run, "first int, votes binary, importances binary").toPandas().sort_values("first")
    votes, importances = (sum(np.frombuffer(x) for x in grown[c]) for c in ("votes", "importances"))
    return CellForest(features, list(means), cuts, votes, num_trees, importances / (importances.sum() or 1.0))

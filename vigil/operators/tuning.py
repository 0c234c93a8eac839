"""Nested grid search of random forests (i08).

A forest of 200 trees holds the forests of 50 and 100, and trees grown to depth
15 those of depth 5 and 10: every (fold, leaf size) is grown once, and all tree
counts and depths are read off on the way.  Trees grow on counted cells
(``binned``): a bootstrap sample of n equal rows is a Poisson(n) weight.  The
cells ride along with every task up to a checked number; blocks of trees are
the tasks, and their votes meet in one aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators.binned import cells, cut_points
from vigil.session import cut_lineage

BINS = 32
#: Different bin combinations up to which the cells ride along with the tasks (a few MB).
MOST_CELLS = 65_536
#: Trees that one task grows side by side.
TREES = 25


def blocks_of(tree_counts: list[int], size: int = TREES) -> list[tuple[int, int]]:
    """(first, end) of blocks of at most ``size`` trees that no tree count cuts."""
    out, begin = [], 0
    for end in sorted(set(tree_counts)):
        out += [(at, min(at + size, end)) for at in range(begin, end, size)]
        begin = end
    return out


def grow_votes(bins: np.ndarray, train: np.ndarray, n_trees: int, depths: list[int], leaf: int, per_node: int,
               rng: np.random.Generator) -> dict[int, np.ndarray]:
    """{depth: sum over the trees of P(label 1) per cell} for trees cut off at each depth.

    ``bins``: cells x features, ``train``: rows of label 0 and 1 per cell.  All trees go down a level together; a split
    lowers the Gini impurity, leaves ``leaf`` sampled rows on both sides and is the best of ``per_node`` random features.
    """
    n_cells, n_features = bins.shape
    width = int(bins.max(initial=0)) + 1
    weight = [rng.poisson(np.broadcast_to(train[k], (n_trees, n_cells))).ravel().astype(float) for k in (0, 1)]
    cell = np.tile(np.arange(n_cells), n_trees)
    at = np.arange(n_trees * n_cells)                 # entries (tree, cell) in nodes that may still split
    node = np.repeat(np.arange(n_trees), n_cells)
    value, out, nodes = np.zeros(n_trees * n_cells), {}, n_trees
    for level in range(max(depths) + 1):
        if len(at):
            w0, w1 = weight[0][at], weight[1][at]
            n0, n1 = (np.bincount(node, w, nodes) for w in (w0, w1))
            value[at] = (n1 / np.maximum(n0 + n1, 1))[node]
        if level in depths:
            out[level] = value.reshape(n_trees, n_cells).sum(axis=0)
        if level == max(depths) or not len(at):
            continue
        chosen = np.argsort(rng.random((nodes, n_features)), axis=1) < per_node
        base = (n0 ** 2 + n1 ** 2) / np.maximum(n0 + n1, 1)
        best, feature, cut = np.full(nodes, 1e-9), np.full(nodes, -1), np.zeros(nodes, np.int64)
        for f in range(n_features):
            key = node * width + bins[cell[at], f]
            l0, l1 = (np.bincount(key, w, nodes * width).reshape(nodes, width).cumsum(axis=1) for w in (w0, w1))
            r0, r1 = n0[:, None] - l0, n1[:, None] - l1
            left, right = l0 + l1, r0 + r1
            gain = (l0 ** 2 + l1 ** 2) / np.maximum(left, 1) + (r0 ** 2 + r1 ** 2) / np.maximum(right, 1) - base[:, None]
            gain[(left < max(leaf, 1)) | (right < max(leaf, 1)) | ~chosen[:, f][:, None]] = -1
            k = gain.argmax(axis=1)
            better = gain[np.arange(nodes), k] > best
            best[better], feature[better], cut[better] = gain[np.arange(nodes), k][better], f, k[better]
        split = feature >= 0
        number = np.cumsum(split) - 1
        on = split[node]
        at, node = at[on], node[on]
        right = bins[cell[at], feature[node]] > cut[node]
        node, nodes = 2 * number[node] + right, 2 * int(split.sum())
    for depth in depths:
        out.setdefault(depth, value.reshape(n_trees, n_cells).sum(axis=0))
    return out


def nested_grid(df: DataFrame, features: list[str], label: str, fold_col: str, grid: dict[str, list[int]], seed: int = 42,
                num_folds: int = 5) -> DataFrame | None:
    """(numTrees, maxDepth, minInstancesPerNode, mean_cv_recall) for every point of the grid; None above MOST_CELLS.

    NULL features take the mean of the training folds, NULL labels count as 0.  The recall of label 1 is averaged over
    the folds that have one.  Draws depend on (seed, fold, leaf size, first tree of a block), so reruns agree.
    """
    spark = df.sparkSession
    own = df.select(*[F.col(f).cast("double").alias(f) for f in features], F.coalesce(F.col(label).cast("int"), F.lit(0)).alias("y"),
                    F.col(fold_col).cast("int").alias("fold"))
    cuts = cut_points(own, features, BINS)
    counted = cut_lineage(cells(own, features, cuts, ["fold", "y"]))
    names = [f"b{i}" for i in range(len(features))]
    if counted.select(*names).distinct().limit(MOST_CELLS + 1).count() > MOST_CELLS:
        return None
    sums = own.groupBy("fold").agg(*[x for f in features for x in (F.sum(f).alias(f"s_{f}"), F.count(f).alias(f"n_{f}"))]).toPandas()
    pdf = counted.toPandas()                                # at most MOST_CELLS combinations x folds x labels
    combos, cell = np.unique(pdf[names].to_numpy(np.int64).reshape(len(pdf), len(names)), axis=0, return_inverse=True)
    rows = np.zeros((num_folds, 2, len(combos)))
    np.add.at(rows, (pdf["fold"].to_numpy(), pdf["y"].to_numpy(), cell.ravel()), pdf["n"].to_numpy())
    filled = []
    for fold in range(num_folds):
        rest, mine = sums[sums["fold"] != fold], combos.copy()
        for i, f in enumerate(features):
            n = rest[f"n_{f}"].sum()
            mean_bin = int(np.searchsorted(cuts[i], rest[f"s_{f}"].sum() / n, side="left")) if n else 0
            mine[mine[:, i] < 0, i] = mean_bin
        filled.append(mine)
    data = spark.sparkContext.broadcast((filled, rows))
    specs = [(fold, leaf, first, end) for fold in range(num_folds) for leaf in grid["minInstancesPerNode"] for first, end in blocks_of(grid["numTrees"])]
    depths, per_node = sorted(set(grid["maxDepth"])), max(1, int(np.ceil(sqrt(len(features)))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for fold, leaf, first, end in (specs[i] for i in pdf["id"]):
                filled, rows = data.value
                rng = np.random.default_rng([seed, fold, leaf, first])
                votes = grow_votes(filled[fold], rows.sum(axis=0) - rows[fold], end - first, depths, leaf, per_node, rng)
                held = np.flatnonzero(rows[fold, 1])          # only held-out rows of label 1 count for recall
                for depth, v in votes.items():
                    yield pd.DataFrame({"fold": fold, "leaf": leaf, "end": end, "depth": depth, "cell": held, "votes": v[held], "positives": rows[fold, 1][held]})

    votes = spark.range(0, len(specs), 1, len(specs)).mapInPandas(
        run, "fold int, leaf int, end int, depth int, cell long, votes double, positives double")
    counts = F.array(*[F.lit(n) for n in sorted(set(grid["numTrees"]))])
    forests = (votes.withColumn("numTrees", F.explode(F.filter(counts, lambda n: n >= F.col("end"))))
               .groupBy("numTrees", "depth", "leaf", "fold", "cell").agg(F.sum("votes").alias("votes"), F.first("positives").alias("positives")))
    hit = F.when(2 * F.col("votes") > F.col("numTrees"), F.col("positives")).otherwise(0.0)
    folds = forests.groupBy("numTrees", "depth", "leaf", "fold").agg((F.sum(hit) / F.sum("positives")).alias("recall"))
    return folds.groupBy("numTrees", F.col("depth").alias("maxDepth"), F.col("leaf").alias("minInstancesPerNode")).agg(
        F.avg("recall").alias("mean_cv_recall"))

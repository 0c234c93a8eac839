"""Second-order boosted trees (i02, second variant): Newton steps, best-first growth, L2 penalty.

Every round sums gradients and Hessians per (node, feature, bin) over the
counted cells of the training data (``binned``): partial sums in the tasks, one
aggregate in Spark.  What comes back to the driver has a fixed size, nodes x
features x bins, however many rows there are.  A tree grows best first: the
leaf with the largest gain splits next.  A round asks for the children of all
nodes that would split if those children gained nothing, so the tree is the one
that asking node by node would give, in as many rounds as it is deep.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators.binned import bin_of, cells, cut_points
from vigil.session import cut_lineage

BINS = 64
#: Trees after which the scores so far are written down instead of being computed again.
WRITE_EVERY = 10


@dataclass
class Tree:
    """Nodes by number, 0 the root: ``split[node]`` = (feature, cut, left, right); other nodes are leaves with a ``value``."""

    split: dict[int, tuple[int, int, int, int]] = field(default_factory=dict)
    value: dict[int, float] = field(default_factory=dict)

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """Leaf of each row of bins; NULL (-1) goes left."""
        node = np.zeros(len(bins), np.int64)
        for k in sorted(self.split):                  # children have larger numbers than their parent
            f, cut, left, right = self.split[k]
            here = node == k
            node[here] = np.where(bins[here, f] <= cut, left, right)
        return node

    def scores(self, bins: np.ndarray) -> np.ndarray:
        node = self.leaves(bins)
        return np.array([self.value.get(k, 0.0) for k in range(int(node.max(initial=0)) + 1)])[node]


@dataclass
class NewtonModel:
    """Log-odds = base + the trees' leaf values."""

    features: list[str]
    cuts: list[list[float]]
    base: float
    trees: list[Tree]

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probability_1`` and ``prediction``."""
        p = 1.0 / (1.0 + F.exp(-F.col("probability_1")))
        names = [f"__b{i}" for i in range(len(self.features))]
        binned = df.withColumns({n: bin_of(f, c) for n, f, c in zip(names, self.features, self.cuts)})
        trees, base = self.trees, self.base

        @F.pandas_udf("double")
        def score(bins: pd.DataFrame) -> pd.Series:
            b = bins.to_numpy()
            return pd.Series(base + sum((t.scores(b) for t in trees), np.zeros(len(b))))

        out = binned.withColumn("probability_1", score(F.struct(*names))).drop(*names).withColumn("probability_1", p)
        return out.withColumn("prediction", (F.col("probability_1") >= 0.5).cast("double"))


def best_splits(hist: np.ndarray, l2: float, least_rows: float, least_hessian: float) -> list[tuple[float, int, int]]:
    """(gain, feature, cut) of the best split of every node; gain 0 where none is allowed.

    ``hist``: node x feature x bin x (gradient, Hessian, rows), the first bin for NULL.  Gain: the sum over both sides of
    G^2 / (H + l2), less that of the node.
    """
    left = hist.cumsum(axis=2)
    total = left[:, :, -1:, :]
    right = total - left
    part = lambda s: s[..., 0] ** 2 / (s[..., 1] + l2)
    gain = part(left) + part(right) - part(total)
    barred = (np.minimum(left[..., 2], right[..., 2]) < least_rows) | (np.minimum(left[..., 1], right[..., 1]) < least_hessian)
    gain = np.where(barred, 0.0, gain)
    out = []
    for g in gain:
        f, k = np.unravel_index(int(g.argmax()), g.shape)
        out.append((float(g[f, k]), int(f), int(k) - 1))
    return out


class _Growth:
    """One tree in the making: nodes, their sums and best splits, and which of them split best first."""

    def __init__(self, leaves: int, depth: int):
        self.leaves, self.most_depth = leaves, depth
        self.depth, self.best, self.sums, self.children = {0: 0}, {}, {}, {}

    def chosen(self) -> list[int]:
        """Nodes that split, best first, if nodes without known children have none."""
        open_, out = {0}, []
        while len(out) < self.leaves - 1:
            able = [k for k in open_ if self.best.get(k, (0.0,))[0] > 1e-9 and self.depth[k] < self.most_depth]
            if not able:
                break
            k = max(able, key=lambda k: (self.best[k][0], -k))
            out.append(k)
            open_.remove(k)
            open_ |= set(self.children.get(k, ()))
        return out

    def unknown(self) -> list[int]:
        return [k for k in self.chosen() if k not in self.children]

    def tree(self, rate: float, l2: float) -> Tree:
        done, tree = set(self.chosen()), Tree()
        ends = {0} if not done else {c for k in done for c in self.children[k]} - done
        for k in done:
            _, f, cut = self.best[k]
            tree.split[k] = (f, cut, *self.children[k])
        for k in ends:
            g, h = self.sums[k]
            tree.value[k] = -rate * g / (h + l2)
        return tree


def train_newton_trees(df: DataFrame, features: list[str], label: str = "target", rounds: int = 100, leaves: int = 31, rate: float = 0.1,
                       l2: float = 1.0, depth: int = 8, least_rows: int = 20, least_hessian: float = 1e-3, bins: int = BINS) -> NewtonModel:
    """i02, second variant: ``rounds`` trees of at most ``leaves`` leaves on the log loss of a 0/1 label.

    NULL features go left of every cut, NULL labels are left out; without rows the model is the log-odds 0.  Results do
    not depend on partitions but for the order of floating sums.
    """
    own = df.where(F.col(label).isNotNull()).select(*features, F.col(label).cast("int").alias("y"))
    cuts = cut_points(own, features, bins)
    names = [f"b{i}" for i in range(len(features))]
    state = cut_lineage(cells(own, features, cuts, ["y"]).withColumn("score", F.lit(0.0)))
    count = state.agg(F.sum("n"), F.sum(F.col("n") * F.col("y"))).first()
    n, ones = int(count[0] or 0), int(count[1] or 0)
    base = float(np.log((ones + 0.5) / (n - ones + 0.5))) if n else 0.0
    width, trees, recent = max(len(c) for c in cuts) + 2, [], []

    def histograms(grown: Tree, wanted: list[int]) -> np.ndarray:
        """Sums per (wanted node, feature, bin) over all cells."""
        place = {k: i for i, k in enumerate(wanted)}
        before = list(recent)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(wanted) * len(names) * width, 3))
            for pdf in batches:
                b, w = pdf[names].to_numpy(), pdf["n"].to_numpy()
                p = 1 / (1 + np.exp(-(base + pdf["score"].to_numpy() + sum((t.scores(b) for t in before), np.zeros(len(b))))))
                at = np.array([place.get(k, -1) for k in range(max(place) + 1)])[np.minimum(grown.leaves(b), max(place))] if len(b) else np.empty(0, int)
                mine = at >= 0
                sums = np.stack([w * (p - pdf["y"].to_numpy()), w * p * (1 - p), w], axis=1)[mine]
                for f in range(len(names)):
                    key = (at[mine] * len(names) + f) * width + b[mine, f] + 1
                    for c in range(3):
                        total[:, c] += np.bincount(key, sums[:, c], len(total))
            full = np.flatnonzero(total[:, 2])
            yield pd.DataFrame({"k": full, "g": total[full, 0], "h": total[full, 1], "n": total[full, 2]})

        out = np.zeros((len(wanted) * len(names) * width, 3))
        summed = state.mapInPandas(run, "k long, g double, h double, n double").groupBy("k").agg(F.sum("g"), F.sum("h"), F.sum("n"))
        for k, g, h, rows in summed.collect():       # at most nodes x features x bins
            out[k] = g, h, rows
        return out.reshape(len(wanted), len(names), width, 3)

    for _ in range(rounds if n else 0):
        grown, now = _Growth(leaves, depth), Tree()
        wanted, next_node = [0], 1
        while wanted:
            hist = histograms(now, wanted)
            for k, best in zip(wanted, best_splits(hist, l2, least_rows, least_hessian)):
                grown.best[k] = best
            for k, h in zip(wanted, hist):
                grown.sums[k] = tuple(h[0].sum(axis=0)[:2])
            wanted = []
            for k in grown.unknown():
                _, f, cut = grown.best[k]
                grown.children[k] = (next_node, next_node + 1)
                now.split[k] = (f, cut, next_node, next_node + 1)
                grown.depth[next_node] = grown.depth[next_node + 1] = grown.depth[k] + 1
                wanted += [next_node, next_node + 1]
                next_node += 2
        tree = grown.tree(rate, l2)
        trees.append(tree)
        if not tree.split and abs(tree.value[0]) < 1e-12:
            break
        recent.append(tree)
        if len(recent) == WRITE_EVERY:
            done = list(recent)

            @F.pandas_udf("double")
            def added(b: pd.DataFrame) -> pd.Series:
                return pd.Series(sum((t.scores(b.to_numpy()) for t in done), np.zeros(len(b))))

            state = cut_lineage(state.withColumn("score", F.col("score") + added(F.struct(*names))))
            recent.clear()
    return NewtonModel(features, cuts, base, trees)

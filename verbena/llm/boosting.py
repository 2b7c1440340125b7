"""Gradient-boosted trees for two classes: fitted here on a small table of features, applied as a Column expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Tree:
    feature: int = -1
    cut: float = 0.0
    low: Tree | None = None
    high: Tree | None = None
    value: float = 0.0


def _grow(x: np.ndarray, slope: np.ndarray, curve: np.ndarray, depth: int, ridge: float) -> Tree:
    leaf = Tree(value=float(slope.sum() / (curve.sum() + ridge)))
    if depth == 0 or len(x) < 8:
        return leaf
    worth = slope.sum() ** 2 / (curve.sum() + ridge)
    best = (1e-6, -1, 0.0)
    for f in range(x.shape[1]):
        levels = np.unique(x[:, f])
        for cut in (levels[:-1] + levels[1:]) / 2 if len(levels) <= 40 else np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 40))):
            low = x[:, f] <= cut
            if 3 < low.sum() < len(x) - 3:
                a, b = slope[low].sum(), curve[low].sum()
                c, d = slope[~low].sum(), curve[~low].sum()
                gain = a * a / (b + ridge) + c * c / (d + ridge) - worth
                if gain > best[0]:
                    best = (gain, f, float(cut))
    if best[1] < 0:
        return leaf
    low = x[:, best[1]] <= best[2]
    return Tree(best[1], best[2], _grow(x[low], slope[low], curve[low], depth - 1, ridge), _grow(x[~low], slope[~low], curve[~low], depth - 1, ridge))


def tree_value(tree: Tree, x: np.ndarray) -> np.ndarray:
    if tree.low is None:
        return np.full(len(x), tree.value)
    return np.where(x[:, tree.feature] <= tree.cut, tree_value(tree.low, x), tree_value(tree.high, x))


@dataclass
class Boosted:
    start: float
    trees: list[Tree]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum(tree_value(t, x) for t in self.trees)

    def column(self, features: Column) -> Column:
        """The margin, from an array of the features."""

        def value(t: Tree) -> Column:
            if t.low is None:
                return F.lit(t.value)
            return F.when(F.get(features, F.lit(t.feature)) <= F.lit(t.cut), value(t.low)).otherwise(value(t.high))

        total = F.lit(self.start)
        for t in self.trees:
            total = total + value(t)
        return total


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 30, depth: int = 3, rate: float = 0.4, ridge: float = 1.0) -> Boosted:
    p = min(max(y.mean(), 1e-3), 1 - 1e-3)
    model = Boosted(float(np.log(p / (1 - p))), [])
    margin = np.full(len(y), model.start)
    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-margin))
        tree = _grow(x, y - chance, chance * (1 - chance), depth, ridge)
        _scale(tree, rate)
        model.trees.append(tree)
        margin += tree_value(tree, x)
    return model


def _scale(tree: Tree, rate: float) -> None:
    tree.value *= rate
    if tree.low is not None:
        _scale(tree.low, rate)
        _scale(tree.high, rate)


def platt(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """a, b with which 1 / (1 + exp(-(a * margin + b))) is the chance of the second class, by Newton steps on smoothed targets."""
    good = y.sum()
    target = np.where(y > 0.5, (good + 1) / (good + 2), 1 / (len(y) - good + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        w, r = p * (1 - p) + 1e-9, p - target
        slope = np.array([(r * margin).sum() + 1e-3 * (a - 1), r.sum()])
        curve = np.array([[(w * margin * margin).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(curve, slope)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
    return max(a, 1e-3), b


def least_threshold(chance: np.ndarray, y: np.ndarray, precision: float, floor: float = 0.5) -> float:
    """The lowest probability, floor at least, from which on the share of the second class reaches precision; 2 if none does."""
    order = np.argsort(-chance, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero((right >= precision) & (chance[order] >= floor))
    return float(chance[order][good[-1]]) if len(good) else 2.0

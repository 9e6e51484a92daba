"""Small decision trees and boosted trees, trained in numpy on bounded labelled tables."""

from __future__ import annotations

import numpy as np


class Tree:
    """A regression tree of least squares, as arrays. For labels 0 and 1 the splits are those of the Gini index."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int, least: int = 1, weight: np.ndarray | None = None) -> None:
        self.feature, self.cut, self.low, self.high, self.value = [], [], [], [], []
        self._grow(x, y, np.ones(len(y)) if weight is None else weight, depth, least)

    def _grow(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, depth: int, least: int) -> int:
        node = len(self.value)
        for store in (self.feature, self.cut, self.low, self.high):
            store.append(-1)
        self.value.append(float(y.sum() / max(weight.sum(), 1e-12)))
        best = (1e-9, -1, 0.0)
        if depth > 0 and len(y) >= 2 * least:
            whole = y.sum() ** 2 / weight.sum()
            for f in range(x.shape[1]):
                order = np.argsort(x[:, f], kind="stable")
                v, sums, sizes = x[order, f], np.cumsum(y[order]), np.cumsum(weight[order])
                at = np.flatnonzero(v[1:] > v[:-1])
                at = at[(at + 1 >= least) & (at + 1 <= len(v) - least)]
                if len(at):
                    left, n = sums[at], sizes[at]
                    gain = left ** 2 / n + (sums[-1] - left) ** 2 / np.maximum(sizes[-1] - n, 1e-12) - whole
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, float(v[at[k]] + v[at[k] + 1]) / 2)
        if best[1] >= 0:
            below = x[:, best[1]] <= best[2]
            self.feature[node], self.cut[node] = best[1], best[2]
            self.low[node] = self._grow(x[below], y[below], weight[below], depth - 1, least)
            self.high[node] = self._grow(x[~below], y[~below], weight[~below], depth - 1, least)
        return node

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        feature, cut, low, high = (np.array(a) for a in (self.feature, self.cut, self.low, self.high))
        while True:
            inner = feature[at] >= 0
            if not inner.any():
                return at
            rows = np.flatnonzero(inner)
            below = x[rows, feature[at[rows]]] <= cut[at[rows]]
            at[rows] = np.where(below, low[at[rows]], high[at[rows]])

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(x)] if len(x) else np.zeros(0)


class Boosted:
    """Gradient boosting with logistic loss and Newton steps in the leaves; `probability` is calibrated on rows held back."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, held: int = 4) -> None:
        back = np.arange(len(y)) % held == 0
        own, target = x[~back], y[~back].astype(float)
        self.rate, self.trees, score = rate, [], np.zeros(len(target))
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            tree = Tree(own, target - p, depth, 5, np.maximum(p * (1 - p), 1e-4))
            self.trees.append(tree)
            score += rate * np.clip(tree.predict(own), -4, 4)
        self.edges, self.levels = _isotonic(self.raw(x[back]), y[back].astype(float))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return sum((self.rate * np.clip(t.predict(x), -4, 4) for t in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.levels[np.clip(np.searchsorted(self.edges, self.raw(x), "right") - 1, 0, len(self.levels) - 1)]


def _isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising step function of the score nearest to the labels: pools of neighbours that would fall are merged."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        pools.append([s, v, 1.0])
        while len(pools) > 1 and (pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2] or pools[-2][0] == pools[-1][0]):
            _, v2, n2 = pools.pop()
            pools[-1][1] += v2
            pools[-1][2] += n2
    return np.array([p[0] for p in pools]), np.array([p[1] / p[2] for p in pools])

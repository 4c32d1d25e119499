"""Histogram gradient-boosted trees for two classes, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """All trees flattened: ``feature`` and ``threshold`` per tree and inner node, values per leaf.

    Nodes stand in heap order, the children of node ``i`` at ``2 i + 1`` and ``2 i + 2``. A
    node that is not split has an infinite threshold, so every row goes left.
    """

    prior: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of class 1 per row; all rows walk down a tree together."""
        total = np.full(len(rows), self.prior)
        inner = self.feature.shape[1]
        depth = (inner + 1).bit_length() - 1
        each = np.arange(len(rows))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(rows), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (rows[each, feature[node]] > threshold[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(
    rows: np.ndarray,
    labels: np.ndarray,
    n_trees: int = 80,
    depth: int = 4,
    rate: float = 0.15,
    bins: int = 64,
    smallest: float = 5.0,
    ridge: float = 1.0,
) -> Trees:
    """Boosted trees for labels 0 and 1.

    Features are cut once into quantile bins; a level's histograms of gradient and curvature
    are one count over (node, feature, bin). With one class only, or no rows, there are no
    trees and the score is the prior.
    """
    n, width = rows.shape
    inner = (1 << depth) - 1
    share = (labels.sum() + 0.5) / (n + 1.0)
    prior = float(np.log(share / (1 - share)))
    if n == 0 or labels.min() == labels.max():
        return Trees(prior, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(rows[:, k], np.arange(1, bins) / bins)) for k in range(width)]
    binned = np.stack([np.searchsorted(edges[k], rows[:, k], side="left") for k in range(width)], axis=1)
    place = binned + np.arange(width) * bins
    total = np.full(n, prior)
    features, thresholds, values = [], [], []
    for _ in range(n_trees):
        chance = 1 / (1 + np.exp(-total))
        gradient, curvature = labels - chance, chance * (1 - chance)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            count, first = 1 << level, (1 << level) - 1
            at = (place + (node * width * bins)[:, None]).ravel()
            shape = (count, width, bins)
            grad = np.bincount(at, np.repeat(gradient, width), count * width * bins).reshape(shape).cumsum(axis=2)
            curve = np.bincount(at, np.repeat(curvature, width), count * width * bins).reshape(shape).cumsum(axis=2)
            all_grad, all_curve = grad[:, :, -1:], curve[:, :, -1:]
            gain = (
                grad**2 / (curve + ridge) + (all_grad - grad) ** 2 / (all_curve - curve + ridge) - all_grad**2 / (all_curve + ridge)
            )
            gain[(curve < smallest / 4) | (all_curve - curve < smallest / 4)] = 0
            flat = gain.reshape(count, -1)
            best = flat.argmax(axis=1)
            chosen, cut = best // bins, best % bins
            split = flat[np.arange(count), best] > 1e-9
            for k in np.flatnonzero(split):
                if cut[k] < len(edges[chosen[k]]):
                    feature[first + k], threshold[first + k] = chosen[k], edges[chosen[k]][cut[k]]
            node = 2 * node + (rows[np.arange(n), feature[first + node]] > threshold[first + node])
        leaves = inner + 1
        grad, curve = np.bincount(node, gradient, leaves), np.bincount(node, curvature, leaves)
        value = rate * grad / (curve + ridge)
        total += value[node]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(prior, np.array(features), np.array(thresholds), np.array(values))

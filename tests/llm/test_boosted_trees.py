"""Boosted trees against plain search for the best split, and what training collects."""

from __future__ import annotations

import numpy as np
import pytest

from wirepulse.llm import boosted_trees, quality_classifier


def gain_of(left: np.ndarray, gradient: np.ndarray, curvature: np.ndarray, smallest: float, ridge: float) -> float:
    if curvature[left].sum() < smallest / 4 or curvature[~left].sum() < smallest / 4:
        return 0.0
    parts = [gradient[side].sum() ** 2 / (curvature[side].sum() + ridge) for side in (left, ~left)]
    return sum(parts) - gradient.sum() ** 2 / (curvature.sum() + ridge)


@pytest.mark.parametrize("seed", range(3))
def test_every_split_is_the_best_one(seed):
    rng = np.random.default_rng(seed)
    rows = np.round(rng.normal(size=(200, 4)), 1)
    labels = ((rows[:, 0] * rows[:, 1] + 0.3 * rng.normal(size=200)) > 0).astype(float)
    bins, depth, rate, smallest, ridge = 16, 3, 0.2, 5.0, 1.0
    trees = boosted_trees.fit(rows, labels, 6, depth, rate, bins, smallest, ridge)
    edges = [np.unique(np.quantile(rows[:, k], np.arange(1, bins) / bins)) for k in range(4)]
    total = np.full(200, np.log((labels.sum() + 0.5) / (201 - labels.sum() - 0.5)))
    for feature, threshold, value in zip(trees.feature, trees.threshold, trees.value, strict=True):
        chance = 1 / (1 + np.exp(-total))
        gradient, curvature = labels - chance, chance * (1 - chance)
        held = {0: np.arange(200)}
        for node in range((1 << depth) - 1):
            at = held[node]
            left = rows[at, feature[node]] <= threshold[node]
            best = max((gain_of(rows[at, k] <= edge, gradient[at], curvature[at], smallest, ridge) for k in range(4) for edge in edges[k]), default=0)
            got = gain_of(left, gradient[at], curvature[at], smallest, ridge) if np.isfinite(threshold[node]) else 0.0
            assert got == pytest.approx(max(best, 0) if best > 1e-9 else 0, abs=1e-9)
            held[2 * node + 1], held[2 * node + 2] = at[left], at[~left]
        for leaf in range(1 << depth):
            at = held[(1 << depth) - 1 + leaf]
            assert value[leaf] == pytest.approx(rate * gradient[at].sum() / (curvature[at].sum() + ridge))
            total[at] += value[leaf]
    assert trees.score(rows) == pytest.approx(1 / (1 + np.exp(-total)))


def test_an_id_is_one_training_row_however_often_it_occurs(spark):
    docs = spark.range(30_000).selectExpr("CAST(IF(id < 29990, 1, id) AS LONG) AS doc_id", "concat('some text ', id % 7) AS text")
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, 1, 1), (29_995, 0, 0), (29_996, None, 0)], "doc_id long, quality int, toxic int")
    x, y = quality_classifier.training_rows(docs, labels, 10)
    assert len(x) == len(y) <= 2 and sorted(y.tolist()) in ([0.0, 1.0], [1.0], [0.0])
    again = quality_classifier.training_rows(docs.repartition(3), labels, 10)
    assert sorted(map(tuple, again[0].tolist())) == sorted(map(tuple, x.tolist()))

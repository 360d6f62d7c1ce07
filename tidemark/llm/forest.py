"""Isolation forest in numpy: random splits, path lengths, anomaly scores."""

from __future__ import annotations

import numpy as np

EULER = 0.5772156649015329


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points, c(n)."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + EULER) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """``trees`` random trees, each over ``sample`` rows; nodes are kept in flat arrays.

    Half of the splits are drawn from the range of the rows at the node, half from the region of the node
    within ``box`` (lowest and highest value of each column). The latter cut off empty space, so rows
    unlike any of ``x`` end on short paths as well.
    """

    def __init__(self, x: np.ndarray, box: tuple[np.ndarray, np.ndarray], trees: int = 100, sample: int = 256, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.sample = min(sample, len(x))
        depth = int(np.ceil(np.log2(max(self.sample, 2)))) + 2
        self.trees = [self._grow(x[rng.choice(len(x), self.sample, replace=False)], box, depth, rng) for _ in range(trees)]

    @staticmethod
    def _grow(x: np.ndarray, box: tuple[np.ndarray, np.ndarray], depth: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        feature, cut, child, value = [], [], [], []
        todo = [(x, *box, 0, -1)]
        while todo:
            rows, floor, roof, level, parent = todo.pop(0)
            if parent >= 0 and child[parent] < 0:
                child[parent] = len(feature)  # the right child follows the left one
            low, high = (floor, roof) if rng.random() < 0.5 or not len(rows) else (rows.min(0), rows.max(0))
            free = np.flatnonzero(high > low)
            child.append(-1)
            if level >= depth or len(rows) <= 1 or not len(free):
                feature.append(-1)
                cut.append(0.0)
                value.append(level + float(mean_path(len(rows))))
                continue
            f = int(rng.choice(free))
            c = rng.uniform(low[f], high[f])
            feature.append(f)
            cut.append(c)
            value.append(0.0)
            me = len(feature) - 1
            left, right = roof.copy(), floor.copy()
            left[f], right[f] = min(c, roof[f]), max(c, floor[f])
            todo += [(rows[rows[:, f] < c], floor, left, level + 1, me), (rows[rows[:, f] >= c], right, roof, level + 1, me)]
        return np.array(feature), np.array(cut), np.array(child), np.array(value)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / c(sample)): near 1 for rows that few splits set apart."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, child, value in self.trees:
            node = np.zeros(len(x), np.int64)
            while (inner := feature[node] >= 0).any():
                k = rows[inner]
                at = node[k]
                node[k] = child[at] + (x[k, feature[at]] >= cut[at])
            total += value[node]
        return 2.0 ** (-total / len(self.trees) / max(float(mean_path(self.sample)), 1e-9))

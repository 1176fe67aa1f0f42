"""Histogram gradient-boosted trees in numpy, flattened into arrays for vectorised traversal."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees in flat arrays: node i of any tree goes to ``left[i]`` if its feature is at most ``cut[i]``.

    Leaves point to themselves, so a fixed number of steps takes every row of every tree to its leaf.
    """

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit(
    x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 8.0, ridge: float = 2.0
) -> Forest:
    """Logistic boosting: every split is chosen from per-bin sums of gradients and curvatures."""
    x = np.asarray(x, float)
    n, width = x.shape
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(width)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(width)], axis=1) if n else np.zeros((0, width), int)
    feature, cut, left, right, value, roots = [], [], [], [], [], []
    margin = np.full(n, base)

    def node() -> int:
        i = len(feature)
        for column, v in ((feature, 0), (cut, np.inf), (left, i), (right, i), (value, 0.0)):
            column.append(v)
        return i

    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        roots.append(node())
        level = [(roots[-1], np.arange(n))]
        for step in range(depth + 1):
            after = []
            for i, own in level:
                gs, hs = g[own].sum(), h[own].sum()
                best = (1e-6, None, None)
                for j in range(width if step < depth and len(own) > 1 else 0):
                    if not len(cuts[j]):
                        continue
                    size = len(cuts[j]) + 1
                    gl = np.cumsum(np.bincount(binned[own, j], g[own], size))[:-1]
                    hl = np.cumsum(np.bincount(binned[own, j], h[own], size))[:-1]
                    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                    gain[(hl < least / 4) | (hs - hl < least / 4)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k)
                if best[1] is None:
                    value[i] = float(-rate * gs / (hs + ridge))
                    margin[own] += value[i]
                    continue
                _, j, k = best
                feature[i], cut[i] = j, float(cuts[j][k])
                left[i], right[i] = node(), node()
                low = binned[own, j] <= k
                after += [(left[i], own[low]), (right[i], own[~low])]
            level = after
    ints = lambda v: np.array(v, np.int64)
    return Forest(ints(feature), np.array(cut, float), ints(left), ints(right), np.array(value, float), ints(roots), depth, base)

"""Gradient-boosted trees for a yes-or-no label on binned features: fitted on a bounded sample, applied to batches."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Complete trees of one depth: feature and bin of each split in heap order, and the leaves' values."""

    edges: list[np.ndarray]
    start: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def _leaf(self, b: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(b), np.int64), np.arange(len(b))
        for _ in range(int(np.log2(len(feature) + 1))):
            at = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
        return at - len(feature)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b, out = self.bins(x), np.full(len(x), self.start)
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            out += value[self._leaf(b, feature, cut)]
        return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 24, damp: float = 2.0) -> Trees:
    """Newton boosting of the logistic loss with histograms of gradients."""
    quantiles = np.linspace(0, 1, bins + 1)[1:-1]
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    model = Trees([np.unique(np.quantile(x[:, j], quantiles)) if len(y) else np.zeros(0) for j in range(x.shape[1])], float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    b, score = model.bins(x), np.full(len(y), model.start)
    inner, width = 2 ** depth - 1, x.shape[1]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, 255, np.int64)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, n = 2 ** level - 1, 2 ** level
            here = at - first
            best = np.full(n, 1e-9)
            for j in range(width):
                cells = here * bins + b[:, j]
                gs = np.bincount(cells, g, n * bins).reshape(n, bins)
                hs = np.bincount(cells, h, n * bins).reshape(n, bins)
                gl, hl = gs.cumsum(axis=1), hs.cumsum(axis=1)
                ga, ha = gl[:, -1:], hl[:, -1:]
                gain = gl ** 2 / (hl + damp) + (ga - gl) ** 2 / (ha - hl + damp) - ga ** 2 / (ha + damp)
                k = gain[:, :-1].argmax(axis=1)
                top = gain[np.arange(n), k]
                better = top > best
                best[better] = top[better]
                feature[first:first + n][better] = j
                cut[first:first + n][better] = k[better]
            at = 2 * at + 1 + (b[np.arange(len(y)), feature[at]] > cut[at])
        leaf = at - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + damp)
        model.feature.append(feature)
        model.cut.append(cut)
        model.value.append(value)
        score += value[leaf]
    return model

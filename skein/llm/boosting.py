"""Gradient-boosted trees for small tables of features, in numpy.

Trees of depth 3 on quantile bins, logistic loss, second-order leaves, and a
Platt scale fitted on rows held out.  Training is for samples of a documented
bound; scoring is vectorised and the model is a few kilobytes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

DEPTH = 3


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Boosted:
    """``rounds`` trees; each is a full tree of (feature, cut) nodes and leaf values."""

    rounds: int = 40
    rate: float = 0.3
    bins: int = 32
    ridge: float = 1.0
    features: list[np.ndarray] = field(default_factory=list)
    cuts: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5

    def fit(self, x: np.ndarray, y: np.ndarray, held: float = 0.25, precision: float = 0.98) -> Boosted:
        """Train on all but every 1/held-th row; calibrate and choose the threshold on those.

        The threshold is the lowest at which the held-out precision is reached.
        """
        hold = np.arange(len(y)) % max(2, round(1 / held)) == 0
        xt, yt, margin = x[~hold], y[~hold].astype(float), np.zeros((~hold).sum())
        edges = [np.unique(np.quantile(xt[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        for _ in range(self.rounds):
            p = sigmoid(margin)
            self._grow(xt, p - yt, p * (1 - p), edges)
            margin += self._tree(len(self.leaves) - 1, xt)
        self._calibrate(self.margin(x[hold]), y[hold].astype(float), precision)
        return self

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, edges: list[np.ndarray]) -> None:
        feature, cut = np.zeros((1 << DEPTH) - 1, int), np.full((1 << DEPTH) - 1, np.inf)
        at = np.zeros(len(x), int)
        for node in range((1 << DEPTH) - 1):
            rows = np.flatnonzero(at == node)
            best = 1e-6
            gs, hs = g[rows].sum(), h[rows].sum()
            for j, e in enumerate(edges):
                if not len(e) or len(rows) < 2:
                    continue
                place = np.searchsorted(e, x[rows, j], side="left")
                gl = np.cumsum(np.bincount(place, g[rows], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(place, h[rows], len(e) + 1))[:-1]
                gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge)
                k = int(gain.argmax())
                if gain[k] > best:
                    best, feature[node], cut[node] = gain[k], j, e[k]
            at[rows] = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        leaf = at - ((1 << DEPTH) - 1)
        total_g, total_h = np.bincount(leaf, g, 1 << DEPTH), np.bincount(leaf, h, 1 << DEPTH)
        self.features.append(feature)
        self.cuts.append(cut)
        self.leaves.append(-self.rate * total_g / (total_h + self.ridge))

    def _tree(self, k: int, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        rows = np.arange(len(x))
        for _ in range(DEPTH):
            at = 2 * at + 1 + (x[rows, self.features[k][at]] > self.cuts[k][at])
        return self.leaves[k][at - ((1 << DEPTH) - 1)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return sum((self._tree(k, x) for k in range(len(self.leaves))), np.zeros(len(x)))

    def _calibrate(self, m: np.ndarray, y: np.ndarray, precision: float) -> None:
        a, b = 1.0, 0.0
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        for _ in range(50):
            p = sigmoid(a * m + b)
            w, r = p * (1 - p) + 1e-6, p - target
            hess = np.array([[(w * m * m).sum(), (w * m).sum()], [(w * m).sum(), w.sum()]]) + 1e-6 * np.eye(2)
            step = np.linalg.solve(hess, [(r * m).sum(), r.sum()])
            a, b = a - step[0], b - step[1]
        self.scale = (float(a), float(b))
        p = self.probability_of(m)
        order = np.argsort(-p, kind="stable")
        right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
        good = np.flatnonzero(right >= precision)
        self.threshold = float(max(0.5, p[order[good[-1]]])) if len(good) else 1.0

    def probability_of(self, margin: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale[0] * margin + self.scale[1])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.probability_of(self.margin(np.asarray(x, float)))

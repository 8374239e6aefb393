"""Gradient-boosted trees for a yes/no target, kept as flat node arrays.

Training takes a bounded sample in memory (histograms over at most 64 bins a feature); scoring is vectorised over rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Node i of all trees: rows with feature[i] <= threshold[i] go to left[i], others to right[i]; a leaf points at itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


@dataclass
class _Nodes:
    rows: list = field(default_factory=list)

    def add(self, feature=0, threshold=0.0, value=0.0) -> int:
        self.rows.append([feature, threshold, len(self.rows), len(self.rows), value])
        return len(self.rows) - 1


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int] | None = None, rounds: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0, least: int = 5) -> Trees:
    """monotone: +1 or -1 for features along which the score may only rise or fall. With no rows or one class, a constant."""
    monotone = monotone or {}
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    base, nodes, roots = float(np.log(share / (1 - share))), _Nodes(), []
    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.01, 0.99, 63), method="lower")) for f in range(x.shape[1])]
        bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        margin = np.full(len(y), base)

        def grow(rows, grad, hess, level, low, high):
            g, h = grad[rows].sum(), hess[rows].sum()
            best = (1e-6, None)
            if level < depth and len(rows) >= 2 * least:
                for f, c in enumerate(cuts):
                    gs = np.cumsum(np.bincount(bins[rows, f], grad[rows], len(c) + 1))[:-1]
                    hs = np.cumsum(np.bincount(bins[rows, f], hess[rows], len(c) + 1))[:-1]
                    ns = np.cumsum(np.bincount(bins[rows, f], minlength=len(c) + 1))[:-1]
                    wl = np.clip(-gs / (hs + ridge), low, high)
                    wr = np.clip(-(g - gs) / (h - hs + ridge), low, high)
                    gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
                    ok = (ns >= least) & (len(rows) - ns >= least)
                    if f in monotone:
                        ok &= monotone[f] * (wr - wl) >= 0
                    if ok.any() and (k := int(np.argmax(np.where(ok, gain, -np.inf)))) >= 0 and gain[k] > best[0]:
                        best = (gain[k], (f, k, wl[k], wr[k]))
            if best[1] is None:
                return nodes.add(value=rate * float(np.clip(-g / (h + ridge), low, high)))
            f, k, wl, wr = best[1]
            me, middle = nodes.add(f, float(cuts[f][k])), (wl + wr) / 2
            # Under a monotone split, no leaf of one side may pass the middle, so deeper splits keep the order.
            left_high = middle if monotone.get(f) == 1 else high
            left_low = middle if monotone.get(f) == -1 else low
            right_low = middle if monotone.get(f) == 1 else low
            right_high = middle if monotone.get(f) == -1 else high
            goes = bins[rows, f] <= k
            nodes.rows[me][2] = grow(rows[goes], grad, hess, level + 1, left_low, left_high)
            nodes.rows[me][3] = grow(rows[~goes], grad, hess, level + 1, right_low, right_high)
            return me

        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            first = len(nodes.rows)
            root = grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf)
            roots.append(root)
            margin += _flat(nodes, [root], depth, 0.0).margin(x)
            if len(nodes.rows) == first + 1:
                break
    if not roots:
        nodes.add()
    return _flat(nodes, roots, depth, base)


def _flat(nodes: _Nodes, roots: list[int], depth: int, base: float) -> Trees:
    f, t, left, right, v = zip(*nodes.rows)
    return Trees(np.array(roots, dtype=np.int64), np.array(f, dtype=np.int64), np.array(t), np.array(left, dtype=np.int64), np.array(right, dtype=np.int64), np.array(v), depth, base)

"""Small models for bounded training sets on the driver: boosted symmetric trees and isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """Gradient-boosted symmetric trees with logistic loss: each tree asks the same question on a level."""

    features: np.ndarray  # trees x depth
    cuts: np.ndarray  # trees x depth
    leaves: np.ndarray  # trees x 2**depth
    bias: float
    knots: np.ndarray | None = None  # isotonic calibration
    values: np.ndarray | None = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for f, c, leaf in zip(self.features, self.cuts, self.leaves):
            at = np.zeros(len(x), dtype=np.int64)
            for level in range(len(f)):
                at |= (x[:, f[level]] > c[level]).astype(np.int64) << level
            out += leaf[at]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities; ties and gaps between knots are interpolated."""
        raw = self.raw(np.nan_to_num(np.asarray(x, dtype=float)))
        if self.knots is None:
            return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        return np.interp(raw, self.knots, self.values)


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and non-decreasing means, with one pseudo-count spread over each block."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum, count, first score, last score
    for s, y in zip(score[order], label[order]):
        blocks.append([float(y), 1.0, s, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    prior = float(label.mean()) if len(label) else 0.5
    knots, values = [], []
    for total, n, first, last in blocks:
        v = (total + prior) / (n + 1)
        knots += [first, last]
        values += [v, v]
    return np.array(knots), np.maximum.accumulate(np.array(values))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0, folds: int = 4, seed: int = 7) -> Boosted:
    """Fit on the driver; the calibration comes from out-of-fold scores. ``x`` must be a bounded sample."""
    x, y = np.nan_to_num(np.asarray(x, dtype=float)), np.asarray(y, dtype=float)
    model = _boost(x, y, trees, depth, rate, bins, l2)
    fold = np.random.default_rng(seed).integers(0, folds, len(y))
    raw = np.zeros(len(y))
    for k in range(folds):
        held = fold == k
        if held.any() and (~held).any() and 0 < y[~held].sum() < (~held).sum():
            raw[held] = _boost(x[~held], y[~held], trees, depth, rate, bins, l2).raw(x[held])
        else:
            raw[held] = model.raw(x[held])
    model.knots, model.values = isotonic(raw, y)
    return model


def _boost(x, y, trees, depth, rate, bins, l2) -> Boosted:
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    edges = [np.unique(np.concatenate([e, (np.unique(x[:64, j])[:8])])) if len(e) < 2 else e for j, e in enumerate(edges)]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    width = max(len(e) for e in edges) + 1
    p = min(max(y.mean(), 1e-6), 1 - 1e-6)
    bias = float(np.log(p / (1 - p)))
    raw = np.full(n, bias)
    fs, cs, ls = [], [], []
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        g, h = y - prob, prob * (1 - prob)
        at, f, c = np.zeros(n, dtype=np.int64), [], []
        for level in range(depth):
            best = (-1.0, 0, 0)
            for j in range(m):
                key = at * width + code[:, j]
                gs = np.bincount(key, g, minlength=width << level).reshape(-1, width).cumsum(axis=1)
                hs = np.bincount(key, h, minlength=width << level).reshape(-1, width).cumsum(axis=1)
                gain = (gs**2 / (hs + l2) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + l2)).sum(axis=0)[: len(edges[j])]
                if len(gain) and gain.max() > best[0] + 1e-12:
                    best = (float(gain.max()), j, int(gain.argmax()))
            _, j, k = best
            f.append(j)
            c.append(edges[j][k])
            at |= (code[:, j] > k).astype(np.int64) << level
        leaf = rate * np.bincount(at, g, minlength=1 << depth) / (np.bincount(at, h, minlength=1 << depth) + l2)
        raw += leaf[at]
        fs.append(f)
        cs.append(c)
        ls.append(leaf)
    return Boosted(np.array(fs), np.array(cs), np.array(ls), bias)

"""Gradient-boosted trees for a few thousand to a few million rows of dense features, in numpy."""

from __future__ import annotations

import numpy as np

BINS, DEPTH = 48, 4


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = 80, rate: float = 0.2, reg: float = 1.0, least: float = 4.0) -> dict:
    """Trees of full depth DEPTH for weighted logistic loss; splits between quantiles of the features."""
    n, k = x.shape
    weight = np.ones(n) if weight is None else weight
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    mean = np.average(y, weights=weight)
    base = float(np.log((mean + 1e-6) / (1 - mean + 1e-6)))
    score = np.full(n, base)
    feature, threshold, leaf = [], [], []
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)
        f, t = np.zeros(inner, int), np.full(inner, np.inf)
        node = np.zeros(n, int)
        for at in range(inner):
            rows = np.flatnonzero(node == at)
            best = 1e-6
            if len(rows):
                gs, hs = g[rows].sum(), h[rows].sum()
                for j in range(k):
                    if not len(cuts[j]):
                        continue
                    size = len(cuts[j]) + 1
                    gl = np.cumsum(np.bincount(binned[rows, j], g[rows], size))[:-1]
                    hl = np.cumsum(np.bincount(binned[rows, j], h[rows], size))[:-1]
                    gain = gl**2 / (hl + reg) + (gs - gl) ** 2 / (hs - hl + reg) - gs**2 / (hs + reg)
                    gain[(hl < least / 8) | (hs - hl < least / 8)] = 0
                    b = int(gain.argmax())
                    if gain[b] > best:
                        best, f[at], t[at] = gain[b], j, cuts[j][b]
            node[rows] = 2 * at + 1 + (x[rows, f[at]] > t[at])
        ends = node - inner
        value = rate * np.bincount(ends, g, leaves) / (np.bincount(ends, h, leaves) + reg)
        score += value[ends]
        feature.append(f.tolist())
        threshold.append([None if np.isinf(v) else round(float(v), 5) for v in t])
        leaf.append([round(float(v), 5) for v in value])
    return {"base": round(base, 5), "feature": feature, "threshold": threshold, "leaf": leaf}


def raw_score(model: dict, x: np.ndarray) -> np.ndarray:
    """Log odds by the trees."""
    out = np.full(len(x), model["base"])
    rows = np.arange(len(x))
    for f, t, v in zip(model["feature"], model["threshold"], model["leaf"]):
        f, t = np.asarray(f), np.asarray([np.inf if c is None else c for c in t])
        node = np.zeros(len(x), int)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, f[node]] > t[node])
        out += np.asarray(v)[node - (2**DEPTH - 1)]
    return out


def calibrate(score: np.ndarray, y: np.ndarray, steps: int = 300) -> tuple[float, float]:
    """Platt's (a, b): the probability is the logistic of a * score + b."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(a * score + b)))
        d = p - y
        w = p * (1 - p) + 1e-6
        a -= 0.5 * (d * score).mean() / ((w * score * score).mean() + 1e-9)
        b -= 0.5 * d.mean() / w.mean()
    return float(a), float(b)


def best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> float:
    """The calibrated probability from which on F1 is highest."""
    grid = np.linspace(0.05, 0.95, 19)
    weight = np.ones(len(p)) if weight is None else weight
    f1 = [2 * weight[(p >= c) & (y > 0)].sum() / max(1e-9, weight[p >= c].sum() + weight[y > 0].sum()) for c in grid]
    top = np.flatnonzero(np.asarray(f1) >= max(f1) - 1e-9)
    return float(grid[top[len(top) // 2]])

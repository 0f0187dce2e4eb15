"""Gradient-boosted regression trees for two classes, on binned features, in numpy: small models that a driver fits on
a bounded sample and executors apply to batches."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Trees(NamedTuple):
    """``cuts[f]`` are a feature's bin edges; a tree is arrays of node feature (-1: leaf), bin, left child and value."""

    cuts: list[np.ndarray]
    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for f, edges in enumerate(cuts):
        out[:, f] = np.searchsorted(edges, x[:, f], "left")
    return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, penalty: float = 1.0, least: float = 4.0) -> Trees:
    """Logistic loss, second-order gains, level by level. An empty sample or one class gives a constant model."""
    weight = np.ones(len(y)) if weight is None else weight
    if not len(y) or y.min() == y.max():
        return Trees([], 0.0 if not len(y) else (8.0 if y[0] else -8.0), [])
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    b = _binned(x, cuts).astype(np.int64)
    share = np.average(y, weights=weight)
    base = float(np.log(share / (1 - share)))
    score, trees = np.full(len(y), base), []
    span = bins + 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        grad, hess = weight * (y - p), weight * p * (1 - p)
        feature, cut, left, value = [-1], [0], [0], [0.0]
        node = np.zeros(len(y), np.int64)
        level = [0]
        for d in range(depth + 1):
            grown = []
            slot = np.full(len(feature), -1)
            slot[level] = np.arange(len(level))
            own = slot[node]
            used = np.flatnonzero(own >= 0)
            g_all = np.bincount(own[used], grad[used], len(level))
            h_all = np.bincount(own[used], hess[used], len(level))
            best = np.full(len(level), 1e-6)
            pick = np.full((len(level), 2), -1)
            for f in range(b.shape[1] if d < depth else 0):
                at = own[used] * span + b[used, f]
                g = np.bincount(at, grad[used], len(level) * span).reshape(-1, span).cumsum(1)
                h = np.bincount(at, hess[used], len(level) * span).reshape(-1, span).cumsum(1)
                gr, hr = g_all[:, None] - g, h_all[:, None] - h
                gain = g * g / (h + penalty) + gr * gr / (hr + penalty) - (g_all * g_all / (h_all + penalty))[:, None]
                gain[(h < least / 4) | (hr < least / 4)] = 0
                k = gain.argmax(1)
                top = gain[np.arange(len(level)), k]
                better = top > best
                best[better], pick[better, 0], pick[better, 1] = top[better], f, k[better]
            for k, n in enumerate(level):
                value[n] = rate * g_all[k] / (h_all[k] + penalty)
                if pick[k, 0] >= 0:
                    feature[n], cut[n], left[n] = int(pick[k, 0]), int(pick[k, 1]), len(feature)
                    grown += [len(feature), len(feature) + 1]
                    feature += [-1, -1]
                    cut += [0, 0]
                    left += [0, 0]
                    value += [0.0, 0.0]
            f_, c_, l_ = np.array(feature), np.array(cut), np.array(left)
            inner = f_[node] >= 0
            at = np.flatnonzero(inner)
            node[at] = l_[node[at]] + (b[at, f_[node[at]]] > c_[node[at]])
            level = grown
            if not level:
                break
        score = score + np.array(value)[node]
        trees.append((np.array(feature), np.array(cut), np.array(left), np.array(value)))
    return Trees(cuts, base, trees)


def predict(model: Trees, x: np.ndarray) -> np.ndarray:
    """Probabilities of the class 1."""
    score = np.full(len(x), model.base)
    if model.trees and len(x):
        b = _binned(x, model.cuts)
        for feature, cut, left, value in model.trees:
            node = np.zeros(len(x), np.int64)
            while True:
                at = np.flatnonzero(feature[node] >= 0)
                if not len(at):
                    break
                n = node[at]
                node[at] = left[n] + (b[at, feature[n]] > cut[n])
            score += value[node]
    return 1 / (1 + np.exp(-np.clip(score, -40, 40)))

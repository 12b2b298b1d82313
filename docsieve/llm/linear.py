"""Hashed logistic regression in numpy: batch fitting and FTRL-proximal."""

from __future__ import annotations

import zlib

import numpy as np


def bucket(feature: str, size: int) -> int:
    """The hash bucket of a feature, alike on every machine."""
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % size


def pack(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Feature lists as (flat indexes, row starts)."""
    starts = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(r) for r in rows], out=starts[1:])
    return np.fromiter((i for r in rows for i in r), np.int64, starts[-1]), starts


def margins(weights: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of weights per row."""
    sums = np.concatenate([[0.0], np.cumsum(weights[flat], dtype=np.float64)])
    return sums[starts[1:]] - sums[starts[:-1]]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[list[int]], labels: list[float], size: int, epochs: int = 60, l2: float = 1e-4, rate: float = 0.5, batch: int = 256, seed: int = 7) -> np.ndarray:
    """Weights of a logistic regression over binary features, by Adagrad over shuffled mini-batches."""
    y, w, g2 = np.asarray(labels, float), np.zeros(size), np.full(size, 1e-8)
    order = np.arange(len(rows))
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        random.shuffle(order)
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            flat, starts = pack([rows[i] for i in part])
            error = sigmoid(margins(w, flat, starts)) - y[part]
            used, where = np.unique(flat, return_inverse=True)
            grad = np.bincount(where, np.repeat(error, np.diff(starts)), len(used)) / len(part) + l2 * w[used]
            g2[used] += grad * grad
            w[used] -= rate * grad / np.sqrt(g2[used])
    return w


def ftrl(rows: list[list[int]], labels: list[float], size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.3, l2: float = 0.5, epochs: int = 8, offset: float = 0.0, weights: list[float] | None = None, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(indexes, values) of the non-zero weights of an FTRL-proximal logistic regression.

    ``offset`` is a fixed bias. Per-coordinate learning rates and L1 sparsity after McMahan et al., Ad click prediction (2013).
    """
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    cases = [np.unique(r) for r in rows]
    weight = np.ones(len(rows)) if weights is None else np.asarray(weights, float)
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in random.permutation(len(cases)):
            x = cases[i]
            if not len(x):
                continue
            zi, ni = z[x], n[x]
            wi = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(wi.sum() + offset, -30, 30)))
            g = (p - labels[i]) * weight[i]
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[x] = zi + g - sigma * wi
            n[x] = ni + g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    index = np.flatnonzero(w)
    return index, w[index]

"""Byte n-gram features and linear hinge-loss models fitted by dual coordinate descent."""

from __future__ import annotations

import numpy as np


def gram_codes(raw: bytes, dim: int) -> np.ndarray:
    """The hashed codes (0 to dim - 1, a power of two) of all byte trigrams, in order; a shorter text gives its padded self."""
    b = np.frombuffer(raw if len(raw) > 2 or not raw else raw.ljust(3), np.uint8).astype(np.uint32)
    if not len(b):
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        x = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(0x9E3779B1)
        return (x >> np.uint32(32 - (dim.bit_length() - 1))).astype(np.int64)


def hinge(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dim: int, cost: float = 1.0, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights (the last one the bias) that minimise |w|²/2 + cost · Σ max(0, 1 - y w·x), by dual coordinate descent.

    rows: indices and values of each example; y: +1 or -1. Coordinates are
    visited in an order shuffled with a fixed seed, so the result is the same
    each time.
    """
    w, alpha, rng = np.zeros(dim + 1), np.zeros(len(rows)), np.random.default_rng(seed)
    norm = np.array([float(v @ v) + 1.0 for _, v in rows])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            slack = y[i] * (float(w[at] @ v) + w[dim]) - 1.0
            new = min(max(alpha[i] - slack / norm[i], 0.0), cost)
            step = (new - alpha[i]) * y[i]
            if step:
                w[at] += step * v
                w[dim] += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


def platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a · margin + b))), fitted to y (0 or 1) by damped Newton steps."""
    x, t = np.stack([margin, np.ones_like(margin)], axis=1), np.array([1.0, 0.0])
    soft = np.where(y > 0, 1 - 1e-3, 1e-3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -35, 35)))
        grad = x.T @ (weight * (p - soft)) + 1e-3 * t
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, grad)
        t = t - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(t[0]), float(t[1])

"""Shared pieces of the numpy networks."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def adam(p: dict[str, np.ndarray], batches, rate: float, gradient) -> dict[str, np.ndarray]:
    """Trains p in place; gradient(p, *batch) gives the loss and its gradient."""
    m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    for t, batch in enumerate(batches, 1):
        _, g = gradient(p, *batch)
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return p

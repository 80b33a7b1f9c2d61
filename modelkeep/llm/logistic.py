"""Logistic regression on the few features of a bounded sample."""

from __future__ import annotations

import numpy as np


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, center: np.ndarray | None = None) -> np.ndarray:
    """Weights of the columns of ``x``, then the constant, by damped Newton
    steps; each is drawn to its ``center`` (0), the constant hardly."""
    x = np.column_stack([x, np.ones(len(x))])
    center = np.zeros(x.shape[1]) if center is None else center
    w = center.astype(float)
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - penalty * (w - center)
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(penalty), gradient)
        step *= min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w

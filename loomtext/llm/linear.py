"""Small logistic regressions, fitted on the driver to a bounded sample of labelled rows."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights, the intercept last, by Newton's method with a ridge on all but the intercept.

    A step that doesn't lower the penalised loss is halved, so that rare classes can't make it diverge.

    With one class only (or no rows) the weights are 0 and the intercept is the smoothed log odds.
    """
    n, d = x.shape
    w = np.zeros(d + 1)
    rate = (y.sum() + 0.5) / (n + 1.0)
    w[d] = np.log(rate / (1 - rate))
    if n == 0 or y.min() == y.max():
        return w
    a = np.hstack([x, np.ones((n, 1))])
    penalty = np.full(d + 1, ridge)
    penalty[d] = 1e-6
    loss = lambda w: float(np.logaddexp(0.0, a @ w).sum() - y @ (a @ w) + penalty @ (w * w) / 2)
    now = loss(w)
    for _ in range(rounds):
        p = sigmoid(a @ w)
        gradient = a.T @ (p - y) + penalty * w
        curve = (a * (p * (1 - p))[:, None]).T @ a
        curve[np.diag_indices(d + 1)] += penalty
        step = np.linalg.solve(curve, gradient)
        while loss(w - step) > now + 1e-9 and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        now = loss(w)
        if np.abs(step).max() < 1e-6:
            break
    return w


def predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])

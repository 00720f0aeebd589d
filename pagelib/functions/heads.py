"""A balanced logistic head of one tag, fitted in a task on a bounded training matrix."""

from __future__ import annotations

import numpy as np


def fit_logistic(x: np.ndarray, y: np.ndarray, c: float, steps: int = 40, rows: np.ndarray | None = None) -> np.ndarray:
    """Weights and intercept for raw features: standardised here, classes balanced here, ridge penalty 1 / c.

    Newton steps, halved until the loss falls; the intercept is not penalised. `rows` tells how many rows each stands for.
    """
    rows = np.ones(len(y)) if rows is None else rows
    mean = np.average(x, axis=0, weights=rows)
    spread = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=rows))
    spread[spread == 0] = 1.0
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    weight = c * len(y) / 2 * rows * np.where(y == 1, 1 / max((rows * y).sum(), 1), 1 / max((rows * (1 - y)).sum(), 1))
    ridge = np.ones(z.shape[1])
    ridge[-1] = 1e-9
    sign = 2 * y - 1

    def loss(w):
        return (weight * np.logaddexp(0, -sign * (z @ w))).sum() + (ridge * w * w).sum() / 2

    w, now = np.zeros(z.shape[1]), None
    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        slope = z.T @ (weight * (p - y)) + ridge * w
        if np.abs(slope).max() < 1e-8 * max(1.0, weight.sum()):
            break
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge)
        move, size = np.linalg.solve(curve, slope), 1.0
        while size > 1e-6 and loss(w - size * move) > now:
            size /= 2
        w = w - size * move
        now = loss(w)
    raw = w[:-1] / spread
    return np.append(raw, w[-1] - raw @ mean)


def steps_down(scores: np.ndarray, y: np.ndarray, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct scores from high to low: (score, positives at it, rows so far, positives so far)."""
    rows = np.ones(len(y)) if rows is None else rows
    order = np.argsort(-scores, kind="stable")
    s, hit = scores[order], (rows * y)[order]
    last = np.append(np.flatnonzero(np.diff(s)), len(s) - 1)
    found = np.cumsum(hit)[last]
    return s[last], np.diff(np.append(0, found)), np.cumsum(rows[order])[last], found


def average_precision(scores: np.ndarray, y: np.ndarray, rows: np.ndarray | None = None) -> float:
    _, at, so_far, found = steps_down(scores, y, rows)
    return float((at * found / so_far).sum() / max(at.sum(), 1))


def best_threshold(scores: np.ndarray, y: np.ndarray, rows: np.ndarray | None = None) -> float:
    """The score with the best F1, the lowest on ties."""
    s, at, so_far, found = steps_down(scores, y, rows)
    f1 = np.round(2 * found / (so_far + at.sum()), 12)
    return float(s[np.flatnonzero(f1 == f1.max())[-1]])


def choose_and_fit(x: np.ndarray, y: np.ndarray, folds: np.ndarray, cs: list[float],
                   rows: np.ndarray | None = None) -> tuple[float, float, float, np.ndarray]:
    """(c, threshold, average precision, head): c judged by scores of rows outside the fit, then fitted on all rows."""
    rows = np.ones(len(y)) if rows is None else rows
    judged = []
    for c in cs:
        out = np.zeros(len(y))
        for f in np.unique(folds):
            inside = folds != f
            head = fit_logistic(x[inside], y[inside], c, rows=rows[inside])
            out[~inside] = x[~inside] @ head[:-1] + head[-1]
        judged.append((average_precision(out, y, rows), -c, best_threshold(out, y, rows)))
    ap, minus_c, threshold = max(judged)
    return -minus_c, threshold, ap, fit_logistic(x, y, -minus_c, rows=rows)

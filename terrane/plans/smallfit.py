"""Fits of a handful of numbers on the driver (at most one per order, site or site set)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, steps: int = 1000) -> np.ndarray:
    """Minimise |a x - b| with x >= 0 by an active set."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, dtype=bool)
    scale = np.linalg.norm(a, axis=0)
    scale[scale == 0] = 1.0
    a = a / scale
    tol = 1e-12 * max(np.abs(a.T @ b).max(), 1e-300)
    for _ in range(steps):
        w = a.T @ (b - a @ x)
        w[free] = -np.inf
        if w.max() <= tol:
            return x / scale
        free[int(np.argmax(w))] = True
        while True:
            z = np.zeros(n)
            z[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if (z[free] > 0).all():
                x = z
                break
            blocked = free & (z <= 0)
            t = (x[blocked] / (x[blocked] - z[blocked])).min()
            x = x + t * (z - x)
            free &= x > 1e-15 * max(x.max(), 1e-300)
            x[~free] = 0.0
    raise RuntimeError(f"no convergence in {steps} steps")


def damped_least_squares(residual: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], x: np.ndarray, lowest: float = -np.inf, steps: int = 2000,
                         tol: float = 1e-9) -> np.ndarray:
    """Minimise |r(x)|^2, x >= lowest, for a residual given with its Jacobian (Levenberg-Marquardt, scaled by the curvature).

    Ends when ten steps in a row together gain less than ``tol`` of what is left.
    """
    x = np.asarray(x, dtype=float)
    r, j = residual(x)
    damping, values = 1e-3, [float(r @ r)]
    for _ in range(steps):
        slope = j.T @ r
        free = (x > lowest) | (slope < 0)  # the others rest on the bound
        size = np.linalg.norm(j[:, free], axis=0)
        size = np.maximum(size, 1e-6 * max(float(size.max(initial=0.0)), 1e-300))
        d = np.zeros(len(x))
        d[free] = -np.linalg.lstsq(np.vstack([j[:, free], np.sqrt(damping) * np.diag(size)]), np.append(r, np.zeros(len(size))), rcond=None)[0]
        moved = np.maximum(x + d, lowest)
        r2, j2 = residual(moved)
        if r2 @ r2 <= r @ r:
            x, r, j, damping = moved, r2, j2, max(damping / 5, 1e-30)
            values.append(float(r @ r))
            if len(values) > 10 and values[-11] - values[-1] <= tol * values[-11]:
                return x
        else:
            damping *= 4
            if damping > 1e20:  # no shorter step can be told apart
                return x
    raise RuntimeError(f"no convergence in {steps} steps")


def descend(at: Callable[[np.ndarray], list[tuple[float, np.ndarray]]], starts: np.ndarray, steps: int = 200, tol: float = 1e-12) -> np.ndarray:
    """Best end of damped Newton descents from several starts that share every evaluation.

    ``at`` gives value and slope for each row of points, and many points cost little more than one: a step asks once for the
    slopes around every point, whose differences are the curvature, and once for the points that several dampings lead to.
    A descent ends when no damping gains more than ``tol`` of the value.
    """
    shift, dampings = 1e-5, np.array([0.0, 1e-8, 1e-6, 1e-4, 1e-2, 1.0, 1e3])
    x = np.array(starts, dtype=float)
    value, slope = (np.array(part) for part in zip(*at(x)))
    live, size = list(range(len(x))), x.shape[1]
    for _ in range(steps):
        if not live:
            return x[int(np.argmin(value))]
        around = at(np.concatenate([x[i] + shift * np.eye(size) for i in live]))
        moves = []
        for n, i in enumerate(live):
            curve = np.array([g for _, g in around[n * size:(n + 1) * size]]) - slope[i]
            weight, axes = np.linalg.eigh((curve + curve.T) / (2 * shift))
            weight = np.abs(weight)  # down from saddles as well
            for damping in dampings:
                d = -axes @ ((axes.T @ slope[i]) / np.maximum(weight + damping * weight.max(), 1e-300))
                moves.append(d / max(1.0, np.abs(d).max()))
        tried = at(np.repeat(x[live], len(dampings), axis=0) + moves)
        for n, i in enumerate(list(live)):
            own = tried[n * len(dampings):(n + 1) * len(dampings)]
            k = int(np.argmin([v for v, _ in own]))
            gain = value[i] - own[k][0]
            if gain > 0:
                x[i], value[i], slope[i] = x[i] + moves[n * len(dampings) + k], *own[k]
            if not gain > tol * abs(value[i]):
                live.remove(i)
    raise RuntimeError(f"no convergence in {steps} steps")

"""Small optimisers on arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def nelder_mead(f: Callable[[np.ndarray], float], start: np.ndarray, steps: int = 2000, tolerance: float = 1e-9) -> tuple[np.ndarray, float]:
    """Minimum of f by the downhill simplex."""
    n = len(start)
    points = np.vstack([start, *(start + (0.1 * abs(start[i]) + 0.1) * np.eye(n)[i] for i in range(n))])
    values = np.array([f(p) for p in points])
    for _ in range(steps):
        order = np.argsort(values, kind="stable")
        points, values = points[order], values[order]
        if abs(values[-1] - values[0]) <= tolerance * (abs(values[0]) + tolerance):
            break
        centre = points[:-1].mean(axis=0)
        mirrored = 2 * centre - points[-1]
        value = f(mirrored)
        if value < values[0]:
            far = centre + 2 * (mirrored - centre)
            far_value = f(far)
            points[-1], values[-1] = (far, far_value) if far_value < value else (mirrored, value)
        elif value < values[-2]:
            points[-1], values[-1] = mirrored, value
        else:
            near = centre + 0.5 * ((mirrored if value < values[-1] else points[-1]) - centre)
            near_value = f(near)
            if near_value < min(value, values[-1]):
                points[-1], values[-1] = near, near_value
            else:
                points[1:] = points[0] + 0.5 * (points[1:] - points[0])
                values[1:] = [f(p) for p in points[1:]]
    best = int(np.argmin(values))
    return points[best], float(values[best])


def simplex_projection(v: np.ndarray, low: float = 0.0, high: float = 1.0) -> np.ndarray:
    """Nearest point with sum 1 and components in [low, high], by bisection on the shift."""
    a, b = v.min() - high, v.max() - low
    for _ in range(60):
        mid = (a + b) / 2
        if np.clip(v - mid, low, high).sum() > 1:
            a = mid
        else:
            b = mid
    return np.clip(v - (a + b) / 2, low, high)


def projected_gradient(gradient: Callable[[np.ndarray], np.ndarray], start: np.ndarray, project: Callable[[np.ndarray], np.ndarray], rate: float, steps: int = 800) -> np.ndarray:
    """Minimum of a smooth convex function over a convex set, with momentum and restarts."""
    x = y = project(start)
    t = 1.0
    for _ in range(steps):
        new = project(y - rate * gradient(y))
        if (y - new) @ (new - x) > 0:
            t = 1.0
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        if np.abs(new - x).max() < 1e-12:
            return new
        x, t = new, t_new
    return x

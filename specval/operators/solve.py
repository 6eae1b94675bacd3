"""Last step of the regressions: a p x p problem on the sums of ``gram``. Never sees rows."""

from __future__ import annotations

import numpy as np

from specval.operators.gram import Gram


def _system(g: Gram, alpha: float, intercept: bool) -> tuple[np.ndarray, np.ndarray]:
    """Normal equations. With an (unpenalised) intercept they are the centred ones."""
    full = g.centred if intercept else g.raw()
    return full[:-1, :-1] + alpha * np.eye(g.p), full[:-1, -1]


def _intercept(g: Gram, beta: np.ndarray, intercept: bool) -> float:
    return float(g.mean[-1] - g.mean[:-1] @ beta) if intercept else 0.0


def unconstrained(g: Gram, alpha: float = 0.0, intercept: bool = True) -> tuple[float, np.ndarray]:
    """Least squares (ridge for alpha > 0); the smallest-norm solution when columns are collinear."""
    a, b = _system(g, alpha, intercept)
    scale = np.sqrt(np.clip(np.diag(a), 1e-300, None))
    scale[np.diag(a) <= 0] = 1.0
    beta = np.linalg.lstsq(a / np.outer(scale, scale), b / scale, rcond=1e-12)[0] / scale
    return _intercept(g, beta, intercept), beta


def clip(beta: np.ndarray, bounds) -> np.ndarray:
    low, high = limits(bounds)
    return np.minimum(np.maximum(beta, low), high)


def limits(bounds) -> tuple[np.ndarray, np.ndarray]:
    low = np.array([-np.inf if lo is None else lo for lo, _ in bounds], dtype=float)
    high = np.array([np.inf if hi is None else hi for _, hi in bounds], dtype=float)
    return low, high


def projected(g: Gram, bounds, alpha: float = 1.0, intercept: bool = True) -> tuple[float, np.ndarray]:
    """Unconstrained solution, then clipped; the intercept is the unclipped one."""
    b0, beta = unconstrained(g, alpha, intercept)
    return b0, clip(beta, bounds)


def equal_weights(g: Gram, bounds, floor: float = 1.0) -> tuple[float, np.ndarray]:
    """The mean price shared equally, clipped."""
    share = max(float(g.mean[-1]) / g.p, floor)
    return 0.0, clip(np.full(g.p, share), bounds)


def bounded(g: Gram, bounds, alpha: float = 1.0, intercept: bool = True, start=None, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Minimise |X b - y|^2 + alpha |b|^2 within bounds, by an active set of coefficients held at a bound.

    Each round solves the free coefficients exactly, moves towards that solution until a bound stops it, and frees the
    held coefficient whose gradient points most strongly inwards. Columns are scaled to unit curvature.
    """
    a, b = _system(g, alpha, intercept)
    scale = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
    a, b = a / np.outer(scale, scale), b / scale
    low, high = (v * scale for v in limits(bounds))
    begin = np.zeros(g.p) if start is None else np.asarray(start, float) * scale
    x = np.minimum(np.maximum(begin, low), high)
    free = np.zeros(g.p, dtype=bool) if start is None else (x > low) & (x < high)
    free |= ~np.isfinite(low) & ~np.isfinite(high)
    tolerance = 1e-10 * max(1.0, float(np.abs(b).max(initial=0.0)))
    for _ in range(rounds):
        while free.any():
            rest = b[free] - a[np.ix_(free, ~free)] @ x[~free]
            goal = x.copy()
            goal[free] = np.linalg.lstsq(a[np.ix_(free, free)], rest, rcond=1e-12)[0]
            step = goal - x
            with np.errstate(divide="ignore", invalid="ignore"):
                room = np.where(step > 0, (high - x) / step, np.where(step < 0, (low - x) / step, np.inf))
            room[~free] = np.inf
            t = float(room.min(initial=np.inf))
            if t >= 1.0:
                x = goal
                break
            x = np.minimum(np.maximum(x + t * step, low), high)
            stop = int(np.argmin(room))
            x[stop] = high[stop] if step[stop] > 0 else low[stop]
            free[stop] = False
        gradient = a @ x - b
        pull = np.where(~free & (x <= low), -gradient, np.where(~free & (x >= high), gradient, -np.inf))
        pull[(low == high)] = -np.inf
        best = int(np.argmax(pull))
        if pull[best] <= tolerance:
            break
        free[best] = True
    else:
        raise ArithmeticError(f"no optimum after {rounds} rounds of the active set")
    beta = x / scale
    return _intercept(g, beta, intercept), clip(beta, bounds)


def objective(g: Gram, beta: np.ndarray, intercept: float, alpha: float) -> float:
    return g.rss(beta, intercept) + alpha * float(beta @ beta)


def kkt_violation(g: Gram, beta: np.ndarray, bounds, alpha: float, intercept: bool) -> float:
    """Largest relative violation of the optimality conditions (0 at the optimum)."""
    a, b = _system(g, alpha, intercept)
    low, high = limits(bounds)
    gradient = a @ beta - b
    slack = 1e-12 * np.maximum(1.0, np.abs(beta))
    at_low, at_high = beta <= low + slack, beta >= high - slack
    wrong = np.where(at_low & at_high, 0, np.where(at_low, np.maximum(-gradient, 0), np.where(at_high, np.maximum(gradient, 0), np.abs(gradient))))
    size = np.sqrt(np.clip(np.diag(a), 1e-300, None)) * max(1.0, float(np.sqrt(max(g.raw()[-1, -1], 0))))
    return float(np.max(wrong / size, initial=0.0))


def condition_number(g: Gram, alpha: float, intercept: bool) -> float:
    return float(np.linalg.cond(_system(g, alpha, intercept)[0]))


def subset_r2(g: Gram, keep: list[int]) -> float:
    """R-squared (not below 0) of the least-squares fit with intercept on some of the features."""
    part = g.subset(keep)
    if part.total_ss() <= 0:
        return 0.0
    b0, beta = unconstrained(part, 0.0, True)
    return max(0.0, 1.0 - part.rss(beta, b0) / part.total_ss())

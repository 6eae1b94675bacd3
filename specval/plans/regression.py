"""The regressions: a distributed pass per fit, then a p x p solve."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specval import config as C
from specval.functions.numeric import known
from specval.operators import solve
from specval.operators.frontier_rows import frontier_rows
from specval.operators.gram import Gram, gram
from specval.operators.skyline import BLOCK_ROWS, efficient_rows
from specval.operators.stats import without_outliers

WELL_CONDITIONED = 1e12
COLLINEAR = 0.8

COEFFICIENTS = (
    "feature string, coefficient double, lower double, upper double, within_bounds boolean, "
    "unconstrained double, adjustment double, base_cost double, rows_used bigint, rows_total bigint, method string"
)


class FitError(ValueError):
    """The data cannot support the fit."""


@dataclass
class Fit:
    features: list[str]
    intercept: float
    beta: np.ndarray
    bounds: list[tuple]
    gram: Gram
    method: str
    alpha: float = 0.0
    with_intercept: bool = False
    free: np.ndarray | None = None
    rows_total: int = 0
    redistributed: list[dict] = field(default_factory=list)

    @property
    def coefficients(self) -> dict[str, float]:
        return dict(zip(self.features, (float(b) for b in self.beta)))

    @property
    def efficiency_ratio(self) -> float:
        return self.gram.n / self.rows_total if self.rows_total else 1.0

    def records(self) -> list[tuple]:
        out = []
        for i, f in enumerate(self.features):
            value, (lo, hi) = float(self.beta[i]), self.bounds[i]
            free = None if self.free is None else float(self.free[i])
            inside = (lo is None or value >= lo) and (hi is None or value <= hi)
            out.append((f, value, lo, hi, inside, free, None if free is None else value - free,
                        float(self.intercept), int(self.gram.n), int(self.rows_total), self.method))
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """I8: one row per feature."""
        return spark.createDataFrame(self.records(), COEFFICIENTS)


def _checked(g: Gram) -> Gram:
    if g.n == 0:
        raise FitError("No rows with a positive price")
    return g


def _solve(g: Gram, bounds, alpha: float, intercept: bool, solver: str) -> tuple[float, np.ndarray]:
    if solver == "bounded":
        return solve.bounded(g, bounds, alpha, intercept)
    if solver == "projected":
        return solve.projected(g, bounds, alpha, intercept)
    if solver == "equal":
        return solve.equal_weights(g, bounds)
    raise ValueError(f"Unknown solver: {solver}")


def fit_efficient(df: DataFrame, features, price: str = "original_fee", alpha: float = 1.0, solver: str = "bounded",
                  block_rows: int = BLOCK_ROWS) -> Fit:
    """Ridge with intercept on the efficient rows with a positive price. A column without any value is no feature."""
    names = [f for f in features if f in df.columns]
    filled = df.agg(*[F.count(f).alias(f) for f in names]).first() if names else {}
    names = [f for f in names if filled[f]]
    if not names:
        raise FitError(f"None of the features {list(features)} found in data")
    rows = efficient_rows(df, names, price, block_rows)
    g = _checked(gram(rows.filter(F.col(price) > 0), names, price))
    bounds = [C.efficiency_bounds(f) for f in names]
    b0, beta = _solve(g, bounds, alpha, True, solver)
    free = solve.unconstrained(g, alpha, True)[1]
    complete = df.na.drop("any", subset=[price, *names]).count()
    return Fit(names, b0, beta, bounds, g, f"efficient_{solver}", alpha, True, free, complete)


def fit_whole_table(df: DataFrame, features, target: str | None = None, outlier_threshold: float = 3.0, alpha: float = 0.0,
                    solver: str | None = None) -> Fit:
    """I4: all rows without price outliers, through the origin, within the whole-table bounds."""
    names = [f for f in features if f in df.columns]
    if not names:
        raise FitError(f"None of the features {list(features)} found in data")
    target = target or ("monthly_fee" if "monthly_fee" in df.columns else "fee")
    kept = without_outliers(df, "original_fee", outlier_threshold).filter(known(df, target) > 0)
    g = _checked(gram(kept, names, target))
    bounds = [C.whole_table_bounds(f) for f in names]
    if solver is None:
        direct = alpha > 0 and solve.condition_number(g, alpha, False) < WELL_CONDITIONED
        solver = "projected" if direct else "bounded"
    b0, beta = _solve(g, bounds, alpha, False, solver)
    free = solve.unconstrained(g, alpha, False)[1]
    return Fit(names, b0, beta, bounds, g, f"whole_table_{solver}", alpha, False, free, g.n)


def fit_prices(df: DataFrame, features, outlier_threshold: float = 3.0, alpha: float = 0.0, use_efficient: bool = True,
               solver: str = "bounded", on_failure: str = "raise") -> Fit:
    """The efficient-row fit on the list price (else the fee); the whole-table fit if that is off.

    When the efficient-row fit is impossible, that is an error; ``on_failure='whole_table'`` asks for the other fit, whose
    ``method`` then says so.
    """
    price = "original_fee" if "original_fee" in df.columns else "fee"
    if use_efficient:
        try:
            return fit_efficient(df, features, price, 1.0, solver)
        except FitError:
            if on_failure != "whole_table":
                raise
            fit = fit_whole_table(df, features, None, outlier_threshold, alpha)
            fit.method += "_after_failed_efficient"
            return fit
    return fit_whole_table(df, features, None, outlier_threshold, alpha)


def fit_frontier_rows(df: DataFrame, features, flags=None, cost: str = "original_fee", key: str = "id", redistribute: bool = True) -> Fit:
    """Bounded least squares through the origin on the frontier rows, unlimited counted as twice the maximum."""
    from specval.operators.redistribute import average_collinear
    from specval.plans.cost_spec import unlimited_as_double_max

    flags = C.UNLIMITED_FLAGS if flags is None else flags
    names = [f for f in C.continuous(features, flags) if f in df.columns]
    values = unlimited_as_double_max(df, names, flags)
    rows = frontier_rows(df.withColumns({f"__v_{f}": v for f, v in values.items()}), names, flags, cost, key)
    g = gram(rows, names, cost, values={f: F.col(f"__v_{f}") for f in names})
    if g.n < len(names) + 1:
        raise FitError(f"Insufficient frontier rows ({g.n}) for {len(names)} features")
    bounds = [C.whole_table_bounds(f) for f in names]
    b0, beta = solve.bounded(g, bounds, 0.0, False)
    fixes: list[dict] = []
    if redistribute:
        beta, fixes = average_collinear(names, beta, g.correlation(), COLLINEAR)
    free = solve.unconstrained(g, 0.0, False)[1]
    return Fit(names, b0, beta, bounds, g, "multi_frontier", 0.0, False, free, g.n, fixes)

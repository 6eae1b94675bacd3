"""Fair cost, its ratio to the price, and the ranking built on it."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specval import config as C
from specval.functions.numeric import known, ratio, total
from specval.operators.curves import CLAMP, CURVE_POINTS, price_values
from specval.operators.features import present_features
from specval.operators.frontier import LIMITED, UNLIMITED, feature_frontiers, marginal_costs
from specval.operators.ordered import ROWS_PER_BUCKET, row_numbers

log = logging.getLogger(__name__)


@dataclass
class Scored:
    """Scored rows, and the tables that explain the score."""

    rows: DataFrame
    cost_structure: DataFrame
    frontier: DataFrame | None = None
    method: str = "frontier"


def contributions(df: DataFrame, frontier: DataFrame, features, flags=None, limit: int = CURVE_POINTS) -> DataFrame:
    """H2: ``contribution_<feature>``, the flag's cheapest cost where unlimited, else the frontier cost."""
    flags = C.UNLIMITED_FLAGS if flags is None else flags
    names = [f for f in C.continuous(features, flags) if f in df.columns]
    flat = {r["feature"]: r["cost"] for r in frontier.filter(F.col("kind") == UNLIMITED).collect()}  # one row per flag
    curve = frontier.filter(F.col("kind") == LIMITED)
    priced = price_values(df, curve, {f: known(df, f) for f in names}, CLAMP, "contribution_", limit)

    def settled(f: str) -> Column:
        metered = F.coalesce(F.col(f"contribution_{f}"), F.lit(0.0))
        flag = flags.get(f)
        if flag not in df.columns:
            return metered
        return F.when(F.col(flag) == 1, F.lit(float(flat.get(flag, 0.0)))).otherwise(metered)

    return priced.withColumns({f"contribution_{f}": settled(f) for f in names})


def frontier_scores(df: DataFrame, features=None, fee: str = "fee", flags=None, cost: str = "original_fee",
                    core=None, limit: int = CURVE_POINTS) -> Scored:
    """H1 to H5: frontiers, contributions, their sum B, and CS = B / fee."""
    flags = C.UNLIMITED_FLAGS if flags is None else flags
    features = C.BASIC_FEATURES if features is None else features
    core = features if core is None else core
    frontier = feature_frontiers(df, features, flags, cost)
    rows = contributions(df, frontier, features, flags, limit)
    parts = [F.col(f"contribution_{f}") for f in C.continuous(core, flags) if f"contribution_{f}" in rows.columns]
    rows = rows.withColumn("B", total(parts)).withColumn("CS", ratio(F.col("B"), F.col(fee)))
    return Scored(rows, marginal_costs(frontier, features, flags), frontier, "frontier")


def linear_baseline(df: DataFrame, intercept: float, coefficients: dict[str, float], values: dict[str, Column] | None = None) -> Column:
    """Intercept plus coefficient times feature; a missing feature counts as 0."""
    values = values or {}
    terms = [F.lit(float(b)) * F.coalesce(values.get(f, F.col(f)).cast("double"), F.lit(0.0)) for f, b in coefficients.items() if f in df.columns]
    return F.lit(float(intercept)) + total(terms)


def fixed_rate_scores(df: DataFrame, fit, fee: str = "fee") -> DataFrame:
    """H7: the fitted rates applied to all rows."""
    b = linear_baseline(df, fit.intercept, fit.coefficients)
    rows = df.withColumn("B_fixed_rates", b).withColumn("CS_fixed_rates", ratio(F.col("B_fixed_rates"), F.col(fee)))
    return rows.withColumns({"B": F.col("B_fixed_rates"), "CS": F.col("CS_fixed_rates")})


def unlimited_as_double_max(df: DataFrame, features, flags) -> dict[str, Column]:
    """A feature's column, or twice the column maximum where the row is unlimited."""
    flagged = [f for f in features if flags.get(f) in df.columns and f in df.columns]
    if not flagged:
        return {f: known(df, f) for f in features if f in df.columns}
    top = df.agg(*[F.max(known(df, f)).alias(f) for f in flagged])
    return {
        f: F.when(F.col(flags[f]) == 1, 2 * top.select(f).scalar()).otherwise(known(df, f)) if f in flagged else known(df, f)
        for f in features if f in df.columns
    }


def multi_frontier_scores(df: DataFrame, fit, fee: str = "fee", flags=None, features=None) -> DataFrame:
    """Rates of the frontier-row fit, next to the frontier method's own B and CS."""
    flags = C.UNLIMITED_FLAGS if flags is None else flags
    values = unlimited_as_double_max(df, list(fit.coefficients), flags)
    both = frontier_scores(df, features, fee, flags).rows.withColumnsRenamed({"B": "B_frontier", "CS": "CS_frontier"})
    both = both.drop(*[c for c in both.columns if c.startswith("contribution_") and c not in df.columns])
    rows = both.withColumn("B_multi_frontier", linear_baseline(df, fit.intercept, fit.coefficients, values))
    rows = rows.withColumn("CS_multi_frontier", ratio(F.col("B_multi_frontier"), F.col(fee)))
    return rows.withColumns({"B": F.col("B_multi_frontier"), "CS": F.col("CS_multi_frontier")})


METHODS = ("frontier", "fixed_rates", "multi_frontier", "linear_decomposition")


def cs_ratio(df: DataFrame, method: str = "frontier", feature_set: str = "basic", fee: str = "fee",
             features=None, solver: str = "bounded", on_failure: str = "raise", key: str = "id") -> Scored:
    """H6: score by the named method. ``on_failure='frontier'`` scores by frontier when the fit fails; ``method`` then says so."""
    from specval.plans import regression as R

    if method not in METHODS:
        raise ValueError(f"Unknown method: {method}. Supported methods: {', '.join(METHODS[:3])}")
    names = C.feature_set(feature_set)
    if method == "frontier":
        return frontier_scores(df, names, fee)
    try:
        if method == "multi_frontier":
            fit = R.fit_frontier_rows(df, features or present_features(df, C.continuous(names, C.UNLIMITED_FLAGS)), key=key)
            return Scored(multi_frontier_scores(df, fit, fee, features=names), fit.table(df.sparkSession), method=method)
        fit = R.fit_prices(df, features or present_features(df, names, C.UNLIMITED_FLAGS), solver=solver)
        return Scored(fixed_rate_scores(df, fit, fee), fit.table(df.sparkSession), method="fixed_rates")
    except R.FitError as problem:
        if on_failure != "frontier":
            raise
        log.warning("%s failed (%s); scoring by frontier", method, problem)
        scored = frontier_scores(df, names, fee)
        scored.method = f"frontier_after_failed_{method}"
        return scored


def rank_rows(df: DataFrame, order=("-CS", "id"), top_n: int | None = None, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``rank_number`` by CS descending with the id as tie-break, and its text form."""
    if top_n is not None:
        # only the first rows are ranked: a top-k, no total order
        columns = [F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_last() for c in order]
        df = df.orderBy(*columns).limit(top_n)
    ranked = row_numbers(df, list(order), "rank_number", rows_per_bucket=rows_per_bucket)
    return ranked.withColumn("rank_display", F.col("rank_number").cast("string"))


def rank_by_cs(df: DataFrame, method: str = "frontier", feature_set: str = "basic", fee: str = "fee",
               top_n: int | None = None, key: str = "id", **options) -> DataFrame:
    scored = cs_ratio(df, method, feature_set, fee, key=key, **options)
    return rank_rows(scored.rows, ("-CS", key), top_n)

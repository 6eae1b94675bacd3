"""Marginal-cost frontiers: levels, change points, segments and cumulative costs per feature."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specval import config as C
from specval.operators import piecewise as P
from specval.operators.frontier_rows import cheapest_unlimited
from specval.operators.levels import level_table
from specval.operators.ordered import ROWS_PER_BUCKET
from specval.session import materialize

MIN_LEVELS = 3
MIN_ROWS = 50
LINEAR_POINTS = 20


@dataclass
class MarginalFrontier:
    points: DataFrame
    segments: DataFrame
    levels: DataFrame
    unlimited: DataFrame


def _usable(coefficients: dict[str, float], features, df: DataFrame) -> dict[str, float]:
    return {f: b for f, b in coefficients.items() if f in features and f in df.columns}


def _few(levels: DataFrame, features) -> list[str]:
    counts = {r["feature"]: r["count"] for r in levels.groupBy("feature").count().collect()}  # one row per feature
    return [f for f in features if 0 < counts.get(f, 0) < MIN_LEVELS]


def marginal_frontier(df: DataFrame, coefficients: dict[str, float], base_cost: float, features, flags=None,
                      cost: str = "original_fee", rows_per_bucket: int = ROWS_PER_BUCKET) -> MarginalFrontier:
    """On the cheapest plan per level, with implausible levels left out."""
    flags = C.UNLIMITED_FLAGS if flags is None else flags
    rates = {f: b for f, b in _usable(coefficients, features, df).items() if b > 0}
    levels = materialize(level_table(df, list(rates), flags, cost).select("feature", "value", F.col("min_cost").alias("cost")), "levels")
    few = _few(levels, rates)
    curved = {f: b for f, b in rates.items() if f not in few}
    placed = P.positions(levels.filter(F.col("feature").isin(list(curved))), rows_per_bucket)
    plausible = materialize(P.without_price_jumps(placed, curved, rows_per_bucket).select("feature", "value", "cost"), "plausible-levels")
    segmented, segments = _segments(plausible, rows_per_bucket)
    points = P.cumulative_costs(segmented, segments, base_cost, curved, rows_per_bucket)
    if few:
        points = points.unionByName(_straight(df, {f: rates[f] for f in few}, base_cost))
    return MarginalFrontier(points, segments, levels, cheapest_unlimited(df, list(rates), flags, cost))


def _segments(levels: DataFrame, rows_per_bucket: int) -> tuple[DataFrame, DataFrame]:
    placed = P.positions(levels, rows_per_bucket)
    changes = materialize(P.change_points(placed, rows_per_bucket=rows_per_bucket), "change-points")
    segmented = materialize(P.with_segments(placed, changes, rows_per_bucket), "segmented-levels")
    return segmented, materialize(P.robust_segments(segmented), "segments")


def _straight(df: DataFrame, rates: dict[str, float], base_cost: float) -> DataFrame:
    """Twenty evenly spaced points on a line, for a feature with too few levels."""
    ends = df.agg(*[e for f in rates for e in (F.min(f).cast("double").alias(f"{f}|lo"), F.max(f).cast("double").alias(f"{f}|hi"))])
    rows = ends.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.lit(float(b)).alias("rate"), F.col(f"`{f}|lo`").alias("lo"), F.col(f"`{f}|hi`").alias("hi"))
        for f, b in rates.items()])).alias("s")).select("s.*")
    steps = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(LINEAR_POINTS - 1))).alias("i"))
    value = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (LINEAR_POINTS - 1)
    return steps.select(
        "feature", value.alias("value"), F.lit(None).cast("double").alias("actual_market_cost"),
        (F.lit(float(base_cost)) + value * F.col("rate")).alias("cumulative_cost"), F.col("rate").alias("marginal_cost"), F.lit("linear").alias("segment_label"))


def whole_table_marginal_frontier(df: DataFrame, features, flags=None, cost: str = "original_fee", fit=None,
                                  rows_per_bucket: int = ROWS_PER_BUCKET) -> MarginalFrontier:
    """Over all rows (unlimited ones included at their stored value), with the coefficients of the price fit."""
    from specval.plans.regression import fit_prices

    flags = C.UNLIMITED_FLAGS if flags is None else flags
    names = [f for f in features if f in df.columns]
    clean = df.na.drop("any", subset=[cost, *names])
    if clean.limit(MIN_ROWS).count() < MIN_ROWS:
        raise ValueError(f"fewer than {MIN_ROWS} complete rows")
    fit = fit or fit_prices(clean, names)
    rates = _usable(fit.coefficients, names, clean)
    levels = materialize(level_table(clean, list(rates), {}, cost, limited=False), "levels")
    few = _few(levels, rates)
    plain = levels.select("feature", "value", F.col("min_cost").alias("cost"))
    segmented, segments = _segments(plain.filter(~F.col("feature").isin(few or [""])), rows_per_bucket)
    points = P.cumulative_costs(segmented, segments, fit.intercept, rates, rows_per_bucket)
    if few:
        rate = F.coalesce(*[F.when(F.col("feature") == f, F.lit(float(rates[f]))) for f in few])
        points = points.unionByName(plain.filter(F.col("feature").isin(few)).select(
            "feature", "value", F.col("cost").alias("actual_market_cost"), (F.lit(float(fit.intercept)) + F.col("value") * rate).alias("cumulative_cost"),
            rate.alias("marginal_cost"), F.lit("linear").alias("segment_label")))
    points = points.join(levels.select("feature", "value", "avg_cost", "plan_count"), ["feature", "value"])
    return MarginalFrontier(points, segments, levels, cheapest_unlimited(clean, list(rates), flags, cost))

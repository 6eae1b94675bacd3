"""Checks of a fitted model."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specval import config as C
from specval.functions.numeric import known, total
from specval.operators import solve
from specval.operators.gram import Gram, gram
from specval.operators.quantiles import EXACT_ROWS, exact_quantiles

FOLDS = 5
KKT_TOLERANCE = 1e-6

Solver = Callable[[Gram], tuple[float, np.ndarray]]


def whole_table_solver(g: Gram) -> tuple[float, np.ndarray]:
    return solve.bounded(g, [C.whole_table_bounds(f) for f in g.features], 0.0, False)


def optimiser_consistency(spark: SparkSession, g: Gram, bounds, alpha: float = 0.0, intercept: bool = False, seed: int = 42) -> DataFrame:
    """L1: the objective from five starting points, their relative spread, and the optimality conditions."""
    draw = np.random.default_rng(seed)
    starts = [np.full(g.p, v) for v in (1.0, 100.0, 1000.0)] + [draw.uniform(1, 1000, g.p), draw.uniform(10, 500, g.p)]
    values, violation = [], 0.0
    for start in starts:
        b0, beta = solve.bounded(g, bounds, alpha, intercept, start=start)
        values.append(solve.objective(g, beta, b0, alpha))
        violation = max(violation, solve.kkt_violation(g, beta, bounds, alpha, intercept))
    mean = float(np.mean(values))
    spread = float(np.std(values)) / mean if mean > 0 else 0.0
    row = (spread < 0.01, spread, len(values), float(min(values)), violation, violation < KKT_TOLERANCE)
    return spark.createDataFrame([row], "is_consistent boolean, objective_cv double, successful_optimizations int, "
                                        "best_objective double, kkt_violation double, is_optimal boolean")


def economic_checks(coefficients: DataFrame) -> DataFrame:
    """L2, from a table (feature, coefficient): 5G over 10 GB of data, tethering over voice, everything positive."""
    def of(feature: str) -> Column:
        return F.max(F.when(F.col("feature") == feature, F.col("coefficient")))

    row = coefficients.agg(
        of("basic_data_clean").alias("data_per_gb"), of("is_5g").alias("fiveg_premium"),
        of("voice_clean").alias("voice_per_min"), of("tethering_gb").alias("tethering_per_gb"),
        F.count_if(F.col("coefficient") < 0).alias("negative_count"), F.count_if(F.col("coefficient") == 0).alias("zero_count"))
    return row.withColumns({
        "scale_ok": F.coalesce(F.col("fiveg_premium") > F.col("data_per_gb") * 10, F.lit(False)),
        "premium_ok": F.coalesce(F.col("tethering_per_gb") > F.col("voice_per_min"), F.lit(False)),
        "positive_ok": (F.col("negative_count") == 0) & (F.col("zero_count") == 0),
    })


def cross_validation(df: DataFrame, features, target: str = "fee", key: str = "id", folds: int = FOLDS,
                     solver: Solver = whole_table_solver, fold: Column | None = None) -> DataFrame:
    """L3: one row per fold with R2 and mean absolute error. Folds come from a hash of the key unless given.

    One pass gives the sums per fold; the training sums are the total minus the fold. A second pass measures the
    absolute errors of all folds at once.
    """
    names = [f for f in features if f in df.columns]
    number = F.pmod(F.xxhash64(key), F.lit(folds)) if fold is None else fold
    folded = df.withColumn("__fold", number.cast("int")).filter(known(df, target).isNotNull())
    whole = gram(folded, names, target, by="__fold")
    lines, rows = {}, []
    for k, part in sorted(whole.by.items()):
        rest = whole.plus(part, -1)
        if rest.n == 0:
            continue
        b0, beta = solver(rest)
        lines[k] = (b0, beta)
        r2 = 1.0 - part.rss(beta, b0) / part.total_ss() if part.total_ss() > 0 else None
        rows.append((k, r2, int(rest.n), int(part.n)))
    values = [F.coalesce(known(df, f), F.lit(0.0)) for f in names]
    guess = F.coalesce(*[
        F.when(F.col("__fold") == k, F.lit(b0) + total([F.lit(float(b)) * v for b, v in zip(beta, values)])) for k, (b0, beta) in lines.items()
    ])
    errors = folded.groupBy("__fold").agg(F.avg(F.abs(known(df, target) - guess)).alias("mae"))
    known_rows = df.sparkSession.createDataFrame(rows, "__fold int, r2_score double, train_size bigint, test_size bigint")
    return known_rows.join(errors, "__fold").select((F.col("__fold") + 1).alias("fold"), "r2_score", "mae", "train_size", "test_size")


def cross_validation_summary(folds: DataFrame) -> DataFrame:
    return folds.agg(
        F.avg("r2_score").alias("mean_r2"), F.stddev_pop("r2_score").alias("std_r2"),
        F.avg("mae").alias("mean_mae"), F.stddev_pop("mae").alias("std_mae"),
    ).withColumn("is_stable", F.col("std_r2") < 0.1)


def residual_quartiles(df: DataFrame, predicted: str, actual: str, exact_rows: int = EXACT_ROWS) -> DataFrame:
    """L4: residuals by quartile of the actual price."""
    base = df.select(known(df, actual).alias("y"), (known(df, actual) - known(df, predicted)).alias("r")).filter("y IS NOT NULL AND r IS NOT NULL")
    q1, q2, q3 = exact_quantiles(base, {"y": [0.25, 0.5, 0.75]}, exact_rows)["y"]
    if q1 is None:
        return base.select(F.lit(0).alias("quartile"), F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("residual_variance"), F.lit(0.0).alias("mean_residual")).limit(0)
    quarter = F.when(F.col("y") <= q1, 1).when(F.col("y") <= q2, 2).when(F.col("y") <= q3, 3).otherwise(4)
    return base.groupBy(quarter.alias("quartile")).agg(
        F.count(F.lit(1)).alias("n"), F.var_pop("r").alias("residual_variance"), F.avg("r").alias("mean_residual"))


def residual_checks(df: DataFrame, predicted: str, actual: str, exact_rows: int = EXACT_ROWS) -> DataFrame:
    """L4: mean, spread, Jarque-Bera normality, evenness over price quartiles, share beyond three deviations."""
    residual = (known(df, actual) - known(df, predicted)).alias("r")
    base = df.select(residual).filter("r IS NOT NULL")
    moments = base.agg(
        F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean_residual"), F.stddev_pop("r").alias("residual_std"),
        F.skewness("r").alias("skew"), F.kurtosis("r").alias("kurt"))
    spread = moments.select("residual_std").scalar()
    beyond = base.agg(F.count_if(F.abs("r") > 3 * spread).alias("n"))
    even = residual_quartiles(df, predicted, actual, exact_rows).agg(
        F.when(F.avg("residual_variance") > 0, F.stddev_pop("residual_variance") / F.avg("residual_variance")).alias("h"))
    jb = F.col("n") / 6 * (F.col("skew") * F.col("skew") + F.col("kurt") * F.col("kurt") / 4)
    return moments.select(
        "n", "mean_residual", "residual_std", jb.alias("jb_statistic"), F.exp(-jb / 2).alias("jb_p_value"),
        (F.exp(-jb / 2) > 0.05).alias("is_normal"), even.scalar().alias("heteroscedasticity"),
        F.coalesce(even.scalar() < 0.5, F.lit(False)).alias("is_homoscedastic"),
        beyond.scalar().alias("outlier_count"), (beyond.scalar() / F.col("n") * 100).alias("outlier_percentage"))


def overall_score(checks: DataFrame) -> DataFrame:
    """0 to 100 and a grade from a one-row table of check results."""
    good = [F.col(c).cast("int") for c in ("scale_ok", "premium_ok", "positive_ok")]
    economic = total(good)
    normal, even = F.col("is_normal"), F.col("is_homoscedastic")
    few, some = F.col("outlier_percentage") < 5, F.col("outlier_percentage") < 10
    quality = normal.cast("int") + even.cast("int") + few.cast("int")
    r2, stable = F.coalesce("mean_r2", F.lit(0.0)), F.coalesce("is_stable", F.lit(False))
    scored = checks.withColumns({
        "optimization_score": F.when(F.col("is_consistent"), 25).when(F.col("successful_optimizations") >= 3, 15).otherwise(0),
        "economic_score": F.when(economic == 3, 25).when(economic == 2, 17).when(economic == 1, 8).otherwise(0),
        "prediction_score": F.when((r2 > 0.8) & stable, 30).when((r2 > 0.6) & stable, 22).when(r2 > 0.6, 20)
        .when(r2 > 0.4, 10).when(r2 > 0.2, 5).otherwise(0),
        "residual_score": F.when(quality == 3, 20).when(quality == 2, 12).when(normal | even | some, 6).otherwise(0),
    })
    scored = scored.withColumn("total_score", sum((F.col(f"{p}_score") for p in ("economic", "prediction", "residual")), F.col("optimization_score")))
    s = F.col("total_score")
    return scored.withColumn("grade", F.when(s >= 85, "A").when(s >= 70, "B").when(s >= 55, "C").when(s >= 40, "D").otherwise("F"))


def full_report(df: DataFrame, fit, features=None, target: str = "fee", key: str = "id", solver: Solver = whole_table_solver) -> DataFrame:
    """All checks of a fit as one row."""
    spark = df.sparkSession
    names = features or fit.features
    values = [F.coalesce(known(df, f), F.lit(0.0)) for f in fit.features]
    scored = df.withColumn("__predicted", F.lit(float(fit.intercept)) + total([F.lit(float(b)) * v for b, v in zip(fit.beta, values)]))
    parts = [
        optimiser_consistency(spark, fit.gram, fit.bounds, fit.alpha, fit.with_intercept),
        economic_checks(fit.table(spark)),
        cross_validation_summary(cross_validation(df, names, target, key, solver=solver)),
        residual_checks(scored, "__predicted", target),
    ]
    report = parts[0].withColumn("__one", F.lit(1))
    for part in parts[1:]:  # one row each
        report = report.join(F.broadcast(part.withColumn("__one", F.lit(1))), "__one")
    return overall_score(report.drop("__one"))

"""Tables that explain a score: frontier points, residuals, coefficients, efficiency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specval import config as C
from specval.functions.numeric import known, total
from specval.functions.text import rank_text, richness, spec_text
from specval.operators.curves import EXTEND, price_values
from specval.operators.frontier import LIMITED, candidates, limited_value, monotone
from specval.operators.frontier_rows import cheapest_unlimited, frontier_rows, on_frontier
from specval.operators.ordered import ROWS_PER_BUCKET, min_ranks
from specval.operators.stats import feature_profile
from specval.session import materialize

FREE_BASELINE = "Free Baseline"


def ranks_with_ties(df: DataFrame, value: str = "CS", ascending: bool = False, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``ranking`` by the raw value, ``display_ranking`` with joint ranks for values equal to 10 digits."""
    ranked = min_ranks(df, value, not ascending, "ranking", "__display", "__ties", rows_per_bucket=rows_per_bucket)
    return ranked.withColumn("display_ranking", rank_text(F.col("__display"), F.col("__ties"))).drop("__display", "__ties")


def efficiency_quadrants(df: DataFrame, baseline: str = "B", fee: str = "fee", ratio: str = "CS") -> DataFrame:
    """H9."""
    size = [F.coalesce(known(df, f), F.lit(0.0)) for f in ("basic_data_clean", "voice_clean", "message_clean", "tethering_gb") if f in df.columns]
    cs = F.coalesce(ratio, F.lit(0.0))
    return df.select(
        "id", F.coalesce(baseline, F.lit(0.0)).alias("baseline"), F.coalesce(fee, F.lit(0.0)).alias("actual"), cs.alias("cs_ratio"),
        total(size).alias("feature_total"), F.coalesce("plan_name", F.lit("Unknown Plan")).alias("plan_name"),
        F.coalesce("mvno", F.lit("Unknown MVNO")).alias("mvno"), (cs >= 1.0).alias("is_good_value"))


def _frontier_tables(df: DataFrame, features, flags, cost):
    points = materialize(candidates(df, features, flags, cost), "frontier-candidates")
    kept = materialize(monotone(points), "frontier")
    limited = F.col("kind") == LIMITED
    return points.filter(limited), kept.filter(limited)


def point_classes(df: DataFrame, features, flags=None, cost: str = "original_fee", key: str = "id") -> DataFrame:
    """every limited row of every feature as frontier, excluded candidate or other."""
    flags = C.UNLIMITED_FLAGS if flags is None else flags
    names = [f for f in C.continuous(features, flags) if f in df.columns]
    points, kept = _frontier_tables(df, names, flags, cost)
    marked = on_frontier(df.filter(known(df, cost).isNotNull()), points, names, flags, cost)
    marked = marked.withColumnsRenamed({f"on_{f}": f"cand_{f}" for f in names})
    marked = on_frontier(marked, kept, names, flags, cost)
    cells = [
        F.struct(
            F.lit(f).alias("feature"), limited_value(df, f, flags).alias("value"),
            F.when(F.col(f"on_{f}"), "frontier").when(F.col(f"cand_{f}"), "excluded").otherwise("other").alias("point_class"))
        for f in names
    ]
    return (
        marked.select(key, known(df, cost).alias("cost"), F.explode(F.array(*cells)).alias("c"))
        .select(key, "c.feature", "c.value", "cost", "c.point_class").filter("value IS NOT NULL"))


def frontier_points(df: DataFrame, features, flags=None, cost: str = "original_fee", key: str = "id", name: str = "plan_name") -> DataFrame:
    """K1: frontier and excluded points with the first plan's name, the free starting point, and the cheapest unlimited plan."""
    flags = C.UNLIMITED_FLAGS if flags is None else flags
    names = [f for f in C.continuous(features, flags) if f in df.columns]
    points, kept = _frontier_tables(df, names, flags, cost)
    marked = on_frontier(df, points, names, flags, cost)
    cells = F.array(*[
        F.when(F.col(f"on_{f}"), F.struct(F.lit(f).alias("feature"), limited_value(df, f, flags).alias("value"))) for f in names
    ])
    hits = marked.select(F.col(key), F.col(name), known(df, cost).alias("cost"), F.explode(F.array_compact(cells)).alias("c"))
    named = hits.groupBy("c.feature", "c.value", "cost").agg(F.min_by(name, key).alias("plan_name"))
    frontier = kept.select("feature", "value", F.lit(True).alias("kept"))
    labelled = named.join(frontier, ["feature", "value"], "left").select(
        "feature", "value", "cost", "plan_name", F.when(F.col("kept"), "frontier").otherwise("excluded").alias("point_class"))
    free = kept.groupBy("feature").agg(F.min("value").alias("v")).filter("v > 0").select(
        "feature", F.lit(0.0).alias("value"), F.lit(0.0).alias("cost"), F.lit(FREE_BASELINE).alias("plan_name"), F.lit("frontier").alias("point_class"))
    flat = cheapest_unlimited(df, names, flags, cost, name, key).select(
        "feature", F.lit(None).cast("double").alias("value"), F.col("min_cost").alias("cost"), "plan_name", F.lit("unlimited").alias("point_class"))
    return labelled.unionByName(free).unionByName(flat)


def residual_table(df: DataFrame, features, flags=None, cost: str = "original_fee", key: str = "id", name: str = "plan_name",
                   labels=None, units=None) -> DataFrame:
    """K2: per feature the plan at the low end of its frontier, less what its other features cost on theirs.

    The residual is missing when one of the other features cannot be priced.
    """
    flags = C.UNLIMITED_FLAGS if flags is None else flags
    labels, units = labels or C.CORE_CONTINUOUS, units or C.FEATURE_UNITS
    names = [f for f in C.continuous(features, flags) if f in df.columns]
    _, kept = _frontier_tables(df, names, flags, cost)
    marked = on_frontier(df, kept, names, flags, cost)
    whole = F.struct(
        F.col(name).alias("target_plan_name"), spec_text(df, names, labels, units, flags).alias("plan_specs"),
        *[known(df, f).alias(f) for f in names])
    cells = F.array(*[
        F.when(F.col(f"on_{f}"), F.struct(
            F.lit(f).alias("feature"),
            F.struct(limited_value(df, f, flags).alias("v"), known(df, cost).alias("c"),
                     (-richness(df, [g for g in names if g != f], flags)).alias("r"), F.col(key).alias("k")).alias("order")))
        for f in names
    ])
    hits = marked.select(whole.alias("row"), F.explode(F.array_compact(cells)).alias("c"))
    targets = hits.groupBy("c.feature").agg(F.min_by("row", "c.order").alias("row"), F.min("c.order").alias("order"))
    targets = materialize(targets.select("feature", "row.*", F.col("order.c").alias("own_cost")), "residual-targets")
    priced = price_values(targets, kept, {f: F.col(f) for f in names}, EXTEND, "cost_")
    parts = [F.when(F.col("feature") != f, F.col(f"cost_{f}")).otherwise(0.0) for f in names]
    others = parts[0]
    for part in parts[1:]:
        others = others + part
    return priced.select(
        F.col("feature").alias("feature_analyzed"), "target_plan_name", "plan_specs", F.col("own_cost").alias("cost_of_analyzed_feature"),
        others.alias("combined_cost_others"), (F.col("own_cost") - others).alias("residual_cost"), others.isNotNull().alias("residual_cost_valid"))


def coefficient_chart(df: DataFrame, coefficients: DataFrame, labels=None, units=None) -> DataFrame:
    """K3: coefficient, label and unit per feature next to the feature's profile."""
    labels, units = labels or C.CORE_CONTINUOUS, units or C.FEATURE_UNITS
    spark = df.sparkSession
    features = [r["feature"] for r in coefficients.select("feature").collect()]  # one row per feature
    names = spark.createDataFrame([(f, labels.get(f, f), units.get(f, "")) for f in features], "feature string, display_name string, unit string")
    return (
        coefficients.select("feature", "coefficient").join(F.broadcast(names), "feature")
        .join(F.broadcast(feature_profile(df, features)), "feature", "left"))


def method_comparison(scored: DataFrame, marginal: DataFrame, coefficients: DataFrame, fee: str = "fee") -> DataFrame:
    """K3: both methods' coefficients per feature, and both methods' mean absolute error against the fee."""
    errors = scored.agg(
        F.avg(F.abs(F.col("B_frontier") - F.col(fee))).alias("traditional_mae"),
        F.avg(F.abs(F.col("B_multi_frontier") - F.col(fee))).alias("multi_frontier_mae"))
    errors = errors.withColumn("improvement_percentage", F.try_divide(F.col("traditional_mae") - F.col("multi_frontier_mae"), F.col("traditional_mae")) * 100)
    both = coefficients.select("feature", F.col("coefficient").alias("pure_cost")).join(
        marginal.select("feature", F.col("coefficient").alias("traditional_cost")), "feature", "left")
    return both.withColumns({c: errors.select(c).scalar() for c in errors.columns})


def frontier_matrix(df: DataFrame, features, flags=None, cost: str = "original_fee", key: str = "id") -> DataFrame:
    """K4: the frontier rows with their features and price."""
    flags = C.UNLIMITED_FLAGS if flags is None else flags
    names = [f for f in C.continuous(features, flags) if f in df.columns]
    return frontier_rows(df, names, flags, cost, key).select(key, "plan_name", *names, cost)


def matrix_ranges(matrix: DataFrame, features) -> DataFrame:
    """K4: smallest and largest value of each feature over the frontier rows."""
    long = matrix.select(*[F.col(f).cast("double").alias(f) for f in features]).unpivot([], list(features), "feature", "value")
    return long.groupBy("feature").agg(F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.count(F.lit(1)).alias("total_plans"))

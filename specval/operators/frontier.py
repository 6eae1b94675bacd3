"""Monotone cost frontiers: what the cheapest offer with at least so much of a feature costs.

A frontier is a long table (kind, feature, value, cost). The input is first reduced to the least cost per distinct
feature value, combined map-side, so a value or cost that a third of the rows share is no hot spot. Columns with very
many distinct values are thinned before that: a row that some row in a higher value range beats by ``cost - value`` can
never be on the frontier. Later steps only see the reduced table.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specval.config import UNLIMITED_FLAGS, continuous
from specval.functions.numeric import known, numbers, unpivot
from specval.operators.ordered import ROWS_PER_BUCKET, running
from specval.operators.quantiles import sketched_quantiles
from specval.session import materialize

LIMITED, UNLIMITED = "limited", "unlimited"
DENSE_VALUES = 50_000  # distinct values among the sample rows above which a column is thinned first
RANGES = 1_000
SKETCH = 4 * RANGES  # size of the sketch that gives their limits
POINT = ["kind", "feature", "value", "cost"]


def limited_value(df: DataFrame, feature: str, flags: dict[str, str]):
    """The feature where it is not unlimited, else missing."""
    value, flag = known(df, feature), flags.get(feature)
    return F.when(F.col(flag) == 0, value) if flag in df.columns else value


def _names_and_marks(df: DataFrame, features, flags) -> tuple[list[str], list[str]]:
    names = [f for f in continuous(features, flags) if f in df.columns]
    marks = dict.fromkeys(flags[f] for f in names if flags.get(f) in df.columns)
    return names, [m for m in marks if m not in names]


def _labelled(points: DataFrame, marks: list[str]) -> DataFrame:
    kind = F.when(F.col("feature").isin(marks or [""]), UNLIMITED).otherwise(LIMITED)
    return points.withColumn("kind", kind).select(*POINT)


def candidates(df: DataFrame, features, flags=None, cost: str = "original_fee") -> DataFrame:
    """Per cost the largest value, then per value the least cost.

    An unlimited flag takes part as a feature whose only value is 1, which leaves its cheapest row. One scan gives one row
    per cost with the best value of every feature.
    """
    flags = UNLIMITED_FLAGS if flags is None else flags
    names, marks = _names_and_marks(df, features, flags)
    best = [F.max(limited_value(df, f, flags)).alias(f) for f in names]
    best += [F.max(F.when(F.col(m) == 1, 1.0)).alias(m) for m in marks]
    priced = df.withColumn("__cost", known(df, cost)).filter("__cost IS NOT NULL")
    per_cost = priced.groupBy("__cost").agg(*best)
    long = unpivot(per_cost, ["__cost"], [c for c in per_cost.columns if c != "__cost"]).filter("value IS NOT NULL")
    return _labelled(long.groupBy("feature", "value").agg(F.min("__cost").alias("cost")), marks)


def cheapest_levels(df: DataFrame, features, flags=None, cost: str = "original_fee", dense_values: int = DENSE_VALUES) -> DataFrame:
    """Least cost per value, from which ``monotone`` makes the same frontier as from the candidates.

    A level that is no candidate costs at least as much as one with a larger value, so its ``cost - value`` is larger and
    it is dropped there.
    """
    flags = UNLIMITED_FLAGS if flags is None else flags
    names, marks = _names_and_marks(df, features, flags)
    values = [limited_value(df, f, flags).alias(f) for f in names]
    flat = [F.when(F.col(m) == 1, 1.0).alias(m) for m in marks]
    wide = df.select(known(df, cost).alias("__cost"), *values, *flat).filter("__cost IS NOT NULL")
    # sketches of the whole table choose between two ways to the same result
    distinct = wide.agg(*[F.approx_count_distinct(f).alias(f) for f in names]).first()
    dense = [f for f in names if distinct[f] > dense_values]
    if dense:
        wide = _thinned(wide, dense)
    long = unpivot(wide, ["__cost"], [*names, *marks]).filter("value IS NOT NULL")
    return _labelled(long.groupBy("feature", "value").agg(F.min("__cost").alias("cost")), marks)


def _thinned(wide: DataFrame, dense: list[str]) -> DataFrame:
    """Blanks values that a row in a higher value range beats. Three scans, none of which shuffles more than a sketch per task."""
    probs = [i / RANGES for i in range(1, RANGES)]
    limits = sketched_quantiles(wide, {f: (F.col(f), probs) for f in dense}, SKETCH)
    cut = Bucketizer(
        splitsArray=[[-math.inf, *sorted({v for v in limits[f] if math.isfinite(v)}), math.inf] for f in dense],
        inputCols=dense, outputCols=[f"__r_{f}" for f in dense], handleInvalid="keep")
    ranged = cut.transform(wide)
    entries = F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.col(f"__r_{f}").cast("int").alias("range"), (F.col("__cost") - F.col(f)).alias("slack"))
        for i, f in enumerate(dense)]))
    rows = ranged.select(entries.alias("e")).select("e.*").filter("slack IS NOT NULL").groupBy("i", "range").agg(F.min("slack").alias("least")).collect()
    least = {(r["i"], r["range"]): r["least"] for r in rows}  # at most RANGES + 1 rows per column
    for i, f in enumerate(dense):
        later, beyond = [], math.inf
        for k in range(RANGES + 1, -1, -1):
            later.append(beyond)
            beyond = min(beyond, least.get((i, k), math.inf))
        bound = F.element_at(numbers(later[::-1]), F.col(f"__r_{f}").cast("int") + 1)
        ranged = ranged.withColumn(f"__keep_{f}", F.when(F.col("__cost") - F.col(f) <= bound, F.col(f)))
    return ranged.withColumns({f: F.col(f"__keep_{f}") for f in dense}).drop(*[f"__keep_{f}" for f in dense], *[f"__r_{f}" for f in dense])


def monotone(points: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET, rows: int | None = None) -> DataFrame:
    """Keep a candidate unless a later one has a smaller ``cost - value``.

    Popping a candidate that is undercut, or that the next kept one exceeds by less than 1 per unit, both mean that
    the newcomer's ``cost - value`` is smaller. So a candidate stays iff it is a suffix minimum of that difference.
    A frontier that ends below 0 also gets the free point (0, 0).
    """
    slack = F.col("cost") - F.col("value")
    scanned = running(points, ["kind", "feature"], ["value"], {"later": ("min", slack)}, "after", rows_per_bucket)
    kept = scanned.filter(F.col("later").isNull() | (slack <= F.col("later")))
    here = F.struct("value", "cost")
    free = F.struct(F.lit(0.0).alias("value"), F.lit(0.0).alias("cost"))
    ends_below_zero = F.col("later").isNull() & (F.col("value") < 0) & (F.col("kind") == LIMITED)
    spread = kept.select("kind", "feature", F.explode(F.when(ends_below_zero, F.array(here, free)).otherwise(F.array(here))).alias("p"))
    return spread.select("kind", "feature", "p.value", "p.cost")


def feature_frontiers(df: DataFrame, features, flags=None, cost: str = "original_fee",
                      rows_per_bucket: int = ROWS_PER_BUCKET, dense_values: int = DENSE_VALUES) -> DataFrame:
    """H1: frontiers of all features and the cheapest unlimited row per flag, as one table."""
    points = materialize(cheapest_levels(df, features, flags, cost, dense_values), "cheapest-levels")
    return materialize(monotone(points, rows_per_bucket), "frontier")  # read several times by every caller


def marginal_costs(frontier: DataFrame, features, flags=None) -> DataFrame:
    """H5: slope between the first two points (the first cost if there is one point only) and the unlimited cost."""
    flags = UNLIMITED_FLAGS if flags is None else flags
    names = continuous(features, flags)
    # keep the two smallest values per feature by aggregation, no sort of the whole frontier
    pair = F.struct("value", "cost")
    first = frontier.filter(F.col("kind") == LIMITED).groupBy("feature").agg(
        F.min(pair).alias("a"), F.count(F.lit(1)).alias("points"))
    second = (
        frontier.filter(F.col("kind") == LIMITED).join(F.broadcast(first.select("feature", "a")), "feature")
        .filter(F.col("value") > F.col("a.value")).groupBy("feature").agg(F.min(pair).alias("b"))
    )
    flat = frontier.filter(F.col("kind") == UNLIMITED).select(F.col("feature").alias("flag"), F.col("cost").alias("unlimited_cost"))
    spark = frontier.sparkSession
    wanted = spark.createDataFrame([(f, flags.get(f)) for f in names], "feature string, flag string")
    slope = F.when(F.col("b").isNull(), F.col("a.cost")).otherwise(
        (F.col("b.cost") - F.col("a.cost")) / (F.col("b.value") - F.col("a.value")))
    return (
        wanted.join(first, "feature", "left").join(second, "feature", "left").join(flat, "flag", "left")
        .filter(F.col("a").isNotNull() | F.col("unlimited_cost").isNotNull())
        .select("feature", slope.alias("coefficient"), "unlimited_cost", F.coalesce("points", F.lit(0)).alias("points"))
    )


def min_increments(df: DataFrame, features, default: float = 1.0, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Smallest step between distinct values per feature; ``default`` for a single value."""
    long = unpivot(df, [], list(features)).filter("value IS NOT NULL AND NOT isnan(value)")
    levels = materialize(long.distinct(), "levels")
    stepped = running(levels, ["feature"], ["value"], {"previous": ("max", F.col("value"))}, "before", rows_per_bucket)
    return stepped.groupBy("feature").agg(
        F.coalesce(F.min(F.col("value") - F.col("previous")), F.lit(float(default))).alias("min_increment"))

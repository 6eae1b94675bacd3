"""Piecewise-linear costs on level tables (feature, value, cost).

Level tables are reduced tables, but a feature can still have very many distinct values, so every step here runs on
``ordered`` and never needs one feature in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specval.functions.numeric import known, numbers, total
from specval.operators import solve
from specval.operators.curves import CLAMP, price_values
from specval.operators.gram import gram
from specval.operators.levels import level_table
from specval.operators.ordered import ROWS_PER_BUCKET, neighbours, row_numbers, running, sequential
from specval.operators.quantiles import EXACT_ROWS, exact_quantiles
from specval.session import materialize

# fixed values of the segment rules
RELATIVE_CHANGE = 0.2
COST_DROP = 0.8
STEEPNESS = 10.0
RATE_SANITY = 100_000.0
RATE_CEILING = 50_000.0
RATE_CAP = 10_000.0
OLS_AGREEMENT = 2.0
HIGH_VALUE_SHARE = 0.8
MIN_SEPARATION = 0.1


# --- change points and segments -----------------------------------------------------------------

def positions(levels: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Adds ``pos`` (1..n by value) and ``n`` per feature, and writes the table once."""
    placed = row_numbers(levels.select("feature", "value", "cost"), ["value"], "pos", ["feature"], rows_per_bucket)
    sizes = levels.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    return materialize(placed.join(F.broadcast(sizes), "feature"), "placed-levels")


def _far_enough(min_gap: int):
    def kernel(pdf, state):
        last = None if state is None else state[0]
        mask = np.zeros(len(pdf), dtype=bool)
        for i, pos in enumerate(pdf["pos"].to_numpy()):
            if last is None or pos - last >= min_gap:
                mask[i], last = True, float(pos)
        return mask, None if last is None else (last,)

    return kernel


def change_points(placed: DataFrame, min_segment: int = 3, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """E5: levels where the mean slope of the next steps differs by more than 20 % from that of the last steps.

    A change point closer than ``min_segment`` levels to the one kept before is skipped.
    """
    w = max(2, min_segment // 2)
    offsets = [o for o in range(-w, w + 1) if o]
    near = neighbours(
        placed, ["feature"], "pos",
        {f"{c}{o}": (c, o) for o in offsets for c in ("value", "cost")}, rows_per_bucket)

    def at(column: str, offset: int) -> Column:
        return F.col(f"`{column}{offset}`") if offset else F.col(column)

    def slope(offset: int) -> Column:
        step = at("value", offset + 1) - at("value", offset)
        return F.when(step != 0, (at("cost", offset + 1) - at("cost", offset)) / step).otherwise(0.0)

    before = total([slope(o) for o in range(-w, 0)]) / w
    after = total([slope(o) for o in range(0, w)]) / w
    index = F.col("pos") - 1
    wide = near.withColumns({"before_slope": before, "after_slope": after})
    sharp = wide.filter(
        (F.col("n") >= 2 * min_segment) & (index >= w) & (index < F.col("n") - 1 - w)
        & (F.abs("before_slope") > 0)
        & (F.abs(F.col("after_slope") - F.col("before_slope")) > RELATIVE_CHANGE * F.abs("before_slope"))
    ).select("feature", "pos", "value", "cost", "before_slope", "after_slope")
    sharp = materialize(sharp, "change-candidates")
    kept = sequential(sharp, "feature", "pos", _far_enough(min_segment), [], rows_per_bucket, label="change-points")
    return kept.withColumn("idx", F.col("pos") - 1)


def with_segments(placed: DataFrame, changes: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Adds ``segment``, the number of change points at or before each level."""
    marked = placed.join(changes.select("feature", "pos", F.lit(1).alias("start")), ["feature", "pos"], "left")
    marked = materialize(marked.withColumn("start", F.coalesce("start", F.lit(0))), "marked-levels")
    counted = running(marked, ["feature"], ["pos"], {"earlier": ("sum", F.col("start"))}, "before", rows_per_bucket)
    return counted.withColumn("segment", F.coalesce("earlier", F.lit(0)) + F.col("start")).drop("earlier", "start")


def _per_segment(segmented: DataFrame) -> DataFrame:
    return segmented.groupBy("feature", "segment").agg(
        F.count(F.lit(1)).alias("points"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"),
        F.min("value").alias("start_feature"), F.max("value").alias("end_feature"),
        F.min_by("cost", "pos").alias("start_cost"), F.max_by("cost", "pos").alias("end_cost"),
        F.regr_slope("cost", "value").alias("ols_slope"), F.regr_intercept("cost", "value").alias("ols_intercept"),
        F.avg("cost").alias("mean_cost"),
    ).filter("points >= 2")


def segment_lines(segmented: DataFrame) -> DataFrame:
    """Least-squares line per segment of at least two levels."""
    flat = F.col("start_feature") == F.col("end_feature")
    return _per_segment(segmented).select(
        "feature", "segment", "start_feature", "end_feature",
        (F.col("first_pos") - 1).alias("start_idx"), (F.col("last_pos") - 1).alias("end_idx"),
        F.when(flat, 0.0).otherwise(F.col("ols_slope")).alias("slope"),
        F.when(flat, F.col("mean_cost")).otherwise(F.col("ols_intercept")).alias("intercept"), "points")


def robust_segments(segmented: DataFrame) -> DataFrame:
    """End-point slope, replaced by the least-squares slope where the two roughly agree; kept within sane limits."""
    width = F.col("end_feature") - F.col("start_feature")
    simple = (F.col("end_cost") - F.col("start_cost")) / width
    base = _per_segment(segmented).withColumn("simple", F.when(width != 0, simple).otherwise(0.0))
    agree = (
        (width != 0) & (F.col("points") >= 3) & (F.abs("simple") < RATE_SANITY) & (F.abs("ols_slope") < RATE_SANITY)
        & (F.abs(F.col("ols_slope") - F.col("simple")) / F.greatest(F.abs("simple"), F.lit(1.0)) < OLS_AGREEMENT)
    )
    rate = F.when(agree, F.col("ols_slope")).otherwise(F.col("simple"))
    line = base.withColumns({
        "rate": rate,
        "intercept": F.when(agree, F.col("ols_intercept")).otherwise(F.col("start_cost") - F.col("simple") * F.col("start_feature")),
    })
    return line.select(
        "feature", "segment", "start_feature", "end_feature",
        F.when(F.col("rate") < 0, 0.0).when(F.col("rate") > RATE_CEILING, RATE_CAP).otherwise(F.col("rate")).alias("marginal_rate"),
        "intercept", "start_cost", "end_cost", F.col("points").alias("data_points"))


def cumulative_costs(segmented: DataFrame, segments: DataFrame, base_cost: float, coefficients: dict[str, float],
                     rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Cost of each level, the used length of every segment up to it times the segment's rate, over the base cost.

    The whole segments below a level come from one prefix sum, its own segment by an equi-join. A feature without
    segments is priced linearly by its coefficient.
    """
    span = F.greatest(F.lit(0.0), F.col("end_feature") - F.greatest(F.col("start_feature"), F.lit(0.0)))
    priced = materialize(segments.withColumn("full_cost", span * F.col("marginal_rate")), "segments")
    present = segmented.select("feature", "segment").distinct()
    chain = materialize(present.join(priced, ["feature", "segment"], "left"), "segment-chain")
    chain = running(
        chain, ["feature"], ["segment"],
        {"below": ("sum", F.col("full_cost")), "earlier": ("sum", F.col("full_cost").isNotNull().cast("bigint"))}, "before", rows_per_bucket)
    fitted = priced.select("feature").distinct().withColumn("fitted", F.lit(True))
    rates = [(f, float(b)) for f, b in coefficients.items()]
    linear = segmented.sparkSession.createDataFrame(rates, "feature string, coefficient double")
    joined = (
        segmented.join(chain, ["feature", "segment"], "left")
        .join(F.broadcast(fitted), "feature", "left").join(F.broadcast(linear), "feature")
    )
    used = F.greatest(F.lit(0.0), F.least("end_feature", "value") - F.greatest(F.col("start_feature"), F.lit(0.0)))
    piecewise = F.coalesce("below", F.lit(0.0)) + F.coalesce(used * F.col("marginal_rate"), F.lit(0.0))
    here = F.col("marginal_rate").isNotNull()
    label = F.concat(
        F.lit("Segment "), (F.coalesce("earlier", F.lit(0)) + 1).cast("string"), F.lit(": "),
        _one_decimal(F.col("start_feature")), F.lit("-"), _one_decimal(F.col("end_feature")))
    return joined.select(
        "feature", "value", F.col("cost").alias("actual_market_cost"),
        (F.lit(float(base_cost)) + F.when(F.col("fitted"), piecewise).otherwise(F.col("value") * F.col("coefficient"))).alias("cumulative_cost"),
        F.coalesce("marginal_rate", "coefficient").alias("marginal_cost"),
        F.when(here, label).otherwise("linear").alias("segment_label"))


def _one_decimal(col: Column) -> Column:
    return F.translate(F.format_number(col, 1), ",", "")


# --- filters on levels ----------------------------------------------------------------------------

def without_cost_drops(levels: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Drop a level cheaper than any lower one. The last kept cost is always the running maximum."""
    seen = running(levels, ["feature"], ["value"], {"highest": ("max", F.col("cost"))}, "before", rows_per_bucket)
    return seen.filter(F.col("highest").isNull() | (F.col("cost") >= F.col("highest"))).drop("highest")


def _plausible(coefficients: dict[str, float]):
    def kernel(pdf, state):
        mask = np.zeros(len(pdf), dtype=bool)
        if len(pdf) == 0:
            return mask, state
        limit = STEEPNESS * coefficients[pdf["feature"].iloc[0]]
        for i, (v, c) in enumerate(zip(pdf["value"].to_numpy(), pdf["cost"].to_numpy())):
            if state is None or not (c < state[1] * COST_DROP or (c - state[1]) / (v - state[0]) > limit):
                mask[i], state = True, (float(v), float(c))
        return mask, state

    return kernel


def without_price_jumps(placed: DataFrame, coefficients: dict[str, float], rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Drop a level that costs less than 0.8 of the level kept before, or rises over 10 times the coefficient.

    With ``slack = cost - limit * value``, a level rises too steeply from the one kept before iff its slack is greater. Where no level costs
    less than 0.8 of any lower one, as after ``without_cost_drops``, only that counts, so the level kept last is the one of
    least slack so far: a running minimum, and no pass depends on another. Other tables go chunk by chunk; a state that all levels
    of a chunk are too cheap or too steep for passes it at once.
    """
    wanted = placed.filter(F.col("feature").isin(list(coefficients)))
    limits = F.create_map(*[F.lit(x) for f, c in coefficients.items() for x in (f, STEEPNESS * c)])
    slack = F.col("cost") - limits[F.col("feature")] * F.col("value")
    seen = running(wanted, ["feature"], ["pos"], {
        "highest": ("max", F.col("cost")),
        "last": ("min", F.struct(slack.alias("slack"), (-F.col("pos")).alias("late"), F.col("value").alias("v"), F.col("cost").alias("c")))}, "before", rows_per_bucket)
    seen = materialize(seen, "price-jumps-seen")
    if seen.filter(F.col("cost") < COST_DROP * F.col("highest")).isEmpty():
        steep = (F.col("cost") - F.col("last.c")) / (F.col("value") - F.col("last.v")) > limits[F.col("feature")]
        return seen.filter(F.col("last").isNull() | ~steep).drop("highest", "last")

    def passes_by(state, chunk) -> bool:
        value, cost = state
        limit = STEEPNESS * coefficients[chunk["feature"]]
        spare = 1e-9 * (abs(cost) + abs(limit * value) + abs(chunk["least_slack"]))  # rounding never lets a chunk with a kept level pass
        return chunk["most"] < cost * COST_DROP or chunk["least_slack"] > cost - limit * value + spare

    return sequential(
        wanted, "feature", "pos", _plausible(coefficients), ["feature", "value", "cost"], rows_per_bucket, label="price-jumps",
        summary={"feature": F.first("feature"), "most": F.max("cost"), "least_slack": F.min(slack)}, passes_by=passes_by)


# --- granular segments ------------------------------------------------------------------------------

def granular_points(df: DataFrame, features, flags=None, cost: str = "original_fee", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    levels = level_table(df, features, flags, cost).select("feature", "value", F.col("min_cost").alias("cost"))
    levels = materialize(levels, "levels")
    return positions(without_cost_drops(levels, rows_per_bucket), rows_per_bucket)


def granular_segments(points: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """One segment per consecutive pair of kept levels."""
    pairs = neighbours(points, ["feature"], "pos", {"end_feature": ("value", 1), "end_cost": ("cost", 1)}, rows_per_bucket)
    return pairs.filter("end_feature IS NOT NULL").select(
        "feature", (F.col("pos") - 1).alias("segment_id"), F.col("value").alias("start_feature"), "end_feature",
        F.col("cost").alias("start_cost"), "end_cost",
        ((F.col("end_cost") - F.col("cost")) / (F.col("end_feature") - F.col("value"))).alias("marginal_rate"))


def unlimited_intercepts(df: DataFrame, points: DataFrame, flags: dict[str, str], cost: str = "original_fee") -> DataFrame:
    """Mean unlimited cost over the mean cost of limited rows at 80 % or more of the largest kept value."""
    tops = {r["feature"]: r["top"] for r in points.groupBy("feature").agg(F.max("value").alias("top")).collect()}
    pairs = [(f, m) for f, m in flags.items() if f in tops and m in df.columns]
    schema = "feature string, flag_name string, coefficient double, unlimited_avg_cost double, limited_avg_cost double, unlimited_count bigint"
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    price = known(df, cost)
    row = df.agg(*[
        e for f, m in pairs for e in (
            F.avg(F.when(F.col(m) == 1, price)).alias(f"{f}|u"),
            F.avg(F.when((F.col(m) == 0) & (known(df, f) >= HIGH_VALUE_SHARE * tops[f]), price)).alias(f"{f}|l"),
            F.count_if((F.col(m) == 1) & price.isNotNull()).alias(f"{f}|n"))
    ])
    cells = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.lit(m).alias("flag_name"), (F.col(f"`{f}|u`") - F.col(f"`{f}|l`")).alias("coefficient"),
                 F.col(f"`{f}|u`").alias("unlimited_avg_cost"), F.col(f"`{f}|l`").alias("limited_avg_cost"), F.col(f"`{f}|n`").alias("unlimited_count"))
        for f, m in pairs
    ])
    return row.select(F.explode(cells).alias("s")).select("s.*").filter("coefficient IS NOT NULL")


def bundle_costs(df: DataFrame, points: DataFrame, intercepts: DataFrame, features, flags: dict[str, str], **limits) -> DataFrame:
    """Segment costs of every row's values plus the unlimited intercepts of its flags.

    Consecutive segments share their ends, so their summed cost is a curve through (value, cost - first cost).
    """
    firsts = points.groupBy("feature").agg(F.min_by("cost", "value").alias("first_cost"))
    curve = points.join(F.broadcast(firsts), "feature").select("feature", "value", (F.col("cost") - F.col("first_cost")).alias("cost"))
    names = [f for f in features if f in df.columns]
    out = price_values(df, curve, {f: F.when(known(df, f) > 0, known(df, f)) for f in names}, CLAMP, "segment_cost_", **limits)
    extra = {r["flag_name"]: r["coefficient"] for r in intercepts.collect()}  # one row per flag
    out = out.withColumns({f"segment_cost_{f}": F.coalesce(f"segment_cost_{f}", F.lit(0.0)) for f in names})
    flat = [F.when(F.col(m) == 1, F.lit(float(v))).otherwise(0.0) for m, v in extra.items() if m in df.columns]
    return out.withColumns({"intercept_cost": total(flat), "total_cost": total([F.col(f"segment_cost_{f}") for f in names] + flat)})


# --- quantile breakpoints and the piecewise regression ------------------------------------------

def detect_breakpoints(df: DataFrame, features, max_segments: int = 3, exact_rows: int = EXACT_ROWS) -> dict[str, list[float]]:
    """Quantile breakpoints, leaving out those within 10 % of the range of the one kept before."""
    names = [f for f in features if f in df.columns]
    if max_segments == 2:
        probs = [0.5]
    elif max_segments == 3:
        probs = [0.33, 0.67]
    else:
        probs = [float(q) for q in np.linspace(0.2, 0.8, max_segments - 1)]
    values = df.select(*[known(df, f).alias(f) for f in names])
    ends = values.agg(*[e for f in names for e in (F.min(f).alias(f"{f}|lo"), F.max(f).alias(f"{f}|hi"))]).first()
    # at least three distinct values: something lies strictly between the smallest and the largest
    spread = values.agg(*[
        F.max((F.col(f) > F.lit(ends[f"{f}|lo"])) & (F.col(f) < F.lit(ends[f"{f}|hi"]))).alias(f) for f in names
    ]).first()
    usable = [f for f in names if spread[f]]
    quantiles = exact_quantiles(values, {f: probs for f in usable}, exact_rows)
    found: dict[str, list[float]] = {f: [] for f in names}
    for f in usable:
        separation = (ends[f"{f}|hi"] - ends[f"{f}|lo"]) * MIN_SEPARATION
        for q in quantiles[f]:
            if not found[f] or abs(q - found[f][-1]) > separation:
                found[f].append(q)
    return found


def segment_feature_names(breakpoints: dict[str, list[float]], features) -> dict[str, list[str]]:
    return {f: [f"{f}_seg_{i}" for i in range(len(breakpoints[f]) + 1)] if breakpoints.get(f) else [f] for f in features}


def segment_features(df: DataFrame, features, breakpoints: dict[str, list[float]]) -> DataFrame:
    """The part of each value that falls into each segment."""
    columns = {}
    for f in features:
        limits = breakpoints.get(f)
        if not limits or f not in df.columns:
            continue
        value = known(df, f)
        columns[f"{f}_seg_0"] = F.when(value.isNotNull(), F.least(value, F.lit(float(limits[0]))))
        for i, low in enumerate(limits):
            over = value - F.lit(float(low))
            part = F.least(over, F.lit(float(limits[i + 1] - low))) if i + 1 < len(limits) else over
            columns[f"{f}_seg_{i + 1}"] = F.when(value.isNotNull(), F.greatest(F.lit(0.0), part))
    return df.withColumns(columns)


class PiecewiseModel:
    """Linear in the segment features; fitted from sums of products."""

    def __init__(self, breakpoints: dict[str, list[float]] | None = None, max_segments: int = 3):
        self.breakpoints = dict(breakpoints or {})
        self.max_segments = max_segments
        self.base_cost = 0.0
        self.coefficients: dict[str, list[float]] = {}

    def fit(self, df: DataFrame, features, cost: str = "original_fee") -> "PiecewiseModel":
        names = [f for f in features if f in df.columns]
        missing = [f for f in names if f not in self.breakpoints]
        if missing:
            self.breakpoints.update(detect_breakpoints(df, missing, self.max_segments))
        parts = segment_feature_names(self.breakpoints, names)
        flat = [c for f in names for c in parts[f]]
        g = gram(segment_features(df, names, self.breakpoints), flat, cost)
        self.base_cost, beta = solve.unconstrained(g, 0.0, True)
        by_name = dict(zip(flat, (float(b) for b in beta)))
        self.coefficients = {f: [by_name[c] for c in parts[f]] for f in names}
        return self

    def predict(self, df: DataFrame, column: str = "predicted_cost") -> DataFrame:
        if not self.coefficients:
            raise ValueError("Model not fitted yet")
        names = [f for f in self.coefficients if f in df.columns]
        parts = segment_feature_names(self.breakpoints, names)
        wide = segment_features(df, names, self.breakpoints)
        terms = [F.lit(b) * F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for f in names for b, c in zip(self.coefficients[f], parts[f])]
        made = [c for c in wide.columns if c not in df.columns]
        return wide.withColumn(column, F.lit(self.base_cost) + total(terms)).drop(*made)

    def marginal_cost(self, feature: str, value: Column) -> Column:
        """The coefficient of the segment a value falls into (0 for an unknown feature)."""
        if feature not in self.coefficients:
            return F.lit(0.0)
        return marginal_cost(value, self.breakpoints.get(feature, []), self.coefficients[feature])


def marginal_cost(value: Column, breakpoints: list[float], coefficients: list[float]) -> Column:
    """Indexed by how many breakpoints lie below the value."""
    below = total([F.when(value > float(b), 1).otherwise(0) for b in breakpoints]).cast("int") if breakpoints else F.lit(0)
    return F.coalesce(F.try_element_at(numbers(coefficients), below + 1), F.lit(0.0))

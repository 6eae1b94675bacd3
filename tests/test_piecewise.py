"""Small limits force the bucketed forms; they must equal the single-task forms, which the SQL check covers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from specval import config as C
from specval.fixtures import plans
from specval.operators import piecewise as P
from specval.operators.features import prepare_features
from specval.operators.levels import level_table
from specval.plans.marginal import marginal_frontier, whole_table_marginal_frontier

FEATURES = ["basic_data_clean", "voice_clean", "tethering_gb"]
RATES = {"basic_data_clean": 120.0, "voice_clean": 8.0, "tethering_gb": 20.0}


@pytest.fixture(scope="module")
def table(spark, folder):
    return prepare_features(plans(spark, folder), exclude=["id"])


def same(a, b, keys=("feature", "value")):
    def rows(df):
        return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect()), key=str)

    assert rows(a) == rows(b)


def test_change_points_by_hand(spark):
    # slope 1 up to value 6, then slope 5
    values = list(range(13))
    costs = [min(v, 6) + 5 * max(0, v - 6) for v in values]
    df = spark.createDataFrame([("f", float(v), float(c)) for v, c in zip(values, costs)], "feature string, value double, cost double")
    slopes = np.diff(costs)
    sharp = [i for i in range(2, len(slopes) - 2) if abs(slopes[i:i + 2].mean() - slopes[i - 2:i].mean()) / abs(slopes[i - 2:i].mean()) > 0.2]
    want = [sharp[0]]
    for i in sharp[1:]:
        if i - want[-1] >= 3:
            want.append(i)
    for chunk in (1000, 4):
        assert sorted(r["idx"] for r in P.change_points(P.positions(df), rows_per_bucket=chunk).collect()) == want
    short = df.filter("value < 5")
    assert P.change_points(P.positions(short)).count() == 0


def test_bucketed_segments_equal_single_task_segments(spark, table):
    levels = level_table(table, FEATURES).select("feature", "value", F.col("min_cost").alias("cost"))
    results = []
    for limit in (1_000_000, 11):
        placed = P.positions(levels, limit)
        segmented = P.with_segments(placed, P.change_points(placed, rows_per_bucket=limit), limit)
        results.append((segmented, P.cumulative_costs(segmented, P.robust_segments(segmented), 1000.0, RATES, limit)))
    same(results[0][0], results[1][0])
    same(results[0][1], results[1][1])


def test_marginal_frontiers_do_not_depend_on_the_limit(table):
    a = marginal_frontier(table, RATES, 500.0, [*FEATURES, "is_5g"])
    b = marginal_frontier(table, RATES, 500.0, [*FEATURES, "is_5g"], rows_per_bucket=9)
    same(a.points, b.points)
    few = marginal_frontier(table, {**RATES, "is_5g": 800.0}, 500.0, ["is_5g", "voice_clean"])
    straight = few.points.filter("feature = 'is_5g'").collect()
    assert len(straight) == 20 and {r["segment_label"] for r in straight} == {"linear"}


def test_whole_table_frontier(spark, table):
    out = whole_table_marginal_frontier(table, FEATURES)
    assert set(r["feature"] for r in out.points.select("feature").distinct().collect()) == set(FEATURES)
    with pytest.raises(ValueError):
        whole_table_marginal_frontier(table.limit(10), FEATURES)


def test_granular_costs(spark, table):
    flags = {f: m for f, m in C.UNLIMITED_FLAGS.items() if f in FEATURES}
    points = P.granular_points(table, FEATURES)
    segments = P.granular_segments(points).collect()
    premiums = P.unlimited_intercepts(table, points, flags)
    extra = {r["flag_name"]: r["coefficient"] for r in premiums.collect()}
    same(P.granular_segments(points), P.granular_segments(P.granular_points(table, FEATURES, rows_per_bucket=8), 5))
    out = P.bundle_costs(table, points, premiums, FEATURES, flags)
    joined = P.bundle_costs(table, points, premiums, FEATURES, flags, limit=1, rows_per_bucket=9)
    same(out.select("id", "total_cost"), joined.select("id", "total_cost"))
    for r in out.limit(40).collect():
        want = sum(
            max(0.0, min(s["end_feature"], r[s["feature"]]) - s["start_feature"]) * s["marginal_rate"]
            for s in segments if r[s["feature"]] > 0) + sum(v for m, v in extra.items() if r[m] == 1)
        assert r["total_cost"] == pytest.approx(want, abs=1e-6)
    kept = points.filter("feature = 'voice_clean'").orderBy("value").collect()
    assert all(a["cost"] <= b["cost"] for a, b in zip(kept, kept[1:]))


def test_piecewise_model_recovers_its_own_rates(spark):
    rows = [(float(v), float(w), 100.0 + 5 * min(v, 20) + 2 * max(0, v - 20) + 7 * w) for v in range(0, 60) for w in range(3)]
    df = spark.createDataFrame(rows, "v double, w double, original_fee double")
    model = P.PiecewiseModel({"v": [20.0], "w": []}).fit(df, ["v", "w"])
    assert model.base_cost == pytest.approx(100) and model.coefficients["v"] == pytest.approx([5, 2]) and model.coefficients["w"] == pytest.approx([7])
    worst = model.predict(df).select(F.max(F.abs(F.col("predicted_cost") - F.col("original_fee")))).first()[0]
    assert worst < 1e-8
    rate = {r["v"]: r["m"] for r in df.select("v", model.marginal_cost("v", F.col("v")).alias("m")).distinct().collect()}
    assert rate[20.0] == pytest.approx(5) and rate[21.0] == pytest.approx(2)
    with pytest.raises(ValueError):
        P.PiecewiseModel().predict(df)
    assert P.detect_breakpoints(df, ["v", "w"], 2)["v"] == pytest.approx([29.5])
    assert len(P.detect_breakpoints(df, ["v"], 5)["v"]) == 4


def test_breakpoints_need_three_values_and_separation(spark):
    df = spark.createDataFrame([(0.0, float(i % 2)) for i in range(30)] + [(100.0, 0.0), (50.0, 1.0)], "a double, b double")
    assert P.detect_breakpoints(df, ["a", "b"]) == {"a": [0.0], "b": []}

import random

import pytest
from pyspark.sql import functions as F

from specval.operators.curves import CLAMP, EXTEND, price_values
from specval.operators.frontier import feature_frontiers, min_increments
from specval.operators.frontier_rows import frontier_rows


def stack_frontier(rows):
    """The pop rules applied one candidate after the other."""
    by_cost, by_value, stack = {}, {}, []
    for v, c in rows:
        by_cost[c] = max(v, by_cost.get(c, v))
    for c, v in by_cost.items():
        by_value[v] = min(c, by_value.get(v, c))
    for v, c in sorted(by_value.items()):
        while stack and (c < stack[-1][1] or c - stack[-1][1] < v - stack[-1][0]):
            stack.pop()
        stack.append((v, c))
    if stack and stack[-1][0] < 0:
        stack.append((0.0, 0.0))
    return sorted(stack)


def points(spark, rows, **kw):
    df = spark.createDataFrame([(float(v), float(c)) for v, c in rows], "f double, original_fee double")
    out = feature_frontiers(df, ["f"], {}, "original_fee", **kw).collect()
    return sorted((r["value"], r["cost"]) for r in out)


@pytest.mark.parametrize("rows, want", [
    ([(0, 5), (1, 9), (2, 4), (5, 6), (10, 30)], [(5, 6), (10, 30)]),
    ([(1, 10), (3, 10)], [(3, 10)]),
    ([(0, 7)], [(0, 7)]),
    ([(0, 0), (4, 4), (8, 7.996)], [(8, 7.996)]),
    ([(0, 0), (4, 4), (8, 8)], [(0, 0), (4, 4), (8, 8)]),
    ([(-5, 3), (-2, 9)], [(-5, 3), (-2, 9), (0, 0)]),
])
def test_hand_made(spark, rows, want):
    assert points(spark, rows) == want


@pytest.mark.parametrize("bucket", [1_000_000, 7])
def test_random_frontiers_match_the_rules(spark, bucket):
    draw = random.Random(11)
    for _ in range(3):
        rows = [(draw.randrange(-20, 200), draw.randrange(0, 300)) for _ in range(draw.randrange(1, 250))]
        assert points(spark, rows, rows_per_bucket=bucket) == stack_frontier(rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_thinned_columns_give_the_same_frontier(spark, seed):
    draw = random.Random(seed)
    rows = [(draw.randrange(-3000, 30000) / 8, draw.randrange(0, 90000) / 4) for _ in range(4000)] + [(5.0, 100.0)] * 2000
    assert points(spark, rows, dense_values=10) == points(spark, rows) == stack_frontier(rows)


def test_slope_of_kept_points_is_at_least_one(spark):
    draw = random.Random(2)
    got = points(spark, [(draw.randrange(500), draw.randrange(4000)) for _ in range(800)])
    assert all((c2 - c1) / (v2 - v1) >= 1 for (v1, c1), (v2, c2) in zip(got, got[1:]))


def test_unlimited_rows_leave_the_curve_and_give_the_flag_cost(spark):
    df = spark.createDataFrame([(5.0, 0, 50.0), (0.0, 1, 90.0), (0.0, 1, 80.0), (7.0, 0, None)], "f double, u int, original_fee double")
    out = {(r["kind"], r["feature"], r["cost"]) for r in feature_frontiers(df, ["f", "u"], {"f": "u"}).collect()}
    assert out == {("limited", "f", 50.0), ("unlimited", "u", 80.0)}


CURVE = [(0.0, 10.0), (10.0, 30.0), (20.0, 100.0)]


@pytest.mark.parametrize("limit", [100, 1])
@pytest.mark.parametrize("mode, want", [
    (CLAMP, {-5.0: 10.0, 0.0: 10.0, 5.0: 20.0, 10.0: 30.0, 15.0: 65.0, 20.0: 100.0, 30.0: 100.0, None: None}),
    (EXTEND, {-5.0: 0.0, 0.0: 10.0, 5.0: 20.0, 10.0: 30.0, 15.0: 65.0, 20.0: 100.0, 30.0: 170.0, None: None}),
])
def test_reading_a_curve_by_literal_and_by_join(spark, mode, want, limit):
    curve = spark.createDataFrame([("f", v, c) for v, c in CURVE] + [("g", 3.0, 7.0)], "feature string, value double, cost double")
    df = spark.createDataFrame([(x, x) for x in want], "f double, g double")
    out = price_values(df, curve, {"f": F.col("f"), "g": F.col("g"), "none": F.col("f")}, mode, limit=limit, rows_per_bucket=3)
    rows = out.collect()
    assert {r["f"]: r["cost_f"] for r in rows} == want
    assert {r["cost_g"] for r in rows if r["f"] is not None} == {7.0}
    assert {r["cost_none"] for r in rows} == {None}


@pytest.mark.parametrize("mode", [CLAMP, EXTEND])
def test_both_ways_give_the_same_doubles(spark, mode):
    draw = random.Random(8)
    xs = sorted(draw.sample(range(1, 500), 40))
    curve = spark.createDataFrame([(f, x / 7, draw.random() * 1000) for f in "fg" for x in xs], "feature string, value double, cost double")
    df = spark.createDataFrame([(i, draw.random() * 90 - 8, draw.random() * 90 - 8) for i in range(2000)], "id bigint, f double, g double")
    columns = {"f": F.col("f"), "g": F.col("g")}
    a, b = ({r["id"]: (r["cost_f"], r["cost_g"]) for r in price_values(df, curve, columns, mode, limit=n).collect()} for n in (10_000, 1))
    assert a == b


def test_frontier_rows_by_literal_and_by_join(spark):
    draw = random.Random(4)
    rows = [(i, float(draw.randrange(40)), int(draw.random() < 0.1), float(draw.randrange(9)), float(draw.randrange(500))) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, f double, u int, g double, original_fee double")
    a = {r["id"] for r in frontier_rows(df, ["f", "g"], {"f": "u"}).collect()}
    b = {r["id"] for r in frontier_rows(df, ["f", "g"], {"f": "u"}, limit=1).collect()}
    limited = stack_frontier([(f, c) for _, f, u, _, c in rows if not u])
    other = stack_frontier([(g, c) for _, _, _, g, c in rows])
    cheapest = min((c, i) for i, _, u, _, c in rows if u)[1]
    want = {i for i, f, u, g, c in rows if (not u and (f, c) in limited) or (g, c) in other or i == cheapest}
    assert a == b == want


def test_min_increments(spark):
    df = spark.createDataFrame([(1.0, 3.0), (4.0, 3.0), (4.5, 3.0)], "a double, b double")
    assert {r["feature"]: r["min_increment"] for r in min_increments(df, ["a", "b"]).collect()} == {"a": 0.5, "b": 1.0}

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from specval import config as C
from specval.operators import commonality, redistribute, skyline, solve, validate
from specval.operators.gram import gram
from specval.operators.skyline import efficient_rows, efficiency
from specval.operators.stats import without_outliers
from specval.plans import regression as R


def data(n=400, p=3, seed=0, collinear=False):
    draw = np.random.default_rng(seed)
    x = draw.integers(0, 30, (n, p)).astype(float)
    if collinear:
        x[:, -1] = x[:, 0]
    y = 500 + x @ np.linspace(-20, 60, p) + draw.normal(0, 30, n)
    return x, y


def frame(spark, x, y):
    names = [f"x{i}" for i in range(x.shape[1])]
    rows = [(i, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id bigint, " + ", ".join(f"{c} double" for c in names) + ", y double"), names


def test_gram_matches_numpy(spark):
    x, y = data()
    df, names = frame(spark, x + 1e6, y)
    g = gram(df, names, "y")
    full = np.column_stack([x + 1e6, y])
    centred = (full - full.mean(0)).T @ (full - full.mean(0))
    assert g.n == len(y) and np.allclose(g.mean, full.mean(0)) and np.allclose(g.centred, centred, rtol=1e-9)
    parts = gram(df.withColumn("k", F.col("id") % 3), names, "y", by="k")
    rest = parts.plus(parts.by[0], -1)
    keep = np.arange(len(y)) % 3 != 0
    sub = full[keep]
    assert np.allclose(rest.centred, (sub - sub.mean(0)).T @ (sub - sub.mean(0)), rtol=1e-8)


@pytest.mark.parametrize("intercept", [True, False])
@pytest.mark.parametrize("alpha", [0.0, 1.0, 50.0])
def test_bounded_solution_is_optimal_by_enumeration(spark, intercept, alpha):
    x, y = data(p=4, seed=3)
    df, names = frame(spark, x, y)
    g = gram(df, names, "y")
    bounds = [(0.0, None), (0.1, 15.0), (0.0, 40.0), (None, None)]
    b0, beta = solve.bounded(g, bounds, alpha, intercept)
    low, high = solve.limits(bounds)
    assert np.all(beta >= low) and np.all(beta <= high)
    best = np.inf
    design = np.column_stack([np.ones(len(y)), x]) if intercept else x
    for held in itertools.product((None, 0, 1), repeat=4):
        fixed = {i: (low[i] if h == 0 else high[i]) for i, h in enumerate(held) if h is not None}
        if not all(np.isfinite(v) for v in fixed.values()):
            continue
        free = [i for i in range(4) if i not in fixed]
        shift = int(intercept)
        columns = ([0] if intercept else []) + [i + shift for i in free]
        target = y - sum(x[:, i] * v for i, v in fixed.items())
        a = design[:, columns]
        penalty = np.diag([0.0] * shift + [alpha] * len(free)) if columns else np.zeros((0, 0))
        w = np.linalg.lstsq(a.T @ a + penalty, a.T @ target, rcond=None)[0] if columns else np.zeros(0)
        full = np.zeros(4)
        full[free] = w[shift:]
        for i, v in fixed.items():
            full[i] = v
        if np.all(full >= low - 1e-9) and np.all(full <= high + 1e-9):
            c = w[0] if intercept else 0.0
            best = min(best, float(np.sum((c + x @ full - y) ** 2) + alpha * full @ full))
    assert solve.objective(g, beta, b0, alpha) == pytest.approx(best, rel=1e-9)
    assert solve.kkt_violation(g, beta, bounds, alpha, intercept) < 1e-8


def test_collinear_columns(spark):
    x, y = data(collinear=True)
    df, names = frame(spark, x, y)
    g = gram(df, names, "y")
    b0, beta = solve.bounded(g, [(0.0, None)] * 3, 1.0, True)
    assert beta[0] == pytest.approx(beta[2])
    report = validate.optimiser_consistency(spark, g, [(0.0, None)] * 3).first()
    assert report["is_consistent"] and report["is_optimal"]
    shared, audit = redistribute.average_collinear(names, [3.0, 1.0, 9.0], g.correlation())
    assert list(shared) == [6.0, 1.0, 6.0] and {a["feature"] for a in audit} == {"x0", "x2"}


def test_constant_feature_has_no_correlation(spark):
    x, y = data()
    x[:, 1] = 4.0
    df, names = frame(spark, x, y)
    assert np.isnan(gram(df, names, "y").correlation()[0, 1])


def brute_skyline(rows):
    keep = set()
    for i, (*f, p) in enumerate(rows):
        if not any(all(a >= b for a, b in zip(g, f)) and q <= p and (any(a > b for a, b in zip(g, f)) or q < p) for *g, q in rows):
            keep.add(i)
    return keep


@pytest.mark.parametrize("block", [20_000, 40, 7])
@pytest.mark.parametrize("front", [False, True])
def test_skyline(spark, block, front):
    draw = np.random.default_rng(9)
    feats = draw.integers(0, 12, (500, 3))
    # on a rising price surface nearly everything is efficient, which forces the block comparison
    price = feats.sum(1) * 10 if front else draw.integers(1, 400, 500)
    rows = [(*map(float, f), float(p)) for f, p in zip(feats, price)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id bigint, a double, b double, c double, p double")
    got = {r["id"] for r in efficient_rows(df, ["a", "b", "c"], "p", block).collect()}
    assert got == brute_skyline(rows)


def test_boxes_rule_out_most_pairs(spark):
    """Six features, nearly everything efficient: under half of all pairs of boxes are compared."""
    draw = np.random.default_rng(3)
    feats = draw.random((6000, 6))
    price = feats.sum(1) + draw.normal(0, 1e-3, 6000)
    df = spark.createDataFrame([(*map(float, f), float(p)) for f, p in zip(feats, price)], "a double, b double, c double, d double, e double, f double, p double")
    placed = skyline.boxed(df, list("abcdefp"), 6000, 100)
    n = placed.select("__block").distinct().count()
    assert 50 <= n <= 70 and placed.groupBy("__block").count().agg({"count": "max"}).first()[0] <= 300
    assert skyline.block_pairs(placed, list("abcdefp")).count() < n * n / 2


def test_skyline_small_missing_and_copies(spark):
    few = spark.createDataFrame([(1.0, 5.0), (0.0, 9.0), (None, 1.0)], "a double, p double")
    assert efficient_rows(few, ["a"], "p").count() == 2
    assert efficiency(few, ["a"], "p").first()["efficiency_ratio"] == 1.0
    copies = spark.createDataFrame([(3.0, 5.0)] * 12 + [(1.0, 6.0)], "a double, p double")
    assert efficient_rows(copies, ["a"], "p").count() == 12


def test_fits_and_tables(spark):
    x, y = data(n=200, p=2, seed=5)
    df, names = frame(spark, np.abs(x), np.abs(y))
    df = df.withColumnsRenamed({"x0": "basic_data_clean", "x1": "is_5g", "y": "original_fee"}).withColumn("fee", F.col("original_fee") * 0.9)
    names = ["basic_data_clean", "is_5g"]
    for solver in ("bounded", "projected", "equal"):
        fit = R.fit_efficient(df, names, solver=solver)
        assert fit.table(spark).filter("within_bounds").count() == 2
    assert R.fit_prices(df, names).method == "efficient_bounded"
    whole = R.fit_whole_table(df, names, alpha=1.0)
    assert whole.method == "whole_table_projected" and whole.coefficients["is_5g"] >= 100
    with pytest.raises(R.FitError):
        R.fit_efficient(df, ["nope"])
    with pytest.raises(R.FitError):
        R.fit_frontier_rows(df.limit(1), names)


def test_outliers(spark):
    rows = [(float(v),) for v in [10] * 30 + [1000]] + [(None,)]
    df = spark.createDataFrame(rows, "original_fee double")
    assert without_outliers(df).count() == 30
    flat = spark.createDataFrame([(5.0,)] * 4, "original_fee double")
    assert without_outliers(flat).count() == 4


def test_commonality_against_numpy(spark):
    x, y = data(n=300, p=4, seed=8)
    x[:, 3] = x[:, 0] + np.random.default_rng(1).normal(0, 2, 300)
    df, names = frame(spark, x, y)
    g = gram(df, names, "y")
    fits = commonality.subset_fits(spark, g)
    got = {r["mask"]: r["r2"] for r in fits.collect()}
    assert len(got) == 15

    def r2(cols):
        a = np.column_stack([np.ones(len(y)), x[:, cols]])
        res = y - a @ np.linalg.lstsq(a, y, rcond=None)[0]
        return 1 - res @ res / ((y - y.mean()) @ (y - y.mean()))

    want = {m: r2([i for i in range(4) if m >> i & 1]) for m in range(1, 16)}
    assert all(got[m] == pytest.approx(want[m], abs=1e-9) for m in want)
    rows = commonality.effects(fits, names).collect()
    unique = {r["f1"]: r["value"] for r in rows if r["type"] == "unique"}
    common = {(r["f1"], r["f2"]): r["value"] for r in rows if r["type"] == "common"}
    assert unique["x2"] == pytest.approx(max(0, want[15] - want[11]), abs=1e-9)
    assert common["x1", "x3"] == pytest.approx(want[10] - want[2] - want[8], abs=1e-9) and len(common) == 6
    shares = {r["feature"]: r for r in commonality.variance_decomposition(fits, names).collect()}
    for i, f in enumerate(names):
        expected = sum(max(0, want[m] - sum(want[1 << j] for j in range(4) if m >> j & 1)) / bin(m).count("1") for m in want if m >> i & 1 and bin(m).count("1") > 1)
        assert shares[f]["common_variance"] == pytest.approx(expected, abs=1e-9)
        assert shares[f]["unique_variance"] == pytest.approx(want[1 << i], abs=1e-9)
    beta = [10.0, 5.0, 3.0, 8.0]
    first = {r["feature"]: r for r in commonality.redistribute(fits, names, beta, g.correlation(), partner="first").collect()}
    row = first["x2"]
    assert row["paired_with"] == "x0"
    share = row["unique_effect"] / (row["unique_effect"] + row["common_effect"])
    assert row["redistributed_value"] == pytest.approx(max(0.1, 13.0 * share))
    near = {r["feature"]: r for r in commonality.redistribute(fits, names, beta, g.correlation()).collect()}
    assert near["x0"]["paired_with"] == "x3" and near["x1"]["paired_with"] is None and near["x1"]["redistributed_value"] == 5.0
    assert commonality.economic_clip("voice_unlimited", 5.0) == 100.0 and commonality.economic_clip("is_5g", 1e9) == 10000.0


def test_cross_validation_against_numpy(spark):
    x, y = data(n=250, p=2, seed=6)
    df, names = frame(spark, x, y)
    folds = validate.cross_validation(df, names, "y").collect()
    assigned = {r["id"]: r["f"] for r in df.select("id", F.pmod(F.xxhash64("id"), F.lit(5)).alias("f")).collect()}
    fold = np.array([assigned[i] for i in range(250)])
    for r in folds:
        test = fold == r["fold"] - 1
        g = gram(df.filter(F.pmod(F.xxhash64("id"), F.lit(5)) != r["fold"] - 1), names, "y")
        _, beta = validate.whole_table_solver(g)
        miss = y[test] - x[test] @ beta
        assert r["mae"] == pytest.approx(np.abs(miss).mean())
        assert r["r2_score"] == pytest.approx(1 - miss @ miss / ((y[test] - y[test].mean()) ** 2).sum())
        assert r["test_size"] == test.sum() and r["train_size"] == (~test).sum()
    assert validate.cross_validation_summary(validate.cross_validation(df, names, "y")).count() == 1


def test_full_report_and_grades(spark):
    x, y = data(n=200, p=2, seed=7)
    df, names = frame(spark, x, np.abs(y) + 1)
    df = df.withColumnsRenamed({"x0": "voice_clean", "x1": "tethering_gb", "y": "fee"}).withColumn("original_fee", F.col("fee"))
    fit = R.fit_whole_table(df, ["voice_clean", "tethering_gb"])
    report = validate.full_report(df, fit).collect()
    assert len(report) == 1 and 0 <= report[0]["total_score"] <= 100 and report[0]["grade"] in "ABCDF"
    assert C.whole_table_bounds("has_unlimited_speed") == (100.0, 20000.0)

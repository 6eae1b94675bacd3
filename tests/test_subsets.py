"""Subset fits by sweeping, and their shares summed inside tasks."""

import time

import numpy as np
import pytest

from specval.operators import commonality, solve
from specval.operators.gram import Gram
from specval.operators.stats import column_profile


def sums(p, n=500, seed=3, twins=()):
    draw = np.random.default_rng(seed)
    x = draw.normal(0, 1, (n, p)) + draw.normal(0, 1, (n, 1))
    for a, b in twins:
        x[:, a] = 7 * x[:, b]
    data = np.column_stack([x, x @ draw.normal(0, 1, p) + draw.normal(0, 2, n)])
    mean = data.mean(0)
    return Gram([f"x{i}" for i in range(p)], n, mean, (data - mean).T @ (data - mean))


@pytest.mark.parametrize("twins", [(), ((4, 1), (5, 1))])
def test_sweep_equals_single_fits(twins):
    g = sums(7, twins=twins)
    for taken in ([], [6], [5, 6]):
        left = commonality.subset_residuals(g.centred, taken, [0, 1, 2, 3, 4])
        for place, rss in enumerate(left.tolist()):
            keep = [i for i in range(5) if place >> i & 1] + taken
            want = solve.subset_r2(g, keep) if keep else 0.0
            assert 1 - rss / g.total_ss() == pytest.approx(want, abs=1e-8)


def test_constant_column_adds_nothing():
    g = sums(3)
    g.centred[1, :] = g.centred[:, 1] = 0.0
    left = commonality.subset_residuals(g.centred, [], [0, 1, 2])
    assert left[0b101] == pytest.approx(left[0b111]) and left[0b010] == pytest.approx(g.total_ss())


def test_many_features(spark):
    g = sums(18, twins=((9, 2),))
    begin = time.time()
    fits = commonality.subset_fits(spark, g)
    shares = {r["feature"]: r for r in commonality.variance_decomposition(fits, g.features).collect()}
    assert fits.count() == 2**18 - 1 and time.time() - begin < 60
    # the equal shares of all subsets, in numpy
    left = commonality.subset_residuals(g.centred, [], list(range(18)))
    r2 = np.maximum(0, 1 - left / g.total_ss())
    masks = np.arange(1 << 18)
    bits = (masks[:, None] >> np.arange(18)) & 1
    own = r2[1 << np.arange(18)]
    size = bits.sum(1)
    share = np.where(size > 1, np.maximum(0, r2 - bits @ own) / np.maximum(size, 1), 0)
    for i, f in enumerate(g.features):
        assert shares[f]["unique_variance"] == pytest.approx(own[i]) and shares[f]["common_variance"] == pytest.approx(share @ bits[:, i])


def test_shares_need_no_shuffle_of_subsets(spark):
    g = sums(4)
    plan = commonality.variance_decomposition(commonality.subset_fits(spark, g), g.features)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(array(1" not in plan and "Aggregate [mask" not in plan


def test_profile_moves_hashes_only(spark):
    rows = [(i, "long " * 5000 + str(i % 7) if i % 5 else None, float(i % 3)) for i in range(200)]
    out = column_profile(spark.createDataFrame(rows, "id long, t string, v double").repartition(4))
    found = {r["column_name"]: (r["null_count"], r["unique_count"]) for r in out.collect()}
    assert found == {"id": (0, 200), "t": (40, 7), "v": (0, 3)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    exchange = plan.index("Exchange hashpartitioning(column_name")
    assert "md5" not in plan[:exchange] and plan.index("unhex(md5") > exchange

"""Exact quantiles through merged sketches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from specval.operators import quantiles


@pytest.fixture
def levels(monkeypatch):
    """Rows of every table of sketches that is written."""
    seen, written = [], quantiles.materialize

    def counted(df, label):
        made = written(df, label)
        seen.append(made.count())
        return made

    monkeypatch.setattr(quantiles, "materialize", counted)
    return seen


def test_sketches_are_merged_as_a_tree(spark, levels):
    df = spark.range(20_000).repartition(50, "id").select((F.col("id") * 7919 % 20_000).cast("double").alias("v"))
    row = quantiles.sketches(df, {"v": F.col("v")}, fan=4).select(F.kll_sketch_get_n_double("v")).first()
    assert row[0] == 20_000 and levels == [13, 4]  # 50 tasks, four at most into one each time, the last four into the result
    got = quantiles.sketched_quantiles(df, {"v": (F.col("v"), [0.1, 0.5, 0.9])}, fan=4)["v"]
    assert np.allclose(got, [2000, 10_000, 18_000], atol=100)


def test_a_group_of_tasks_merges_a_fixed_number(spark):
    df = spark.range(5000).repartition(23).select(F.col("id").cast("double").alias("v"))
    groups = df.groupBy(F.floor(F.spark_partition_id() / 4).alias("g")).agg(F.count_distinct(F.spark_partition_id()).alias("n")).collect()
    assert len(groups) == 6 and max(r["n"] for r in groups) == 4
    plan = quantiles.sketches(df, {"v": F.col("v")}, fan=4)._jdf.queryExecution().executedPlan().toString()
    assert "kll_merge_agg_double" in plan and "percentile" not in plan


@pytest.mark.parametrize("size", [8, 64, 4096])
def test_poor_sketches_only_cost_rounds(spark, monkeypatch, size):
    original = quantiles.sketched_quantiles
    monkeypatch.setattr(quantiles, "sketched_quantiles", lambda df, wanted: original(df, wanted, size, 3))
    rng = np.random.default_rng(5)
    values = np.concatenate((rng.normal(size=3000), np.full(1500, 0.25), [np.inf, -np.inf] * 20))
    df = spark.createDataFrame([(float(v), None, float(i % 7)) for i, v in enumerate(values)], "v double, gone double, few double").repartition(11)
    probs = [0.0, 0.01, 0.3, 0.5, 0.77, 1.0]
    got = quantiles.exact_quantiles(df, {"v": probs, "gone": [0.5], "few": probs}, 50)
    assert got["gone"] == [None]
    ordered, places = np.sort(values), [(len(values) - 1) * p for p in probs]
    want = [ordered[int(p)] if p == int(p) else ordered[int(p)] * (1 - p % 1) + ordered[int(p) + 1] * (p % 1) for p in places]
    assert got["v"] == pytest.approx(want, abs=1e-12)
    assert got["few"] == pytest.approx(list(np.quantile(np.arange(len(values)) % 7, probs)))

"""Sums of products of many columns: numpy inside tasks, the same numbers as the generated aggregate."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from specval.operators import gram as G


@pytest.fixture(scope="module")
def table(spark):
    draw = np.random.default_rng(4)
    x = draw.integers(0, 50, (600, 100)).astype(float)
    x[:, 7] = 3.0
    x[::9, 5] = np.nan
    y = x[:, 3] * 20 + draw.normal(0, 5, 600) + 1e6
    y[::50] = np.nan
    names = [f"f{i}" for i in range(100)]
    rows = [(*map(float, a), float(b), i % 3 if i % 11 else None) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names) + ", y double, part int").repartition(6)
    return df, names, np.nan_to_num(x)[~np.isnan(y)], y[~np.isnan(y)]


def test_hundred_features(table):
    df, names, x, y = table
    g = G.gram(df, names, "y")
    data = np.column_stack([x, y])
    away = data - data.mean(0)
    assert g.n == len(y) and np.allclose(g.mean, data.mean(0)) and np.allclose(g.centred, away.T @ away, rtol=1e-9, atol=1e-6)


def test_groups_and_both_forms(table, monkeypatch):
    df, names, _, _ = table
    few = names[:10]
    want = G.gram(df, few, "y", by="part")
    monkeypatch.setattr(G, "GENERATED", 2)
    got = G.gram(df, few, "y", by="part")
    assert set(got.by) == set(want.by) == {0, 1, 2, None}
    for key, part in want.by.items():
        assert got.by[key].n == part.n and np.allclose(got.by[key].centred, part.centred, rtol=1e-9, atol=1e-6)
    empty = G.gram(df.filter(F.lit(False)), few, "y")
    assert empty.n == 0 and G.gram(df.filter(F.lit(False)), few, "y", by="part").n == 0


def test_tables_of_products_and_correlations(table, monkeypatch):
    df, names, x, _ = table
    few = names[:9]
    calls = {f.__name__: {(r["f1"], r["f2"]): r[2] for r in f(*a).collect()} for f, a in (
        (G.sufficient_statistics, (df, few, "y")), (G.correlations, (df, few)))}
    monkeypatch.setattr(G, "GENERATED", 2)
    for f, a in ((G.sufficient_statistics, (df, few, "y")), (G.correlations, (df, few))):
        got = {(r["f1"], r["f2"]): r[2] for r in f(*a).collect()}
        assert got.keys() == calls[f.__name__].keys()
        assert all(got[k] == (pytest.approx(v, rel=1e-9, abs=1e-9) if v is not None else None) for k, v in calls[f.__name__].items())
    assert len(G.high_correlations(df.withColumn("twin", F.col("f3") * 2), ["f3", "twin", "f9"]).collect()) == 1


def test_correlations_of_few_features_are_sums_of_products(spark, monkeypatch):
    draw = np.random.default_rng(8)
    x = draw.normal(0, 1, (4000, 15)) + 1e7
    x[:, 4] = x[:, 3] * -2 + 5
    x[:, 6] = 0.1
    rows = [tuple(map(float, r)) for r in x]
    names = [f"f{i}" for i in range(15)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(5)
    passes = []
    monkeypatch.setattr(G, "cell_sums", lambda *a, real=G.cell_sums: passes.append(a) or real(*a))
    got = {(r["f1"], r["f2"]): r["corr"] for r in G.correlations(df, names).collect()}
    with np.errstate(all="ignore"):
        want = np.corrcoef(x.T)
    assert len(passes) == 1 and len(got) == 105
    for i in range(15):
        for j in range(i + 1, 15):
            assert got[f"f{i}", f"f{j}"] == (None if 6 in (i, j) else pytest.approx(want[i, j], abs=1e-9))


def test_correlations_of_awkward_columns(spark):
    df = spark.createDataFrame([(1.0, None, float("inf"), 4), (2.0, 3.0, 1.0, 8), (4.0, float("nan"), 2.0, 16)], "a double, b double, c double, d int")
    got = {(r["f1"], r["f2"]): r["corr"] for r in G.correlations(df, ["a", "b", "c", "d"]).collect()}
    assert got["a", "d"] == pytest.approx(1.0) and got["a", "b"] == pytest.approx(np.corrcoef([1, 2, 4], [0, 3, 0])[0, 1])
    assert [k for k, v in got.items() if v is None] == [("a", "c"), ("b", "c"), ("c", "d")]
    assert [r["corr"] for r in G.correlations(df.filter("a > 9"), ["a", "d"]).collect()] == [None]
    assert G.correlations(df, ["a"]).collect() == []

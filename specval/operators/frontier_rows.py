"""Rows that lie on a frontier."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specval.config import UNLIMITED_FLAGS, continuous
from specval.functions.numeric import known, unpivot
from specval.operators.curves import CURVE_POINTS, curve_table, is_point, locate
from specval.operators.frontier import LIMITED, feature_frontiers, limited_value
from specval.operators.joins import join_measured
from specval.session import materialize


def on_frontier(df: DataFrame, points: DataFrame, features, flags, cost: str = "original_fee", limit: int = CURVE_POINTS) -> DataFrame:
    """C4: adds ``on_<feature>``, true where (value, cost) is a point of that feature's frontier."""
    names = [f for f in continuous(features, flags) if f in df.columns]
    columns = {f: limited_value(df, f, flags) for f in names}
    price = known(df, cost)
    curves = curve_table(points, limit)
    if curves is None:
        rows = materialize(df.withColumn("__rid", F.monotonically_increasing_id()), "frontier-rows")
        values = {f: limited_value(rows, f, flags).alias(f) for f in names}
        long = unpivot(rows.select("__rid", known(rows, cost).alias("__y"), *values.values()), ["__rid", "__y"], names).filter("value IS NOT NULL")
        marks = points.filter(F.col("feature").isin(names)).select("feature", "value", F.col("cost").alias("__y")).distinct()
        hits = join_measured(long, marks, ["feature", "value", "__y"], "left_semi")
        back = hits.groupBy("__rid").agg(*[F.max(F.col("feature") == f).alias(f"on_{f}") for f in names])
        return rows.join(back, "__rid", "left").drop("__rid").withColumns({f"on_{f}": F.coalesce(f"on_{f}", F.lit(False)) for f in names})
    located = locate(df, curves, columns)
    marks = {f"on_{f}": is_point(curves[f], f, price) if f in curves else F.lit(False) for f in names}
    return located.withColumns(marks).drop(*[f"__x_{f}" for f in names], *[f"__i_{f}" for f in names])


def cheapest_unlimited(df: DataFrame, features, flags=None, cost: str = "original_fee", name: str = "plan_name", key: str = "id") -> DataFrame:
    """D3: per flag the cheapest unlimited row's cost, key and name, and how many unlimited rows there are."""
    flags = UNLIMITED_FLAGS if flags is None else flags
    pairs = [(f, flags[f]) for f in continuous(features, flags) if f in df.columns and flags.get(f) in df.columns]
    if not pairs:
        return df.sparkSession.createDataFrame([], "feature string, flag string, min_cost double, id bigint, plan_name string, plan_count bigint")
    label = F.col(name) if name in df.columns else F.lit("Unknown")
    price = known(df, cost)
    aggregates = []
    for f, m in pairs:
        mine = (F.col(m) == 1) & price.isNotNull()
        order = F.when(mine, F.struct(price.alias("c"), F.col(key).alias("k")))
        aggregates += [
            F.min(order).alias(f"{f}|first"), F.min_by(label, order).alias(f"{f}|name"), F.count_if(mine).alias(f"{f}|n")]
    row = df.agg(*aggregates)
    cells = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.lit(m).alias("flag"), F.col(f"`{f}|first`.c").alias("min_cost"),
                 F.col(f"`{f}|first`.k").alias(key), F.col(f"`{f}|name`").alias("plan_name"), F.col(f"`{f}|n`").alias("plan_count"))
        for f, m in pairs
    ])
    return row.select(F.explode(cells).alias("s")).select("s.*").filter("plan_count > 0")


def frontier_rows(df: DataFrame, features, flags=None, cost: str = "original_fee", key: str = "id",
                  frontier: DataFrame | None = None, limit: int = CURVE_POINTS) -> DataFrame:
    """rows on any feature's frontier and the cheapest unlimited row per flag; each row once, no shuffle."""
    flags = UNLIMITED_FLAGS if flags is None else flags
    names = [f for f in continuous(features, flags) if f in df.columns]
    if frontier is None:
        frontier = feature_frontiers(df, names, flags, cost)
    marked = on_frontier(df, frontier.filter(F.col("kind") == LIMITED), names, flags, cost, limit)
    picked = [r[key] for r in cheapest_unlimited(df, names, flags, cost, key=key).collect()]  # one row per flag
    tests = [F.col(f"on_{f}") for f in names] + ([F.col(key).isin(picked)] if picked else [])
    return marked.filter(reduce(lambda a, b: a | b, tests)).drop(*[f"on_{f}" for f in names])


def frontier_summary(df: DataFrame, features, flags=None, cost: str = "original_fee", key: str = "id") -> DataFrame:
    """Points per feature frontier, and the number of distinct frontier rows."""
    flags = UNLIMITED_FLAGS if flags is None else flags
    frontier = feature_frontiers(df, features, flags, cost)
    rows = frontier_rows(df, features, flags, cost, key, frontier).agg(F.count(F.lit(1)).alias("n"))
    return (
        frontier.filter(F.col("kind") == LIMITED).groupBy("feature").agg(F.count(F.lit(1)).alias("frontier_points"))
        .withColumn("total_frontier_rows", rows.scalar())
    )

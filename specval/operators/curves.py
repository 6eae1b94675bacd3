"""Reading costs off frontier curves.

Up to ``CURVE_POINTS`` points the curves are literals and each row finds its segment by binary search, so no row is
moved and no join is planned. Longer curves are joined: the distinct feature values and the curve points go through
one ordered scan, and the priced values are joined back to the rows.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specval.functions.numeric import numbers, unpivot
from specval.operators.joins import join_measured
from specval.operators.ordered import ROWS_PER_BUCKET, running
from specval.session import materialize

CURVE_POINTS = 20_000
CLAMP, EXTEND = "clamp", "extend"


def curve_table(points: DataFrame, limit: int = CURVE_POINTS) -> dict[str, tuple[list[float], list[float]]] | None:
    """Curves as sorted lists per feature, or ``None`` when there are more points than ``limit``."""
    rows = points.select("feature", "value", "cost").limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    curves: dict[str, tuple[list, list]] = {}
    for r in sorted(rows, key=lambda r: (r["feature"], r["value"])):
        xs, ys = curves.setdefault(r["feature"], ([], []))
        xs.append(r["value"])
        ys.append(r["cost"])
    return curves


def locate(df: DataFrame, curves: dict, columns: dict[str, Column]) -> DataFrame:
    """Adds ``__i_<feature>``: how many curve points are at or below the value (missing value -> missing)."""
    names = [f for f in columns if f in curves]
    if not names:
        return df
    df = df.withColumns({f"__x_{f}": columns[f] for f in names})
    cut = Bucketizer(
        splitsArray=[[-math.inf, *curves[f][0], math.inf] for f in names],
        inputCols=[f"__x_{f}" for f in names], outputCols=[f"__i_{f}" for f in names], handleInvalid="keep")
    return cut.transform(df)


def read_cost(curve, feature: str, mode: str) -> Column:
    xs, ys = curve
    x, i, k = F.col(f"__x_{feature}"), F.col(f"__i_{feature}").cast("int"), len(xs)
    if k == 1:
        return F.when(x.isNotNull(), ys[0])
    def line(j: Column) -> Column:
        x1, y1 = F.element_at(numbers(xs), j), F.element_at(numbers(ys), j)
        x2, y2 = F.element_at(numbers(xs), j + 1), F.element_at(numbers(ys), j + 1)
        return F.when(x == x1, y1).otherwise(y1 + (x - x1) * (y2 - y1) / (x2 - x1))

    if mode == CLAMP:
        return F.when(i <= 0, ys[0]).when(i >= k, ys[-1]).otherwise(line(i))
    # multiplied before divided, as in the joined form, so that both give the same doubles
    first = ys[0] + (x - xs[0]) * (ys[1] - ys[0]) / (xs[1] - xs[0])
    last = F.when(x == xs[-1], ys[-1]).otherwise(ys[-2] + (x - xs[-2]) * (ys[-1] - ys[-2]) / (xs[-1] - xs[-2]))
    return F.when(i <= 0, first).when(i >= k, last).otherwise(line(i))


def is_point(curve, feature: str, cost: Column) -> Column:
    """C4: the row's (value, cost) is one of the curve points."""
    i = F.col(f"__i_{feature}").cast("int")
    hit = (F.element_at(numbers(curve[0]), i) == F.col(f"__x_{feature}")) & (F.element_at(numbers(curve[1]), i) == cost)
    return F.coalesce(F.when((i >= 1) & (i <= len(curve[0])), hit), F.lit(False))


def price_values(df: DataFrame, points: DataFrame, columns: dict[str, Column], mode: str = CLAMP, prefix: str = "cost_",
                 limit: int = CURVE_POINTS, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """C2 (``clamp``) and C3 (``extend``): adds ``<prefix><feature>``, the curve's cost at ``columns[feature]``.

    A feature without a curve, and a missing value, give a missing cost.
    """
    curves = curve_table(points, limit)
    if curves is None:
        return _price_by_join(df, points, columns, mode, prefix, rows_per_bucket)
    located = locate(df, curves, columns)
    out = located.withColumns({
        f"{prefix}{f}": read_cost(curves[f], f, mode).cast("double") if f in curves else F.lit(None).cast("double") for f in columns
    })
    return out.drop(*[f"__x_{f}" for f in columns], *[f"__i_{f}" for f in columns])


def _price_by_join(df, points, columns, mode, prefix, rows_per_bucket) -> DataFrame:
    names = list(columns)
    df = df.withColumns({f"__x_{f}": columns[f] for f in names})
    wide = df.select(*[F.col(f"__x_{f}").cast("double").alias(f) for f in names])
    levels = unpivot(wide, [], names).filter("value IS NOT NULL").distinct().withColumn("cost", F.lit(None).cast("double"))
    marks = points.select("feature", "value", "cost").filter(F.col("feature").isin(names))
    merged = materialize(levels.unionByName(marks).groupBy("feature", "value").agg(F.max("cost").alias("cost")), "curve-levels")
    point = F.when(F.col("cost").isNotNull(), F.struct("value", "cost"))
    scan = running(merged, ["feature"], ["value"], {"lower": ("max", point)}, "before", rows_per_bucket)
    scan = running(scan, ["feature"], ["value"], {"upper": ("min", point)}, "after", rows_per_bucket)
    if mode == EXTEND:
        # the second point from either end continues the first and last segment
        ends = marks.groupBy("feature").agg(F.min(F.struct("value", "cost")).alias("p1"), F.max(F.struct("value", "cost")).alias("pk"))
        inner = marks.join(F.broadcast(ends), "feature")
        p2 = inner.filter(F.col("value") > F.col("p1.value")).groupBy("feature").agg(F.min(F.struct("value", "cost")).alias("p2"))
        pj = inner.filter(F.col("value") < F.col("pk.value")).groupBy("feature").agg(F.max(F.struct("value", "cost")).alias("pj"))
        ends = ends.join(p2, "feature", "left").join(pj, "feature", "left")
        scan = scan.join(F.broadcast(ends), "feature")
    x = F.col("value")

    def line(a: str, b: str) -> Column:
        return F.col(f"{a}.cost") + (x - F.col(f"{a}.value")) * (F.col(f"{b}.cost") - F.col(f"{a}.cost")) / (
            F.col(f"{b}.value") - F.col(f"{a}.value"))

    below = F.col("upper.cost") if mode == CLAMP else F.coalesce(F.when(F.col("p2").isNotNull(), line("p1", "p2")), F.col("upper.cost"))
    above = F.col("lower.cost") if mode == CLAMP else F.coalesce(F.when(F.col("pj").isNotNull(), line("pj", "pk")), F.col("lower.cost"))
    priced = scan.select("feature", "value", F.when(F.col("cost").isNotNull(), F.col("cost"))
                         .when(F.col("lower").isNull(), below).when(F.col("upper").isNull(), above)
                         .otherwise(line("lower", "upper")).alias("cost"))
    priced = materialize(priced, "curve-prices")
    # one long join for all features, then one row per row again: the wide rows are shuffled once, not once per feature
    df = materialize(df.withColumn("__rid", F.monotonically_increasing_id()), "curve-rows")
    long = unpivot(df.select("__rid", *[F.col(f"__x_{f}").cast("double").alias(f) for f in names]), ["__rid"], names).filter("value IS NOT NULL")
    costs = join_measured(long, priced, ["feature", "value"], "inner")
    back = costs.groupBy("__rid").agg(*[F.max(F.when(F.col("feature") == f, F.col("cost"))).alias(f"{prefix}{f}") for f in names])
    return df.join(back, "__rid", "left").drop("__rid", *[f"__x_{f}" for f in names])

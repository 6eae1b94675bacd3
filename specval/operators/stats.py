"""One-pass summaries and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specval.functions.numeric import known, unpivot


def without_outliers(df: DataFrame, column: str = "original_fee", threshold: float = 3.0) -> DataFrame:
    """Rows within ``threshold`` sample standard deviations of the mean; all rows if there is no spread."""
    value = known(df, column)
    moments = df.agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    spread = moments.select("s").scalar()
    distance = F.abs(F.try_divide(value - moments.select("m").scalar(), spread))
    return df.filter(F.when(spread > 0, distance <= threshold).otherwise(True))


def outlier_counts(df: DataFrame, column: str = "original_fee", threshold: float = 3.0) -> DataFrame:
    kept = without_outliers(df, column, threshold).agg(F.count(F.lit(1)).alias("kept_rows"))
    total = df.agg(F.count(F.lit(1)).alias("n"))
    out = kept.withColumn("total_rows", total.scalar())
    return out.select("total_rows", "kept_rows", (F.col("total_rows") - F.col("kept_rows")).alias("outliers_removed"))


def ranking_statistics(df: DataFrame, value: str = "CS", name: str = "plan_name", tie: str = "id") -> DataFrame:
    """Counts around 1, mean, and the first and last row of the ranking (missing ratios last); zeros for an empty table."""
    v = F.col(value)
    order = F.struct(v.isNull(), -v, F.col(tie))
    return df.agg(
        F.count(F.lit(1)).alias("total_plans"),
        F.coalesce(F.avg(v), F.lit(0.0)).alias("avg_ratio"),
        F.count_if(v >= 1).alias("good_value_count"),
        F.count_if(v < 1).alias("poor_value_count"),
        F.min_by(name, order).alias("best_value_plan"),
        F.max_by(name, order).alias("worst_value_plan"),
    )


def ratio_summary(df: DataFrame, value: str = "CS") -> DataFrame:
    """Counts and shares of rows at or above, and below, a ratio of 1."""
    v = F.col(value)
    out = df.agg(
        F.count(F.lit(1)).alias("total_plans"), F.coalesce(F.avg(v), F.lit(0.0)).alias("avg_cs"),
        F.count_if(v >= 1).alias("high_cs_count"), F.count_if(v < 1).alias("low_cs_count"))
    share = {s: F.coalesce(F.try_divide(F.col(f"{s}_cs_count"), F.col("total_plans")), F.lit(0.0)) for s in ("high", "low")}
    return out.withColumns({"high_cs_pct": share["high"], "low_cs_pct": share["low"]})


def feature_profile(df: DataFrame, features) -> DataFrame:
    """Non-missing count, distinct count, min, max, mean per feature."""
    long = unpivot(df, [], [f for f in features if f in df.columns]).filter("value IS NOT NULL AND NOT isnan(value)")
    # two map-side combined steps instead of a set of distinct values per feature in one task
    levels = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    return levels.groupBy("feature").agg(
        F.sum("n").alias("total_plans"), F.count(F.lit(1)).alias("unique_values"),
        F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("avg_value"))


def diagonal_range(df: DataFrame, baseline: str = "B", fee: str = "fee") -> DataFrame:
    """Smallest and largest number over both columns, missing counted as 0."""
    b, f = F.coalesce(F.col(baseline), F.lit(0.0)), F.coalesce(F.col(fee), F.lit(0.0))
    return df.agg(F.least(F.min(b), F.min(f)).alias("min_value"), F.greatest(F.max(b), F.max(f)).alias("max_value"))


def column_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Type, missing values and distinct values of every column.

    Exact distinct counts go through (column, value) groups, so no task holds all values of a column. A value travels as the
    128 bits of its MD5, never as text, and only once for each task that has it. ``approximate`` uses sketches: one scan, no such shuffle.
    """
    kinds = df.sparkSession.createDataFrame([(c, t) for c, t in df.dtypes], "column_name string, data_type string")
    if approximate:
        row = df.agg(*[
            F.struct(F.lit(c).alias("column_name"), F.count_if(F.col(c).isNull()).alias("null_count"), F.approx_count_distinct(c).alias("unique_count")).alias(f"c{i}")
            for i, c in enumerate(df.columns)])
        cells = row.select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(df.columns))])).alias("s")).select("s.*")
        return kinds.join(cells, "column_name")
    texts = df.select(*[F.unhex(F.md5(F.encode(F.col(c).cast("string"), "utf-8"))).alias(c) for c in df.columns])
    levels = texts.unpivot([], df.columns, "column_name", "value").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    counts = levels.groupBy("column_name").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.count("value").alias("unique_count"))
    return kinds.join(counts, "column_name", "left").select(
        "column_name", "data_type", F.coalesce("null_count", F.lit(0)).alias("null_count"), F.coalesce("unique_count", F.lit(0)).alias("unique_count"))

"""Level tables: one row per distinct value of a feature."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specval.config import UNLIMITED_FLAGS, continuous
from specval.functions.numeric import known, unpivot
from specval.operators.frontier import limited_value


def level_table(df: DataFrame, features, flags=None, cost: str = "original_fee", limited: bool = True) -> DataFrame:
    """Least and mean cost and row count per (feature, value); ``limited`` leaves out unlimited rows.

    All features share one scan and one map-side combined shuffle. Costs are not collected into lists.
    """
    flags = UNLIMITED_FLAGS if flags is None else flags
    names = [f for f in continuous(features, flags) if f in df.columns]
    values = [(limited_value(df, f, flags) if limited else known(df, f)).alias(f) for f in names]
    wide = df.select(known(df, cost).alias("__cost"), *values).filter("__cost IS NOT NULL")
    long = unpivot(wide, ["__cost"], names).filter("value IS NOT NULL")
    return long.groupBy("feature", "value").agg(
        F.min("__cost").alias("min_cost"), F.avg("__cost").alias("avg_cost"), F.count(F.lit(1)).alias("plan_count"))

"""Input tables of the registered queries, all derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specval import fixtures
from specval.operators.features import prepare_features
from specval.plans.cost_spec import frontier_scores
from specval.session import materialize, scratch_dir

_shared: dict[tuple, DataFrame] = {}

# fixed rates for queries that score with given coefficients
GIVEN_INTERCEPT = 1500.0
GIVEN_RATES = {
    "basic_data_clean": 120.0, "basic_data_unlimited": 9000.0, "daily_data_clean": 300.0, "daily_data_unlimited": 4000.0,
    "voice_clean": 8.0, "voice_unlimited": 2500.0, "message_clean": 3.0, "message_unlimited": 700.0, "additional_call": 5.0,
    "is_5g": 800.0, "tethering_gb": 20.0, "speed_when_exhausted": 50.0, "data_throttled_after_quota": 400.0,
    "data_unlimited_speed": 600.0, "has_unlimited_speed": 600.0,
}


class GivenFit:
    """Coefficients that were not fitted here."""

    def __init__(self, intercept: float, coefficients: dict[str, float]):
        self.intercept, self.coefficients = intercept, dict(coefficients)


def once(spark: SparkSession, name: str, folder: str, build) -> DataFrame:
    """A table several queries read; built once per application and input folder."""
    key = (spark.sparkContext.applicationId, name, folder)
    if key not in _shared:
        _shared[key] = build()
    return _shared[key]


def forget() -> None:
    _shared.clear()


def plans(spark, folder):
    return fixtures.plans(spark, folder)


def items(spark, folder):
    return fixtures.priced_items(spark, folder)


def features(spark, folder):
    return once(spark, "features", folder, lambda: prepare_features(plans(spark, folder), exclude=["id"]))


def scored(spark, folder):
    """Plans scored by the frontier method."""
    return once(spark, "scored", folder, lambda: materialize(frontier_scores(features(spark, folder)).rows, "scored"))


def folder_for(spark, label: str) -> str:
    import uuid

    return f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded (and -0.0 as 0.0), so that sums in another order compare equal."""
    return df.select(*[
        (F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes
    ])

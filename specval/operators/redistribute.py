"""Sharing coefficients between correlated features: steps on p numbers after the distributed pass."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specval.operators.gram import high_correlations

AUDIT = (
    "feature string, paired_with string, correlation double, original_value double, partner_original_value double, "
    "total_value double, redistributed_value double, method string"
)


def average_collinear(features: list[str], beta, correlation: np.ndarray, threshold: float = 0.8) -> tuple[np.ndarray, list[dict]]:
    """Both coefficients of each highly correlated pair become their mean, pair after pair."""
    shared = np.array(beta, dtype=float)
    audit: dict[str, dict] = {}
    strength = np.abs(np.nan_to_num(correlation, nan=0.0))
    for i, j in zip(*np.triu_indices(len(features), 1)):
        if strength[i, j] <= threshold:
            continue
        before = {i: shared[i], j: shared[j]}
        mean = (shared[i] + shared[j]) / 2
        for a, b in ((i, j), (j, i)):
            audit[features[a]] = {
                "feature": features[a], "paired_with": features[b], "correlation": float(strength[i, j]),
                "original_value": float(before[a]), "partner_original_value": float(before[b]),
                "total_value": float(before[a] + before[b]), "redistributed_value": float(mean), "method": "simple_averaging",
            }
        shared[i] = shared[j] = mean
    return shared, list(audit.values())


def collinearity_report(df: DataFrame, features: list[str], coefficients: dict[str, float], threshold: float = 0.8) -> DataFrame:
    """Highly correlated pairs of features with both coefficients and their mean."""
    pairs = high_correlations(df, features, threshold)
    known_rates = [(f, float(coefficients[f])) for f in features]
    first = df.sparkSession.createDataFrame(known_rates, "f1 string, coefficient1 double")
    second = df.sparkSession.createDataFrame(known_rates, "f2 string, coefficient2 double")
    return pairs.join(F.broadcast(first), "f1").join(F.broadcast(second), "f2").select(
        "f1", "f2", "corr", "coefficient1", "coefficient2", ((F.col("coefficient1") + F.col("coefficient2")) / 2).alias("shared"))


def audit_table(spark: SparkSession, audit: list[dict]) -> DataFrame:
    fields = [part.split()[0] for part in AUDIT.split(", ")]
    return spark.createDataFrame([tuple(a.get(f) for f in fields) for a in audit], AUDIT)

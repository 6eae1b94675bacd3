"""Variance decomposition over all subsets of the features.

The rows are read once (sums of products). The 2^p - 1 subset fits are a Spark job of their own on the p x p sums: each
task sweeps all subsets of the first features together, for its choices of the other ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specval.config import economic_bounds, redistribution_bounds
from specval.operators.gram import Gram

MAX_FEATURES = 62  # bits of the mask
TAIL = 12  # features whose subsets are swept together; 2^12 small matrices are a few MB


def sweep(system: np.ndarray, scale: np.ndarray, at: int = 0) -> np.ndarray:
    """What is left of symmetric matrices (... x m x m) after the column ``at`` is taken out of the others.

    A column that the ones taken before explain (up to rounding) adds nothing.
    """
    pivot = system[..., at, at]
    usable = pivot > 1e-11 * scale
    row = system[..., at, :]
    factor = np.where(usable, 1.0 / np.where(usable, pivot, 1.0), 0.0)
    return system - factor[..., None, None] * row[..., :, None] * row[..., None, :]


def subset_residuals(centred: np.ndarray, taken: list[int], rest: list[int]) -> np.ndarray:
    """Residual sums of squares of the fits on ``taken`` and each subset of ``rest``; bit i of the place stands for ``rest[i]``.

    Each step doubles the matrices (with and without the next feature) and leaves out its column, so a subset costs a few
    numbers instead of a fit of its own.
    """
    order = [*taken, *rest, len(centred) - 1]
    spread = np.diag(centred)[order]
    states = centred[np.ix_(order, order)][None]
    for i in range(len(taken)):
        states = sweep(states, spread[i])[:, 1:, 1:]
    for i in range(len(taken), len(order) - 1):
        states = np.concatenate([states[:, 1:, 1:], sweep(states, spread[i])[:, 1:, 1:]])
    return states[:, 0, 0]


def subset_fits(spark: SparkSession, g: Gram) -> DataFrame:
    """(mask, size, r2) for every non-empty subset; bit i of the mask stands for feature i.

    A task row stands for a choice of the features beyond the first ``TAIL``; the subsets of those are swept together.
    """
    if g.p > MAX_FEATURES:
        raise ValueError(f"{g.p} features have 2^{g.p} subsets; a mask has {MAX_FEATURES} bits")
    centred, total = g.centred, g.total_ss()
    tail = min(g.p, TAIL)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for head in pdf["id"].tolist():
                taken = [i for i in range(tail, len(centred) - 1) if (head >> (i - tail)) & 1]
                left = subset_residuals(centred, taken, list(range(tail)))
                r2 = np.maximum(0.0, 1.0 - left / total) if total > 0 else np.zeros(len(left))
                masks = (head << tail) + np.arange(1 << tail, dtype=np.int64)
                yield pd.DataFrame({"mask": masks, "r2": r2})[masks > 0]

    heads = 1 << (g.p - tail)
    ids = spark.range(0, heads, numPartitions=max(1, min(heads, 8 * spark.sparkContext.defaultParallelism)))
    return ids.mapInPandas(run, "mask bigint, r2 double").withColumn("size", F.bit_count("mask"))


def _features(spark: SparkSession, features: list[str]) -> DataFrame:
    return spark.createDataFrame([(i, f, 1 << i) for i, f in enumerate(features)], "i int, feature string, bit bigint")


def effects(fits: DataFrame, features: list[str]) -> DataFrame:
    """Unique effect of each feature and common effect of each pair."""
    spark = fits.sparkSession
    names = F.broadcast(_features(spark, features))
    full = (1 << len(features)) - 1
    r2 = fits.select("mask", "r2")
    total = r2.filter(F.col("mask") == full).select("r2").scalar()
    unique = (
        names.withColumn("mask", F.lit(full) - F.col("bit")).join(r2, "mask", "left")
        .select(F.lit("unique").alias("type"), F.col("feature").alias("f1"), F.lit(None).cast("string").alias("f2"),
                F.greatest(F.lit(0.0), total - F.coalesce("r2", F.lit(0.0))).alias("value")))
    single = r2.join(names.select("bit", F.col("bit").alias("mask"), "i", "feature"), "mask").select("i", "feature", "bit", "r2")
    a = single.select(F.col("i").alias("ia"), F.col("feature").alias("f1"), F.col("bit").alias("ba"), F.col("r2").alias("ra"))
    b = single.select(F.col("i").alias("ib"), F.col("feature").alias("f2"), F.col("bit").alias("bb"), F.col("r2").alias("rb"))
    pairs = fits.filter("size = 2").select("mask", "r2")
    # the two bits of a pair mask name its members, so both joins are equi-joins
    low = F.col("mask").bitwiseAND(-F.col("mask"))
    common = (
        pairs.withColumn("ba", low).withColumn("bb", F.col("mask") - low)
        .join(F.broadcast(a), "ba").join(F.broadcast(b), "bb")
        .select(F.lit("common").alias("type"), "f1", "f2", (F.col("r2") - F.col("ra") - F.col("rb")).alias("value")))
    return unique.unionByName(common)


def variance_decomposition(fits: DataFrame, features: list[str]) -> DataFrame:
    """Per feature its own R2 and its equal share of what subsets explain beyond their members' own R2."""
    spark = fits.sparkSession
    names = F.broadcast(_features(spark, features))
    full = (1 << len(features)) - 1
    total = fits.filter(F.col("mask") == full).select("r2").scalar()
    own = fits.filter("size = 1").select(F.col("mask").alias("bit"), F.col("r2").alias("own"))
    alone = {r["bit"]: r["own"] for r in own.collect()}  # a number for each feature

    def holds(i: int) -> Column:
        return F.col("mask").bitwiseAND(F.lit(1 << i).cast("bigint")) != 0

    owned = reduce(add, [F.when(holds(i), F.lit(alone[1 << i])).otherwise(0.0) for i in range(len(features))])
    share = F.greatest(F.lit(0.0), F.col("r2") - owned) / F.col("size")
    sums = fits.filter("size > 1").select("mask", share.alias("share")).agg(  # one row leaves each task
        *[F.sum(F.when(holds(i), F.col("share"))).alias(f"s{i}") for i in range(len(features))])
    per_feature = sums.select(F.explode(F.array(*[
        F.struct(F.lit(1 << i).cast("bigint").alias("bit"), F.col(f"s{i}").alias("common")) for i in range(len(features))])).alias("s")).select("s.*")
    common = F.coalesce("common", F.lit(0.0))

    def percent(part: Column) -> Column:
        return F.when(total > 0, part / total * 100).otherwise(0.0)

    return names.join(own, "bit").join(per_feature, "bit", "left").select(
        "feature", F.col("own").alias("unique_variance"), common.alias("common_variance"), (F.col("own") + common).alias("total_contribution"),
        percent(F.col("own")).alias("unique_percentage"), percent(common).alias("common_percentage"))


def commonality_report(fits: DataFrame, features: list[str]) -> DataFrame:
    """Every effect with its share of the total R2 in percent."""
    full = (1 << len(features)) - 1
    total = fits.filter(F.col("mask") == full).select("r2").scalar()
    return effects(fits, features).select(
        "type", "f1", "f2", "value", F.when(total > 0, F.col("value") / total * 100).otherwise(0.0).alias("percentage"))


def redistribute(fits: DataFrame, features: list[str], beta, correlation: np.ndarray, threshold: float = 0.8,
                 partner: str = "correlated") -> DataFrame:
    """Each coefficient becomes (own + partner's) times its unique share of unique and positive common effects.

    ``partner='correlated'`` takes the most correlated feature above the threshold and leaves others alone;
    ``partner='first'`` takes the first other feature.
    """
    spark = fits.sparkSession
    strength = np.abs(np.nan_to_num(correlation, nan=0.0))
    rows = []
    for i, f in enumerate(features):
        others = [j for j in range(len(features)) if j != i]
        j = None
        if others and partner == "first":
            j = others[0]
        elif others:
            best = max(others, key=lambda o: strength[i, o])
            j = best if strength[i, best] > threshold else None
        low, high = redistribution_bounds(f)
        rows.append((f, float(beta[i]), None if j is None else features[j], None if j is None else float(beta[j]),
                     None if j is None else float(strength[i, j]), low, high))
    own = spark.createDataFrame(rows, "feature string, original_value double, paired_with string, partner_value double, "
                                      "correlation double, low double, high double")
    parts = effects(fits, features)
    unique = parts.filter("type = 'unique'").select(F.col("f1").alias("feature"), F.col("value").alias("unique_effect"))
    both = parts.filter("type = 'common'").select(F.explode(F.array("f1", "f2")).alias("feature"), F.greatest("value", F.lit(0.0)).alias("v"))
    common = both.groupBy("feature").agg(F.sum("v").alias("common_effect"))
    joined = own.join(unique, "feature", "left").join(common, "feature", "left").na.fill(0.0, ["unique_effect", "common_effect"])
    explained = F.col("unique_effect") + F.col("common_effect")
    pool = F.col("original_value") + F.col("partner_value")
    shared = pool * F.col("unique_effect") / explained
    value = (
        F.when(F.col("paired_with").isNull(), F.col("original_value"))
        .when(explained > 0, F.least(F.greatest(shared, "low"), F.coalesce("high", F.lit(float("inf")))))
        .otherwise(pool / 2))
    return joined.select(
        "feature", "paired_with", "correlation", "original_value", "unique_effect", "common_effect",
        explained.alias("total_variance_effect"), value.alias("redistributed_value"))


def economic_clip(feature: str, value: float) -> float:
    low, high = economic_bounds(feature)
    return max(low, value) if high is None else min(max(low, value), high)


def economic_clips(coefficients: DataFrame) -> DataFrame:
    """Coefficients (feature, coefficient) held within the economic bounds of their kind."""
    name = F.lower("feature")
    unlimited, service = name.contains("unlimited"), name.contains("5g") | name.contains("tethering")
    low = F.when(unlimited | service, 100.0).otherwise(0.1)
    high = F.when(unlimited, 20000.0).when(service, 10000.0).otherwise(float("inf"))
    return coefficients.withColumn("clipped", F.least(F.greatest(F.col("coefficient"), low), high))

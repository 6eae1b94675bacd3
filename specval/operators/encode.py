"""Encodings of the unlimited flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specval.config import UNLIMITED_FLAGS
from specval.functions.numeric import known
from specval.operators.quantiles import EXACT_ROWS, exact_quantiles

SIMILAR = (0.8, 1.2)


def dummy_columns(df: DataFrame, columns, levels: dict[str, list] | None = None) -> DataFrame:
    """One 0/1 column per level of each column, without the lowest level.

    The plan gets a column per level, so the driver has to know them; ``levels`` gives them without a scan. ``dummy_entries``
    is the form for columns with very many levels.
    """
    for c in [c for c in columns if c in df.columns]:
        known_levels = (levels or {}).get(c)
        if known_levels is None:
            known_levels = [r[0] for r in df.select(c).filter(F.col(c).isNotNull()).distinct().collect()]  # as many as the result has columns
        df = df.withColumns({f"{c}_{v}": F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0)) for v in sorted(known_levels)[1:]})
    return df


def dummy_entries(df: DataFrame, columns, key: str) -> DataFrame:
    """J10 in long form: (key, column, level) for every entry that is 1; nothing about the levels reaches the driver."""
    names = [c for c in columns if c in df.columns]
    lowest = df.agg(*[F.min(c).alias(c) for c in names]).first()
    entries = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level"), (F.col(c) > F.lit(lowest[c])).alias("one")) for c in names]
    return df.select(key, F.explode(F.array(*entries)).alias("e")).filter("e.one").select(key, "e.column", "e.level")


def unlimited_premiums(df: DataFrame, flags: dict[str, str], cost: str = "original_fee", exact_rows: int = EXACT_ROWS) -> dict[str, float]:
    """Mean unlimited cost over the mean cost of limited rows within 20 % of the median limited value."""
    pairs = {f: m for f, m in flags.items() if f in df.columns and m in df.columns}
    if not pairs:
        return {}
    limited = df.select(*[F.when(F.col(m) == 0, known(df, f)).alias(f) for f, m in pairs.items()])
    medians = {f: q[0] for f, q in exact_quantiles(limited, {f: [0.5] for f in pairs}, exact_rows).items()}
    price = known(df, cost)
    row = df.agg(*[
        e for f, m in pairs.items() if medians[f] is not None for e in (
            F.avg(F.when(F.col(m) == 1, price)).alias(f"{f}|u"),
            F.avg(F.when((F.col(m) == 0) & known(df, f).between(medians[f] * SIMILAR[0], medians[f] * SIMILAR[1]), price)).alias(f"{f}|l"))
    ]).first() if any(v is not None for v in medians.values()) else {}
    out = {}
    for f in pairs:
        if medians[f] is not None and row[f"{f}|u"] is not None and row[f"{f}|l"] is not None:
            out[f] = row[f"{f}|u"] - row[f"{f}|l"]
    return out


def premium_columns(df: DataFrame, flags: dict[str, str], cost: str = "original_fee", exact_rows: int = EXACT_ROWS) -> DataFrame:
    """``<column>_unlimited_premium``, the premium where the flag is set."""
    premiums = unlimited_premiums(df, flags, cost, exact_rows)
    return df.withColumns({f"{f}_unlimited_premium": F.col(flags[f]) * F.lit(float(p)) for f, p in premiums.items()})


def mixed_column(df: DataFrame, column: str, flag: str, threshold: float | None = None) -> DataFrame:
    """Unlimited as a large number (twice the largest limited value), and a marker of such rows."""
    if column not in df.columns or flag not in df.columns:
        return df
    high = F.lit(float(threshold)) if threshold is not None else (
        df.agg((2 * F.max(F.when(F.col(flag) == 0, known(df, column)))).alias("t")).select("t").scalar())
    unlimited = F.coalesce(F.col(flag) == 1, F.lit(False))
    return df.withColumns({
        f"{column}_mixed": F.when(unlimited, high).otherwise(F.col(column).cast("double")),
        f"{column}_is_synthetic": unlimited.cast("int"),
    })


def with_segment(df: DataFrame, flag: str) -> DataFrame:
    """Rows labelled limited or unlimited."""
    return df.withColumn("segment", F.when(F.col(flag) == 0, "limited").when(F.col(flag) == 1, "unlimited")).filter("segment IS NOT NULL")


def split_segments(df: DataFrame, column: str, flag: str) -> dict[str, DataFrame]:
    if column not in df.columns or flag not in df.columns:
        return {}
    parts = {"limited": df.filter(F.col(flag) == 0), "unlimited": df.filter(F.col(flag) == 1)}
    return {name: part for name, part in parts.items() if not part.isEmpty()}


def categorical_marginal_costs(df: DataFrame, column: str, flag: str, base_coefficient: float, cost: str = "original_fee") -> DataFrame:
    """Per-unit cost of limited rows (given) and of unlimited rows (taken as twice the largest value)."""
    value, price = known(df, column), known(df, cost)
    limited, unlimited = F.col(flag) == 0, F.col(flag) == 1
    row = df.agg(
        F.avg(F.when(unlimited, price)).alias("u"), F.avg(F.when(limited, price)).alias("l"),
        (2 * F.max(F.when(limited, value)) - F.avg(F.when(limited, value))).alias("width"))
    return row.select(
        F.lit(column).alias("feature"), F.lit(float(base_coefficient)).alias("limited"),
        F.when(F.col("width") > 0, (F.col("u") - F.col("l")) / F.col("width")).alias("unlimited"))


STRATEGIES = ("separate_handling", "dummy_variables", "premium_encoding")


def apply_encoding(df: DataFrame, strategy: str = "separate_handling", flags: dict[str, str] | None = None) -> DataFrame:
    """J15."""
    flags = UNLIMITED_FLAGS if flags is None else flags
    if strategy == "separate_handling":
        return df
    if strategy == "dummy_variables":
        return dummy_columns(df, list(flags.values()))
    if strategy == "premium_encoding":
        return premium_columns(df, flags)
    raise ValueError(f"Unknown encoding strategy: {strategy}")

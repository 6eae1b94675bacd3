"""From raw plan columns to numeric features.

One narrow projection builds every column. The only jobs are one aggregate for the column-wide maximum (a scalar
subquery of the plan) and, when medians are to be filled in, one count and one quantile job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specval import config as C
from specval.functions.numeric import as_flag, finite, is_numeric, is_text, known
from specval.operators.quantiles import EXACT_ROWS, exact_quantiles
from specval.session import materialize


def coerce_mixed(df: DataFrame) -> DataFrame:
    """B1: text columns that should be numbers; unreadable text counts as 0."""
    return df.withColumns({
        c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
        for c in C.MIXED_COLUMNS if c in df.columns and is_text(df, c)
    })


def with_network(df: DataFrame) -> DataFrame:
    """B2."""
    flag = as_flag(F.col("network") == "5G") if "network" in df.columns else F.lit(0)
    return df.withColumn("is_5g", flag)


def with_throttle(df: DataFrame) -> DataFrame:
    """Mbps after the quota is used up; other units and missing text count as 0."""
    if "data_exhaustion" not in df.columns:
        return df.withColumns({"speed_when_exhausted": F.lit(0.0), "has_throttled_data": F.lit(0)})
    text = F.col("data_exhaustion")
    number = F.trim(F.replace(text, F.lit("Mbps"), F.lit(""))).try_cast("double")
    speed = F.when(text.contains("Mbps"), F.coalesce(number, F.lit(0.0))).otherwise(0.0)
    return df.withColumn("speed_when_exhausted", speed).withColumn(
        "has_throttled_data", as_flag(F.col("speed_when_exhausted") > 0))


def finite_maxima(df: DataFrame) -> DataFrame:
    """One row with the largest limited basic and daily quota (defaults 100 and 10)."""
    def best(raw: str, clean: str, default: float):
        if raw in df.columns:
            value = F.max(F.when(~F.col(raw).isin(C.DATA_UNLIMITED_VALUES), F.col(raw)))
        elif clean in df.columns:
            value = F.max(clean)
        else:
            value = F.lit(None)
        return F.coalesce(value.cast("double"), F.lit(float(default)))

    return df.agg(
        best("basic_data", "basic_data_clean", 100).alias("max_basic_data"),
        best("daily_data", "daily_data_clean", 10).alias("max_daily_data"),
    )


def with_data_allowance(df: DataFrame) -> DataFrame:
    """Unlimited flags, cleaned quotas, monthly total."""
    maxima = finite_maxima(df)
    flags, clean = {}, {}
    for kind in ("basic", "daily"):
        raw, flag, out = f"{kind}_data", f"{kind}_data_unlimited", f"{kind}_data_clean"
        if raw in df.columns:
            flags[flag] = as_flag(F.col(raw).isin(C.DATA_UNLIMITED_VALUES))
        elif flag not in df.columns:
            flags[flag] = F.lit(0)
        if out in df.columns:
            continue
        if raw not in df.columns:
            clean[out] = F.lit(0.0)
            continue
        value = F.when(F.col(raw) == C.NOT_APPLICABLE, 0.0).otherwise(F.col(raw).cast("double"))
        if kind == "daily":
            value = F.coalesce(value, F.lit(0.0))
        clean[out] = F.when(F.col(flag) == 1, 0.0).otherwise(value)
    df = df.withColumns(flags)
    df = df.withColumns(clean) if clean else df
    return df.withColumns({
        "has_daily_allocation": as_flag(F.col("daily_data_clean") > 0),
        "total_data": F.when(F.col("basic_data_unlimited") == 1, maxima.select("max_basic_data").scalar())
        .otherwise(F.col("basic_data_clean") + F.col("daily_data_clean") * 30),
    })


def with_unlimited_kind(df: DataFrame) -> DataFrame:
    """B8 to B11."""
    df = df.withColumn("has_unlimited_data", as_flag((F.col("basic_data_unlimited") == 1) | (F.col("daily_data_unlimited") == 1)))
    df = df.withColumn(
        "has_unlimited_speed", as_flag((F.col("has_unlimited_data") == 1) & (F.col("speed_when_exhausted") == 0)))
    full_speed, throttled = F.col("has_unlimited_speed") == 1, F.col("has_throttled_data") == 1
    unlimited = F.col("has_unlimited_data") == 1

    def by_kind(speed, slowed, always_slow, limited):
        return F.when(full_speed, speed).when(throttled, slowed).when(unlimited, always_slow).otherwise(limited)

    df = df.withColumns({
        "any_unlimited_data": as_flag(unlimited | throttled),
        "unlimited_type": by_kind("unlimited_speed", "throttled_unlimited", "unlimited_with_throttling", "limited"),
        "unlimited_type_numeric": by_kind(3, 2, 1, 0),
        "throttle_speed_normalized": F.when(
            throttled, F.least(F.col("speed_when_exhausted") / C.MAX_THROTTLE_MBPS, F.lit(1.0)))
        .when(full_speed, 1.0).otherwise(0.0),
    })
    kind = F.col("unlimited_type_numeric")
    return df.withColumns({
        "data_stops_after_quota": as_flag(kind == 0),
        "data_throttled_after_quota": as_flag(kind == 2),
        "data_unlimited_speed": as_flag(kind == 3),
    })


def with_boolean_flags(df: DataFrame) -> DataFrame:
    """0/1 columns; text is read as a boolean, so 'False' is 0."""
    return df.withColumns({
        f"{c}_numeric": as_flag(F.col(c).try_cast("boolean")) for c in C.FLAG_COLUMNS if c in df.columns
    })


def with_calls_and_texts(df: DataFrame) -> DataFrame:
    """A quota whose whole part contains 999 is unlimited, -1 is not available."""
    for base in ("voice", "message"):
        flag, missing, clean = f"{base}_unlimited", f"{base}_na", f"{base}_clean"
        if base in df.columns:
            if is_text(df, base):
                df = df.withColumn(base, F.coalesce(F.col(base).try_cast("double"), F.lit(0.0)))
            value = F.col(base)
            df = df.withColumns({
                flag: as_flag(value.try_cast("bigint").cast("string").contains(C.UNLIMITED_DIGITS)),
                missing: as_flag(value == C.NOT_APPLICABLE),
            })
            df = df.withColumn(clean, F.when((F.col(flag) == 1) | (F.col(missing) == 1), 0.0).otherwise(value.cast("double")))
        elif clean not in df.columns:
            df = df.withColumns({flag: F.lit(0), missing: F.lit(0), clean: F.lit(0.0)})
    return df


def with_sim_status(df: DataFrame) -> DataFrame:
    """A missing status counts as supported, but not as free."""
    columns = {}
    for status, prefix in (
        ("usim_delivery_fee_status", "usim"), ("nfc_usim_delivery_fee_status", "nfc_usim"), ("esim_fee_status", "esim"),
    ):
        if status in df.columns:
            columns[f"{prefix}_supported"] = (~F.col(status).eqNullSafe("UNSUPPORTED")).cast("int")
            columns[f"{prefix}_is_free"] = as_flag(F.col(status).isin("FREE", "FREE_ON_ACTIVATION"))
    return df.withColumns(columns) if columns else df


def with_prices(df: DataFrame) -> DataFrame:
    """B15 to B17."""
    kind = F.col("unlimited_type")
    columns = {
        "price_per_gb": F.when(
            (F.col("total_data") > 0) & (F.col("any_unlimited_data") == 0), F.try_divide(F.col("fee"), F.col("total_data"))),
        "price_unlimited_adjusted": F.when(kind == "unlimited_speed", F.col("fee") * 0.7)
        .when(kind == "throttled_unlimited", F.col("fee") * 0.8)
        .when(kind == "unlimited_with_throttling", F.col("fee") * 0.9),
        "monthly_price": F.col("fee"),
    }
    if "original_fee" in df.columns:
        paid = F.col("original_fee") <= 0
        if "discount_period" in df.columns:
            paid = (F.coalesce(F.col("discount_period"), F.lit(-1)) == 0) | paid
        columns["original_fee"] = F.when(paid, F.col("fee")).otherwise(F.col("original_fee"))
    if "agreement" in df.columns:
        columns["has_agreement"] = as_flag(F.col("agreement").try_cast("boolean"))
    if "agreement_period" in df.columns:
        columns["agreement_period"] = F.coalesce(F.col("agreement_period"), F.lit(0))
    return df.withColumns(columns)


def without_infinities(df: DataFrame) -> DataFrame:
    fractions = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: finite(F.col(c)) for c in fractions})


def impute_medians(df: DataFrame, exclude=(), exact_rows: int = EXACT_ROWS) -> DataFrame:
    """B18, after infinities became missing: missing numbers become the column median (exact). A filled integer column becomes double."""
    # columns that cannot be missing by construction, such as the 0/1 flags, need no count
    numbers = [c for c in df.columns if is_numeric(df, c) and df.schema[c].nullable and c not in set(exclude)]
    if not numbers:
        return df
    present = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(known(df, c)).alias(c) for c in numbers]).first().asDict()
    holes = [c for c in numbers if present[c] < present["__rows"]]
    medians = exact_quantiles(df, {c: [0.5] for c in holes}, exact_rows, present)
    return df.withColumns({
        c: F.coalesce(known(df, c), F.lit(medians[c][0]).cast("double")) for c in holes
    })


def derive(df: DataFrame) -> DataFrame:
    """Every derived column, before imputation; a lazy plan."""
    for step in (
        coerce_mixed, with_network, with_throttle, with_data_allowance, with_unlimited_kind,
        with_boolean_flags, with_calls_and_texts, with_sim_status, with_prices,
    ):
        df = step(df)
    return df


def prepare_features(df: DataFrame, impute: bool = True, exclude=(), exact_rows: int = EXACT_ROWS, keep=None,
                     path: str | None = None) -> DataFrame:
    """The feature table, written once (to scratch, or to ``path``) because every model reads it several times by column.

    ``keep`` names the columns to write; on a wide input that is worth giving.
    """
    table = without_infinities(derive(df))
    if keep is not None:
        table = table.select(*keep)
    if impute:
        table = impute_medians(table, exclude, exact_rows)
    if path is None:
        return materialize(table, "features")
    table.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(table.schema).parquet(path)


def key_statistics(df: DataFrame, features=None, exact_rows: int = EXACT_ROWS) -> DataFrame:
    """Min, max, mean and median of the key features, one row each."""
    names = [f for f in (features or C.KEY_FEATURES) if f in df.columns]
    medians = exact_quantiles(df, {f: [0.5] for f in names}, exact_rows)
    row = df.agg(*[
        expr for f in names for expr in (
            F.min(f).cast("double").alias(f"{f}|min"), F.max(f).cast("double").alias(f"{f}|max"),
            F.avg(f).alias(f"{f}|mean"))
    ])
    cells = F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"`{f}|min`").alias("min"), F.col(f"`{f}|max`").alias("max"),
                 F.col(f"`{f}|mean`").alias("mean"), F.lit(medians[f][0]).cast("double").alias("median"))
        for f in names
    ]))
    return row.select(cells.alias("s")).select("s.*")


def present_features(df: DataFrame, features, flags=None) -> list[str]:
    """Configured features that exist; with ``flags`` also the flags of the listed columns."""
    names = list(features)
    for column, flag in (flags or {}).items():
        if column in names and flag not in names:
            names.append(flag)
    return [f for f in names if f in df.columns]


def upstream_columns(df: DataFrame) -> DataFrame:
    """Tethering in GB from an MB or GB quantity, and the discount in percent."""
    columns = {}
    if {"tethering_data", "tethering_data_unit"} <= set(df.columns):
        amount = F.coalesce(F.col("tethering_data").try_cast("double"), F.lit(0.0))
        columns["tethering_gb"] = F.when(F.col("tethering_data_unit") == "MB", amount / 1000).otherwise(amount)
    if {"fee", "original_fee"} <= set(df.columns):
        columns["discount_percentage"] = (1 - F.try_divide(F.col("fee"), F.col("original_fee"))) * 100
    return df.withColumns(columns)

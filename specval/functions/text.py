"""Display columns of the report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specval import config as C
from specval.functions.numeric import FRACTIONS, total

# fixed values: labels of the report tables
UNLIMITED_TEXT = "무제한"
ENDS_TEXT = "소진시 종료"
AFTER_TEXT = "소진시 "
ALWAYS_TEXT = "항상 "
EXTRA_TEXT = "부가: "
WON, MINUTES, MESSAGES, TIMES = "원", "분", "건", "배"
RANK_TEXT, JOINT_TEXT = "위", "공동 "


def with_commas(value: Column) -> Column:
    """G1: N/A for a missing number, no decimals for a whole one, else two."""
    return (
        F.when(value.isNull() | F.isnan(value.cast("double")), "N/A")
        .when(value == F.floor(value), F.format_number(value, 0)).otherwise(F.format_number(value, 2)))


def shortened(name: Column, length: int = 40) -> Column:
    """G2."""
    return (
        F.when(name.isNull(), "").when(F.length(name) <= length, name)
        .otherwise(F.concat(F.substring(name, 1, length - 3), F.lit("..."))))


def rank_text(rank: Column, ties: Column) -> Column:
    """N위, with a leading 공동 for a shared rank."""
    return F.concat(F.when(ties > 1, JOINT_TEXT).otherwise(""), rank.cast("string"), F.lit(RANK_TEXT))


def _flag(df: DataFrame, feature: str, flags) -> Column:
    mark = flags.get(feature)
    return F.coalesce(F.col(mark) == 1, F.lit(False)) if mark in df.columns else F.lit(False)


def plain(df: DataFrame, name: str) -> Column:
    """One decimal for fractions, none for integers."""
    col = F.col(name)
    return F.translate(F.format_number(col, 1), ",", "") if isinstance(df.schema[name].dataType, FRACTIONS) else col.cast("string")


def richness(df: DataFrame, features, flags=None) -> Column:
    """100 per unlimited feature, 10 per positive one, 1 per present one."""
    flags = C.UNLIMITED_FLAGS if flags is None else flags
    points = [
        F.when(_flag(df, f, flags), 100).when(F.col(f) > 0, 10).when(F.col(f) <= 0, 1).otherwise(0)
        for f in features if f in df.columns
    ]
    return total(points).cast("int")


def spec_text(df: DataFrame, features, labels=None, units=None, flags=None) -> Column:
    """``Name: value unit; ...``."""
    labels, units = labels or C.CORE_CONTINUOUS, units or C.FEATURE_UNITS
    flags = C.UNLIMITED_FLAGS if flags is None else flags
    parts = []
    for f in features:
        unit, value = units.get(f, ""), F.lit("N/A")
        if f in df.columns:
            value = (
                F.when(_flag(df, f, flags), f"Unlimited {unit}".strip())
                .when(F.col(f).isNotNull(), F.trim(F.concat(plain(df, f), F.lit(f" {unit}")))).otherwise("N/A"))
        parts.append(F.concat(F.lit(f"{labels.get(f, f)}: "), value))
    return F.concat_ws("; ", *parts)


def other_spec_text(df: DataFrame, features, analyzed: str, units=None, flags=None, cost: str = "original_fee") -> Column:
    """``a + b = 1,000 KRW`` over the features other than ``analyzed``."""
    units = units or C.FEATURE_UNITS
    flags = C.UNLIMITED_FLAGS if flags is None else flags
    parts = []
    for f in features:
        if f == analyzed:
            continue
        unit = units.get(f, "")
        missing = F.lit(f"N/A {unit}".strip())
        if f not in df.columns:
            parts.append(missing)
            continue
        counted = F.trim(F.concat(plain(df, f), F.lit(f" {unit}")))
        parts.append(
            F.when(_flag(df, f, flags) & (F.col(f) > 0), F.concat(F.lit("Unlimited ("), F.trim(F.concat(F.col(f).cast("string"), F.lit(f" {unit}"))), F.lit(")")))
            .when(_flag(df, f, flags), f"Unlimited {unit}".strip())
            .when(F.col(f).isNotNull(), counted).otherwise(missing))
    price = F.when(F.col(cost).isNotNull(), F.format_number(F.col(cost), 0)).otherwise("N/A") if cost in df.columns else F.lit("0")
    return F.concat(F.concat_ws(" + ", *parts), F.lit(" = "), price, F.lit(" KRW"))


def plan_table(df: DataFrame, flags=None) -> DataFrame:
    """The cells of the ranking table, one row per plan, one text column per cell."""
    flags = C.UNLIMITED_FLAGS if flags is None else flags
    have = set(df.columns)
    amount = {f: with_commas(F.col(f)) for f in have if f in C.BASIC_FEATURES}
    cs = F.coalesce("CS", F.lit(0.0))
    arrow = F.when(cs > 1, "↑").when(cs < 1, "↓").otherwise("→")
    times = F.when(cs == float("inf"), "∞").otherwise(F.translate(F.format_number(cs, 2), ",", ""))
    rank = F.col("rank_display") if "rank_display" in have else F.col("rank_number").cast("string") if "rank_number" in have else F.lit("N/A")
    cells = {
        "rank_cell": rank,
        "plan_cell": F.concat(shortened(F.col("plan_name"), 30), F.lit(" ("), F.col("id").cast("string"), F.lit(")")),
        "mvno_cell": F.coalesce("mvno", F.lit("N/A")),
        "original_fee_cell": F.concat(with_commas(F.col("original_fee")), F.lit(WON)),
        "fee_cell": F.concat(with_commas(F.col("fee")), F.lit(WON)),
        "cs_cell": F.concat(with_commas(F.coalesce("B", F.lit(0.0))), F.lit(f"{WON} ("), times, F.lit(f"{TIMES} "), arrow, F.lit(")")),
    }
    if "is_5g" in have:
        cells["network_cell"] = F.when(F.col("is_5g") == 1, "5G").otherwise("LTE")
    for f, unit, dash in (("basic_data_clean", "GB", False), ("daily_data_clean", "GB", True), ("tethering_gb", "GB", True), ("message_clean", MESSAGES, False)):
        if f in have:
            counted = F.concat(amount[f], F.lit(unit))
            if dash:
                counted = F.when(F.col(f) == 0, "-").otherwise(counted)
            cells[f"{f}_cell"] = F.when(_flag(df, f, flags), UNLIMITED_TEXT).otherwise(counted)
    if "voice_clean" in have:
        spoken = F.when(_flag(df, "voice_clean", flags), UNLIMITED_TEXT).otherwise(F.concat(amount["voice_clean"], F.lit(MINUTES)))
        extra = F.coalesce("additional_call", F.lit(0)) if "additional_call" in have else F.lit(0)
        cells["voice_clean_cell"] = F.concat(
            spoken, F.when(extra > 0, F.concat(F.lit(f" ({EXTRA_TEXT}"), with_commas(extra), F.lit(f"{MINUTES})"))).otherwise(""))
    if {"throttle_speed_normalized", "unlimited_type_numeric"} <= have:
        speed = F.concat(F.translate(F.format_number(F.col("throttle_speed_normalized") * 10, 1), ",", ""), F.lit("Mbps"))
        kind = F.col("unlimited_type_numeric")
        cells["throttle_cell"] = (
            F.when(kind == 2, F.concat(F.lit(AFTER_TEXT), speed)).when(kind == 1, F.concat(F.lit(ALWAYS_TEXT), speed))
            .when(kind == 3, UNLIMITED_TEXT).otherwise(ENDS_TEXT))
    return df.select("id", *[c.alias(n) for n, c in cells.items()])


def storable(df: DataFrame) -> DataFrame:
    """Infinities become the largest double and missing numbers 0, as the response needs."""
    largest = 1.7976931348623157e308
    columns = {}
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            col = F.col(name)
            columns[name] = F.coalesce(
                F.when(col.isin(float("inf"), float("-inf")), F.lit(largest)).otherwise(F.nanvl(col, F.lit(0.0).cast(kind))), F.lit(0.0))
        elif kind in ("int", "bigint", "smallint", "tinyint"):
            columns[name] = F.coalesce(F.col(name), F.lit(0).cast(kind))
    return df.withColumns(columns)

"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRACTIONS = (T.DoubleType, T.FloatType)


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def known(df: DataFrame, name: str) -> Column:
    """The column as double, with NaN read as missing."""
    col = F.col(name)
    if isinstance(df.schema[name].dataType, FRACTIONS):
        col = F.nanvl(col, F.lit(None).cast("double"))
    return col.cast("double")


def drop_missing(df: DataFrame, names) -> DataFrame:
    return df.na.drop("any", subset=list(names))


def as_flag(condition: Column) -> Column:
    """0/1 integer; a missing condition counts as 0."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def finite(col: Column) -> Column:
    """Infinities become missing."""
    return F.when(col.isin(float("inf"), float("-inf")), F.lit(None)).otherwise(col)


def ratio(numerator: Column, price: Column) -> Column:
    """numerator / price where a zero price gives a signed infinity, and 0/0 is missing."""
    return (
        F.when(price != 0, numerator / price)
        .when((price == 0) & (numerator > 0), F.lit(float("inf")))
        .when((price == 0) & (numerator < 0), F.lit(float("-inf")))
    )


def total(columns: list[Column]) -> Column:
    result = F.lit(0.0)
    for col in columns:
        result = result + col
    return result


def unpivot(df: DataFrame, keys: list[str], columns: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Wide columns to (name, value) rows; all values become double."""
    wide = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    return wide.unpivot(keys, columns, name, value)


def numbers(values) -> Column:
    """A constant array of doubles."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")

"""Column expressions and joins that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space that separates words, and a word.
WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of a lookup table that may be broadcast; with a few numbers a row that is under 64 MB.
BROADCAST_ROWS = 1_000_000


def text_of(column: str) -> Column:
    """The text; a missing one counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def boxed(names: list[str]) -> Column:
    """The columns as one struct ``__doc``, so that names used on the way can't clash with theirs."""
    return F.struct(*[F.col(quoted(c)).alias(c) for c in names]).alias("__doc")


def unboxed(names: list[str]) -> list[Column]:
    return [F.col(f"__doc.{quoted(c)}").alias(c) for c in names]


def word_count(column: str) -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def join_checked(rows: DataFrame, lookup: DataFrame, on: list[str], how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join ``rows`` with a lookup that holds each key once: broadcast when it has at most ``limit`` rows, else shuffled.

    The lookup is counted first. In the shuffled form Spark's skew join splits a key that many of ``rows`` share;
    the lookup's side of such a key is one row.
    """
    if lookup.limit(limit + 1).count() <= limit:
        lookup = F.broadcast(lookup)
    return rows.join(lookup, on, how)

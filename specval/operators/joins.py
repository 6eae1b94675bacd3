"""Equi-joins of a large table with a lookup table of unknown size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_CELLS = 4_000_000  # rows times columns, about 32 MB of numbers


def join_measured(rows: DataFrame, lookup: DataFrame, on: list[str], how: str, broadcast_rows: int | None = None) -> DataFrame:
    """Broadcast ``lookup``, which holds each key once, when it has at most ``broadcast_rows`` rows (by default as many as
    make BROADCAST_CELLS cells), else join by shuffle.

    A key that a third of ``rows`` share makes a large partition on that side only; the adaptive skew join splits it
    and repeats the lookup's few rows, so nothing is copied beforehand. ``how`` is inner, left, left_semi or left_anti.
    """
    if broadcast_rows is None:
        broadcast_rows = BROADCAST_CELLS // len(lookup.columns)
    if lookup.limit(broadcast_rows + 1).count() <= broadcast_rows:
        lookup = F.broadcast(lookup)
    return rows.join(lookup, on, how)

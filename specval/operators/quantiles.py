"""Exact quantiles of columns of any size.

``percentile`` keeps one counter per distinct value in a single task, which is fine up to a bound. Beyond it the
wanted order statistics of all columns are bracketed at once with KLL sketches, the brackets are verified by counting, and the
search continues inside them until what is left is below the bound. The number of scans depends on the number of rounds (mostly one),
not on the number of columns or quantiles. Sketches are merged as a tree: ``FAN`` of them make one of the next level.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specval.functions.numeric import known
from specval.session import materialize

EXACT_ROWS = 2_000_000
SIZE = 4096  # of a sketch, about 100 KB; its ranks are off by less than 0.1 % nearly always
MARGIN = 0.002
FAN = 64


def exact_quantiles(df: DataFrame, wanted: dict[str, list[float]], exact_rows: int = EXACT_ROWS,
                    sizes: dict[str, int] | None = None) -> dict[str, list]:
    """Linear-interpolation quantiles per column (missing values ignored); ``None`` for an empty column.

    ``sizes`` are the numbers of present values, if they are known already.
    """
    if not wanted:
        return {}
    names = list(wanted)
    sizes = sizes or df.agg(*[F.count(known(df, c)).alias(c) for c in names]).first()
    result: dict[str, list] = {c: [None] * len(wanted[c]) for c in names if sizes[c] == 0}
    small = [c for c in names if 0 < sizes[c] <= exact_rows]
    if small:
        row = df.agg(*[
            F.percentile(known(df, c), F.array(*[F.lit(float(q)) for q in wanted[c]])).alias(c) for c in small
        ]).first()
        result.update({c: list(row[c]) for c in small})
    large = [c for c in names if sizes[c] > exact_rows]
    if large:
        result.update(_refined(df.select(*[known(df, c).alias(c) for c in large]), {c: sizes[c] for c in large}, wanted, exact_rows))
    return result


def sketches(df: DataFrame, columns: dict[str, Column], size: int = SIZE, fan: int = FAN) -> DataFrame:
    """One row with a KLL sketch of each column's present values.

    A task makes one sketch per column; the sketches of ``fan`` tasks are merged into one, those again, until ``fan`` or fewer are left.
    """
    group = "__tasks"
    level = df.groupBy(F.floor(F.spark_partition_id() / fan).alias(group)).agg(
        *[F.kll_sketch_agg_double(c, size).alias(n) for n, c in columns.items()])
    level = materialize(level, "sketches")
    while level.count() > fan:
        level = materialize(level.groupBy(F.floor(F.col(group) / fan).alias(group)).agg(
            *[F.kll_merge_agg_double(F.col(f"`{n}`"), size).alias(n) for n in columns]), "sketches")
    return level.agg(*[F.kll_merge_agg_double(F.col(f"`{n}`"), size).alias(n) for n in columns])


def sketched_quantiles(df: DataFrame, wanted: dict[str, tuple[Column, list[float]]], size: int = SIZE, fan: int = FAN) -> dict[str, list[float]]:
    """Approximate quantiles of columns of doubles; an empty list for one without values."""
    merged = sketches(df, {n: c for n, (c, _) in wanted.items()}, size, fan)
    filled = {n: F.kll_sketch_get_n_double(F.col(f"`{n}`")) > 0 for n in wanted}
    row = merged.select(*[
        F.when(filled[n], F.kll_sketch_get_quantile_double(F.col(f"`{n}`"), F.array(*[F.lit(float(p)) for p in probs]))).alias(n)
        for n, (_, probs) in wanted.items()]).first()
    return {n: list(row[n] or []) for n in wanted}


@dataclass
class Rank:
    """The search for the ``k``-th smallest (0-based) value of a column; it lies strictly between ``low`` and ``high``."""

    column: str
    k: int
    inside: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    margin: float = MARGIN
    answer: float | None = None

    def scope(self) -> Column:
        v = F.col(f"`{self.column}`")
        inner = v.isNotNull()
        if self.low is not None:
            inner = inner & (v > self.low)
        if self.high is not None:
            inner = inner & (v < self.high)
        return F.when(inner, v)

    def narrow(self, a: float, b: float, lt: int, upto_a: int, lt_b: int, upto_b: int) -> None:
        if self.k < self.below + lt or self.k >= self.below + upto_b:
            self.margin *= 4  # the sketch missed; at margin 1 the bracket is the whole scope
        elif self.k < self.below + upto_a:
            self.answer = a
        elif self.k >= self.below + lt_b:
            self.answer = b
        else:  # a and b themselves are ruled out, so the scope always shrinks
            self.low, self.high, self.below, self.inside = a, b, self.below + upto_a, lt_b - upto_a


def _refined(df: DataFrame, sizes: dict[str, int], wanted: dict[str, list[float]], exact_rows: int) -> dict[str, list]:
    places = {(c, q): math.floor((n - 1) * q) for c, n in sizes.items() for q in wanted[c]}
    ranks = {(c, k): Rank(c, k, sizes[c]) for (c, _), low in places.items() for k in (low, min(low + 1, sizes[c] - 1))}
    _search(df, list(ranks.values()), exact_rows)
    result = {}
    for c, n in sizes.items():
        result[c] = []
        for q in wanted[c]:
            low = places[c, q]
            share = (n - 1) * q - low
            a, b = ranks[c, low].answer, ranks[c, min(low + 1, n - 1)].answer
            result[c].append(a * (1 - share) + b * share if share else a)
    return result


def _search(df: DataFrame, ranks: list[Rank], exact_rows: int) -> None:
    while open_ := [r for r in ranks if r.answer is None and r.inside > exact_rows]:
        # ranks of a column that haven't been narrowed yet share a sketch
        scopes: dict[tuple, str] = {}
        asked: dict[str, tuple[Column, list[float]]] = {}
        places = []
        for r in open_:
            at = (r.k - r.below) / max(r.inside - 1, 1)
            name = scopes.setdefault((r.column, r.low, r.high), f"s{len(scopes)}")
            probs = asked.setdefault(name, (r.scope().cast("double"), []))[1]
            places.append((name, len(probs)))
            probs += [max(0.0, at - r.margin), min(1.0, at + r.margin)]
        found = sketched_quantiles(df, asked)
        brackets = [(found[name][k], found[name][k + 1]) for name, k in places]
        counted = []
        for r, (a, b) in zip(open_, brackets):
            v = r.scope()
            counted += [F.count_if(v < a), F.count_if(v <= a), F.count_if(v < b), F.count_if(v <= b)]
        counts = df.agg(*[c.alias(f"c{i}") for i, c in enumerate(counted)]).first()
        for i, (r, (a, b)) in enumerate(zip(open_, brackets)):
            r.narrow(a, b, *counts[4 * i:4 * i + 4])
    rest = [r for r in ranks if r.answer is None]
    if not rest:
        return
    inside = [F.struct(F.lit(i).alias("i"), r.scope().alias("v")) for i, r in enumerate(rest)]
    values = df.select(F.explode(F.filter(F.array(*inside), lambda s: s["v"].isNotNull())).alias("s")).groupBy("s.i", "s.v").count()
    ordered = Window.partitionBy("i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)  # at most exact_rows rows per rank
    place = F.element_at(F.array(*[F.lit(r.k - r.below) for r in rest]), F.col("i") + 1)
    found = values.withColumn("upto", F.sum("count").over(ordered)).filter(F.col("upto") > place).groupBy("i").agg(F.min("v").alias("v"))
    for row in found.collect():
        rest[row["i"]].answer = row["v"]

"""Sums of products: all that the regressions need from the rows.

One aggregate of p(p+1)/2 + ... sums, combined map-side, for p features up to ``GENERATED`` columns (about 15 as a rule). More
columns would pass the size of generated code: then numpy multiplies Arrow batches inside tasks and an aggregate keyed by matrix
cell adds up what tasks found. Columns are shifted by their means first (a pass that adds up one number per column), which keeps
the sums well scaled; what is left of the centring is done on the p x p result. No row prefix or sample has a say in the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specval.functions.numeric import known

GENERATED = 24  # columns whose sums of products are one generated aggregate
BATCH_CELLS = 1_000_000  # numbers that are multiplied at once


@dataclass
class Gram:
    """Row count, means and centred cross products of features and target."""

    features: list[str]
    n: int
    mean: np.ndarray  # features, then target
    centred: np.ndarray  # (p + 1) x (p + 1)
    by: dict = field(default_factory=dict)

    @property
    def p(self) -> int:
        return len(self.features)

    def raw(self) -> np.ndarray:
        """X'X, X'y, y'y around 0."""
        return self.centred + self.n * np.outer(self.mean, self.mean)

    def plus(self, other: "Gram", sign: int = 1) -> "Gram":
        """Statistics of both row sets together, or (sign -1) of this set without the other."""
        n = self.n + sign * other.n
        if n <= 0:
            return Gram(self.features, 0, np.zeros_like(self.mean), np.zeros_like(self.centred))
        mean = (self.n * self.mean + sign * other.n * other.mean) / n
        here, there = self.mean - mean, other.mean - mean
        centred = (self.centred + self.n * np.outer(here, here)) + sign * (other.centred + other.n * np.outer(there, there))
        return Gram(self.features, n, mean, centred)

    def subset(self, keep: list[int]) -> "Gram":
        index = [*keep, self.p]
        return Gram([self.features[i] for i in keep], self.n, self.mean[index], self.centred[np.ix_(index, index)])

    def total_ss(self) -> float:
        return float(self.centred[-1, -1])

    def rss(self, beta: np.ndarray, intercept: float) -> float:
        """Sum of squared residuals of ``intercept + x beta``."""
        w = np.append(-np.asarray(beta, float), 1.0)
        offset = float(w @ self.mean - intercept)
        return float(w @ self.centred @ w + self.n * offset * offset)

    def correlation(self) -> np.ndarray:
        """Feature correlations; a constant feature gives NaN."""
        s = self.centred[:-1, :-1]
        spread = np.sqrt(np.clip(np.diag(s), 0, None))
        spread[spread <= 1e-12 * np.maximum(1.0, np.abs(self.mean[:-1])) * np.sqrt(max(self.n, 1))] = np.nan
        return s / np.outer(spread, spread)


def product_sums(m: int) -> list[Column]:
    """Count, sums and sums of products of the columns x0 .. x(m-1)."""
    texts = ["count(1) AS n"] + [f"sum(x{i}) AS s{i}" for i in range(m)]
    texts += [f"sum(x{i} * x{j}) AS q{i}_{j}" for i in range(m) for j in range(i, m)]
    return [F.expr(t) for t in texts]


def cell_sums(rows: DataFrame, m: int, by: str | None = None) -> DataFrame:
    """(group, cell, total) of the columns x0 .. x(m-1): cell i * (m + 1) + j, i <= j, of the products of the columns and a last one of ones.

    A task returns one matrix per group; groups are few.
    """
    width = m + 1
    upper = np.array([i * width + j for i in range(width) for j in range(i, width)], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str | None, np.ndarray] = {}
        step = max(1, BATCH_CELLS // width)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x = np.column_stack([*(c.to_numpy(zero_copy_only=False) for c in part.columns[1:]), np.ones(part.num_rows)])
                keys = part.column(0).dictionary_encode()
                # a missing group is a group of its own
                codes = keys.indices.fill_null(len(keys.dictionary)).to_numpy(zero_copy_only=False)
                names = [*keys.dictionary.to_pylist(), None]
                for code in np.unique(codes).tolist():
                    own = x[codes == code]
                    found[names[code]] = found.get(names[code], 0.0) + own.T @ own
        for key, total in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(upper), pa.string()), pa.array(upper), pa.array(total.ravel()[upper])], names=["key", "cell", "total"])

    group = F.col(by).cast("string") if by else F.lit("")
    columns = rows.select(group.alias("key"), *[F.col(f"x{i}").cast("double") for i in range(m)])
    return columns.mapInArrow(run, "key string, cell long, total double").groupBy("key", "cell").agg(F.sum("total").alias("total"))


def _wide_rows(moved: DataFrame, m: int, by: str | None) -> list[dict]:
    """As the rows of ``product_sums``, from ``cell_sums``."""
    cells: dict[str | None, dict] = {}
    for r in cell_sums(moved, m, by).collect():  # groups times columns squared
        i, j = divmod(r["cell"], m + 1)
        name = "n" if i == m else f"s{i}" if j == m else f"q{i}_{j}"
        cells.setdefault(r["key"], {})[name] = r["total"]
    if not by:
        return [cells.get("", {"n": 0})]
    kind = moved.schema["by"].dataType
    named = moved.sparkSession.createDataFrame([(k,) for k in cells], "key string").select("key", F.col("key").cast(kind).alias("by")).collect() if cells else []
    return [{**cells[r["key"]], "by": r["by"]} for r in named]


def gram(df: DataFrame, features: list[str], target: str, by: str | None = None,
         values: dict[str, Column] | None = None) -> Gram:
    """D9 over rows with a target; missing features count as 0. ``by`` also keeps the sums per group (few groups)."""
    values = values or {}
    m = len(features) + 1

    def wide(rows: DataFrame, *more: Column) -> DataFrame:
        columns = [F.coalesce(values.get(f, known(rows, f)), F.lit(0.0)).alias(f"x{i}") for i, f in enumerate(features)]
        out = rows.select(*columns, known(rows, target).alias(f"x{m - 1}"), *more)
        return out.filter(F.col(f"x{m - 1}").isNotNull())

    first = wide(df).agg(*[F.expr(f"avg(x{i}) AS m{i}") for i in range(m)]).first()
    shift = np.array([v if v is not None and np.isfinite(v) else 0.0 for v in first])
    keep = [F.col(by).alias("by")] if by else []
    moved = wide(df, *keep).select(*[(F.col(f"x{i}") - F.lit(float(shift[i]))).alias(f"x{i}") for i in range(m)], *(["by"] if by else []))
    if m > GENERATED:
        rows = _wide_rows(moved, m, "by" if by else None)
    else:
        rows = (moved.groupBy("by") if by else moved.groupBy()).agg(*product_sums(m)).collect()  # one row per group
    parts = {r["by"] if by else None: _from_sums(features, r, shift) for r in rows}
    whole = None
    for part in parts.values():
        whole = part if whole is None else whole.plus(part)
    if whole is None:
        whole = Gram(list(features), 0, np.zeros(m), np.zeros((m, m)))
    whole.by = parts if by else {}
    return whole


def _from_sums(features, row, shift) -> Gram:
    m = len(features) + 1
    n = row["n"]
    if n == 0:
        return Gram(list(features), 0, np.zeros(m), np.zeros((m, m)))
    s = np.array([row[f"s{i}"] for i in range(m)], dtype=float)
    q = np.zeros((m, m))
    for i in range(m):
        for j in range(i, m):
            q[i, j] = q[j, i] = row[f"q{i}_{j}"]
    return Gram(list(features), n, shift + s / n, q - np.outer(s, s) / n)


def sufficient_statistics(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """D9 as a table: one row per pair of columns with the sum of their product (``1`` stands for the constant)."""
    names = [*features, target]
    values = {c: F.coalesce(known(df, c), F.lit(0.0)) for c in names}
    pairs = [("1", "1")] + [("1", c) for c in names] + [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = {}
    for i, (a, b) in enumerate(pairs):
        left = values.get(a, F.lit(1.0))
        sums[f"q{i}"] = F.sum(left * values.get(b, F.lit(1.0)))
    if len(names) > GENERATED:
        rows = df.filter(known(df, target).isNotNull()).select(*[values[c].alias(f"x{i}") for i, c in enumerate(names)])
        at = {c: i for i, c in enumerate(names)} | {"1": len(names)}
        named = [(min(at[a], at[b]) * (len(names) + 1) + max(at[a], at[b]), a, b) for a, b in pairs]
        lookup = df.sparkSession.createDataFrame(named, "cell long, f1 string, f2 string")
        found = cell_sums(rows, len(names)).select("cell", F.col("total").alias("sum_product"))
        return F.broadcast(lookup).join(found, "cell", "left").select("f1", "f2", "sum_product")  # columns squared
    row = df.filter(known(df, target).isNotNull()).agg(*[c.alias(n) for n, c in sums.items()])
    cells = [F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), F.col(f"q{i}").alias("sum_product")) for i, (a, b) in enumerate(pairs)]
    return row.select(F.explode(F.array(*cells)).alias("s")).select("s.*")


def correlations(df: DataFrame, features: list[str]) -> DataFrame:
    """Pearson correlation of every pair of features; missing for a constant column.

    One pass for means and limits, one of sums of products by numpy inside tasks, whatever the number of features: a generated aggregate
    of a covariance and two deviations per pair is too long to be compiled.
    """
    m = len(features)
    rows = df.select(*[F.coalesce(known(df, f), F.lit(0.0)).alias(f"x{i}") for i, f in enumerate(features)])
    first = rows.agg(F.count(F.lit(1)).alias("n"), *[F.expr(f"{a}(x{i}) AS {a}{i}") for i in range(m) for a in ("avg", "min", "max")]).first()
    shift = np.array([first[f"avg{i}"] if first[f"avg{i}"] is not None and np.isfinite(first[f"avg{i}"]) else 0.0 for i in range(m)])
    sums = _wide_rows(rows.select(*[(F.col(f"x{i}") - F.lit(float(shift[i]))).alias(f"x{i}") for i in range(m)]), m, None)[0]
    constant = np.array([first[f"min{i}"] == first[f"max{i}"] for i in range(m)], bool)
    with np.errstate(all="ignore"):
        s = _from_sums(features[:-1], sums, shift).centred
        spread = np.where(constant, np.nan, np.sqrt(np.clip(np.diag(s), 0, None)))
        r = s / spread[:, None] / spread[None, :]
    pairs = [(a, b, float(r[i, j]) if np.isfinite(r[i, j]) else None) for i, a in enumerate(features) for j, b in enumerate(features) if i < j]
    return df.sparkSession.createDataFrame(pairs, "f1 string, f2 string, corr double")


def high_correlations(df: DataFrame, features: list[str], threshold: float = 0.8) -> DataFrame:
    return correlations(df, features).filter(F.abs("corr") > threshold)

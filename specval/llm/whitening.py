"""Whitening of vectors from exact sums of squares.

Products of two dimensions are never summed. Polarisation gives every covariance from variances: the squared centred values of each dimension and of
the sum of each pair of dimensions are added up in whole numbers, and cov(a, b) = (var(a + b) - var(a) - var(b)) / 2.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specval.llm.text import slices
from specval.llm.vectors import finite, matrices
from specval.session import materialize

SCALE = 1024
OFFSET = 100_000
COMPONENTS = 8
ROWS = 4096
LARGEST = 2.0**62


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    scaled = np.floor(SCALE * vectors)
    if (np.abs(scaled) > LARGEST).any():
        raise ValueError(f"an entry is beyond {LARGEST / SCALE:g}: scaled, it doesn't fit 64 bits")
    return scaled.astype(np.int64) + OFFSET


def pair_places(dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The dimensions of each place in the sums: every dimension alone, then every pair."""
    i, j = np.triu_indices(dims, 1)
    alone = np.arange(dims)
    return np.concatenate((alone, i)), np.concatenate((alone, j))


def squares(centred: np.ndarray) -> list[int]:
    """Exact sums of the squares of every dimension and of the sum of every pair of dimensions."""
    rows, dims = centred.shape
    most = 2 * int(np.abs(centred).max(initial=0))
    if most * most * max(rows, 1) >= 2**63:
        centred = centred.astype(object)  # Python's integers have no bound
    out = (centred * centred).sum(axis=0).tolist()
    for i in range(dims - 1):
        both = centred[:, i + 1:] + centred[:, i:i + 1]
        out += (both * both).sum(axis=0).tolist()
    return out


def totals(numbers: np.ndarray) -> list[int]:
    """Exact sums of the columns."""
    most = int(np.abs(numbers).max(initial=0))
    return (numbers if most * max(len(numbers), 1) < 2**63 else numbers.astype(object)).sum(axis=0).tolist()


class Fit:
    """Sums of the fit list, and the covariances and components that follow."""

    def __init__(self, n: int, sums: list[int], squared: list[int], floors: list[int]):
        dims = len(sums)
        self.n, self.sums, self.floors = n, sums, floors
        rest = [s - n * f for s, f in zip(sums, floors)]  # what the whole part of the mean leaves
        i, j = (p.tolist() for p in pair_places(dims))
        # n * n * variance, of a dimension and of the sum of two: the deviations from the whole part are centred exactly here
        spread = [n * t - (rest[a] if a == b else rest[a] + rest[b]) ** 2 for t, a, b in zip(squared, i, j)]
        self.covariance = np.zeros((dims, dims))
        for v, a, b in zip(spread, i, j):
            exact = v if a == b else (v - spread[a] - spread[b]) // 2  # always even
            self.covariance[a, b] = self.covariance[b, a] = float(Fraction(exact, n * n))
        values, axes = np.linalg.eigh(self.covariance)
        self.values, self.axes = np.maximum(values[::-1], 0.0), axes[:, ::-1]
        self.trace = float(Fraction(sum(spread[:dims]), n * n))
        self.means = np.array([float(Fraction(r, n)) for r in rest])

    def explained(self, components: int) -> list[float]:
        return [float(e / self.trace) if self.trace > 0 else 0.0 for e in self.values[:components]]

    def factors(self, components: int) -> np.ndarray:
        """Axes divided by their standard deviations; zero where a component has no variance but for rounding."""
        values = self.values[:components]
        real = values > 1e-12 * max(self.trace, 1e-300)
        return self.axes[:, :components] * np.where(real, 1 / np.sqrt(np.where(real, values, 1.0)), 0.0)


def _task_sums(vectors: DataFrame, floors: list[int] | None) -> DataFrame:
    """(place, sum) of each task: of the entries if ``floors`` is missing, else of the squares of the entries less their floors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[int] | None = None
        for part in slices(batches, ROWS):
            for _, raw in matrices(part.column(0)):
                x = whole_numbers(raw)
                found = totals(x) if floors is None else squares(x - np.array(floors, np.int64))
                sums = found if sums is None else [a + b for a, b in zip(sums, found)]
        sums = sums or []
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(sums)), pa.int32()), pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))], names=["place", "total"])

    return vectors.mapInArrow(run, "place int, total decimal(38,0)")


def _added(parts: DataFrame) -> list[int]:
    """One row per place; as many as pairs of dimensions, whatever the number of vectors."""
    rows = parts.groupBy("place").agg(F.sum("total").alias("total")).collect()
    return [int(r["total"]) for r in sorted(rows, key=lambda r: r["place"])]


def fit(usable: DataFrame) -> Fit | None:
    """``usable`` has one column of vectors of one length. Three passes: rows, sums, squares."""
    n = usable.count()
    if not n:
        return None
    sums = _added(_task_sums(usable, None))
    floors = [s // n for s in sums]
    return Fit(n, sums, _added(_task_sums(usable, floors)), floors)


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable row and component: ``__id``, ``__component`` (from 1, by falling variance), ``__n``, ``__deviation`` (exact, decimal),
    ``__whitened``, ``__explained`` and ``__identity_error``.

    Vectors that are missing or hold missing or non-finite entries are left out, and so are those whose length isn't the one that most
    usable vectors have (the greater of equally frequent ones): they lie in another space. Finite entries beyond 4.5e15 are an error. Rows may repeat an id, a missing id stays missing.
    A component without variance has whitened values of 0 and shows as 1 in the identity error. Empty tables, and tables without a usable
    vector, give an empty result; other columns are not read.
    """
    spark = rows.sparkSession
    base = rows.filter(finite(vector_col)).select(F.col(id_col).alias("__id"), F.col(vector_col).alias("__v"))
    lengths = base.groupBy(F.size("__v").alias("d")).count().filter("d > 0").orderBy(F.col("count").desc(), F.col("d").desc()).limit(1).collect()
    kind = base.schema["__id"].dataType.simpleString()
    table = f"__id {kind}, __component int, __n long, __deviation decimal(38,0), __whitened double, __explained double, __identity_error double"
    if not lengths:
        return spark.createDataFrame([], table)
    dims = lengths[0]["d"]
    base = base.filter(F.size("__v") == dims)
    made = fit(base.select("__v"))
    components = min(components, dims)
    n, sums, floors, means, factors = made.n, made.sums, np.array(made.floors, np.int64), made.means, made.factors(components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [s - n * f for s, f in zip(sums, floors.tolist())]
        for part in slices(batches, ROWS):
            for _, raw in matrices(part.column(1)):
                centred = whole_numbers(raw) - floors
                # n * x - S is n * centred - rest; in 64 bits where that and the sum of its squares fit
                most = n * int(np.abs(centred).max(initial=0)) + max(map(abs, rest))
                exact = np.int64 if dims * most * most < 2**63 else object
                away = centred.astype(exact) * n - np.array(rest, exact)
                deviation = (away * away).sum(axis=1).tolist()
                white = (centred - means) @ factors
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(white) + 1) * components, pa.int32()), pa.array(white.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([Decimal(d) for d in deviation], pa.decimal128(38, 0)), lists], names=["__id", "__deviation", "__w"])

    white = materialize(base.mapInArrow(run, f"__id {kind}, __deviation decimal(38,0), __w array<double>"), "whitened")
    at = [F.col("__w")[k] for k in range(components)]
    centre = white.agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(at)]).first()
    pairs = [(a, b) for a in range(components) for b in range(a, components)]
    second = white.agg(*[F.avg((at[a] - centre[a]) * (at[b] - centre[b])).alias(f"c{a}_{b}") for a, b in pairs]).first()
    error = max(abs(second[k] - (a == b)) for k, (a, b) in enumerate(pairs))
    shares = F.array(*[F.lit(e) for e in made.explained(components)])
    return white.select("__id", "__deviation", F.posexplode("__w").alias("__k", "__whitened")).select(
        "__id", (F.col("__k") + 1).alias("__component"), F.lit(n).cast("long").alias("__n"), "__deviation", "__whitened",
        F.get(shares, F.col("__k")).alias("__explained"), F.lit(float(error)).alias("__identity_error"))

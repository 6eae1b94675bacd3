"""Pareto-efficient rows: no other row has all features at least as good at no higher price, with one better.

1. Only the cheapest row of a feature vector can be efficient: one map-side combined aggregate.
2. Every partition drops what its own rows dominate. A bounded set of strong points (cheap for much) then goes to all
   tasks, which drop what these dominate; this repeats on fewer partitions while it still shrinks the set.
3. The survivors are cut into boxes by a k-d tree over features and price. A row can only be dominated from a box that reaches
   at least as high in every feature and at least as low in price, so only such pairs of boxes are compared.
Nothing is dropped or capped. If nearly all vectors are efficient, step 3 stays quadratic in the boxes that dominance allows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specval.functions.numeric import drop_missing
from specval.operators.joins import join_measured
from specval.session import materialize

BLOCK_ROWS = 8_000
STRONG_ROWS = 2_000  # rows that go to the driver and to every task
SAMPLE_ROWS, SAMPLE_PER_BLOCK = 200_000, 64  # rows the k-d tree is built from: a hash of the row decides
MIN_ROWS = 10
PRICE = "__price"


def _dominated(targets: np.ndarray, others: np.ndarray, chunk: int = 256) -> np.ndarray:
    """Per target row: does some other row have price (last column) <= and all features >=, and differ?

    Columns with many values go first, because they rule out most pairs; once few pairs are left only those are
    looked at. Rows are distinct, so a row that is at least as good everywhere and differs is better somewhere.
    """
    hit = np.zeros(len(targets), dtype=bool)
    if not len(targets) or not len(others):
        return hit
    last = targets.shape[1] - 1
    order = [last, *sorted(range(last), key=lambda j: -len(np.unique(others[:512, j])))]
    for start in range(0, len(targets), chunk):
        block = targets[start:start + chunk]
        good = np.ones((len(block), len(others)), dtype=bool)
        rest = list(order)
        while rest and (len(rest) == len(order) or good.mean() > 0.05):
            j = rest.pop(0)
            mine, theirs = block[:, j][:, None], others[:, j][None, :]
            good &= (theirs <= mine) if j == last else (theirs >= mine)
        i, k = np.nonzero(good)
        for j in rest:
            stay = others[k, j] >= block[i, j]
            i, k = i[stay], k[stay]
        better = (others[k] != block[i]).any(axis=1)
        hit[start + i[better]] = True
    return hit


def _own_skyline(points: np.ndarray) -> np.ndarray:
    """Indices of the efficient rows, comparing in price order against those found so far."""
    order = np.lexsort((*[-points[:, j] for j in range(points.shape[1] - 1)], points[:, -1]))
    found: list[int] = []
    step = 512
    for start in range(0, len(order), step):
        batch = order[start:start + step]
        if found:
            batch = batch[~_dominated(points[batch], points[found])]
        # equal prices inside a batch can dominate in either direction, so compare the batch with itself
        batch = batch[~_dominated(points[batch], points[batch])]
        found.extend(batch.tolist())
    return np.array(found, dtype=int)


def _local(columns: list[str], window_rows: int):
    """Drops rows that another row of the partition dominates, in one pass with bounded memory and linear work.

    A window of the cheapest efficient rows so far is held back; what does not fit is passed on, to be compared in a
    later step. A partition of at most ``window_rows`` rows is finished completely.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for pdf in batches:
            fresh = pdf.iloc[_own_skyline(pdf[columns].to_numpy(float))]
            if held is not None and len(held):
                new, old = fresh[columns].to_numpy(float), held[columns].to_numpy(float)
                stay = ~_dominated(new, old)
                held, fresh = held[~_dominated(old, new[stay])], fresh[stay]
                fresh = pd.concat([held, fresh])
            held = fresh.sort_values(columns[-1], kind="stable").reset_index(drop=True)
            if len(held) > window_rows:
                yield held.iloc[window_rows:]
                held = held.iloc[:window_rows]
        if held is not None and len(held):
            yield held

    return run


def efficient_vectors(df: DataFrame, features: list[str], price: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The efficient (features, price) combinations of rows without missing values."""
    columns = [*features, PRICE]
    vectors = df.groupBy(*features).agg(F.min(price).cast("double").alias(PRICE))
    wide = vectors.select(*features, *[F.col(f).cast("double").alias(f"__d{i}") for i, f in enumerate(features)], PRICE)
    numeric = [*[f"__d{i}" for i in range(len(features))], PRICE]
    survivors = materialize(wide.mapInPandas(_local(numeric, block_rows), wide.schema), "skyline")
    left = survivors.count()
    if left > block_rows:
        survivors = materialize(_without_clearly_dominated(survivors, numeric), "skyline-strong")
        left = survivors.count()
    while left > block_rows:
        parts = -(-left // block_rows)
        merged = materialize(survivors.repartition(parts, F.xxhash64(*columns)).mapInPandas(_local(numeric, block_rows), wide.schema), "skyline")
        now = merged.count()
        survivors, shrunk, left = merged, now < 0.7 * left, now
        if not shrunk:
            break
    return _across_blocks(survivors, numeric, left, block_rows).select(*columns)


def _without_clearly_dominated(points: DataFrame, numeric: list[str]) -> DataFrame:
    """Drops what the rows with the best price for their features dominate. Exact: a dominated row is never efficient."""
    ends = points.agg(*[F.min(c).alias(f"lo{i}") for i, c in enumerate(numeric)], *[F.max(c).alias(f"hi{i}") for i, c in enumerate(numeric)]).first()
    span = [ends[f"hi{i}"] - ends[f"lo{i}"] for i in range(len(numeric))]
    span = [float(v) if v and np.isfinite(v) else 1.0 for v in span]
    score = F.col(numeric[-1]) / span[-1]
    for c, v in zip(numeric[:-1], span):
        score = score - F.col(c) / v
    rows = points.orderBy(score).limit(STRONG_ROWS).select(*numeric).collect()
    strong = np.array([tuple(r) for r in rows], dtype=float).reshape(-1, len(numeric))
    shared = points.sparkSession.sparkContext.broadcast(strong[_own_skyline(strong)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[~_dominated(pdf[numeric].to_numpy(float), shared.value)]

    return points.mapInPandas(run, points.schema)


class Boxes:
    """A k-d tree that cuts the largest box at the median of its part of a sample; ``place`` gives the box of each row.

    Every cut costs time in proportion to its box, so a tree costs the sample times the logarithm of the boxes.
    """

    def __init__(self, sample: np.ndarray, boxes: int):
        self.dim, self.cut, self.child = [-1], [0.0], [(0, 0)]
        spread = np.ptp(sample, axis=0) if len(sample) else np.ones(sample.shape[1])
        spread = np.where(np.isfinite(spread) & (spread > 0), spread, 1.0)
        heap, count = [(-len(sample), 0, sample)], 1  # largest box first; its number breaks ties, so rows are never compared
        while heap and count < boxes:
            _, node, rows = heapq.heappop(heap)
            width = np.ptp(rows, axis=0) / spread if len(rows) else np.zeros(sample.shape[1])
            width = np.where(np.isfinite(width), width, 0)
            dim = int(np.argmax(width))
            if width[dim] <= 0:
                continue  # one point only: can't be cut
            values = rows[:, dim]
            middle = (len(values) - 1) // 2
            cut = float(np.partition(values, middle)[middle])
            if cut == values.max():
                cut = float(values[values < cut].max())
            low = values <= cut
            self.dim[node], self.cut[node], self.child[node] = dim, cut, (len(self.dim), len(self.dim) + 1)
            self.dim += [-1, -1]
            self.cut += [0.0, 0.0]
            self.child += [(0, 0), (0, 0)]
            for child, part in zip(self.child[node], (rows[low], rows[~low])):
                heapq.heappush(heap, (-len(part), child, part))
            count += 1
        self.arrays = np.array(self.dim), np.array(self.cut), np.array(self.child)

    def place(self, points: np.ndarray) -> np.ndarray:
        dim, cut, child = self.arrays
        node = np.zeros(len(points), dtype=int)
        while True:
            open_ = np.flatnonzero(dim[node] >= 0)
            if not len(open_):
                return node
            at = node[open_]
            node[open_] = child[at, (points[open_, dim[at]] > cut[at]).astype(int)]


def boxed(points: DataFrame, numeric: list[str], rows: int, block_rows: int) -> DataFrame:
    """Adds ``__block`` and ``__pos``, a number of the row."""
    boxes = -(-rows // block_rows)
    share = min(1.0, min(SAMPLE_ROWS, SAMPLE_PER_BLOCK * boxes) / rows)
    chosen = points.filter(F.pmod(F.xxhash64(*numeric), F.lit(1 << 20)) < int(share * (1 << 20))).select(*numeric).collect()
    tree = points.sparkSession.sparkContext.broadcast(Boxes(np.array([tuple(r) for r in chosen], dtype=float).reshape(-1, len(numeric)), boxes))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(__block=tree.value.place(pdf[numeric].to_numpy(float)))

    schema = f"{', '.join(f'`{c}` {t}' for c, t in points.dtypes)}, __block bigint"
    return materialize(points.mapInPandas(run, schema).withColumn("__pos", F.monotonically_increasing_id()), "skyline-blocks")


def block_pairs(placed: DataFrame, numeric: list[str]) -> DataFrame:
    """(``target``, ``other``): pairs of boxes in which ``other`` can hold a row that dominates one of ``target``."""
    ends = [e for c in numeric for e in (F.max(c).alias(f"hi_{c}"), F.min(c).alias(f"lo_{c}"))]
    corners = materialize(placed.groupBy("__block").agg(*ends), "skyline-corners")
    highs, lows = [f"hi_{c}" for c in numeric], [f"lo_{c}" for c in numeric]
    rows = corners.select("__block", *highs, *lows).collect()  # one row per block_rows survivors
    table = np.array([tuple(r) for r in rows], dtype=float).reshape(len(rows), 1 + 2 * len(numeric))
    shared = placed.sparkSession.sparkContext.broadcast(table)
    p = len(numeric)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, high, low = shared.value[:, 0].astype(int), shared.value[:, 1:1 + p], shared.value[:, 1 + p:]
        for pdf in batches:
            for block, *edges in pdf[["__block", *lows[:-1], highs[-1]]].itertuples(index=False):
                can = (high[:, :-1] >= np.array(edges[:-1], float)).all(1) & (low[:, -1] <= edges[-1])
                yield pd.DataFrame({"target": block, "other": names[can]})

    return corners.repartition(max(1, len(rows) // 64)).mapInPandas(run, "target bigint, other bigint")


def _across_blocks(points: DataFrame, numeric: list[str], rows: int, block_rows: int) -> DataFrame:
    if rows <= block_rows:
        # bounded by block_rows; one task finishes the job
        return points.coalesce(1).mapInPandas(_local(numeric, block_rows), points.schema)
    placed = boxed(points, numeric, rows, block_rows)
    pairs = materialize(block_pairs(placed, numeric), "skyline-pairs")
    targets = placed.withColumnRenamed("__block", "target").join(pairs, "target")
    renamed = {c: f"o_{c}" for c in numeric}
    others = placed.select("__block", *numeric).withColumnsRenamed({**renamed, "__block": "other"}).join(pairs, "other")

    def compare(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if mine.empty or theirs.empty:
            return pd.DataFrame({"__pos": pd.Series(dtype="int64")})
        hit = _dominated(mine[numeric].to_numpy(float), theirs[[f"o_{c}" for c in numeric]].to_numpy(float))
        return pd.DataFrame({"__pos": mine.loc[hit, "__pos"].to_numpy()})

    lost = (
        targets.select("target", "other", "__pos", *numeric).groupBy("target", "other")
        .cogroup(others.select("target", "other", *renamed.values()).groupBy("target", "other"))
        .applyInPandas(compare, "__pos bigint").distinct()
    )
    return placed.join(lost, "__pos", "left_anti").drop("__pos", "__block")


def efficient_rows(df: DataFrame, features: list[str], price: str, block_rows: int = BLOCK_ROWS, min_rows: int = MIN_ROWS) -> DataFrame:
    """The rows themselves, exact copies included. Fewer than ``min_rows`` complete rows are all kept."""
    names = [f for f in features if f in df.columns]
    if not names:
        raise ValueError(f"None of the features {features} found in data")
    clean = drop_missing(df, [price, *names])
    if clean.limit(min_rows).count() < min_rows:
        return clean
    vectors = materialize(efficient_vectors(clean, names, price, block_rows), "efficient")
    marked = clean.withColumn(PRICE, F.col(price).cast("double"))
    return join_measured(marked, vectors, [*names, PRICE], "left_semi").drop(PRICE)


def efficiency(df: DataFrame, features: list[str], price: str, rows: DataFrame | None = None) -> DataFrame:
    """Counts of complete and efficient rows and their ratio (1.0 when all are kept)."""
    names = [f for f in features if f in df.columns]
    clean = drop_missing(df, [price, *names]).agg(F.count(F.lit(1)).alias("complete_rows"))
    kept = (efficient_rows(df, names, price) if rows is None else rows).agg(F.count(F.lit(1)).alias("efficient_rows"))
    both = kept.withColumn("complete_rows", clean.scalar())
    return both.select("complete_rows", "efficient_rows", F.try_divide("efficient_rows", "complete_rows").alias("efficiency_ratio"))

"""Similarity join of vectors by spherical-cap filters.

A filter is a direction; a vector passes it when its inner product with the direction reaches a height. Directions are the words of random
product codes: a random rotation, then one of ``width`` unit vectors in each half of the coordinates. All words that a vector passes are listed
without trying them one by one: a word of the first half is followed up only if the best word of the second could still reach the height.
Vectors that pass a common filter are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specval.llm.graph import components
from specval.llm.text import mix, slices
from specval.llm.vectors import finite, matrices
from specval.session import materialize

THRESHOLD = 0.93
RECALL = 0.9995  # of pairs exactly at the threshold; closer pairs meet more often
ROTATIONS = 16
TRIALS = 4_000  # pairs at the threshold on which the height is set
TILE_ROWS = 256
BROADCAST_BUCKETS = 1_000_000  # of 8 bytes and a count


class Code:
    """``rotations`` random product codes for vectors of ``dims`` components, with ``width`` words per half."""

    def __init__(self, dims: int, width: int, rotations: int):
        self.dims, self.width, self.half = dims, width, max(4, -(-dims // 2))
        rng = np.random.default_rng([20240711, dims, width])
        self.words = []
        for _ in range(rotations):
            turn, _ = np.linalg.qr(rng.standard_normal((2 * self.half, 2 * self.half)))
            words = rng.standard_normal((2, width, self.half))
            self.words.append((turn, words / np.linalg.norm(words, axis=2, keepdims=True) / np.sqrt(2)))

    def passed(self, units: np.ndarray, height: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, filter, inner product) of all filters that the unit vectors pass."""
        wide = np.zeros((len(units), 2 * self.half))
        wide[:, :self.dims] = units
        rows, filters, products = [], [], []
        for k, (turn, (first, second)) in enumerate(self.words):
            turned = wide @ turn
            a, b = turned[:, :self.half] @ first.T, turned[:, self.half:] @ second.T
            row, i = np.nonzero(a >= height - b.max(axis=1, keepdims=True))
            for at in range(0, len(row), 20_000):
                r, w = row[at:at + 20_000], i[at:at + 20_000]
                total = a[r, w][:, None] + b[r]
                hit, j = np.nonzero(total >= height)
                rows.append(r[hit])
                filters.append((k * self.width + w[hit]) * self.width + j)
                products.append(total[hit, j])
        return np.concatenate(rows), np.concatenate(filters).astype(np.uint64), np.concatenate(products)


@lru_cache(maxsize=64)
def code(dims: int, width: int, rotations: int) -> Code:
    return Code(dims, width, rotations)


@lru_cache(maxsize=64)
def height(dims: int, width: int, rotations: int, threshold: float, recall: float) -> float:
    """The greatest height at which ``recall`` of random pairs at the threshold pass a common filter."""
    made, rng = code(dims, width, rotations), np.random.default_rng(11)
    wide = max(dims, 2)  # in one dimension no two vectors are at the threshold; those in two are as hard at least
    made = made if wide == dims else code(wide, width, rotations)
    x, z = rng.standard_normal((2, TRIALS, wide))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = threshold * x + np.sqrt(1 - threshold**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    best = np.full(TRIALS, -1.0)  # height of the highest filter that both pass
    for (turn, (first, second)) in made.words:
        sums = []
        for units in (x, y):
            padded = np.zeros((TRIALS, 2 * made.half))
            padded[:, :wide] = units
            turned = padded @ turn
            sums.append((turned[:, :made.half] @ first.T, turned[:, made.half:] @ second.T))
        (ax, bx), (ay, by) = sums
        # the best common word uses high words of either half: the leading ones by the lesser product are enough for a lower bound
        low_a, low_b = np.minimum(ax, ay), np.minimum(bx, by)
        lead = min(8, width)
        i, j = np.argsort(-low_a, axis=1)[:, :lead], np.argsort(-low_b, axis=1)[:, :lead]
        at = np.arange(TRIALS)[:, None, None]
        both = np.minimum(ax[at, i[:, :, None]] + bx[at, j[:, None, :]], ay[at, i[:, :, None]] + by[at, j[:, None, :]])
        best = np.maximum(best, both.max(axis=(1, 2)))
    return float(np.sort(best)[int((1 - recall) * TRIALS)])


def code_width(rows: int) -> int:
    """Words per half. Filters grow with the rows, so that unrelated vectors rarely share one; at 4096 decoding a vector and comparing it cost alike."""
    return int(2 ** np.clip(np.round(np.log2(max(rows, 2)) / 2), 4, 12))


def _units(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # no overflow, no underflow to zero
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _decoded(classes: DataFrame, width: int, rotations: int, threshold: float, recall: float, known: dict[int, float]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 512):
            ids, labels = part.column(0).to_numpy(), part.column(1).to_numpy()
            for rows, vectors in matrices(part.column(2)):
                dims = vectors.shape[1]
                least = known.get(dims) or height(dims, width, rotations, threshold, recall)
                who, filters, _ = code(dims, width, rotations).passed(_units(vectors), least)
                group = mix(labels[rows].astype(np.uint64) + np.uint64(dims))
                buckets = mix(group[who] ^ mix(filters + np.uint64(1))).astype(np.int64)
                order = np.lexsort((buckets, who))
                ends = np.searchsorted(who[order], np.arange(len(rows) + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(buckets[order], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), lists], names=["__c", "__buckets"])

    return classes.select("__c", "__l", "__v").mapInArrow(run, "__c long, __buckets array<long>")


def _tile_links(bucket: int, first: int, second: int, ids, sizes, own, labels, lists, vectors, threshold: float):
    """Linked classes of one tile with the rows they link to, and the smallest class each is joined with.

    A pair counts in the smallest bucket that both are in; within a bucket each pair of tiles meets once.
    """
    units, x = _units(vectors), vectors / np.abs(vectors).max(axis=1, keepdims=True)
    norms = np.sqrt((x * x).sum(axis=1))
    near = units @ units.T >= threshold - 1e-9
    i, j = np.nonzero(np.triu(near, 1) & (labels[:, None] == labels[None, :]))
    if first != second:
        apart = own[i] != own[j]
        i, j = i[apart], j[apart]
    exact = (x[i] * x[j]).sum(axis=1) / (norms[i] * norms[j]) >= threshold
    i, j = i[exact], j[exact]
    if not len(i):
        return None
    low = np.arange(len(ids))
    while True:  # least member each can reach
        least = low.copy()
        np.minimum.at(least, i, low[j])
        np.minimum.at(least, j, low[i])
        least = least[least]
        if (least == low).all():
            break
        low = least
    member = np.repeat(np.arange(len(ids)), [len(f) for f in lists])
    flat = np.concatenate(lists)
    earlier = flat < bucket
    places, column, uses = np.unique(flat[earlier], return_inverse=True, return_counts=True)
    shared = np.zeros((len(ids), len(places)), np.float32)
    shared[member[earlier], column] = 1
    shared = shared[:, uses > 1]
    owned = np.zeros(len(i), bool)
    for at in range(0, len(i), 4096):
        a, b = i[at:at + 4096], j[at:at + 4096]
        owned[at:at + 4096] = ~(shared[a] * shared[b]).any(axis=1)
    counts = np.bincount(i[owned], sizes[j[owned]], len(ids)) + np.bincount(j[owned], sizes[i[owned]], len(ids))
    hit = np.unique(np.concatenate((i, j)))
    return ids[hit], counts[hit].astype(np.int64), ids[low[hit]]


def _verified(tiles: DataFrame, threshold: float) -> DataFrame:
    """Runs over rows sorted by tile; holds one tile at a time."""
    kind = pa.schema([("__c", pa.int64()), ("__links", pa.int64()), ("__to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.RecordBatch] = []
        now = None

        def close() -> pa.RecordBatch | None:
            if not pending:
                return None
            tile = pa.Table.from_batches(pending).combine_chunks().to_batches()[0]
            pending.clear()
            if tile.num_rows < 2:
                return None
            ids, sizes, own, labels = (tile.column(k).to_numpy() for k in (3, 4, 5, 6))
            lists = tile.column(7)
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy()
            parts = list(matrices(tile.column(8)))
            if len(parts) != 1:
                raise ValueError("vectors of different lengths share a bucket: two of its 64-bit hashes are equal")
            found = _tile_links(*now, ids, sizes, own, labels, [flat[a:b] for a, b in zip(ends, ends[1:])], parts[0][1], threshold)
            return pa.RecordBatch.from_arrays([pa.array(f) for f in found], schema=kind) if found else None

        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if a == b:
                    continue
                key = tuple(keys[:, a].tolist())
                if key != now:
                    made = close()
                    if made is not None:
                        yield made
                    now = key
                pending.append(batch.slice(a, b - a))
        made = close()
        if made is not None:
            yield made

    return tiles.mapInArrow(run, "__c long, __links long, __to long")


def similar_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD,
                    recall: float = RECALL, rotations: int = ROTATIONS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """One row per row of ``rows``: ``__id``, ``__n_links`` (other rows at the threshold or above, under the same label) and ``__component``
    (smallest id that links reach).

    Missing labels, and vectors that are missing, empty, zero or hold missing or non-finite components, link with nothing; vectors of
    different lengths don't either. Equal vectors are one class and cost one comparison. Rows may repeat an id; a missing id is never the
    smallest unless the component has no other. An empty table gives an empty result; other columns are not read.

    Classes that share a filter form a bucket, cut into tiles of about ``tile_rows``; pairs of tiles are compared and a tile returns a row per linked
    class, never pairs. So a group of n near copies moves n * n / tile_rows rows, once per filter they share.
    """
    v = F.col(vector_col)
    usable = F.coalesce(F.col(label_col).isNotNull() & finite(vector_col) & F.exists(vector_col, lambda x: x != 0), F.lit(False))
    label = F.when(usable, F.xxhash64(F.col(label_col).cast("string")))
    base = rows.select(F.col(id_col).cast("long").alias("__id"), label.alias("__l"), F.when(usable, v).alias("__v"))
    keys = {"__h1": F.when(F.col("__l").isNotNull(), F.xxhash64("__l", "__v")), "__h2": F.when(F.col("__l").isNotNull(), F.xxhash64(F.lit(1), "__l", "__v"))}
    base = base.withColumns(keys)
    classes = base.filter("__l IS NOT NULL").groupBy("__h1", "__h2").agg(
        F.first("__l").alias("__l"), F.first("__v").alias("__v"), F.count(F.lit(1)).alias("__size"), F.min("__id").alias("__first"))
    classes = materialize(classes.withColumn("__c", F.monotonically_increasing_id()), "caps-classes")
    width = code_width(classes.count())
    common = classes.groupBy(F.size("__v").alias("d")).count().orderBy(F.col("count").desc(), "d").limit(4).collect()
    known = {r["d"]: height(r["d"], width, rotations, threshold, recall) for r in common}
    listed = materialize(_decoded(classes, width, rotations, threshold, recall, known), "caps-filters")
    entries = listed.select("__c", F.explode("__buckets").alias("__bucket"))
    buckets = entries.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    buckets = buckets.select("__bucket", F.ceil(F.col("__n") / tile_rows).cast("int").alias("__tiles"))
    buckets = materialize(buckets, "caps-buckets")
    lookup = F.broadcast(buckets) if buckets.count() <= BROADCAST_BUCKETS else buckets
    members = materialize(entries.join(lookup, "__bucket"), "caps-members")
    lists = members.groupBy("__c").agg(F.collect_list("__bucket").alias("__buckets"))  # at most the filters of one vector
    full = lists.join(classes.select("__c", "__size", "__l", "__v"), "__c")
    own = F.pmod(F.xxhash64("__c", F.lit(7)), F.col("__tiles")).cast("int")
    pairs = members.withColumn("__own", own).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__tiles") - 1)))
    pairs = pairs.select("__c", "__bucket", "__own", F.least("__own", "__other").alias("__a"), F.greatest("__own", "__other").alias("__b"))
    tiles = pairs.join(full, "__c").select("__bucket", "__a", "__b", "__c", "__size", "__own", "__l", "__buckets", "__v")
    tiles = tiles.repartition("__bucket", "__a", "__b").sortWithinPartitions("__bucket", "__a", "__b")
    found = materialize(_verified(tiles, threshold), "caps-links")
    roots = components(found.select(F.col("__c").alias("u"), F.col("__to").alias("v")))
    links = found.groupBy("__c").agg(F.sum("__links").alias("__links"))
    placed = roots.select(F.col("node").alias("__c"), "root").join(classes.select("__c", "__first"), "__c")
    least = placed.groupBy("root").agg(F.min("__first").alias("__component"))
    placed = placed.select("__c", "root").join(least, "root").join(links, "__c").select("__c", "__component", "__links")
    result = classes.select("__c", "__h1", "__h2", "__first", "__size").join(placed, "__c", "left").select(
        "__h1", "__h2", F.coalesce("__component", "__first").alias("__component"),
        (F.coalesce("__links", F.lit(0)) + F.col("__size") - 1).alias("__n_links"))
    result = materialize(result, "caps-result")
    lookup = F.broadcast(result) if result.count() <= BROADCAST_BUCKETS else result
    done = base.select("__id", "__h1", "__h2").join(lookup, ["__h1", "__h2"], "left")
    alone = F.col("__h1").isNull()  # such a row is its own component
    return done.select("__id", F.coalesce("__n_links", F.lit(0)).cast("long").alias("__n_links"),
                       F.when(alone, F.col("__id")).otherwise(F.col("__component")).alias("__component"))

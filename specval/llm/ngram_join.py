"""Similarity join on word shingles: a MinHash LSH forest for candidates, exact Jaccard similarity for every link."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specval.llm.common import boxed, join_checked, unboxed
from specval.llm.graph import components
from specval.llm.text import hash_words, mix, slices, window_hashes
from specval.session import materialize

SHINGLE = 5
THRESHOLD = 0.8
TREES, DEPTH = 16, 8  # the forest and the longest prefix that is tried
RECALL = 0.999  # wanted for a pair just at the threshold
TILE_ROWS, TILE_SHINGLES = 512, 1_000_000
SLACK = 0.3  # signatures may understate a similarity by this much, six times the standard error of 64 values


def prefix_length(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """Shortens the prefix from ``depth`` values until a pair at the threshold shares one in some tree with probability ``recall``."""
    length = depth
    while length > 1 and 1 - (1 - threshold**length) ** trees < recall:
        length -= 1
    return length


def shingle_sets(texts: list[str | None], width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words of each text. A shorter text has one: all its words."""
    counts, words = hash_words(texts)
    ends = np.cumsum(counts)
    out = []
    for n, e in zip(counts.tolist(), ends.tolist()):
        own = words[e - n:e]
        out.append(np.unique(window_hashes(own, width)) if n >= width else window_hashes(own, n, seed=n) if n else own)
    return out


def signatures(sets: list[np.ndarray], values: int) -> np.ndarray:
    """``values`` MinHash values (32 bits) per non-empty set."""
    factors = mix(np.arange(1, values + 1, dtype=np.uint64)) | np.uint64(1)
    out = np.zeros((len(sets), values), np.uint32)
    full = [k for k, s in enumerate(sets) if len(s)]
    if full:
        all_ = np.concatenate([sets[k] for k in full])
        at = np.cumsum([0] + [len(sets[k]) for k in full[:-1]])
        for v in range(values):
            out[full, v] = np.minimum.reduceat(((all_ * factors[v]) >> np.uint64(32)).astype(np.uint32), at)
    return out


def _signed(values) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def text_key(column: str):
    return F.md5(F.encode(F.coalesce(F.col(column).cast("string"), F.lit("")), "utf-8"))


def _sketches(docs: DataFrame, id_col: str, text_col: str, width: int, trees: int, length: int) -> DataFrame:
    """Per row: id, text key, number of shingles, a 128-bit hash of the set, the signature and the prefix of each tree as a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = shingle_sets(part.column(2).to_pylist(), width)
            sig = signatures(sets, trees * length)
            prefix = np.zeros((len(sets), trees), np.uint64)
            for t in range(trees):
                h = np.full(len(sets), t + 1, np.uint64)
                for k in range(t * length, (t + 1) * length):
                    h = mix(h * np.uint64(31) + sig[:, k])
                prefix[:, t] = h
            full = [len(s) > 0 for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()),
                 _signed([mix(s).sum(dtype=np.uint64) for s in sets]), _signed([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets]),
                 pa.array([r.tobytes() for r in sig], pa.binary()),
                 pa.array([r.tolist() if f else [] for r, f in zip(prefix.view(np.int64), full)], pa.list_(pa.int64()))],
                names=["__id", "__key", "__n", "__h1", "__h2", "__sig", "__prefixes"])

    schema = T.StructType([T.StructField("__id", docs.schema[id_col].dataType), T.StructField("__key", T.StringType()),
                           *[T.StructField(c, T.LongType()) for c in ("__n", "__h1", "__h2")],
                           T.StructField("__sig", T.BinaryType()), T.StructField("__prefixes", T.ArrayType(T.LongType()))])
    return docs.select(F.col(id_col).alias("__id"), text_key(text_col).alias("__key"), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def _with_shingles(texts: DataFrame, width: int) -> DataFrame:
    """(``__key``, ``__text``) to (``__key``, ``__shingles``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = shingle_sets(part.column(1).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["__key", "__shingles"])

    return texts.select("__key", "__text").mapInArrow(run, "__key string, __shingles binary")


class Tile:
    """The members of one tile (or of two that are compared); finds all links that are this tile's to find."""

    def __init__(self, block: int, first: int, second: int):
        self.block, self.same = block, first == second
        self.ids, self.sizes, self.tiles, self.sigs, self.blocks, self.sets = [], [], [], [], [], []
        self.first = first

    def links(self, threshold: float) -> tuple[list[int], list[int], list[int]]:
        """(class, number of linked rows, a class of the same component) for every member with a link."""
        k = len(self.ids)
        sig = np.stack([np.frombuffer(s, np.uint32) for s in self.sigs])
        sets = [np.frombuffer(s, np.uint64) for s in self.sets]
        n, sizes, left = np.array([len(s) for s in sets]), np.array(self.sizes), np.array(self.tiles) == self.first
        blocks = [set(b) for b in self.blocks]
        names, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        at = np.cumsum(n) - n
        mark = np.zeros(len(names), bool)
        linked, parent = np.zeros(k, np.int64), list(range(k))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i in range(k):
            if not left[i]:
                continue
            ok = np.minimum(n, n[i]) >= threshold * np.maximum(n, n[i])
            if self.same:
                ok[:i + 1] = False
            else:
                ok &= ~left
            ok[ok] = (sig[ok] == sig[i]).mean(1) >= threshold - SLACK
            others = [j for j in np.flatnonzero(ok).tolist() if min(blocks[i] & blocks[j]) == self.block]
            if not others:
                continue
            mark[inverse[at[i]:at[i] + n[i]]] = True
            if 4 * len(others) > k:
                common = np.add.reduceat(mark[inverse].astype(np.int64), at)[others]
            else:
                common = np.array([np.count_nonzero(mark[inverse[at[j]:at[j] + n[j]]]) for j in others])
            mark[inverse[at[i]:at[i] + n[i]]] = False
            for j, c in zip(others, common.tolist()):
                if c >= threshold * (n[i] + n[j] - c) - 1e-9:
                    linked[i] += sizes[j]
                    linked[j] += sizes[i]
                    parent[root(j)] = root(i)
        hit = np.flatnonzero(linked).tolist()
        return [self.ids[i] for i in hit], linked[hit].tolist(), [self.ids[root(i)] for i in hit]


def _verified(tiles: DataFrame, threshold: float) -> DataFrame:
    """Runs over rows sorted by tile; holds one tile at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, out = None, ([], [], [])

        def close() -> None:
            if tile is not None and len(tile.ids) > 1:
                for o, v in zip(out, tile.links(threshold)):
                    o.extend(v)

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=["__c", "__links", "__to"])
            for o in out:
                o.clear()
            return made

        now = None
        for part in slices(batches, 1024):
            columns = [c.to_pylist() for c in part.columns]
            for block, first, second, c, size, own, sig, blocks, shingles in zip(*columns):
                if (block, first, second) != now:
                    close()
                    now, tile = (block, first, second), Tile(block, first, second)
                for to, value in zip((tile.ids, tile.sizes, tile.tiles, tile.sigs, tile.blocks, tile.sets), (c, size, own, sig, blocks, shingles)):
                    to.append(value)
            if len(out[0]) > 10_000:
                yield batch()
        close()
        yield batch()

    return tiles.mapInArrow(run, "__c long, __links long, __to long")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, width: int = SHINGLE,
                   trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, tile_rows: int = TILE_ROWS) -> DataFrame:
    """One row per row of ``docs``: ``__id``, ``__key`` (MD5 of the text), ``__class`` and ``__group`` (structs ``gap``, ``id``, ``key`` of
    the first row of the class and of the group) and ``__n_links``.

    A class holds the rows with equal sets of shingles; classes are linked when their Jaccard similarity reaches the threshold; a
    group is a connected component. ``__n_links`` counts the other rows of the class and all rows of linked classes. Texts without words
    form one class. Missing ids come last. An empty table gives an empty result.

    Per tree the classes that share a prefix of their signature form a block. Equal blocks of several trees count once. A block is
    cut into tiles of at most ``tile_rows`` classes (fewer when they are long) and pairs of tiles are compared, each pair of classes
    in the smallest block that both are in; a tile returns one row per linked class, never pairs. So a group of copies costs
    nothing, and a block of n similar, different texts costs n * n / tile_rows rows moved.
    """
    length = prefix_length(threshold, recall, trees, depth)
    rows = materialize(_sketches(docs, id_col, text_col, width, trees, length), "join-sketches")
    first = F.min(F.struct(F.col("__id").isNull().alias("gap"), F.col("__id").alias("id"), F.col("__key").alias("key")))
    classes = rows.groupBy("__h1", "__h2").agg(
        first.alias("__class"), F.count(F.lit(1)).alias("__size"), F.first("__n").alias("__n"),
        F.first("__sig").alias("__sig"), F.first("__prefixes").alias("__prefixes"))
    classes = materialize(classes.withColumn("__c", F.monotonically_increasing_id()), "join-classes")
    entries = classes.select("__c", "__n", F.explode("__prefixes").alias("__block"))
    blocks = entries.groupBy("__block").agg(F.count(F.lit(1)).alias("__rows"), F.sum("__n").alias("__shingles"),
                                            F.bit_xor(F.xxhash64("__c")).alias("__who"), F.bit_xor(F.xxhash64("__c", F.lit(1))).alias("__who2")).filter("__rows > 1")
    blocks = blocks.groupBy("__rows", "__shingles", "__who", "__who2").agg(F.min("__block").alias("__block"))
    count = F.ceil(F.greatest(F.col("__rows") / tile_rows, F.col("__shingles") / TILE_SHINGLES)).cast("int")
    blocks = materialize(blocks.select("__block", count.alias("__tiles")), "join-blocks")
    members = materialize(join_checked(entries.select("__c", "__block"), blocks, ["__block"], "inner"), "join-members")
    lists = members.groupBy("__c").agg(F.collect_list("__block").alias("__blocks"))  # at most one block per tree
    wanted = lists.join(classes.select("__c", "__size", "__sig", F.col("__class.key").alias("__key")), "__c")
    wanted = materialize(wanted, "join-candidates")
    keyed = docs.select(text_key(text_col).alias("__key"), F.col(text_col).cast("string").alias("__text"))
    texts = join_checked(keyed, wanted.select("__key"), ["__key"], "left_semi").groupBy("__key").agg(F.first("__text").alias("__text"))
    full = wanted.join(_with_shingles(texts, width), "__key").drop("__key")
    full = materialize(full, "join-shingles")
    own = F.pmod(F.xxhash64("__c", F.lit(7)), F.col("__tiles")).cast("int")
    pairs = members.withColumn("__own", own).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__tiles") - 1)))
    pairs = pairs.select("__c", "__block", "__own", F.least("__own", "__other").alias("__a"), F.greatest("__own", "__other").alias("__b"))
    tiles = pairs.join(full, "__c").select("__block", "__a", "__b", "__c", "__size", "__own", "__sig", "__blocks", "__shingles")
    found = materialize(_verified(tiles.repartition("__block", "__a", "__b").sortWithinPartitions("__block", "__a", "__b"), threshold), "join-links")
    roots = components(found.select(F.col("__c").alias("u"), F.col("__to").alias("v")))
    links = found.groupBy("__c").agg(F.sum("__links").alias("__links"))
    placed = roots.select(F.col("node").alias("__c"), "root").join(links, "__c").join(classes.select("__c", "__class"), "__c")
    groups = placed.groupBy("root").agg(F.min("__class").alias("__group"))
    placed = join_checked(placed, groups, ["root"], "inner").select("__c", "__links", "__group")
    known = classes.join(placed, "__c", "left").select(
        "__h1", "__h2", "__class", F.coalesce("__group", "__class").alias("__group"),
        (F.coalesce("__links", F.lit(0)) + F.col("__size") - 1).alias("__n_links"))
    known = materialize(known, "join-known")
    return join_checked(rows.select("__id", "__key", "__h1", "__h2"), known, ["__h1", "__h2"], "inner").drop("__h1", "__h2")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``docs`` with one row of each group of similar texts: that with the smallest id. Rows that repeat its id and text stay with it.

    Any column names are allowed.
    """
    rows = similar_groups(docs, id_col, text_col, **settings)
    this = F.struct(F.col("__id").isNull().alias("gap"), F.col("__id").alias("id"), F.col("__key").alias("key"))
    gone = rows.filter(~this.eqNullSafe(F.col("__group"))).select(
        F.coalesce(F.col("__id").cast("string"), F.lit("")).alias("__gone"), F.col("__id").isNull().alias("__gap"), "__key").distinct()
    keyed = docs.select(boxed(docs.columns), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("__gone"),
                        F.col(id_col).isNull().alias("__gap"), text_key(text_col).alias("__key"))
    kept = join_checked(keyed, materialize(gone, "join-gone"), ["__gone", "__gap", "__key"], "left_anti")
    return kept.select(*unboxed(docs.columns))

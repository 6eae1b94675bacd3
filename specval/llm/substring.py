"""Substring duplicates by relative Lempel-Ziv factors: what a document repeats from documents with smaller ids.

The index of reference blocks is made of seeds: runs of 20 words chosen so that every run of 50 words holds one, and equal runs the same
one. A seed with its block (all words that a window around the seed can reach) is looked up as a whole; a block that an earlier document
holds too is a factor of the document, and consecutive factors join to longer ones. Where a block is not found as a whole, that is at the
boundaries of factors, its windows are looked up one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specval.llm.common import join_checked
from specval.llm.text import hash_words, mix, slices, split_words
from specval.session import materialize

WINDOW, SEED = 50, 20
BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
SEED_ROWS = 2_000_000  # seeds that may be broadcast, two numbers each
RANGE_ROWS = 300_000  # documents whose ranges may be broadcast
RANGES = 4_000_000  # and all their ranges


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, pow(BASE, -1, 2**64)):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Words:
    """Word hashes of some texts with constant-time hashes of any run of words."""

    def __init__(self, texts: list[str | None]):
        self.counts, words = hash_words(texts)
        self.ends = np.cumsum(self.counts)
        self.starts = self.ends - self.counts
        size = 1 << max(16, int(len(words) + 1).bit_length())
        power, self.inverse = _powers(size)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * power[:len(words)], out=self.sums[1:])
        self.doc = np.repeat(np.arange(len(texts)), self.counts)

    def runs(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[first]) * self.inverse[first])

    def windows(self, window: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all windows inside one text, and the start of the seed of each: the least hash among its runs of ``seed`` words."""
        n = len(self.doc)
        starts = np.arange(max(0, n - window + 1))
        starts = starts[starts + window <= self.ends[self.doc[starts]]]
        if not len(starts):
            return starts, starts
        at = np.arange(n - seed + 1)
        hashes = self.runs(at, at + seed)
        view = np.lib.stride_tricks.sliding_window_view(hashes, window - seed + 1)
        return starts, starts + np.concatenate([view[part].argmin(1) for part in np.array_split(starts, len(starts) // 50_000 + 1)])

    def blocks(self, seeds: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each seed, and of the block of words around it that its windows can reach (cut at the ends of the text)."""
        doc, reach = self.doc[seeds], window - seed
        low, high = np.maximum(self.starts[doc], seeds - reach), np.minimum(self.ends[doc], seeds + window)
        shape = mix(((seeds - low) * 65536 + (high - seeds)).astype(np.uint64))
        return self.runs(seeds, seeds + seed), mix(self.runs(low, high) ^ shape)


def _lists(values: np.ndarray, counts: np.ndarray, kind) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def row_keys(id_col: str, text_col: str) -> list[Column]:
    """Two hashes that tell rows with different ids or texts apart; rows that repeat both are one document."""
    id_, text = F.col(id_col).cast("string"), F.col(text_col).cast("string")
    return [F.xxhash64(id_, text).alias("__k1"), F.xxhash64(text, F.lit(1), id_).alias("__k2")]


def _seeded(docs: DataFrame, id_col: str, text_col: str, window: int, seed: int) -> DataFrame:
    """One row per row of ``docs``: id, keys, and lists of the seeds' places, hashes and block hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words(part.column(3).to_pylist())
            seeds = np.unique(words.windows(window, seed)[1])
            hashes, blocks = words.blocks(seeds, window, seed)
            doc = words.doc[seeds]
            counts = np.bincount(doc, minlength=part.num_rows)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(2), _lists((seeds - words.starts[doc]).astype(np.int32), counts, pa.int32()),
                 _lists(hashes.view(np.int64), counts, pa.int64()), _lists(blocks.view(np.int64), counts, pa.int64())],
                names=["__id", "__k1", "__k2", "place", "seed", "block"])

    schema = T.StructType([T.StructField("__id", docs.schema[id_col].dataType), T.StructField("__k1", T.LongType()), T.StructField("__k2", T.LongType()),
                           T.StructField("place", T.ArrayType(T.IntegerType())), T.StructField("seed", T.ArrayType(T.LongType())),
                           T.StructField("block", T.ArrayType(T.LongType()))])
    return docs.select(F.col(id_col).alias("__id"), *row_keys(id_col, text_col), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def _windows(texts: DataFrame, window: int, seed: int) -> DataFrame:
    """(``__row``, ``__id``, ``__text``, ``__places``): the windows of the seeds at these places, as ``__start``, ``__seed``, ``__window``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words(part.column(2).to_pylist())
            wanted = np.zeros(len(words.doc), bool)
            for first, places in zip(words.starts.tolist(), part.column(3).to_pylist()):
                wanted[first + np.array(places, np.int64)] = True
            starts, seeds = words.windows(window, seed)
            if not len(starts):
                continue
            keep = wanted[seeds]
            starts, seeds = starts[keep], seeds[keep]
            doc = words.doc[starts]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(doc)), part.column(1).take(pa.array(doc)), pa.array((starts - words.starts[doc]).astype(np.int32)),
                 pa.array(words.runs(seeds, seeds + seed).view(np.int64)), pa.array(words.runs(starts, starts + window).view(np.int64))],
                names=["__row", "__id", "__start", "__seed", "__window"])

    schema = T.StructType([texts.schema["__row"], texts.schema["__id"], T.StructField("__start", T.IntegerType()),
                           T.StructField("__seed", T.LongType()), T.StructField("__window", T.LongType())])
    return texts.select("__row", "__id", "__text", "__places").mapInArrow(run, schema)


def _earlier(smallest: str) -> Column:
    """Whether a document with a smaller id has it too; a missing id counts as larger than any other."""
    return F.col(smallest).isNotNull() & (F.col("__id").isNull() | (F.col(smallest) < F.col("__id")))


def _shared() -> list[Column]:
    return [F.min("__id").alias("__least"), F.max("__id").alias("__most"), F.count_if(F.col("__id").isNull()).alias("__gaps")]


IN_SEVERAL = "__least < __most OR (__least IS NOT NULL AND __gaps > 0)"


def _with_lists(docs: DataFrame, lists: DataFrame, how: str, limit: int, ranges: int) -> DataFrame:
    """Joins lists (``__k1``, ``__k2``, ``__list``) to the documents: broadcast when few and short, else shuffled."""
    rows, size = lists.agg(F.count(F.lit(1)), F.sum(F.size("__list"))).first()
    if rows <= limit and (size or 0) <= ranges:
        lists = F.broadcast(lists)
    return docs.join(lists, ["__k1", "__k2"], how)


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(``__k1``, ``__k2``, ``__list``): per document the ranges (``low``, ``high``, inclusive) of starts of repeated windows."""
    parsed = materialize(_seeded(docs, id_col, text_col, window, seed).withColumn("__row", F.monotonically_increasing_id()), "lz-seeds")
    each = parsed.select("__row", "__id", F.explode(F.arrays_zip("place", "seed", "block")).alias("s")).select("__row", "__id", "s.*")
    seeds = each.groupBy("seed").agg(*_shared(), (F.min("block") < F.max("block")).alias("__differ")).filter(IN_SEVERAL)
    seeds = materialize(seeds.select("seed", "__differ"), "lz-shared")
    known = materialize(join_checked(each, seeds, ["seed"], "inner", SEED_ROWS), "lz-known")
    blocks = known.groupBy("seed", "block").agg(F.min("__id").alias("__least"))
    judged = materialize(join_checked(known, blocks, ["seed", "block"], "left").withColumn("__found", _earlier("__least")), "lz-judged")
    whole = judged.filter("__found").select("__row", F.greatest(F.col("place") - (window - seed), F.lit(0)).alias("low"), F.col("place").alias("high"))
    # at the boundaries of factors: blocks that are not found while their seed occurs in other blocks
    open_ = judged.filter("NOT __found AND __differ").groupBy("__row").agg(F.first("__id").alias("__id"), F.collect_list("place").alias("__list"))
    keys = parsed.select("__row", "__k1", "__k2")
    open_ = materialize(open_.join(keys, "__row"), "lz-open")
    once = open_.groupBy("__k1", "__k2").agg(F.min("__row").alias("__row"))  # rows that repeat id and text are one document
    open_ = open_.join(once, ["__k1", "__k2", "__row"], "left_semi")
    keyed = docs.select(*row_keys(id_col, text_col), F.col(text_col).cast("string").alias("__text"))
    texts = _with_lists(keyed, open_, "inner", RANGE_ROWS, RANGES).withColumnRenamed("__list", "__places")
    cut = materialize(_windows(texts, window, seed), "lz-windows")
    common = cut.groupBy("__seed", "__window").agg(*_shared()).filter(IN_SEVERAL).select("__seed", "__window", "__least")
    single = join_checked(cut, common, ["__seed", "__window"], "inner", SEED_ROWS).filter(_earlier("__least"))
    ranges = whole.unionByName(single.select("__row", F.col("__start").alias("low"), F.col("__start").alias("high")))
    lists = ranges.groupBy("__row").agg(F.collect_list(F.struct("low", "high")).alias("__list")).join(keys, "__row")
    return materialize(lists.groupBy("__k1", "__k2").agg(F.flatten(F.collect_set("__list")).alias("__list")), "lz-ranges")


def spans(ranges: list[dict] | None, n: int, window: int = WINDOW) -> np.ndarray:
    """Which of ``n`` words are covered by windows that start in the ranges."""
    steps = np.zeros(n + 1, np.int64)
    for r in ranges or ():
        high = min(r["high"], n - window)
        if r["low"] <= high:
            steps[r["low"]] += 1
            steps[high + window] -= 1
    return np.cumsum(steps[:-1]) > 0


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED,
                 texts: bool = False) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_words``, ``n_removed``, ``kept_sha256``; with ``texts`` also ``kept_text`` and ``spans``
    (first word and the word behind the last of each removed span).

    A word is removed when a window of ``window`` words that covers it also starts in a document with a smaller id. Missing and empty texts
    have no words; shorter texts lose none. Rows that repeat an id don't remove each other's words; missing ids come last. An empty
    table gives an empty result. A passage that a third of all documents hold is a key with partial sums, never a gathered group.
    """
    lists = repeated_ranges(docs, id_col, text_col, window, seed)
    keyed = docs.select(F.col(id_col).alias("__id"), *row_keys(id_col, text_col), F.col(text_col).cast("string").alias("__text"))
    marked = _with_lists(keyed, lists, "left", RANGE_ROWS, RANGES).select("__id", "__text", "__list")
    names = [id_col, "n_words", "n_removed", "kept_sha256", *(["kept_text", "spans"] if texts else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sizes, removed, digests, kept_texts, all_spans = [], [], [], [], []
            for text, ranges in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                words, cut = split_words(text), []
                n, gone = len(words), 0
                if ranges:
                    mask = spans(ranges, n, window)
                    gone = int(mask.sum())
                    edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])))).reshape(-1, 2).tolist()
                    cut = [{"start": a, "end": b} for a, b in edges]
                    words = [w for w, m in zip(words, mask.tolist()) if not m]
                kept = " ".join(words)
                sizes.append(n)
                removed.append(gone)
                digests.append(hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest())
                if texts:
                    kept_texts.append(kept)
                    all_spans.append(cut)
            columns = [part.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            if texts:
                columns += [pa.array(kept_texts, pa.string()), pa.array(all_spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    kinds = [docs.schema[id_col].dataType, T.LongType(), T.LongType(), T.StringType(), *([T.StringType(), T.ArrayType(span)] if texts else [])]
    return marked.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)]))

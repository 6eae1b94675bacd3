"""Large JSON arrays read by many tasks.

Spark's text reader cuts a file into byte ranges at any separator, here at each ``}``. What a range means depends on what came
before it: whether it starts inside a string, and how deep. A first pass sums up every range for both cases, the ranges of a
file are then composed in order, and a second pass cuts the elements out. Elements that go over the border of a range are put
together from its ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specval.session import materialize

#: Files up to this length are one value of one task.
WHOLE_BYTES = 64 << 20
FIXED_SPLITS = "spark.sql.files.minPartitionNum"

ESCAPED = re.compile(r"\\.", re.S)
OPENING, CLOSING = re.compile(r"[\[{]"), re.compile(r"[\]}]")


def depth_change(piece: str) -> tuple[bool, int, int]:
    """(an odd number of quotes, change of depth if the piece starts outside of strings, the same if it starts inside one).

    No piece starts after half an escape, as the character before it is ``}``.
    """
    if "\\" in piece:
        piece = ESCAPED.sub("", piece)
    parts = piece.split('"')
    outside, inside = "".join(parts[0::2]), "".join(parts[1::2])
    return len(parts) % 2 == 0, *(len(OPENING.findall(p)) - len(CLOSING.findall(p)) for p in (outside, inside))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    for batch in batches:
        for path, start, piece in zip(*(c.to_pylist() for c in batch.columns)):
            yield (path, start), piece


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple[str, int], list] = {}
    for key, piece in _ranges(batches):
        s = found.setdefault(key, [False, 0, 0, ""])
        odd, outside, inside = depth_change(piece)
        # the closing bracket after the piece counts where it is outside of strings
        first, second = (inside, outside) if s[0] else (outside, inside)
        s[0] ^= odd
        s[1] += first - (not s[0])
        s[2] += second - s[0]
        s[3] = s[3] or piece.lstrip()[:1]
    if found:
        rows = [(*k, *v) for k, v in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["path", "start", "odd", "outside", "inside", "opening"])


def _states(rows) -> tuple[dict[tuple[str, int], tuple[bool, int, bool]], list[str]]:
    """For each range of the files that hold an array: (starts inside a string, depth at its start, last of its file); the other files."""
    files: dict[str, list] = {}
    for r in rows:
        files.setdefault(r["path"], []).append(r)
    states, others = {}, []
    for path, ranges in files.items():
        ranges.sort(key=lambda r: r["start"])
        if ranges[0]["opening"] != "[":
            others.append(path)
            continue
        inside, depth = False, 0
        for r in ranges:
            states[path, r["start"]] = (inside, depth, r is ranges[-1])
            depth += r["inside"] if inside else r["outside"]
            inside ^= r["odd"]
    return states, others


class Range:
    """One range of a file: complete elements come out of ``add``; ``parts`` are the texts before the first and after the last cut."""

    def __init__(self, inside: bool, depth: int, last: bool):
        self.inside, self.depth, self.last, self.cuts, self.held, self.head = inside, depth, last, 0, [], None

    def add(self, piece: str, ends: bool) -> str | None:
        """The element that the piece completes, if any. No bracket follows a piece that ends the file."""
        if ends and self.last:
            self.held.append(piece)
            return None
        odd, outside, inside = depth_change(piece)
        self.depth += inside if self.inside else outside
        self.inside ^= odd
        self.depth -= not self.inside
        self.held += [piece, "}"]
        if self.inside or self.depth != 1:
            return None
        text, self.held = "".join(self.held), []
        self.cuts += 1
        if self.cuts == 1:
            self.head = text
            return None
        return text

    def parts(self) -> list[tuple[int, str]]:
        """(cuts of this range before the text, text)."""
        tail = "".join(self.held)
        return [(0, tail)] if self.cuts == 0 else [(0, self.head), (self.cuts, tail)]


def _elements(states):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, now, at = [], 0, None, None

        def close() -> None:
            if at is not None:
                out.extend((*now, at.cuts, place, text) for place, text in at.parts())

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[]] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                                              names=["path", "start", "cuts", "place", "value"])

        for (key, piece), after in pairwise(chain(_ranges(batches), [(None, "")])):
            if key != now:
                close()
                state = states.value.get(key)
                now, at = key, Range(*state) if state else None
            made = at.add(piece, after[0] != key) if at else None
            if made is not None:
                out.append((*key, None, None, made))
                size += len(made)
                if size > 4_000_000:
                    yield batch()
                    size = 0
        close()
        yield batch()

    return run


def _texts(parts: DataFrame) -> DataFrame:
    """Complete elements, and those put together from the ends of ranges, each as an array of its own."""
    whole = parts.filter("place IS NULL").select(F.regexp_replace("value", r"^[\s,]+", "").alias("value"))
    ends = parts.filter("place IS NOT NULL")
    in_file = Window.partitionBy("path").orderBy("start", "place")  # two rows for each range of a file
    before = F.sum(F.when(F.col("place") == 0, F.col("cuts")).otherwise(0)).over(in_file) - F.col("cuts")
    numbered = ends.select("path", "start", "place", "value", (before + F.col("place")).alias("element"))
    joined = numbered.groupBy("path", "element").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("start", "place", "value"))), lambda s: s["value"]), "").alias("value"))
    last = F.max("element").over(Window.partitionBy("path"))
    text = F.when(F.col("element") == 0, F.regexp_replace("value", r"^\s*\[", "")).otherwise(F.col("value"))
    joined = joined.select(F.when(F.col("element") == last, F.regexp_replace(text, r"\]\s*$", "")).otherwise(text).alias("value"))
    joined = joined.select(F.regexp_replace("value", r"^[\s,]+", "").alias("value")).filter("trim(value) <> ''")
    return whole.unionByName(joined).select(F.concat(F.lit("["), "value", F.lit("]")).alias("value"))


def read_json_values(spark: SparkSession, path: str, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """``value``: a row per file, but a row per object for files longer than ``whole_bytes`` that hold one array.

    Such an array is read by as many tasks as it has byte ranges (``spark.sql.files.maxPartitionBytes``), twice; a row is an array with one
    object (and with what is no object before it, which is for the reader of the rows to reject). Longer files that hold anything else are
    one value as well. The driver holds three numbers for each byte range of the long files, less than Spark's own list of ranges. An array that is cut
    off gives its complete objects, and the rest as a text that isn't JSON.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")  # the content isn't read
    long = [r["path"] for r in files.filter(F.col("length") > whole_bytes).select("path").collect()]
    if not long:
        return spark.read.text(path, wholetext=True)
    before = spark.conf.get(FIXED_SPLITS, None)
    # both passes have to see the same ranges, also where executors come or go in between
    spark.conf.set(FIXED_SPLITS, before or str(spark.sparkContext.defaultParallelism))
    try:
        pieces = spark.read.option("lineSep", "}").text(long).select(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
        ranges = pieces.mapInArrow(_summaries, "path string, start long, odd boolean, outside long, inside long, opening string")
        states, others = _states(ranges.collect())  # a row per byte range
        shared = spark.sparkContext.broadcast(states)
        parts = materialize(pieces.mapInArrow(_elements(shared), "path string, start long, cuts long, place long, value string"), "json-elements")
    finally:
        spark.conf.set(FIXED_SPLITS, before) if before else spark.conf.unset(FIXED_SPLITS)
    short = [r["path"] for r in files.filter(F.col("length") <= whole_bytes).select("path").collect()]
    rest = [*short, *others]
    out = _texts(parts)
    return out.unionByName(spark.read.text(rest, wholetext=True)) if rest else out

"""Packing by concatenating all token streams and cutting them into windows of equal length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specval.llm.common import join_checked
from specval.llm.text import by_bytes, slices
from specval.llm.tokens import WordBpe, loaded
from specval.session import materialize

LENGTH = 4096
_PLAIN_SPACE = np.arange(256, dtype=np.uint8)
_PLAIN_SPACE[9:14] = 32
BATCH_BYTES = 4_000_000  # of text, or one text if that is longer
END_ID = 2


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _spaced(texts: pa.Array) -> pa.Array:
    """The texts with a space for each white-space byte; missing ones are empty. In UTF-8 these bytes are never part of another character."""
    texts = pc.fill_null(texts, "")
    _, places, body = texts.buffers()
    body = pa.py_buffer(_PLAIN_SPACE[np.frombuffer(body, np.uint8)].tobytes()) if body else body
    return pa.StringArray.from_buffers(len(texts), places, body, offset=texts.offset)


def _ids_of(bpe: WordBpe, texts: pa.Array, end_id: int) -> tuple[np.ndarray, pa.Array]:
    """(numbers of ids, ids as bytes) of texts, each with its end. Only a batch's different words reach the tokenizer; Arrow and numpy do the rest."""
    lists = pc.split_pattern(_spaced(texts), " ")  # spaces at an end or side by side make empty words, which have no ids
    coded = lists.flatten().dictionary_encode()
    counts, flat = bpe.streams(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
    first = np.cumsum(counts) - counts
    word = coded.indices.to_numpy()
    lengths = counts[word]
    reach = np.concatenate(([0], np.cumsum(lengths)))
    stream = flat[np.repeat(first[word] - reach[:-1], lengths) + np.arange(reach[-1])]
    offsets = lists.offsets.to_numpy()
    ends = reach[offsets[1:] - offsets[0]]
    sizes = np.diff(ends, prepend=0) + 1
    stream = np.insert(stream, ends, end_id).astype("<u2")
    places = np.concatenate(([0], 2 * np.cumsum(sizes))).astype(np.int32)
    return sizes.astype(np.int64), pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(places), pa.py_buffer(stream.tobytes())])


def token_streams(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, end_id: int) -> DataFrame:
    """``__id``, ``__tokens``, ``__ids`` (unsigned 16-bit), ``__part`` (the task) and ``__before`` (the task's ids before the row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, before = loaded(WordBpe, vocabulary), TaskContext.get().partitionId(), 0
        for batch in by_bytes(batches, 1, BATCH_BYTES):
            sizes, ids = _ids_of(bpe, batch.column(1), end_id)
            starts = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), ids, pa.array(np.full(len(ids), part, np.int32)), pa.array(starts)],
                names=["__id", "__tokens", "__ids", "__part", "__before"])

    fields = [T.StructField("__id", docs.schema[id_col].dataType), T.StructField("__tokens", T.LongType()), T.StructField("__ids", T.BinaryType()),
              T.StructField("__part", T.IntegerType()), T.StructField("__before", T.LongType())]
    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, T.StructType(fields))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID,
         vocabulary: str | None = None) -> DataFrame:
    """One row per piece: the id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``,
    ``padded_length`` and the piece's ``ids`` (binary, unsigned 16-bit, little-endian).

    Rows are concatenated in the order of tasks and of rows in a task. The first pass writes the ids with counts that start anew in
    every task; a table with one sum per task turns them into global offsets; the second pass cuts at multiples of ``length``.
    So only the last sequence can be short, and it is padded unless it is as long as a power of two. A missing or empty text
    is its end id alone. Rows that repeat an id are packed one by one. An empty table gives an empty result.
    """
    vocabulary = vocabulary or default_vocabulary()
    streams = materialize(token_streams(docs, id_col, text_col, vocabulary, end_id), "pack-streams")
    parts = materialize(streams.groupBy("__part").agg(F.sum("__tokens").alias("__sum")), "pack-parts")
    total = parts.agg(F.sum("__sum")).first()[0] or 0
    ahead = F.sum("__sum").over(Window.orderBy("__part")) - F.col("__sum")  # one row per task of the first pass
    placed = join_checked(streams, parts.select("__part", ahead.alias("__ahead")), ["__part"], "inner")
    last = total % length
    short = last if last and last & (last - 1) == 0 else length

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, at, size, crc, whole, sequence, offset, kept = [], [], [], [], [], [], [], []
            for k, (raw, first) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                ids = np.frombuffer(raw, "<u2")
                wide, n, s = ids.astype("<u4"), len(ids), 0
                while s < n:
                    here = (first + s) % length
                    e = min(n, s + length - here)
                    rows.append(k)
                    at.append(s)
                    size.append(e - s)
                    crc.append(zlib.crc32(wide[s:e]))
                    whole.append(n)
                    sequence.append((first + s) // length)
                    offset.append(here)
                    kept.append(raw[2 * s:2 * e])
                    s = e
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(x, pa.int64()) for x in (at, size, crc, whole, sequence, offset)],
                 pa.array(kept, pa.binary())],
                names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    numbers = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *[T.StructField(x, T.LongType()) for x in numbers],
                           T.StructField("ids", T.BinaryType())])
    pieces = placed.select("__id", "__ids", (F.col("__ahead") + F.col("__before")).alias("__first")).mapInArrow(cut, schema)
    padded = F.when(F.col("sequence_id") == total // length, short).otherwise(length)
    return pieces.withColumn("padded_length", padded.cast("long"))

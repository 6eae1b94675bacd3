"""Quality classifier: gated attention over the passages of a document (multiple-instance learning).

Every passage is encoded by numbers taken from its bytes and words. A small network learns from document labels which
passages to look at (gated attention) and scores the attention-weighted sum of the encoded passages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specval.llm.common import boxed, unboxed
from specval.llm.text import _IS_WHITE, _hash_bytes, slices

PASSAGE_WORDS = 64
MAX_PASSAGES = 256  # when training, longer documents get longer passages, so that the driver's part is bounded and the whole text is read
TRAIN_ROWS = 4000  # the bound of the labelled sample the model is fitted on
HIDDEN, ATTENTION = 16, 8
THRESHOLD = 0.3
SLICE = 1_000_000  # bytes handled at once
LONG_CHARS = 2 * PASSAGE_WORDS * MAX_PASSAGES - 2  # a shorter text has no more than MAX_PASSAGES passages

#: Kinds of bytes. Letters of other scripts are bytes above 127.
_KINDS = [(b"\n", 1), (b" \t\x0b\x0c\r", 2), (b"0123456789", 3), (b".", 4), (b",;:", 5), (b"!", 6), (b"?", 7), (b"#$%&*", 8),
          (b"|<>", 9), (b"()[]{}", 10), (b"\"'`", 11), (b"/\\@_=+-~^", 12), (bytes(range(65, 91)), 13), (bytes(range(97, 123)), 14)]
KINDS = 17
_KIND = np.zeros(256, np.int64)
for _chars, _kind in _KINDS:
    _KIND[list(_chars)] = _kind
_KIND[128:192], _KIND[192:] = 15, 16
WIDTH = KINDS + 7


def encode_passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(passages of each text, features of all passages in order). A text without words is one passage of zeros."""
    counts, rows, at = np.ones(len(texts), np.int64), [], 0
    while at < len(texts):
        parts, size, first = [], 0, at
        while at < len(texts) and (size < SLICE or not parts):
            parts.append((texts[at] or "").encode("utf-8", "surrogatepass"))
            size += len(parts[-1]) + 1
            at += 1
        n, x = _encode(parts)
        counts[first:at] = n
        rows.append(x)
    return counts, np.concatenate(rows) if rows else np.zeros((0, WIDTH))


def _encode(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return _encode_bytes(np.frombuffer(b"\n".join(parts) + b"\n", np.uint8), np.cumsum([len(p) + 1 for p in parts]), MAX_PASSAGES)


def passage_slices(text: str | None) -> Iterator[np.ndarray]:
    """Features of the passages of one text, all of 64 words but the last, for about ``SLICE`` bytes at a time."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass") + b"\n", np.uint8)
    at, size = 0, SLICE
    while len(raw) - at > size:
        white = _IS_WHITE[raw[at:at + size]]
        starts = np.flatnonzero(~white & np.concatenate(([True], white[:-1])))
        n = (len(starts) - 1) // PASSAGE_WORDS * PASSAGE_WORDS  # whole passages, up to the first word of the next one
        if n <= 0:
            size *= 2
            continue
        end = at + int(starts[n])
        yield _encode_bytes(raw[at:end], np.array([end - at]))[1]
        at, size = end, SLICE
    yield _encode_bytes(raw[at:], np.array([len(raw) - at]))[1]


def _encode_bytes(raw: np.ndarray, ends: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    words, starts = _hash_bytes(raw)
    n_words = np.diff(np.searchsorted(starts, ends), prepend=0)
    long = np.maximum(PASSAGE_WORDS, -(-n_words // most) if most else np.zeros_like(n_words))
    n_passages = np.maximum(1, -(-n_words // long))
    first_passage = np.cumsum(n_passages) - n_passages
    total = int(n_passages.sum())
    out = np.zeros((total, WIDTH))
    if not len(starts):
        return n_passages, out
    doc = np.repeat(np.arange(len(ends)), n_words)
    place = np.arange(len(words)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    passage = first_passage[doc] + place // long[doc]
    following = np.append(starts[1:], len(raw))
    reach = np.minimum(following, ends[doc]) - starts  # bytes up to the next word or the end of the text
    cell = np.repeat(passage, following - starts) * KINDS + _KIND[raw[starts[0]:]]
    for k in np.flatnonzero(reach < following - starts).tolist():  # white space before the first word of the next text
        cell[starts[k] + reach[k] - starts[0]:following[k] - starts[0]] = total * KINDS
    kinds = np.bincount(cell, minlength=total * KINDS)[:total * KINDS].reshape(total, KINDS)
    size = np.maximum(kinds.sum(1), 1)
    n = np.maximum(np.bincount(passage, minlength=total), 1)
    out[:, :KINDS] = kinds / size[:, None]
    length = np.minimum(reach - 1, 60).astype(float)
    mean = np.bincount(passage, length, total) / n
    out[:, KINDS] = mean / 10
    out[:, KINDS + 1] = np.sqrt(np.maximum(np.bincount(passage, length**2, total) / n - mean**2, 0)) / 10
    again = np.zeros(len(words))
    again[1:] = (words[1:] == words[:-1]) & (passage[1:] == passage[:-1])
    out[:, KINDS + 2] = np.bincount(passage, again, total) / n
    order = np.lexsort((words, passage))
    new = np.ones(len(words))
    new[1:] = (words[order][1:] != words[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    out[:, KINDS + 3] = np.bincount(passage[order], new, total) / n
    capital = (_KIND[raw[starts]] == 13).astype(float)
    out[:, KINDS + 4] = np.bincount(passage, capital, total) / n
    out[:, KINDS + 5] = np.log1p(n) / 5
    out[:, KINDS + 6] = np.minimum(kinds[:, 1] / n, 1)
    out[np.bincount(passage, minlength=total) == 0] = 0
    return n_passages, out


@dataclass
class Model:
    """Standardisation and weights; ``constant`` is the score of every text when there was nothing to learn from."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None

    def score(self, counts: np.ndarray, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(counts), self.constant)
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        return 1 / (1 + np.exp(-np.clip(_forward(self.weights, counts, x)["logit"], -40, 40)))

    def score_texts(self, texts: list[str | None]) -> np.ndarray:
        """Scores by passages of 64 words at every size: sums of long texts are merged slice by slice."""
        short = [len(t or "") <= LONG_CHARS for t in texts]
        scores = np.zeros(len(texts))
        scores[short] = self.score(*encode_passages([t for t, s in zip(texts, short) if s])) if any(short) else []
        for k in np.flatnonzero(~np.array(short, bool)):
            scores[k] = self._score_long(texts[k])
        return scores

    def _score_long(self, text: str) -> float:
        if self.constant is not None:
            return self.constant
        top, total, sums = -np.inf, 0.0, np.zeros(HIDDEN)
        for x in passage_slices(text):
            h, _, _, a = _attend(self.weights, np.clip((x - self.mean) / self.scale, -6, 6))
            best = max(top, a.max())
            e, before = np.exp(a - best), np.exp(top - best)
            top, total, sums = best, total * before + e.sum(), sums * before + e @ h
        logit = (sums / total) @ self.weights["c"] + self.weights["b"][0]
        return float(1 / (1 + np.exp(-np.clip(logit, -40, 40))))


def _attend(w: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    h = np.tanh(x @ w["E"] + w["e"])
    t = np.tanh(h @ w["V"])
    g = 1 / (1 + np.exp(-(h @ w["U"])))
    return h, t, g, (t * g) @ w["a"]


def _forward(w: dict[str, np.ndarray], counts: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
    at = np.cumsum(counts) - counts
    h, t, g, a = _attend(w, x)
    a = np.exp(a - np.repeat(np.maximum.reduceat(a, at), counts))
    a /= np.repeat(np.add.reduceat(a, at), counts)
    z = np.add.reduceat(a[:, None] * h, at)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "at": at, "logit": z @ w["c"] + w["b"]}


def fit(counts: np.ndarray, x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 128, rate: float = 0.01,
        decay: float = 1e-4, seed: int = 7) -> Model:
    """Adam on the log loss of document labels. Without rows, or with one label only, the smoothed share of ones is the score."""
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(WIDTH), np.ones(WIDTH), {}, float((y.sum() + 1) / (len(y) + 2)))
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    x = np.clip((x - mean) / scale, -6, 6)
    w = {"E": rng.normal(0, 0.3, (WIDTH, HIDDEN)), "e": np.zeros(HIDDEN), "V": rng.normal(0, 0.3, (HIDDEN, ATTENTION)),
         "U": rng.normal(0, 0.3, (HIDDEN, ATTENTION)), "a": rng.normal(0, 0.3, ATTENTION), "c": rng.normal(0, 0.3, HIDDEN), "b": np.zeros(1)}
    m, v, step = {k: np.zeros_like(p) for k, p in w.items()}, {k: np.zeros_like(p) for k, p in w.items()}, 0
    at = np.cumsum(counts) - counts
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(y), batch):
            rows = order[k:k + batch]
            take = np.concatenate([np.arange(at[r], at[r] + counts[r]) for r in rows])
            n, xs = counts[rows], x[take]
            f = _forward(w, n, xs)
            d = (1 / (1 + np.exp(-f["logit"])) - y[rows]) / len(rows)
            dz = np.repeat(d[:, None] * w["c"], n, 0)
            da = (dz * f["h"]).sum(1)
            da = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, f["at"]), n))
            dt, dg = da[:, None] * w["a"] * f["g"] * (1 - f["t"]**2), da[:, None] * w["a"] * f["t"] * f["g"] * (1 - f["g"])
            dh = (f["a"][:, None] * dz + dt @ w["V"].T + dg @ w["U"].T) * (1 - f["h"]**2)
            grad = {"E": xs.T @ dh, "e": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ da, "c": f["z"].T @ d, "b": np.array([d.sum()])}
            step += 1
            for name, p in w.items():
                g = grad[name] + decay * p
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.999 * v[name] + 0.001 * g * g
                p -= rate * (1 - 0.9 * epoch / epochs) * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w)


def held_out(id_col: str):
    """The CRC-32 of the id as text, modulo 5, is 0; so is a missing id."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          rows: int = TRAIN_ROWS) -> Model:
    """Fits on at most ``rows`` labelled ids that are not held out, chosen by a hash of the id; the driver gets their passages' features.

    Of an id with several labels the mean counts; rows without a label or an id are left out.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.avg(F.col(label_col).cast("double")).alias("__y"))
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(rows)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).join(F.broadcast(chosen), "__id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            counts, x = encode_passages(part.column(1).to_pylist())
            at = np.cumsum(counts) - counts
            raw = [x[a:a + n].astype("<f4").tobytes() for a, n in zip(at, counts)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(raw, pa.binary())], names=["__id", "__y", "__x"])

    schema = T.StructType([texts.schema["__id"], texts.schema["__y"], T.StructField("__x", T.BinaryType())])
    sample = texts.select("__id", "__text", "__y").mapInArrow(run, schema).limit(2 * rows).collect()  # an id may repeat in docs
    sample.sort(key=lambda r: (r["__id"], r["__x"]))
    bags = [np.frombuffer(r["__x"], "<f4").reshape(-1, WIDTH) for r in sample]
    counts = np.array([len(b) for b in bags], np.int64)
    x = np.concatenate(bags).astype(float) if bags else np.zeros((0, WIDTH))
    return fit(counts, x, np.array([r["__y"] for r in sample]))


def score(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns (default: all) and ``__score`` for every row. A missing text counts as empty."""
    carry = docs.columns if carry is None else carry

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            scores = model.score_texts(part.column(part.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(scores, pa.float64())], names=[*carry, "__score"])

    schema = T.StructType([*[docs.schema[c] for c in carry], T.StructField("__score", T.DoubleType())])
    return docs.select(*carry, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
             threshold: float = THRESHOLD, carry: list[str] | None = None, rows: int = TRAIN_ROWS) -> DataFrame:
    """``carry`` columns (default: the id), ``__held_out``, ``__score`` (0 to 1), ``__predicted`` (1 from ``threshold`` on), one row per row of ``docs``.

    Texts without words are scored like others. An empty table gives an empty result; without labels all scores are equal.
    """
    model = train(docs, labels, id_col, text_col, label_col, rows)
    carry = [id_col] if carry is None else carry
    return score(docs, model, text_col, carry).select(
        *carry, held_out(id_col).alias("__held_out"), "__score", (F.col("__score") >= threshold).cast("int").alias("__predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts; any column names are allowed."""
    rows = docs.select(F.col(id_col), F.col(text_col), boxed(docs.columns))
    judged = classify(rows, labels, id_col, text_col, carry=[id_col, "__doc"], **settings)
    return judged.filter("__predicted = 1").select(*unboxed(docs.columns))

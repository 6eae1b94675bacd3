"""Words of texts inside Arrow tasks: splitting, and word and window hashes for many texts at once with numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space that ``str.split`` knows and the word rule doesn't.
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SLICE_BYTES = 2_000_000

_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[9, 10, 11, 12, 13, 32]] = True
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_BYTE_VALUE[_IS_WHITE] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)


def split_words(text: str | None) -> list[str]:
    if not text:
        return []
    return WORD.findall(text) if OTHER_SPACE.search(text) else text.split()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Short pieces of the batches, so that what a task builds from them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Pieces of the batches of at most ``limit`` bytes in a text column, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, upto - at)
            at = upto


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _hash_bytes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words in UTF-8 bytes."""
    white = _IS_WHITE[raw]
    starts = np.flatnonzero(~white & np.concatenate(([True], white[:-1])))
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    reach = np.diff(np.append(starts, len(raw)))
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, reach)
    values = _BYTE_VALUE[raw[starts[0]:]] * powers(int(reach.max()))[place]
    return mix(np.add.reduceat(values, starts - starts[0])), starts


def hash_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(number of words of each text, 64-bit hashes of all words in order). Missing texts have no words."""
    counts, hashes = np.zeros(len(texts), np.int64), []
    at, pending, size = 0, [], 0

    def flush(first: int, parts: list[bytes]) -> None:
        raw = np.frombuffer(b"\n".join(parts), np.uint8)
        ends = np.cumsum([len(p) + 1 for p in parts])
        found, starts = _hash_bytes(raw)
        counts[first:first + len(parts)] = np.diff(np.searchsorted(starts, ends), prepend=0)
        hashes.append(found)

    for k, text in enumerate(texts):
        part = (text or "").encode("utf-8", "surrogatepass")
        pending.append(part)
        size += len(part) + 1
        if size >= SLICE_BYTES:
            flush(at, pending)
            at, pending, size = k + 1, [], 0
    if pending:
        flush(at, pending)
    return counts, np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)


def window_hashes(words: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of ``width`` consecutive word hashes (none if there are fewer words)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factor = mix(np.array([seed + 1], np.uint64))[0] | np.uint64(1)
    out = np.zeros(n, np.uint64)
    for k in range(width):  # Horner's rule, modulo 2**64
        out = out * factor + words[k:k + n]
    return mix(out)

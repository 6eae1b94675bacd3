"""Quality rules: plain counts, and how well a public vocabulary fits the text (fertility) against bands per language."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specval.llm.common import join_checked
from specval.llm.text import slices, split_words
from specval.llm.tokens import WordPieces, loaded
from specval.session import materialize

MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"

#: Measures: has an edge below, has one above, least distance of an edge from the median, and whether the distance shrinks with the
#: square root of the number of words, as the sampling error of a mean does.
MEASURES = {"chars_per_token": (True, True, 1.0, True), "byte_share": (False, True, 2.0, True), "token_entropy": (True, False, 1.25, False)}
SPREADS = 7.0  # distance of an edge from the median, as a multiple of the distance between the median and the quartile on that side

#: Code point ranges by script, for texts without a language.
SCRIPTS = {
    "Latin": "A-Za-zÀ-ɏ", "Greek": "Ͱ-Ͽ", "Cyrillic": "Ѐ-ԯ", "Hebrew": "֐-׿", "Arabic": "؀-ۿ",
    "Devanagari": "ऀ-ॿ", "Kana": "぀-ヿ", "Han": "一-鿿", "Hangul": "가-힯",
}
_SCRIPTS = {name: re.compile(f"[{chars}]") for name, chars in SCRIPTS.items()}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def script_of(text: str) -> str:
    """The script with most letters in the text."""
    if text.isascii():
        return "Latin"
    counts = {name: len(p.findall(text)) for name, p in _SCRIPTS.items()}
    best = max(counts, key=counts.get)
    return best if counts[best] else "Other"


def repeated_words(words: list[str]) -> int:
    """Words in a run of three that the text holds at least twice."""
    n = len(words) - 2
    if n < 2:
        return 0
    seen: dict[str, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    size = len(seen)
    if size < 2**21:
        keys = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
    else:
        keys = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], 1), axis=0, return_inverse=True)[1].reshape(-1)
    order = np.argsort(keys, kind="stable")
    same = np.diff(keys[order]) == 0
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n + 2, bool)
    for k in range(3):
        covered[k:k + n] |= twice
    return int(covered.sum())


def repeated_lines(text: str, words: list[str]) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text or not words:
        return 0
    seen, again = set(), 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif split_words(line):
            seen.add(line)
    return again


def measure(text: str | None, pieces: WordPieces, words: list[str]) -> tuple:
    text = text or ""
    ids = pieces.ids(words)
    chars = sum(map(len, words))
    base = (len(words), chars, sum(map(text.count, SYMBOLS)), repeated_lines(text, words), repeated_words(words))
    if not len(ids):
        return *base, None, None, None
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    return *base, chars / len(ids), float(pieces.is_byte[ids].mean()), float(-(share * np.log2(share)).sum())


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang",
             vocabulary: str | None = None) -> DataFrame:
    """One row per row of ``docs``: ``__id``, ``__group`` (the language, else the script), ``__words`` (a hash of the words in order), counts
    and fertility measures."""
    vocabulary = vocabulary or default_vocabulary()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(WordPieces, vocabulary)
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            words = [split_words(t) for t in texts]
            pieces.learn([w for ws in words for w in ws])
            columns = list(zip(*[measure(t, pieces, ws) for t, ws in zip(texts, words)]))
            group = [x if x is not None else f"script {script_of(t or '')}" for x, t in zip(batch.column(2).to_pylist(), texts)]
            same = [hashlib.blake2b(" ".join(ws).encode("utf-8", "surrogatepass"), digest_size=16).digest() for ws in words]
            kinds = [pa.int64()] * len(names) + [pa.float64()] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(group, pa.string()), pa.array(same, pa.binary()),
                                              *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                                             names=["__id", "__group", "__words", *names, *MEASURES])

    schema = T.StructType([T.StructField("__id", docs.schema[id_col].dataType), T.StructField("__group", T.StringType()), T.StructField("__words", T.BinaryType()),
                           *[T.StructField(n, T.LongType()) for n in names], *[T.StructField(n, T.DoubleType()) for n in MEASURES]])
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"), lang.alias("__lang")).mapInArrow(run, schema)


def scale(name: str):
    return F.sqrt("n_words") if MEASURES[name][3] else F.lit(1.0)


def bands(measured: DataFrame, spreads: float = SPREADS) -> DataFrame:
    """Per group and measure: the ``_mid`` and how far below (``_low``) and above (``_high``) it a scaled measure may lie; null: any distance.

    From the different texts of the group that pass the base rules: copies (also with other white space) count once, so they do not draw
    the quartiles together. Partial sums and sketches that merge, so a group or a text with a third of the rows is no hot spot.
    """
    sound = measured.filter(~base_failed()).groupBy("__group", "__words").agg(*[F.first(c).alias(c) for c in ("n_words", *MEASURES)])
    mids = sound.groupBy("__group").agg(*[F.percentile_approx(m, 0.5, 10_000).alias(f"{m}_mid") for m in MEASURES])
    away = join_checked(sound, mids, ["__group"], "inner").groupBy("__group").agg(
        *[F.first(f"{m}_mid").alias(f"{m}_mid") for m in MEASURES],
        *[F.percentile_approx((F.col(m) - F.col(f"{m}_mid")) * scale(m), [0.25, 0.75], 10_000).alias(m) for m in MEASURES])
    edges = []
    for m, (below, above, least, _) in MEASURES.items():
        none = F.lit(None).cast("double")
        edges.append((F.greatest(-spreads * F.col(m)[0], F.lit(least)) if below else none).alias(f"{m}_low"))
        edges.append((F.greatest(spreads * F.col(m)[1], F.lit(least)) if above else none).alias(f"{m}_high"))
    return away.select("__group", *[f"{m}_mid" for m in MEASURES], *edges)


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang",
                  vocabulary: str | None = None, spreads: float = SPREADS) -> DataFrame:
    """One row per row of ``docs``: the id, the counts, ``base_failed``, ``kept``, and the measures.

    A missing or empty text has no words and fails the base rules. Texts without a language are grouped by script.
    A text outside a band of its group is not kept. An empty table gives an empty result; repeated rows are judged alike.
    """
    measured = materialize(measures(docs, id_col, text_col, lang_col, vocabulary), "rules-measures")
    judged = join_checked(measured, bands(measured, spreads), ["__group"], "left")
    outside = F.lit(False)
    for m in MEASURES:
        away = (F.col(m) - F.col(f"{m}_mid")) * scale(m)
        outside = outside | F.coalesce(away < -F.col(f"{m}_low"), F.lit(False)) | F.coalesce(away > F.col(f"{m}_high"), F.lit(False))
    failed = base_failed()
    return judged.select(F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         failed.alias("base_failed"), (~failed & ~outside).alias("kept"), *MEASURES)

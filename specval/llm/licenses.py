"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specval.session import materialize

#: Wordings of license statements, all public.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
                         "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed "
                         "to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
                         "KIND, either express or implied.",
    "MIT": "Released under the MIT License.",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal "
                 "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
                 "sublicense, and/or sell copies of the Software.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                  "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "all rights reserved": "All rights reserved.",
}

WIDTH = 5  # words of a shingle; a template with fewer words is one shingle
WINDOW, STRIDE = 16, 8  # words
PIECE, PIECE_STEP = 8, 4  # words; a piece of a template lies inside some window wherever it occurs
CONTAINMENT = 0.8
COLLISION = 0.999


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def pieces_of(words: list[str]) -> list[list[str]]:
    """Overlapping pieces that hold every shingle of a template."""
    last = max(len(words) - PIECE, 0)
    return [words[a:a + PIECE] for a in sorted({*range(0, last, PIECE_STEP), last})]


def shingles(words: list[str], width: int) -> list[str]:
    return sorted({" ".join(words[k:k + width]) for k in range(len(words) - width + 1)})


def bands_needed(collision: float = COLLISION, window: int = WINDOW, width: int = WIDTH) -> int:
    """Bands of one value so that a window and a piece that share a single shingle meet with this probability.

    The similarity is then at least 1 to the number of shingles in a window (a piece adds none, as it lies in the window).
    """
    similarity, bands, missed = 1 / (window - width + 1), 0, 1.0
    while missed > 1 - collision:
        missed *= 1 - similarity
        bands += 1
    return bands


def _at(words: Column, k: Column, width: int) -> list[Column]:
    return [F.element_at(words, (k + j + 1).cast("int")) for j in range(width)]


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, whatever the optimiser does with the columns in between."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _signature(hashes: Column, bands: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, b))))


def _template_table(spark: SparkSession, templates: dict[str, str], width: int) -> DataFrame | None:
    rows = []
    for name, text in templates.items():
        words = words_of(text)
        if words and min(len(words), WIDTH) == width:
            total = len(shingles(words, width))
            rows += [(name, n, shingles(p, width), total) for n, p in enumerate(pieces_of(words))]
    return spark.createDataFrame(rows, "license string, __piece int, __wanted array<string>, __total int") if rows else None


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None,
         containment: float = CONTAINMENT, collision: float = COLLISION) -> DataFrame:
    """One row per row of ``docs`` and license found: the id, ``license``, ``containment`` and ``first_word``.

    Words are runs of ASCII letters and digits, in lower case. A text holds a template when ``containment`` of the template's
    shingles are in the text, wherever they are. Pieces and bands only find the templates to count for a text: one shared shingle
    is enough. ``first_word`` starts the first window with ``containment`` of a piece, or with any shingle if there is none.
    Missing, empty and short texts hold nothing; an empty table gives an empty result; repeated rows are rows of their own.

    Windows that share no shingle with any template cannot meet one in a band, so signatures are made for the others only. The
    templates are a small fixed table: only they are broadcast.
    """
    spark, templates = docs.sparkSession, TEMPLATES if templates is None else templates
    widths = sorted({min(len(words_of(t)), WIDTH) for t in templates.values()} - {0})
    pieces = {w: _template_table(spark, templates, w) for w in widths}
    found = _windows_with_hits(docs, id_col, text_col, pieces)
    out = None
    for w in widths:
        part = _verified(found.filter(F.col("__width") == w), pieces[w], w, containment, bands_needed(collision, width=w))
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("__id", id_col)


def _windows_with_hits(docs: DataFrame, id_col: str, text_col: str, pieces: dict[int, DataFrame]) -> DataFrame:
    """The windows that share a shingle with a template, for each width of shingles."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), F.lit("([a-z0-9]+)"))

    def codes(width: int) -> list[int]:  # of the templates
        known = pieces[width].select(F.explode("__wanted").alias("s")).distinct()
        return [r[0] for r in known.select(F.xxhash64(*[F.element_at(F.split("s", " "), j + 1) for j in range(width)])).collect()]

    def numbers(hits: Column, width: int) -> Column:
        before = F.filter(hits, lambda k: (k >= STRIDE) & (k % STRIDE + width + STRIDE <= WINDOW))
        return F.array_distinct(F.concat(F.transform(hits, lambda k: F.floor(k / STRIDE)), F.transform(before, lambda k: F.floor(k / STRIDE) - 1)))

    def windows(w: Column, width: int, wanted: list[int]) -> Column:
        places = F.when(F.size(w) >= width, F.sequence(F.lit(0), F.size(w) - width)).otherwise(F.array().cast("array<int>"))
        return let(F.filter(places, lambda k: F.xxhash64(*_at(w, k, width)).isin(wanted)), lambda hits: F.transform(numbers(hits, width), lambda j: F.struct(
            F.lit(width).alias("__width"), (j * STRIDE).cast("int").alias("__start"), F.slice(w, (j * STRIDE + 1).cast("int"), F.lit(WINDOW)).alias("__words"))))

    wanted = {width: codes(width) for width in pieces}
    every = F.explode(let(words, lambda w: F.concat(*[windows(w, width, wanted[width]) for width in pieces])))
    found = docs.select(F.col(id_col).alias("__id"), F.col(text_col), F.monotonically_increasing_id().alias("__row")).select("__row", "__id", every.alias("w"))
    return materialize(found.select("__row", "__id", "w.*"), "license-windows")


def _verified(found: DataFrame, pieces: DataFrame, width: int, containment: float, bands: int) -> DataFrame:
    own = F.transform(F.sequence(F.lit(0), F.size("__words") - width), lambda k: F.array_join(F.slice("__words", (k + 1).cast("int"), width), " "))
    windows = found.withColumn("__own", F.array_distinct(own))
    code = lambda column: F.transform(column, lambda s: F.xxhash64(s))
    banded = windows.select("__row", F.posexplode(_signature(code("__own"), bands)).alias("__band", "__value"))
    targets = pieces.select("license", F.posexplode(_signature(code("__wanted"), bands)).alias("__band", "__value"))
    met = banded.join(F.broadcast(targets), ["__band", "__value"]).select("__row", "license").distinct()
    whole = pieces.groupBy("license", "__total").agg(F.array_distinct(F.flatten(F.collect_list("__wanted"))).alias("__all"), F.collect_list("__wanted").alias("__pieces"))
    pairs = met.join(windows.select("__row", "__id", "__start", "__own"), "__row").join(F.broadcast(whole), "license")
    hits = pairs.withColumn("__common", F.array_intersect("__own", "__all")).filter(F.size("__common") > 0)
    piece = F.exists("__pieces", lambda p: F.size(F.array_intersect("__common", p)) >= containment * F.size(p))
    each = hits.select("__row", "__id", "license", "__total", "__start", F.when(piece, F.col("__start")).alias("__held"), F.explode("__common").alias("__shingle"))
    once = each.groupBy("__row", "__id", "license", "__total", "__shingle").agg(F.min("__start").alias("__start"), F.min("__held").alias("__held"))
    counted = once.groupBy("__row", "__id", "license", "__total").agg(
        F.count(F.lit(1)).alias("__n"), F.coalesce(F.min("__held"), F.min("__start")).alias("first_word"))
    share = F.col("__n") / F.col("__total")
    return counted.filter(share >= containment).select("__id", "license", share.alias("containment"), F.col("first_word").cast("long"))


def scan_sql(templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> str:
    """The same rows in SQL over ``documents``, by comparing all windows with all pieces that share a shingle."""
    rows, widths = [], set()
    for name, text in (TEMPLATES if templates is None else templates).items():
        words = words_of(text)
        width = min(len(words), WIDTH)
        widths.add(width)
        total = len(shingles(words, width))
        for n, piece in enumerate(pieces_of(words)):
            wanted = shingles(piece, width)
            rows += [f"('{name}', {width}, {n}, '{s}', {len(wanted)}, {total})" for s in wanted]
    joined = {w: " || ' ' || ".join(["word", *(f"lead(word, {k}) OVER byplace" for k in range(1, w))]) for w in sorted(widths)}
    grams = " UNION ALL ".join(f"SELECT doc_id, p, {w} AS width, {text} AS shingle FROM words WINDOW byplace AS (PARTITION BY doc_id ORDER BY p)" for w, text in joined.items())
    return f"""
WITH wanted(license, width, piece, shingle, piece_size, total) AS (VALUES {', '.join(rows)}),
texts AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM texts),
grams AS ({grams}),
hits AS (
  SELECT s.doc_id, s.p, t.* FROM grams s JOIN wanted t ON s.shingle = t.shingle AND s.width = t.width
), windows AS (
  SELECT *, p // {STRIDE} AS j FROM hits
  UNION ALL
  SELECT *, p // {STRIDE} - 1 AS j FROM hits WHERE p // {STRIDE} >= 1 AND p % {STRIDE} + width + {STRIDE} <= {WINDOW}
), held AS (
  SELECT doc_id, license, piece, j, piece_size FROM windows GROUP BY ALL HAVING count(DISTINCT shingle) >= {containment} * piece_size
)
SELECT w.doc_id, w.license, count(DISTINCT w.shingle) / any_value(w.total) AS containment, CAST({STRIDE} * min(w.j) AS BIGINT) AS first_word
FROM windows w SEMI JOIN held h ON w.doc_id = h.doc_id AND w.license = h.license AND w.piece = h.piece AND w.j = h.j
GROUP BY w.doc_id, w.license HAVING count(DISTINCT w.shingle) >= {containment} * any_value(w.total)
"""

"""Exact duplicates by progressive refinement: length, then a hash of the prefix, then a hash of the whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specval.llm.common import BROADCAST_ROWS, WHITE, boxed, join_checked, quoted, text_of, unboxed
from specval.session import materialize

PREFIX = 256  # characters


def normalised(column: str) -> Column:
    return F.regexp_replace(text_of(column), WHITE, " ")


def _refined(docs: DataFrame, id_col: str, text_col: str, held: list[str], digest: bool, prefix: int,
             limit: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(every row: ``__row``, ``__id``, ``__sha`` with ``digest``, the ``held`` columns in ``__doc``; rows of a group of two or more: ``__row``,
    ``__first``, ``__size``, ``__sha``).

    Rows are numbered in a written table; from there on only numbers and hashes are joined, never texts. Where more than
    ``limit`` prefixes repeat, the join needs an exchange, and each row is hashed before it instead of after it.
    """
    def whole(column: str) -> Column:
        return F.sha2(F.encode(normalised(column), "utf-8"), 256).alias("__sha")

    text = normalised(quoted(text_col))
    rows = materialize(docs.select(
        boxed(held), F.col(quoted(id_col)).alias("__id"),
        F.length(text).alias("__n"), F.xxhash64(F.substring(text, 1, prefix)).alias("__p"),
        *([whole(quoted(text_col))] if digest else []), F.monotonically_increasing_id().alias("__row")), "exact-rows")
    keys = rows.select("__n", "__p")
    lengths = materialize(keys.groupBy("__n").count().filter("count > 1").select("__n"), "exact-lengths")
    repeated = join_checked(keys, lengths, ["__n"], "left_semi").groupBy("__n", "__p").count().filter("count > 1")
    repeated = materialize(repeated.select("__n", "__p"), "exact-prefixes")
    narrow = ["__id", "__row", F.col("__sha") if digest else whole(f"__doc.{quoted(text_col)}")]
    if repeated.count() <= limit:
        hits = rows.join(F.broadcast(repeated), ["__n", "__p"], "left_semi").select(*narrow)
    else:
        hits = rows.select("__n", "__p", *narrow).join(repeated, ["__n", "__p"], "left_semi").drop("__n", "__p")
    hits = materialize(hits, "exact-hits")
    first = F.min(F.struct(F.col("__id").isNull().alias("gap"), F.col("__id").alias("id"), F.col("__row").alias("row")))
    groups = hits.groupBy("__sha").agg(first.alias("__first"), F.count(F.lit(1)).alias("__size")).filter("__size > 1")
    groups = materialize(groups, "exact-groups")
    placed = join_checked(hits.select("__row", "__sha"), groups, ["__sha"], "inner")
    return rows, materialize(placed, "exact-placed")


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None,
                 digest: bool = False, prefix: int = PREFIX) -> DataFrame:
    """One row per row of ``docs``: ``__keep_id``, ``__group_size``, ``__kept``, ``__sha``, then the ``carry`` columns (the id).

    Texts are equal when they agree after each run of white space is replaced by one space; a missing text is empty.
    The row with the smallest id stays (missing ids come last; of rows that repeat an id and a text one stays).
    An empty table gives an empty result. With ``digest`` there is ``text_sha256`` for every row, else for those
    in a group only, and only texts whose length and prefix occur twice are hashed in full. Of the columns of ``docs`` only a
    carried one that has the name of an output column is ambiguous; names used on the way can't clash.

    All groups are formed by partial aggregation, so a group with a third of all rows is no hot spot, and no text goes
    through a shuffle.
    """
    carry = [id_col] if carry is None else carry
    held = carry if digest or text_col in carry else [*carry, text_col]
    rows, placed = _refined(docs, id_col, text_col, held, digest, prefix)
    rows = rows.select("__row", "__id", F.struct(*unboxed(carry)).alias("__doc"), *(["__sha"] if digest else []))
    joined = join_checked(rows, placed.drop("__sha") if digest else placed, ["__row"], "left")
    grouped = F.col("__size").isNotNull()
    return joined.select(
        *unboxed(carry),
        F.when(grouped, F.col("__first.id")).otherwise(F.col("__id")).alias("__keep_id"),
        F.coalesce("__size", F.lit(1)).cast("long").alias("__group_size"),
        F.when(grouped, F.col("__first.row") == F.col("__row")).otherwise(True).alias("__kept"), "__sha")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text another row with a smaller id holds; any column names are allowed.

    Where more than a million rows go, the last join moves each text once.
    """
    rows, placed = _refined(docs, id_col, text_col, docs.columns, False, PREFIX)
    gone = placed.filter(F.col("__first.row") != F.col("__row")).select("__row")
    kept = join_checked(rows.select("__row", "__doc"), gone, ["__row"], "left_anti")
    return kept.select(*unboxed(docs.columns))

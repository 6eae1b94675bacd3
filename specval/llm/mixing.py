"""Mixing sources to target weights with nested hash thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specval.llm.common import boxed, join_checked, unboxed, word_count
from specval.operators.ordered import row_numbers
from specval.session import materialize

WEIGHTS = (1, 2, 3)
EPOCHS = 3
LEVELS, BITS = 5, 12  # a hash has LEVELS * BITS = 60 bits


def hash_of(id_col: str, text_col: str) -> Column:
    """60 bits of the MD5 of the id; of the text where there is no id."""
    seed = F.coalesce(F.col(id_col).cast("string"), F.col(text_col).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(F.encode(seed, "utf-8")), 1, 15), 16, 10).cast("long")


def source_key(column: str) -> Column:
    """A source as a join key that sorts by code point, a missing one last."""
    return F.when(F.col(column).isNull(), F.lit("2")).otherwise(F.concat(F.lit("1"), F.col(column).cast("string")))


def source_targets(totals: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS, budget: float = 1.0) -> DataFrame:
    """Adds ``__target`` to a table (``__source``, ``__total``).

    Sources in order weigh ``weights``, repeating, and share ``budget`` of the sum of totals. A target stops at ``epochs``
    times its total; what is left over is shared by weight among the others until none is above. The driver sees two
    sums a round.
    """
    ranked = row_numbers(totals, ["__source"], "__rank")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.col("__rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = materialize(ranked.withColumn("__weight", weight.cast("long")), "mix-sources")
    cap = F.lit(epochs) * F.col("__total")
    over, before = F.lit(False), -1
    whole = ranked.agg(F.sum("__total")).first()[0] or 0
    while True:
        open_weight, spent, full = ranked.agg(
            F.sum(F.when(~over, F.col("__weight"))), F.sum(F.when(over, cap)), F.count_if(over)).first()
        if not open_weight or full == before:
            break
        left, before = budget * whole - (spent or 0), full
        share = F.col("__weight").cast("double") * F.lit(float(left)) / F.lit(float(open_weight))
        over = share > cap
    target = cap.cast("double") if before < 0 else F.when(over, cap.cast("double")).otherwise(share)
    return ranked.select("__source", "__total", target.alias("__target"))


def thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source ``__times`` (whole passes) and ``__upto``: rows with a hash up to it are taken once more.

    ``rows`` has ``__source``, ``__size``, ``__hash``. Sums by source and hash bucket find the bucket in which the rest of
    the target is used up; only rows of that bucket are summed again by the next bits, until the bucket is one hash value.
    That value is taken when it brings the sum closer to the target. A smaller budget takes a subset of the rows.
    """
    times = F.when(F.col("__total") > 0, F.floor(F.col("__target") / F.col("__total"))).otherwise(0).cast("long")
    state = targets.select("__source", times.alias("__times"), (F.col("__target") - times * F.col("__total")).alias("__rest"))
    state = materialize(state, "mix-rest")
    open_ = state.select("__source", "__rest", F.lit(0).cast("long").alias("__below"), F.lit(0).cast("long").alias("__prefix"))
    found = None
    order = Window.partitionBy("__source").orderBy("__bucket")
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = join_checked(rows, open_, ["__source"], "inner")
        if level:
            inside = inside.filter(F.shiftright("__hash", shift + BITS) == F.col("__prefix"))
        sums = inside.groupBy("__source", F.shiftright("__hash", shift).alias("__bucket")).agg(
            F.sum("__size").alias("__sum"), F.min("__hash").alias("__low"), F.max("__hash").alias("__high"),
            F.first("__rest").alias("__rest"), F.first("__below").alias("__below"))
        edge = sums.withColumn("__upto", F.col("__below") + F.sum("__sum").over(order)).withColumn("__below", F.col("__upto") - F.col("__sum"))
        edge = materialize(edge.filter((F.col("__rest") > 0) & (F.col("__upto") > F.col("__rest")) & (F.col("__below") <= F.col("__rest"))), f"mix-level{level}")
        single = F.col("__low") == F.col("__high")
        closer = F.col("__upto") - F.col("__rest") < F.col("__rest") - F.col("__below")
        done = edge.filter(single).select("__source", F.when(closer, F.col("__high")).otherwise(F.col("__low") - 1).alias("__upto"))
        found = done if found is None else found.unionByName(done)
        open_ = edge.filter(~single).select("__source", "__rest", "__below", F.col("__bucket").alias("__prefix"))
        if open_.isEmpty():
            break
    return state.select("__source", "__times").join(found, "__source", "left").select(
        "__source", "__times", F.coalesce("__upto", F.lit(-1)).alias("__upto"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                weights=WEIGHTS, epochs: int = EPOCHS, budget: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """The narrow table of ``docs`` (``__id``, ``__source``, ``__size`` in words, ``__hash``) and a plan with one row per source:
    ``__total``, ``__target``, ``__times``, ``__upto``. A row is taken ``__times`` times, and once more if ``__hash <= __upto``.

    Missing text has size 0; a missing source is a source of its own, last in order. Rows that repeat an id have one hash
    and are taken alike. A source without words has target 0. An empty table gives empty tables. Reruns agree.
    """
    rows = materialize(docs.select(F.col(id_col).alias("__id"), source_key(source_col).alias("__source"),
                                   word_count(text_col).alias("__size"), hash_of(id_col, text_col).alias("__hash")), "mix-rows")
    totals = rows.groupBy("__source").agg(F.sum("__size").alias("__total"))
    targets = source_targets(totals, weights, epochs, budget)
    plan = targets.join(thresholds(rows, targets), "__source")
    return rows, materialize(plan, "mix-plan")


def times_taken() -> Column:
    return F.col("__times") + F.when(F.col("__hash") <= F.col("__upto"), 1).otherwise(0)


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
          weights=WEIGHTS, epochs: int = EPOCHS, budget: float = 1.0) -> DataFrame:
    """``docs`` with every row as often as the mix takes it: none, one or several times. Any column names are allowed."""
    _, plan = mix_sources(docs, id_col, source_col, text_col, weights, epochs, budget)
    keyed = docs.select(boxed(docs.columns), source_key(source_col).alias("__source"), hash_of(id_col, text_col).alias("__hash"))
    taken = join_checked(keyed, plan.select("__source", "__times", "__upto"), ["__source"], "inner").withColumn("__taken", times_taken())
    copies = taken.filter("__taken > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__taken").cast("int"))))
    return copies.select(*unboxed(docs.columns))

"""Order-dependent operators that do not put a whole ordering into one task.

A plain ``Window.orderBy`` sorts its partition in one task. That is used here only up to ``ROWS_PER_BUCKET`` rows, or as many of a wide table as
make ``CELLS_PER_BUCKET`` values, as whole rows are sorted. Larger inputs go through Spark's
range exchange on all ordering columns and are written once, each row with the number of its partition: the bucket. As the table is written, a
repeated task cannot move a row. Totals per bucket form a small table that carries counts, minima, ... from one bucket to the next.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specval.session import materialize

ROWS_PER_BUCKET = 2_000_000
CELLS_PER_BUCKET = 8_000_000  # rows times columns; some 130 MB of a sorting task
BROADCAST_TOTALS = 500_000  # rows of totals per group and bucket that may be broadcast
BUCKET = "__bucket"


@dataclass(frozen=True)
class Key:
    """One ordering column. Missing values come last in either direction."""

    name: str
    descending: bool = False

    def sort(self) -> Column:
        col = F.col(self.name)
        return col.desc_nulls_last() if self.descending else col.asc_nulls_last()


def key(spec) -> Key:
    if isinstance(spec, Key):
        return spec
    return Key(spec[1:], True) if spec.startswith("-") else Key(spec)


@dataclass
class Layout:
    df: DataFrame
    group: list[str]
    keys: list[Key]
    rows: int
    buckets: list[str] = field(default_factory=list)

    @property
    def single(self) -> bool:
        return not self.buckets

    def window(self):
        return Window.partitionBy(*self.group, *self.buckets).orderBy(*[k.sort() for k in self.keys])

    def across(self):
        """Order of the buckets; the table it runs on has one row per group and bucket."""
        return Window.partitionBy(*self.group).orderBy(*self.buckets)

    def carry(self, totals: dict[str, Column], carried: dict[str, Column]) -> DataFrame:
        """One row per group and bucket: ``totals`` per bucket, then ``carried`` computed over the bucket order."""
        table = self.df.groupBy(*self.group, *self.buckets).agg(*[c.alias(n) for n, c in totals.items()])
        return table.select(*self.group, *self.buckets, *[c.alias(n) for n, c in carried.items()])

    def attach(self, table: DataFrame) -> DataFrame:
        table = materialize(table.withColumnsRenamed({c: f"__j_{c}" for c in self.group + self.buckets}), "bucket-totals")
        if table.count() <= BROADCAST_TOTALS:
            table = F.broadcast(table)
        match = reduce(
            lambda a, b: a & b,
            [F.col(c).eqNullSafe(F.col(f"__j_{c}")) for c in self.group + self.buckets],
        )
        return self.df.join(table, match, "left").drop(*[f"__j_{c}" for c in self.group + self.buckets])

    def clean(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.buckets)


def layout(df: DataFrame, group, order, rows_per_bucket: int = ROWS_PER_BUCKET, rows: int | None = None) -> Layout:
    """``df`` as it is if it has at most ``rows_per_bucket`` rows (fewer if they are wide), else in buckets of about as many, in the order of group and keys.

    Spark's range exchange picks the limits. Rows that tie in all keys are told apart by a hash of their other columns, so a tie is as many
    buckets as it needs; only rows that are equal in every column stay together.
    """
    keys = [key(k) for k in order]
    group = list(group)
    if rows is None:
        rows = df.count()
    rows_per_bucket = min(rows_per_bucket, max(1, CELLS_PER_BUCKET // len(df.columns)))
    plan = Layout(df, group, keys, rows)
    if rows <= rows_per_bucket:
        return plan
    kinds = {f.name: f.dataType for f in df.schema.fields}
    rest = [c for c in df.columns if not isinstance(kinds[c], (T.MapType, T.VariantType))]
    limits = [*[F.col(c) for c in group], *[k.sort() for k in keys], F.xxhash64(*rest)]
    ranged = df.repartitionByRange(math.ceil(rows / rows_per_bucket), *limits).withColumn(BUCKET, F.spark_partition_id())
    plan.df, plan.buckets = materialize(ranged, "ordered"), [BUCKET]
    return plan


def row_numbers(df: DataFrame, order, name: str, group=(), rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Position 1..n within ``group`` by ``order`` (a leading ``-`` means descending)."""
    plan = layout(df, group, order, rows_per_bucket)
    local = F.row_number().over(plan.window()).cast("bigint")
    if plan.single:
        return plan.df.withColumn(name, local)
    before = plan.across().rowsBetween(Window.unboundedPreceding, -1)
    table = plan.carry({"__n": F.count(F.lit(1))}, {"__before": F.coalesce(F.sum("__n").over(before), F.lit(0))})
    numbered = plan.attach(table).withColumn(name, F.col("__before") + local).drop("__before")
    return plan.clean(numbered)


def min_ranks(df: DataFrame, value: str, descending: bool, rank: str, display_rank: str, ties: str,
              digits: int = 10, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Competition ranks: ``rank`` by the raw value; ``display_rank`` and the number of ``ties`` by the rounded value.

    A value can go over several buckets. Only the first and the last value of a bucket can have begun before it or go on after it;
    the bucket totals say where such a value starts and how often it occurs, every other value is ranked within its bucket.
    """
    raw, rounded = Key(value, descending), Key("__round", descending)
    df = df.withColumn("__round", F.round(F.col(value), digits))
    plan = layout(df, [], [rounded, raw], rows_per_bucket)
    if plan.single:
        by_raw = Window.orderBy(raw.sort())
        by_round = Window.orderBy(rounded.sort())
        return plan.df.select(
            "*", F.rank().over(by_raw).cast("bigint").alias(rank), F.rank().over(by_round).cast("bigint").alias(display_rank),
            F.count(F.lit(1)).over(Window.partitionBy("__round")).alias(ties),
        ).drop("__round")
    local = plan.window()
    whole = Window.partitionBy(BUCKET)
    edges = plan.df.select(
        BUCKET, F.struct("__round", F.col(value).alias("raw")).alias("v"), F.row_number().over(local).alias("k"),
        F.count(F.lit(1)).over(whole).alias("n"), F.rank().over(local).alias("starts"),
        F.rank().over(Window.partitionBy(BUCKET).orderBy(rounded.sort())).alias("round_starts"))
    # one row per bucket: its size, first and last value, and where the last one starts within it
    at_first, at_last = F.col("k") == 1, F.col("k") == F.col("n")
    table = materialize(edges.groupBy(BUCKET).agg(
        F.first("n").alias("n"), F.max(F.when(at_first, F.col("v"))).alias("first"), F.max(F.when(at_last, F.col("v"))).alias("last"),
        F.max(F.when(at_last, F.col("starts"))).alias("starts"), F.max(F.when(at_last, F.col("round_starts"))).alias("round_starts")), "bucket-edges")
    order = Window.orderBy(BUCKET)
    table = table.withColumns({
        "before": F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "previous": F.lag("last").over(order)})
    for name, part, starts in (("raw", lambda c: F.col(c), "starts"), ("round", lambda c: F.col(f"{c}.__round"), "round_starts")):
        goes_on = F.col("previous").isNotNull() & part("first").eqNullSafe(part("previous"))
        alone = goes_on & part("first").eqNullSafe(part("last"))  # the bucket is inside one value that began earlier
        table = table.withColumn(f"__began_{name}", F.when(~alone, F.col("before") + F.col(starts)))
        earlier = F.last(f"__began_{name}", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
        table = table.withColumn(f"__first_{name}", F.when(goes_on, earlier).otherwise(F.col("before") + 1))
    table = table.select(BUCKET, F.col("before").alias("__before"), F.col("first").alias("__first"), F.col("last").alias("__last"), "__first_raw", "__first_round")
    joined = plan.attach(table)
    first_raw = F.col("__round").eqNullSafe(F.col("__first.__round")) & F.col(value).eqNullSafe(F.col("__first.raw"))
    first_round = F.col("__round").eqNullSafe(F.col("__first.__round"))
    edge = first_round | F.col("__round").eqNullSafe(F.col("__last.__round"))
    cell = Window.partitionBy(BUCKET, "__round")
    ranked = joined.withColumns({
        rank: F.when(first_raw, F.col("__first_raw")).otherwise(F.col("__before") + F.rank().over(local)),
        display_rank: F.when(first_round, F.col("__first_round")).otherwise(
            F.col("__before") + F.rank().over(Window.partitionBy(BUCKET).orderBy(rounded.sort()))),
        "__here": F.count(F.lit(1)).over(cell), "__edge": edge,
    })
    # values at the edges of buckets, at most two a bucket, are counted over all buckets
    totals = plan.df.join(F.broadcast(_edge_values(table)), F.col("__round").eqNullSafe(F.col("__value")), "left_semi") \
        .groupBy(F.col("__round").alias("__value")).agg(F.count(F.lit(1)).alias("__all"))
    out = ranked.join(F.broadcast(totals), F.col("__edge") & F.col("__round").eqNullSafe(F.col("__value")), "left")
    out = out.withColumn(ties, F.coalesce("__all", "__here"))
    return plan.clean(out.drop("__round", "__before", "__first", "__last", "__first_raw", "__first_round", "__here", "__edge", "__value", "__all"))


def _edge_values(table: DataFrame) -> DataFrame:
    return table.select(F.explode(F.array("__first.__round", "__last.__round")).alias("__value")).distinct()


AGGREGATES = {"min": F.min, "max": F.max, "sum": F.sum}


def running(df: DataFrame, group, order, outputs: dict[str, tuple[str, Column]], side: str = "before",
            rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Aggregates over the rows strictly before (or after) each row in its group: ``{name: (min|max|sum, column)}``."""
    plan = layout(df, group, order, rows_per_bucket)
    span = (Window.unboundedPreceding, -1) if side == "before" else (1, Window.unboundedFollowing)
    inner = plan.window().rowsBetween(*span)
    if plan.single:
        return plan.df.withColumns({n: AGGREGATES[a](c).over(inner) for n, (a, c) in outputs.items()})
    outer = plan.across().rowsBetween(*span)
    table = plan.carry(
        {f"__t_{n}": AGGREGATES[a](c) for n, (a, c) in outputs.items()},
        {f"__c_{n}": AGGREGATES[a](F.col(f"__t_{n}")).over(outer) for n, (a, _) in outputs.items()},
    )
    joined = plan.attach(table)
    merged = {}
    for n, (a, c) in outputs.items():
        near, far = AGGREGATES[a](c).over(inner), F.col(f"__c_{n}")
        if a == "sum":
            merged[n] = F.when(near.isNull() & far.isNull(), F.lit(None)).otherwise(
                F.coalesce(near, F.lit(0)) + F.coalesce(far, F.lit(0)))
        else:
            low = a == "min"
            merged[n] = F.when(near.isNull(), far).when(far.isNull(), near).otherwise(
                F.when((near <= far) if low else (near >= far), near).otherwise(far))
    return plan.clean(joined.withColumns(merged).drop(*[f"__c_{n}" for n in outputs]))


def neighbours(df: DataFrame, group, position: str, outputs: dict[str, tuple[str, int]],
               chunk_rows: int = ROWS_PER_BUCKET, rows: int | None = None) -> DataFrame:
    """Values of rows ``offset`` positions away (negative = earlier); ``position`` is 1..n within the group.

    Positions are cut into equal chunks; each chunk also receives copies of the few rows next to its edges.
    """
    group = list(group)
    if rows is None:
        rows = df.count()
    reach = max(abs(o) for _, o in outputs.values())
    if rows <= chunk_rows:
        spec = Window.partitionBy(*group).orderBy(position)
        return df.withColumns({n: F.lead(c, o).over(spec) for n, (c, o) in outputs.items()})
    size = max(chunk_rows, 2 * reach)
    slot = (F.col(position) - 1) % size
    home = F.floor((F.col(position) - 1) / size)
    copies = F.array_compact(F.array(
        home,
        F.when(slot < reach, home - 1),
        F.when(slot >= size - reach, home + 1),
    ))
    spread = df.withColumn("__home", home).withColumn("__chunk", F.explode(copies))
    spec = Window.partitionBy(*group, "__chunk").orderBy(position)
    out = spread.withColumns({n: F.lead(c, o).over(spec) for n, (c, o) in outputs.items()})
    return out.filter("__chunk = __home").drop("__home", "__chunk")


def sequential(df: DataFrame, group: str, position: str, kernel, needed: list[str],
               chunk_rows: int = ROWS_PER_BUCKET, rows: int | None = None, label: str = "sequential",
               summary: dict[str, Column] | None = None, passes_by=None) -> DataFrame:
    """Keep rows by a rule that depends on the row kept last, in order of ``position`` within ``group``.

    ``kernel(pdf, state) -> (mask, state)`` treats one chunk. Chunks run in parallel from an assumed incoming state;
    the passes repeat until the state leaving every chunk equals the one its successor assumed, which then is the
    in-order result. Rules of this kind forget their start quickly, so two or three passes are usual. A state that chunks can't
    change would wander on by one chunk a pass: ``passes_by(state, totals)`` says from a chunk's ``summary`` (aggregates, by name) that
    no row of it is kept, and such chunks are passed at once.
    """
    schema = df.schema
    if rows is None:
        rows = df.count()
    if rows <= chunk_rows:
        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(position, kind="stable")
            mask, _ = kernel(pdf, None)
            return pdf[mask]

        return df.groupBy(group).applyInPandas(whole, schema)

    data = materialize(df.withColumn("__chunk", F.floor((F.col(position) - 1) / chunk_rows)), label)
    totals = {}
    if summary:
        found = data.groupBy(F.col(group).cast("string").alias("__g"), "__chunk").agg(*[c.alias(n) for n, c in summary.items()]).collect()  # a row per chunk
        totals = {(r["__g"], r["__chunk"]): r for r in found}
    narrow = data.select(*dict.fromkeys([group, position, "__chunk", *needed]))
    entry: dict[tuple, tuple] = {}
    while True:
        leaving = _chunk_states(narrow, group, position, kernel, entry)
        following: dict[tuple, tuple] = {}
        state, before = None, None
        for place in sorted(leaving):  # a chunk hands its state to the next one of its group that has rows
            if before is None or before[0] != place[0]:
                state = None
            if state is not None:
                following[place] = state
            if state is None or passes_by is None or not passes_by(state, totals[place]):
                state = leaving[place] if leaving[place] is not None else state
            before = place
        if following == entry:
            break
        entry = following

    def keep(key, pdf):
        pdf = pdf.sort_values(position, kind="stable")
        mask, _ = kernel(pdf, entry.get((str(key[0]), int(key[1]))))
        return pdf[mask].drop(columns="__chunk")

    return data.groupBy(group, "__chunk").applyInPandas(keep, schema)


def _chunk_states(data: DataFrame, group: str, position: str, kernel, entering: dict[tuple, tuple]) -> dict[tuple, tuple | None]:
    """The state that leaves each chunk, given the states that enter."""

    def run(key, pdf):
        pdf = pdf.sort_values(position, kind="stable")
        state = kernel(pdf, entering.get((str(key[0]), int(key[1]))))[1]
        return pd.DataFrame({"g": [str(key[0])], "c": [int(key[1])], "s": [list(state) if state is not None else None]})

    out = data.groupBy(group, "__chunk").applyInPandas(run, "g string, c bigint, s array<double>")
    return {(r["g"], r["c"]): (tuple(r["s"]) if r["s"] is not None else None) for r in out.collect()}

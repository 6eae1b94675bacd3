"""Shards by balanced label propagation: linked rows move towards their neighbours' shards under capacity quotas."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specval.llm.common import join_checked, text_of
from specval.session import materialize

SHARDS, ROUNDS = 16, 4
QUOTA_BUCKETS = 256  # per target shard
FILL_BUCKETS = 1024  # per size class; with at most 48 classes the driver sees at most 49,152 sums
SLOT_ROWS = 50_000  # rows numbered by one window


def bucket(column: str, buckets: int, *seed) -> Column:
    return F.pmod(F.xxhash64(F.col(column), *[F.lit(s) for s in seed]), F.lit(buckets)).cast("int")


def propagate_labels(nodes: DataFrame, links: DataFrame, shards: int = SHARDS, capacity: float | None = None,
                     rounds: int = ROUNDS) -> DataFrame:
    """(``node``, ``size``) and undirected (``a``, ``b``) links: gives ``node``, ``size``, ``shard``.

    Nodes start in the shard of a hash. In even rounds those with a smaller neighbour may move, in odd rounds the others, so
    that two neighbours never swap. A mover wants the shard that holds most of its neighbours (ties: the smaller number).
    A shard takes movers in the order of a hash bucket as long as they fit into what is free below ``capacity``; sums by
    shard and bucket decide this, nothing is sorted. A node without links stays. Links to itself don't count.
    """
    both = links.filter("a <> b").select("a", "b").union(links.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both, "shard-links")
    lowest = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("__near"))
    state = nodes.join(lowest, "node", "left").select(
        "node", "size", bucket("node", shards, "start").alias("shard"), (F.col("__near") < F.col("node")).alias("__up"))
    state = materialize(state, "shard-labels")
    if capacity is None:
        capacity = (nodes.agg(F.sum("size")).first()[0] or 0) / shards
    for turn in range(rounds):
        near = both.join(state.select(F.col("node").alias("b"), "shard"), "b")
        votes = near.groupBy(F.col("a").alias("node"), "shard").agg(F.count(F.lit(1)).alias("__n"))
        want = votes.groupBy("node").agg(F.max(F.struct("__n", (-F.col("shard")).alias("s"))).alias("__best"))
        want = want.select("node", (-F.col("__best.s")).cast("int").alias("__to"))
        moving = state.join(want, "node", "left").withColumn("__bucket", bucket("node", QUOTA_BUCKETS, turn))
        free = F.col("__up") if turn % 2 == 0 else ~F.col("__up")
        moving = moving.withColumn("__to", F.when(free & (F.col("__to") != F.col("shard")), F.col("__to")))
        moving = materialize(moving, f"shard-wishes{turn}")
        load = moving.groupBy("shard").agg(F.sum("size").alias("__load")).withColumnRenamed("shard", "__to")
        asked = moving.filter("__to IS NOT NULL").groupBy("__to", "__bucket").agg(F.sum("size").alias("__sum"))
        asked = asked.join(F.broadcast(load), "__to", "left")  # one row per shard
        upto = F.sum("__sum").over(Window.partitionBy("__to").orderBy("__bucket"))
        granted = asked.withColumn("__upto", upto).filter(F.col("__upto") + F.coalesce("__load", F.lit(0)) <= capacity)
        granted = granted.select("__to", "__bucket", F.lit(True).alias("__go"))  # at most QUOTA_BUCKETS rows per shard
        state = moving.join(F.broadcast(granted), ["__to", "__bucket"], "left").select(
            "node", "size", F.when(F.col("__go"), F.col("__to")).otherwise(F.col("shard")).alias("shard"), "__up")
        state = materialize(state, f"shard-labels{turn}")
        if moving.filter("__to IS NOT NULL").isEmpty() and turn % 2:
            break
    return state.select("node", "size", "shard")


def fill_evenly(rows: DataFrame, loads: dict[int, int], shards: int = SHARDS) -> DataFrame:
    """Adds ``shard`` to (``node``, ``size``): rows go to the emptiest shard by size class and hash bucket, largest sums first.

    The driver handles one sum per class (power of two of the size) and bucket, a number that doesn't grow with the rows.
    """
    size_class = F.floor(F.log2(F.greatest("size", F.lit(1)))).cast("int")
    rows = rows.withColumns({"__class": size_class, "__bucket": bucket("node", FILL_BUCKETS, "fill")})
    sums = rows.groupBy("__class", "__bucket").agg(F.sum("size").alias("__sum")).collect()
    heap = [(loads.get(s, 0), s) for s in range(shards)]
    heapq.heapify(heap)
    placed = []
    for r in sorted(sums, key=lambda r: (-r["__sum"], r["__class"], r["__bucket"])):
        load, shard = heapq.heappop(heap)
        placed.append((r["__class"], r["__bucket"], shard))
        heapq.heappush(heap, (load + r["__sum"], shard))
    table = rows.sparkSession.createDataFrame(placed, "__class int, __bucket int, shard int")
    return rows.join(F.broadcast(table), ["__class", "__bucket"]).drop("__class", "__bucket")


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS,
                    rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: the id, ``size`` (UTF-8 bytes and one), ``text_crc32``, ``shard``, ``slot``.

    Rows with equal texts are linked (a star around the first of them, whatever their number) and are propagated under
    the capacity of an even share; the rows without links then even the shards out. A missing text is empty. Rows that repeat an
    id are rows of their own. An empty table gives an empty result. Slots of a shard count from 0 without gaps.
    """
    text = text_of(text_col)
    raw = F.encode(text, "utf-8")
    base = materialize(docs.select(
        F.col(id_col).alias("__id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(raw).alias("__crc"),
        F.sha2(raw, 256).alias("__key"), F.monotonically_increasing_id().alias("node")), "shard-rows")
    total, count = base.agg(F.sum("size"), F.count(F.lit(1))).first()
    groups = base.groupBy("__key").agg(F.min("node").alias("__head"), F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    linked = materialize(join_checked(base.select("node", "size", "__key"), groups.select("__key", "__head"), ["__key"], "inner"), "shard-groups")
    spread = propagate_labels(linked.select("node", "size"), linked.select(F.col("node").alias("a"), F.col("__head").alias("b")),
                              shards, (total or 0) / shards, rounds)
    loads = {r["shard"]: r["n"] for r in spread.groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    single = join_checked(base, groups.select("__key"), ["__key"], "left_anti").select("node", "size")
    labels = spread.select("node", "shard").unionByName(fill_evenly(single, loads, shards).select("node", "shard"))
    parts = max(1, -(-(count or 0) // (SLOT_ROWS * shards)))
    placed = base.join(labels, "node").select(
        "__id", "size", "__crc", "shard", "node", F.pmod("node", F.lit(parts)).cast("int").alias("__part"))
    placed = materialize(placed, "shard-placed")
    counts = placed.groupBy("shard", "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("shard").orderBy("__part")) - F.col("__n")
    counts = counts.select("shard", "__part", before.alias("__before"))
    number = F.row_number().over(Window.partitionBy("shard", "__part").orderBy("node")) - 1
    return join_checked(placed, counts, ["shard", "__part"], "inner").select(
        F.col("__id").alias(id_col), "size", F.col("__crc").alias("text_crc32"), "shard",
        (F.col("__before") + number).cast("long").alias("slot"))

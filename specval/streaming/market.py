"""A stream of market snapshots: each new one replaces the ranking."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from specval import config as C
from specval.operators.features import prepare_features
from specval.plans.cost_spec import cs_ratio, rank_rows
from specval.session import clear_scratch, scratch_scope
from specval.sources.store import committed, save_rankings

ANNOUNCEMENT = "snapshot_id string, path string"


def rank_snapshot(rows: DataFrame, root: str, run_id: str, method: str = "fixed_rates", fee: str = "fee", key: str = "id") -> str:
    """Features, score, ranking and the stored tables of one snapshot."""
    scored = cs_ratio(prepare_features(rows, exclude=[key]), method, fee=fee, key=key)
    ranked = rank_rows(scored.rows, ("-CS", key))
    return save_rankings(ranked, scored.cost_structure, root, scored.method, run_id=run_id)


def announce(spark: SparkSession, folder: str, snapshot_id: str, path: str) -> None:
    """Tells the stream that the files under ``path`` are complete: one small file in ``folder``."""
    spark.createDataFrame([(snapshot_id, path)], ANNOUNCEMENT).coalesce(1).write.mode("append").json(folder)


def rank_stream(spark: SparkSession, folder: str, root: str, checkpoint: str, method: str = "fixed_rates", fee: str = "fee",
                schema: T.StructType = C.PLAN_SCHEMA, key: str = "id"):
    """M1: one micro-batch per announced snapshot, which may have any number of files (a ratio needs the whole market, so
    snapshots are not added up).

    Runs are named after the stream, which lives as long as its checkpoint, the batch and the place in it. A run of a repeated batch that is
    in the store already is left alone; the store's log orders all runs, those of other streams and of batch jobs too, by completion.
    Several announcements in one file are treated in their order. Intermediate tables are dropped once a run is stored.
    """
    source = spark.readStream.schema(ANNOUNCEMENT).option("maxFilesPerTrigger", 1).json(folder)

    def handle(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        stream = session.sparkContext.getLocalProperty("sql.streaming.queryId")
        for k, r in enumerate(batch.collect()):  # the announcements of one file
            name = re.sub(r"[^A-Za-z0-9_.-]", "_", r["snapshot_id"] or "")[:80]
            run_id = f"{stream}-{batch_id:08d}-{k:03d}-{name}"
            if committed(session, root, run_id) is not None:
                continue
            scope = f"market-{stream}-{batch_id}"
            scratch_scope(session, scope)
            try:
                rank_snapshot(session.read.schema(schema).json(r["path"]), root, run_id, method, fee, key)
            finally:
                scratch_scope(session, "main")
                clear_scratch(session, scope)

    return (
        source.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start())

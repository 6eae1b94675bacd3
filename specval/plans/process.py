"""The whole batch job: read, derive, score, rank, store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from specval.operators.features import prepare_features
from specval.plans.cost_spec import Scored, cs_ratio, rank_rows
from specval.sources.plans import Batch, read_batch, read_batches
from specval.sources.store import load_rankings, response, save_rankings, save_raw, stamp

RESPONSE_TOP = 10


@dataclass
class Result:
    ranked: DataFrame
    scored: Scored
    run_id: str
    top: DataFrame


def process(spark: SparkSession, path: str, root: str, lines: bool = True, key: str = "id") -> Result:
    """The job for a source with one set of options."""
    return process_batch(read_batch(spark, path, lines), root, key)


def process_all(spark: SparkSession, path: str, root: str, lines: bool = True, key: str = "id") -> list[Result]:
    """The job once per set of options in the source."""
    return [process_batch(batch, root, key) for batch in read_batches(spark, path, lines)]


def process_batch(batch: Batch, root: str, key: str = "id") -> Result:
    spark, options = batch.rows.sparkSession, batch.options
    save_raw(batch.rows, f"{root}/raw")
    if not batch.rejects.isEmpty():
        batch.rejects.write.mode("overwrite").parquet(f"{root}/rejects")
    # the processed snapshot is the table the models read; nothing is written twice
    features = prepare_features(batch.rows, exclude=[key], path=f"{root}/processed/run_ts={stamp()}")
    scored = cs_ratio(features, options["method"], options["featureSet"], options["feeColumn"], key=key)
    ranked = rank_rows(scored.rows, ("-CS", key))
    run_id = save_rankings(ranked, scored.cost_structure, root, scored.method)
    stored = load_rankings(spark, root, run_id).rankings
    top = response(stored.orderBy("rank_number").limit(RESPONSE_TOP), bool(options["includeComparison"]))
    return Result(stored, scored, run_id, top)

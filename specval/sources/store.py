"""Writing inputs and results, and reading results back."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specval.functions.text import storable
from specval.sources.commits import CommitLog

METADATA = "run_id string, method string, timestamp timestamp, has_data boolean, num_plans bigint, has_charts boolean, place bigint, folder string"
RESPONSE = ["id", "plan_name", "mvno", "fee", "original_fee", "rank", "rank_number", "B", "CS"]


def stamp() -> str:
    return datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S_%f")


def save_raw(df: DataFrame, folder: str, timestamp: str | None = None) -> str:
    """A JSON snapshot of the input under ``run_ts=<timestamp>``."""
    path = f"{folder}/run_ts={timestamp or stamp()}"
    df.write.mode("overwrite").json(path)
    return path


def save_processed(df: DataFrame, folder: str, timestamp: str | None = None, latest: bool = True, fmt: str = "csv") -> tuple[str, str | None]:
    """A snapshot and the overwritten ``latest`` copy. The copy is read from the snapshot, not computed again."""
    snapshot = f"{folder}/processed/run_ts={timestamp or stamp()}"
    df.write.mode("overwrite").format(fmt).option("header", True).save(snapshot)
    if not latest:
        return snapshot, None
    target = f"{folder}/latest"
    df.sparkSession.read.format(fmt).option("header", True).schema(df.schema).load(snapshot) \
        .write.mode("overwrite").format(fmt).option("header", True).save(target)
    return snapshot, target


@dataclass
class Stored:
    rankings: DataFrame
    cost_structure: DataFrame
    metadata: dict
    charts: DataFrame | None


def _log(spark: SparkSession, root: str) -> CommitLog:
    return CommitLog(spark, f"{root}/commits")


def committed(spark: SparkSession, root: str, run_id: str) -> int | None:
    """The place of a run among all runs, if it is complete."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/runs/{run_id}")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    return next((entry["place"] or number for number, entry in _log(spark, root).newest_first() if entry["run_id"] == run_id), None)


def save_rankings(rankings: DataFrame, cost_structure: DataFrame, root: str, method: str = "fixed_rates",
                  charts: DataFrame | None = None, run_id: str | None = None) -> str:
    """Tables of one run in a folder of their own, then its entry in the commit log.

    Readers follow the log, whose numbers order runs by completion whoever writes them, so a run that was interrupted is never seen. Writing
    a run again under the same id replaces it in its place: tables that are being read stay as they are.
    """
    spark = rankings.sparkSession
    run_id = run_id or f"{stamp()}-{uuid.uuid4().hex[:8]}"
    place = committed(spark, root, run_id)
    base = f"{root}/runs/{run_id}/{uuid.uuid4().hex}"
    rankings.write.parquet(f"{base}/rankings")
    cost_structure.write.parquet(f"{base}/cost_structure")
    if charts is not None:
        charts.write.parquet(f"{base}/charts")
    rows = spark.read.parquet(f"{base}/rankings").count()
    _log(spark, root).add({
        "run_id": run_id, "method": method, "timestamp": datetime.now(timezone.utc).isoformat(), "has_data": True, "num_plans": rows,
        "has_charts": charts is not None, "place": place, "folder": base})
    return run_id


def run_metadata(spark: SparkSession, root: str) -> DataFrame | None:
    """One row per run, with its ``place``; None for a folder without runs."""
    if not _log(spark, root).numbers():
        return None
    entries = spark.read.schema(METADATA).json(f"{root}/commits/*.json").withColumn(
        "number", F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)", 1).cast("bigint"))
    last = entries.groupBy("run_id").agg(F.max_by(F.struct(*[c for c in entries.columns if c != "run_id"]), "number").alias("e"))
    return last.select("run_id", "e.*").withColumn("place", F.coalesce("place", "number")).drop("number")


def store_info(spark: SparkSession, root: str) -> dict:
    """Metadata of the newest run, or ``has_data`` False.

    The newest run is the one whose first entry has the greatest number. Entries are read from the end; those before the best
    place so far can't be newer.
    """
    best: dict = {}
    for number, entry in _log(spark, root).newest_first():
        if best and number < best["place"]:
            break
        place = entry["place"] or number
        if not best or place > best["place"]:
            best = entry | {"place": place}
    return best | {"timestamp": datetime.fromisoformat(best["timestamp"])} if best else {"has_data": False}


def has_rankings(spark: SparkSession, root: str) -> bool:
    return bool(store_info(spark, root).get("has_data"))


def load_rankings(spark: SparkSession, root: str, run_id: str | None = None) -> Stored | None:
    """A10: the newest complete run (or the last state of a given one), or nothing."""
    if run_id is None:
        info = store_info(spark, root)
    else:
        info = next((entry for _, entry in _log(spark, root).newest_first() if entry["run_id"] == run_id), {})
    if not info.get("has_data"):
        return None
    base = info["folder"]
    charts = spark.read.parquet(f"{base}/charts") if info["has_charts"] else None
    return Stored(spark.read.parquet(f"{base}/rankings"), spark.read.parquet(f"{base}/cost_structure"), info, charts)


def response(ranked: DataFrame, include_comparison: bool = False) -> DataFrame:
    """The columns a caller receives, free of infinities and missing numbers."""
    if "rank" not in ranked.columns and "rank_number" in ranked.columns:
        ranked = ranked.withColumn("rank", F.col("rank_number"))
    names = RESPONSE + (["B_frontier", "CS_frontier"] if include_comparison else [])
    picked = storable(ranked.select(*[c for c in names if c in ranked.columns]))
    return picked.withColumn("value_ratio", F.col("CS"))

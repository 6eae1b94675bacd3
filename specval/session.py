"""Session defaults and the shared scratch folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "specval", **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="specval-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


SCOPE = "specval.scratch.scope"


def scratch_scope(spark: SparkSession, name: str) -> None:
    """From now on intermediate tables go to the part ``name`` of the application's folder, which can be dropped as a whole."""
    spark.conf.set(SCOPE, name)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Cuts the lineage at a table every executor can reach, so a lost executor repeats only its own tasks, and
    gives Catalyst real file sizes and column pruning for everything that follows.
    """
    spark = df.sparkSession
    path = f"{_folder(spark, spark.conf.get(SCOPE, 'main'))}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession, scope: str | None = None) -> None:
    """Drop the intermediate tables of this application, or of one scope."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_folder(spark, scope))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _folder(spark: SparkSession, scope: str | None) -> str:
    return f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}" + (f"/{scope}" if scope else "")

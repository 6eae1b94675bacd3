"""Stand-in input tables computed from the given star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PLANS_SQL = """
SELECT p_partkey AS id, p_name AS plan_name, p_brand AS mvno,
  CASE p_partkey % 3 WHEN 0 THEN 'M0' WHEN 1 THEN 'M1' ELSE 'M2' END AS mno,
  CASE WHEN p_partkey % 4 = 0 THEN '5G' WHEN p_partkey % 97 = 0 THEN NULL ELSE 'LTE' END AS network,
  CASE WHEN p_size = 50 THEN '999' WHEN p_size = 49 THEN '9999' WHEN p_size = 48 THEN '-1'
       WHEN p_size = 47 THEN 'n/a' ELSE CAST(p_size AS STRING) END AS basic_data,
  CASE WHEN p_partkey % 50 = 1 THEN CAST(999 AS DOUBLE) WHEN p_partkey % 10 = 0 THEN CAST(p_partkey % 6 AS DOUBLE) END AS daily_data,
  CASE p_partkey % 6 WHEN 0 THEN '1Mbps' WHEN 1 THEN '5Mbps' WHEN 2 THEN '400Kbps' WHEN 3 THEN '0.4Mbps' END AS data_exhaustion,
  CASE WHEN p_partkey % 7 = 0 THEN 9996 WHEN p_partkey % 11 = 0 THEN -1 ELSE (p_partkey * 13) % 500 END AS voice,
  CASE WHEN p_partkey % 5 = 0 THEN 999 WHEN p_partkey % 13 = 0 THEN -1 ELSE (p_partkey * 7) % 400 END AS message,
  (p_partkey % 3) * 30 AS additional_call,
  CAST((p_partkey * 3) % 40 AS DOUBLE) AS tethering_gb,
  CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE p_partkey % 2 = 0 END AS agreement,
  CASE p_partkey % 4 WHEN 0 THEN 'UNSUPPORTED' WHEN 1 THEN 'FREE' WHEN 2 THEN 'PAID' END AS usim_delivery_fee_status,
  CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE 6 END AS discount_period,
  CASE WHEN p_partkey % 17 = 0 THEN CAST(0 AS DOUBLE)
       ELSE CAST(3000 + p_size * 200 + ((p_partkey * 13) % 500) * 10 + ((p_partkey * 31) % 40) * 100 AS DOUBLE) END AS original_fee,
  CASE WHEN p_partkey % 101 = 0 THEN CAST(0 AS DOUBLE)
       ELSE CAST(2000 + p_size * 150 + ((p_partkey * 13) % 500) * 8 + ((p_partkey * 29) % 30) * 100 AS DOUBLE) END AS fee
FROM part
"""

PRICED_ITEMS_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS quantity_unlimited,
       l_extendedprice AS original_fee, l_extendedprice * (1 - l_discount) AS fee
FROM lineitem
"""

ITEM_FEATURES = ["l_quantity", "l_discount", "l_tax"]
ITEM_FLAGS = {"l_quantity": "quantity_unlimited"}


ROWS_PER_TASK = 100_000


def spread(df: DataFrame) -> DataFrame:
    """The rows in more partitions where a narrow file of few splits or row groups would give them to a few tasks: what is derived from a row
    costs far more than reading it."""
    tasks = -(-df.count() // ROWS_PER_TASK)
    return df.repartition(tasks) if tasks > df.rdd.getNumPartitions() else df


def plans(spark: SparkSession, folder: str) -> DataFrame:
    part = spread(spark.read.parquet(f"{folder}/part.parquet"))
    return spark.sql(PLANS_SQL.replace("FROM part", "FROM {part}"), part=part)


def priced_items(spark: SparkSession, folder: str) -> DataFrame:
    source = spark.read.parquet(f"{folder}/lineitem.parquet")
    return spark.sql(PRICED_ITEMS_SQL.replace("FROM lineitem", "FROM {lineitem}"), lineitem=source)

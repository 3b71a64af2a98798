"""Forests as DataFrames, and the forest that the driver's tables stand for.

nodes: neuron_id, id, type, x, y, z, radius, parent (-1: root). Every operator is
keyed by neuron_id, so a corpus of neurons is one table.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: One neuron a user; runs unchanged in Spark SQL and DuckDB.
GOLD = """
SELECT CAST(user_id AS BIGINT) AS neuron_id, CAST(id AS BIGINT) AS id,
  CAST(CASE WHEN id = 1 THEN 1 WHEN event_type = 'click' THEN 2 WHEN event_type = 'view' THEN 3 WHEN event_type = 'purchase' THEN 4 ELSE 5 END AS INT) AS type,
  CAST(value AS DOUBLE) AS x, CAST(event_id * 37 % 500 AS DOUBLE) AS y, CAST(event_id * 53 % 300 AS DOUBLE) AS z,
  CAST(0.5 AS DOUBLE) + CAST(event_id % 5 AS DOUBLE) * CAST(0.25 AS DOUBLE) AS radius,
  CAST(CASE WHEN id = 1 OR event_id % 29 = 0 THEN -1 ELSE greatest(1, id - 1 - (event_id % 3)) END AS BIGINT) AS parent
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS id FROM events) e
"""
#: A reconstruction of it: the first nine tenths of each neuron, moved a little.
PRED = """
SELECT CAST(user_id AS BIGINT) AS neuron_id, CAST(id AS BIGINT) AS id,
  CAST(CASE WHEN id = 1 THEN 1 WHEN event_type = 'click' THEN 2 WHEN event_type = 'view' THEN 3 WHEN event_type = 'purchase' THEN 4 ELSE 5 END AS INT) AS type,
  CAST(value AS DOUBLE) + j AS x, CAST(event_id * 37 % 500 AS DOUBLE) + j AS y, CAST(event_id * 53 % 300 AS DOUBLE) + j AS z,
  CAST(0.5 AS DOUBLE) + CAST(event_id % 5 AS DOUBLE) * CAST(0.25 AS DOUBLE) AS radius,
  CAST(CASE WHEN id = 1 OR event_id % 29 = 0 THEN -1 ELSE greatest(1, id - 1 - (event_id % 3)) END AS BIGINT) AS parent
FROM (SELECT *, CAST(event_id % 7 - 3 AS DOUBLE) * CAST(0.5 AS DOUBLE) AS j, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS id, count(*) OVER (PARTITION BY user_id) AS n FROM events) e
WHERE id <= 0.9 * n
"""


def forest(spark: SparkSession, sf_dir: str, sql: str = GOLD) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")
    return spark.sql(sql.replace("FROM events", "FROM {events}"), events=events)


def written(df: DataFrame) -> DataFrame:
    """df through a table in the shared folder: cuts the lineage of iterative plans, and outlives lost executors."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"file://{tempfile.mkdtemp(prefix='dendrica-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)

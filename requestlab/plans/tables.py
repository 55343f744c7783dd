"""The driver's tables as inputs of the request operators, by the same SQL on Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One request per event: label, time and raw text.
REQUESTS_SQL = r"""
SELECT event_id AS request_id, ts,
  CASE WHEN event_type = 'error' THEN 'attack' ELSE 'valid' END AS label,
  concat_ws(chr(10),
    concat(CASE event_id % 5 WHEN 0 THEN 'POST' WHEN 1 THEN 'PROPFIND' ELSE 'GET' END, ' ',
      CASE event_id % 8 WHEN 0 THEN '/' WHEN 1 THEN '/a//b' WHEN 2 THEN '/./x' WHEN 3 THEN '/../etc/passwd'
        WHEN 4 THEN '/p%2541' WHEN 5 THEN '/d%2Fe' WHEN 6 THEN '/<s>' ELSE concat('/', event_type) END,
      CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN '?q=a%20b&bare' WHEN 2 THEN '?x=1&x=2' WHEN 3 THEN '?e=&arr[]=1'
        WHEN 4 THEN '?a=1;b=2' WHEN 5 THEN concat('?token=', user_id) ELSE concat('?n=%C3%A9&z=%00&k=', regexp_extract(props, '[0-9]+', 0)) END,
      CASE WHEN event_id % 97 = 0 THEN '' ELSE ' HTTP/1.1' END),
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'Host: shop.example.com' END,
    'User-Agent: T/1.0 (x)',
    CASE event_id % 4 WHEN 1 THEN concat('Accept: a', chr(10), 'accept: b') WHEN 2 THEN concat('X-Fold: a', chr(10), '  b')
      WHEN 3 THEN 'Connection:    close' END) AS request
FROM events
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task of per-row work gets at most.
DEALT = 50_000


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly by all their columns: a task a core at least, ``DEALT`` rows a task at most.

    The splits of a scan follow bytes and row groups, so a large table may leave all its rows to few tasks.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // DEALT))
    return df.repartition(tasks, *df.columns)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``request_id, ts, label, request`` of every event."""
    events = spread(table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "user_id", "props"))
    return spark.sql(REQUESTS_SQL.replace("FROM events", "FROM {events}"), events=events)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, label, embedding``: label 9 is the attack class."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(F.col("label") == 9, "attack").otherwise("valid").alias("label"), "embedding"
    )

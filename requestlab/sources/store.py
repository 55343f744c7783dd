"""Written intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import os
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join is broadcast.
FEW = 100_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of the warehouse.

    A warehouse on local disks is shared only by a local master; elsewhere it is refused, since
    executors would write where nobody else reads.
    """
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    house = spark.conf.get("spark.sql.warehouse.dir")
    if (house.startswith("file:") or "://" not in house and _local_by_default(spark)) and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share: the warehouse is on a local disk")
    return os.path.join(house, "_intermediate", spark.sparkContext.applicationId)


def _local_by_default(spark: SparkSession) -> bool:
    return spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").startswith("file:")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and return the table read back: later jobs reread files, also when executors are lost."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*written: DataFrame | None) -> None:
    """Delete tables of :func:`materialize` that no later job reads."""
    for df in written:
        if df is not None and (path := _paths.pop(df, None)):
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def beside(side: DataFrame, most: int = FEW) -> DataFrame:
    """A written table as the side of a join: broadcast if it is counted to have ``most`` rows or fewer."""
    return F.broadcast(side) if side.limit(most + 1).count() <= most else side.hint("merge")

"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local folder in local mode, an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts its lineage, and fixes what a rerun might order otherwise. It goes with discard(), at the latest as the driver's JVM ends."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    folder = _path(spark, path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return out


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def discard(table: DataFrame) -> None:
    """Delete a written table that nothing reads any more."""
    spark = table.sparkSession
    folder = _path(spark, table._folder)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    store.delete(folder, True)
    store.cancelDeleteOnExit(folder)

"""Cutting lineage in iterative plans: tables in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def _delete(df: DataFrame, path: str, now: bool) -> None:
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if now:
        store.delete(where, True)
    else:
        store.deleteOnExit(where)


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder named in spark.checkpoint.dir and reads it again; it goes with the application."""
    spark = df.sparkSession
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{root}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _delete(df, path, False)
    found = spark.read.schema(df.schema).parquet(path)
    found._tm_path = path
    return found


def drop(*cuts: DataFrame) -> None:
    """Removes tables of cut() that no plan reads any more."""
    for df in cuts:
        _delete(df, df._tm_path, True)

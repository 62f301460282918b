"""Small helpers shared by the operators: scratch tables, tokenizer paths and slices of Arrow batches."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str) -> str:
    """A file's own path, or the place of a file that the public_tokenizers package holds."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; without one there is no safe place."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there goes when the application ends."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def saved(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes df as Parquet to the shared folder and reads it again, which cuts its lineage; also the path."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, *paths: str) -> None:
    """Removes scratch tables that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables that only the steps within a `with` block read; they go at its end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def saved(self, df: DataFrame, name: str) -> DataFrame:
        found, path = saved(df, name)
        self.paths.append(path)
        return found

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        forget(self.spark, *self.paths)


def part(array: Column, first: Column, last: Column) -> Column:
    """The elements from first to last, in time of their number; slice would read the whole array in a lambda."""
    return F.when(first <= last, F.transform(F.sequence(first, last), lambda i: F.element_at(array, i))).otherwise(F.slice(array, 1, 0))


def runs_of(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Splits 0..len(sizes) into ranges whose sizes add up to at most `most` (one item may exceed it alone)."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)

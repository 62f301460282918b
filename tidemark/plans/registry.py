"""Registering queries: SQL that two engines read alike, or a function and the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """A query in Spark SQL whose tables are in braces; oracle: the DuckDB text where dialects differ."""
    names = sorted(set(re.findall(r"\{(\w+)\}", text)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})

    run.__name__ = run.__qualname__ = name
    QUERIES[name] = run
    ORACLE[name] = (oracle or text).replace("{", "").replace("}", "")


def query(oracle: str | None = None):
    """Decorates a function (spark, sf_dir) -> DataFrame, which is registered by its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add

"""Writing an estate: its graph, tables made where they are missing, updates by predicate, and rows that tell of a step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str, estate: str) -> None:
    """Vertices and edges of one estate as Parquet; what the folder holds of the same estate is replaced, others stay."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.withColumn("estate", F.lit(estate)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("estate").parquet(f"{folder}/{name}")


def read_graph(spark: SparkSession, folder: str, estate: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one estate; only its partition is read."""
    nodes, edges = (spark.read.parquet(f"{folder}/{name}").filter(F.col("estate") == estate).drop("estate") for name in ("nodes", "edges"))
    return nodes, edges


def create_if_missing(spark: SparkSession, name: str, schema: str) -> bool:
    """Makes an empty table unless there is one; whether it was made."""
    known = spark.catalog.tableExists(name)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet")
    return not known


def update_where(df: DataFrame, test: Column, values: dict[str, Column]) -> DataFrame:
    """The rows with new values where the test holds; it is null, so false, where it can't be told. Written elsewhere."""
    return df.withColumns({c: F.when(test, v).otherwise(F.col(c)) for c, v in values.items()})


def step_row(df: DataFrame, step: str, least: int = 1) -> DataFrame:
    """One row: the step, its rows, and OK or, with fewer than `least`, WARN."""
    return df.agg(F.count("*").alias("row_count")).select(F.lit(step).alias("step"), "row_count", F.when(F.col("row_count") >= least, "OK").otherwise("WARN").alias("status"))

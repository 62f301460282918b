"""The stage algebra of dataflow tools: eleven stages, each a function from tables to a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

JOINS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "leftouter": "left", "rightouter": "right", "fullouter": "full"}


def source(spark, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def sink(df: DataFrame, path: str, mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    """mode append adds rows, overwrite replaces the table."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def insert_new(df: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key the target doesn't have: what an idempotent append adds."""
    return df.join(target.select(*keys).distinct(), keys, "left_anti")


def join(left: DataFrame, right: DataFrame, keys: list[str], kind: str = "inner") -> DataFrame:
    return left.join(right, keys, JOINS[kind.lower().replace("_", "").replace(" ", "")])


def sort(df: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() if d.lower().startswith("d") else F.col(c).asc() for c, d in keys])


def dedup(df: DataFrame, keys: list[str], order: list[str], keep: str = "first") -> DataFrame:
    """Of each key the first or last row in a total order."""
    by = [F.col(c).asc() if keep == "first" else F.col(c).desc() for c in order]
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter("_nth = 1").drop("_nth")


def first_and_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the first and the last row in a total order, told apart by `kept`; one shuffle serves both."""
    row, by = F.struct(*df.columns), F.struct(*order)
    ends = df.groupBy(*keys).agg(F.min_by(row, by).alias("first"), F.max_by(row, by).alias("last"))
    both = ends.select(F.explode(F.array(F.struct(F.lit("first").alias("kept"), F.col("first").alias("r")), F.struct(F.lit("last").alias("kept"), F.col("last").alias("r")))).alias("x"))
    return both.select("x.r.*", "x.kept")


def aggregate(df: DataFrame, keys: list[str], aggregates: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(name) for name, c in aggregates.items()])


def lookup(df: DataFrame, reference: DataFrame, keys: list[str], fail: bool = False) -> DataFrame:
    """A left join, or an inner one where rows without a match are rejected; Spark broadcasts a side it knows is small."""
    return df.join(reference, keys, "inner" if fail else "left")


def filter_rows(df: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and rejects (false or null)."""
    return df.filter(keep), df.filter(~F.coalesce(keep, F.lit(False)))


def router(df: DataFrame, routes: dict[str, Column], default: str = "default") -> DataFrame:
    """Adds `route`: the first condition that holds, else the default."""
    chosen = None
    for name, condition in routes.items():
        chosen = F.when(condition, name) if chosen is None else chosen.when(condition, name)
    return df.withColumn("route", F.lit(default) if chosen is None else chosen.otherwise(default))


def union(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def transform(df: DataFrame, derivations: dict[str, Column]) -> DataFrame:
    """Derived columns, each of which may use those before it."""
    for name, c in derivations.items():
        df = df.withColumn(name, c)
    return df


def surrogate_key(df: DataFrame, order: list[str], out: str = "sk", start: int = 1) -> DataFrame:
    """Dense keys in a total order, numbered by range partitions, without bringing all rows to one task."""
    from ..functions.scratch import cut

    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))  # one row for each partition
    number = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + start
    return placed.join(F.broadcast(offsets), part == F.col("_part")).withColumn(out, number).select(*df.columns, out)

"""Slowly changing dimensions and upserts, as whole-table rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN_END = "9999-12-31"


def scd2(changes: DataFrame, key: str, at: str, tiebreak: str) -> DataFrame:
    """Adds version, effective_from, effective_to (OPEN_END for the current one) and is_current."""
    w = Window.partitionBy(key).orderBy(at, tiebreak)
    following = F.lead(F.date_format(at, "yyyy-MM-dd")).over(w)
    return changes.withColumns({"version": F.row_number().over(w).cast("long"), "effective_from": F.date_format(at, "yyyy-MM-dd"), "effective_to": F.coalesce(following, F.lit(OPEN_END)), "is_current": following.isNull()})


def as_of(history: DataFrame, day: str) -> DataFrame:
    """The versions in force on a day."""
    return history.filter((F.col("effective_from") <= day) & (F.col("effective_to") > day))


def merge(target: DataFrame, source: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Upsert: the source's values where it has the key, else the target's; `action` says which."""
    t = target.select(*keys, *[F.col(v).alias(f"_t_{v}") for v in values], F.lit(True).alias("_in_t"))
    s = source.select(*keys, *[F.col(v).alias(f"_s_{v}") for v in values], F.lit(True).alias("_in_s"))
    in_s, in_t = F.col("_in_s").isNotNull(), F.col("_in_t").isNotNull()
    action = F.when(in_s & in_t, "update").when(in_s, "insert").otherwise("keep")
    return t.join(s, keys, "full").select(*keys, *[F.when(in_s, F.col(f"_s_{v}")).otherwise(F.col(f"_t_{v}")).alias(v) for v in values], action.alias("action"))


def update_from(target: DataFrame, source: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """UPDATE … FROM: values of matching rows are replaced, others stay; source keys must be unique."""
    s = source.select(*keys, *[F.col(v).alias(f"_s_{v}") for v in values], F.lit(True).alias("_hit"))
    joined = target.join(s, keys, "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in target.columns])

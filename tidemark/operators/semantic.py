"""Rules in column lineage: CASE expressions, contracts of procedures, and logic that is alike or in conflict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of an expression that evidence shows, and names that it lists.
SHOWN, NAMED = 80, 3


def normalised(expression: Column) -> Column:
    """Upper case, white space collapsed."""
    return F.upper(F.trim(F.regexp_replace(expression, r"\s+", " ")))


def case_rules(lineage: DataFrame) -> DataFrame:
    """(type, fqn, snippet, confidence, source_ref) of each column that a CASE makes."""
    name = F.concat_ws(".", "target_table", "target_column")
    found = lineage.filter(F.upper("transform").rlike(r"\bCASE\s+WHEN\b"))
    return found.select(F.lit("business_rule").alias("type"), name.alias("fqn"), F.substring("transform", 1, SHOWN).alias("snippet"), F.lit(0.85).alias("confidence"), F.concat_ws(":", "target_table", "target_column").alias("source_ref")).distinct()


def contracts(procedures: DataFrame, words: dict[str, str]) -> DataFrame:
    """(type, fqn, snippet, confidence, source_ref, meaning): procedures (fqn, reads) whose names hold one of the words and
    that read tables; words: what each means."""
    meaning = F.lit(None).cast("string")
    for word, text in words.items():
        meaning = F.when(F.upper("fqn").contains(word.upper()), text).otherwise(meaning)
    found = procedures.withColumn("meaning", meaning).filter(F.col("meaning").isNotNull() & (F.size("reads") > 0))
    return found.select(F.lit("implicit_contract").alias("type"), "fqn", F.concat(F.lit("reads "), F.array_join(F.array_sort("reads"), ", ")).alias("snippet"), F.lit(0.8).alias("confidence"), F.col("fqn").alias("source_ref"), "meaning")


def similar_logic(lineage: DataFrame) -> DataFrame:
    """(expression, columns, names): expressions, without regard to case and white space, that make several columns.

    names are the first NAMED columns by alphabet. A row of lineage for each source counts its column once.
    """
    made = lineage.filter("transform is not null").select(normalised(F.col("transform")).alias("expression"), F.concat_ws(".", "target_table", "target_column").alias("name")).distinct()
    groups = made.groupBy("expression").agg(F.count("*").alias("columns"), F.array_sort(F.collect_set("name")).alias("names")).filter("columns > 1")
    return groups.select("expression", "columns", F.array_join(F.slice("names", 1, NAMED), ", ").alias("names"))


def conflicting_logic(lineage: DataFrame) -> DataFrame:
    """(target_column, expressions): columns of one name that different expressions make, in whatever tables."""
    made = lineage.filter("transform is not null").select("target_column", normalised(F.col("transform")).alias("e"))
    return made.groupBy("target_column").agg(F.countDistinct("e").alias("expressions")).filter("expressions > 1")


def review_queue(lineage: DataFrame, least: float = 0.6) -> DataFrame:
    """Rows of column lineage that a human should look at, the least certain first."""
    return lineage.filter(F.col("confidence") < least).orderBy("confidence", "target_table", "target_column")

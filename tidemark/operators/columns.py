"""Columns across an estate: their graph, identities, expressions, registers, and SQL made of their lineage.

Column lineage has rows target_table, target_column, source_table, source_column, transform, confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import closure, reversed_edges

REFERENCE = r"\b([A-Za-z_]\w*\.[A-Za-z_]\w*)\b"


def column_edges(lineage: DataFrame) -> DataFrame:
    """(src, dst, transform, confidence) between TABLE.COLUMN names; unresolved rows, without a source, give none."""
    return lineage.filter("source_table is not null and source_column is not null").select(F.concat_ws(".", "source_table", "source_column").alias("src"), F.concat_ws(".", "target_table", "target_column").alias("dst"), "transform", "confidence")


def journey(lineage: DataFrame, column: str) -> DataFrame:
    """(direction, fqn, hops, transform, confidence): all columns before and after one, nearest first.

    transform and confidence are those of the most certain edge by which a column is reached in the least hops.
    """
    edges, spark = column_edges(lineage), lineage.sparkSession
    root = spark.createDataFrame([(column,)], "root string")
    out = None
    for name, way in (("upstream", reversed_edges(edges)), ("downstream", edges.select("src", "dst"))):
        found = closure(way, root).filter(F.col("node") != column).select("node", "hops")
        before = found.select(F.col("node").alias("from"), F.col("hops").alias("h")).unionByName(spark.createDataFrame([(column, 0)], "from string, h int"))
        a, b = ("dst", "src") if name == "upstream" else ("src", "dst")
        last = edges.select(F.col(a).alias("from"), F.col(b).alias("node"), "transform", "confidence").join(before, "from").join(found, "node").filter(F.col("h") + 1 == F.col("hops"))
        best = last.groupBy("node", "hops").agg(F.max_by(F.struct("transform", "confidence"), F.struct("confidence", "transform")).alias("e"))
        rows = best.select(F.lit(name).alias("direction"), F.col("node").alias("fqn"), "hops", "e.transform", "e.confidence")
        out = rows if out is None else out.unionByName(rows)
    return out


def hops(lineage: DataFrame) -> DataFrame:
    """(column_name, upstream, downstream, hops_ref, depth) of each target column.

    upstream and downstream are how many columns there are each way, hops_ref the larger of the two (at least 1), and
    depth the true distance of the farthest column upstream.
    """
    edges = column_edges(lineage)
    up = closure(reversed_edges(edges)).filter("root <> node").groupBy(F.col("root").alias("column_name")).agg(F.count("*").alias("upstream"), F.max("hops").alias("depth"))
    down = closure(edges).filter("root <> node").groupBy(F.col("root").alias("column_name")).agg(F.count("*").alias("downstream"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    rows = edges.select(F.col("dst").alias("column_name")).distinct().join(up, "column_name", "left").join(down, "column_name", "left")
    return rows.select("column_name", zero("upstream").alias("upstream"), zero("downstream").alias("downstream"), F.greatest(zero("upstream"), zero("downstream"), F.lit(1)).cast("long").alias("hops_ref"), zero("depth").alias("depth"))


def identities(columns: DataFrame) -> DataFrame:
    """(canonical_id, fqn, aliases, confidence): columns (table_name, column_name) that are one thing in several tables.

    The canonical name is the column's with _KEY or _FK at its end as _ID, in lower case; names of one column alone give
    no row. aliases are the others of the group; 1.0 is the confidence of an identifier, 0.85 that of other names.
    """
    named = columns.select(F.lower(F.regexp_replace("column_name", "(?i)(_ID|_KEY|_FK)$", "_ID")).alias("canonical_id"), F.concat_ws(".", "table_name", "column_name").alias("fqn")).distinct()
    groups = named.groupBy("canonical_id").agg(F.sort_array(F.collect_set("fqn")).alias("members")).filter(F.size("members") > 1)
    each = groups.select("canonical_id", F.explode("members").alias("fqn"), "members")
    return each.select("canonical_id", "fqn", F.array_except("members", F.array("fqn")).alias("aliases"), F.when(F.col("canonical_id").endswith("_id"), 1.0).otherwise(0.85).alias("confidence"))


def expression_type(expression: Column) -> Column:
    """direct, conditional, function, expression, constant, or passthrough where there is none."""
    e = F.trim(expression)
    return (
        F.when(F.coalesce(e, F.lit("")) == "", "passthrough")
        .when(e.rlike(r"^[A-Za-z_]\w*\.[A-Za-z_]\w*$"), "direct")
        .when(F.upper(e).rlike("IF|ELSE"), "conditional")
        .when(e.contains("("), "function")
        .when(e.rlike(r"[-+*/%]"), "expression")
        .when(e.rlike("^['\"]"), "constant")
        .otherwise("expression")
    )


def expression_sources(expression: Column) -> Column:
    """The distinct LINK.COLUMN names in an expression, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(expression, F.lit("")), F.lit(REFERENCE), F.lit(1))))


def cardinality(expression: Column) -> Column:
    return F.when(F.size(expression_sources(expression)) > 1, "N->1").otherwise("1->1")


def stage_lineage(stages: DataFrame, links: DataFrame) -> DataFrame:
    """A row a link (name, source_stage, target_stage): its stages' names and types (name, type), and what comes in.

    input_link is the first by name of the links into the source stage, empty where there is none.
    """
    first = links.groupBy(F.col("target_stage").alias("source_stage")).agg(F.min("name").alias("input_link"))
    kind = lambda end, out: stages.select(F.col("name").alias(end), F.col("type").alias(out))
    rows = links.join(first, "source_stage", "left").join(kind("source_stage", "stage_type"), "source_stage", "left").join(kind("target_stage", "next_stage_type"), "target_stage", "left")
    said = lambda c, out: F.coalesce(c, F.lit("")).alias(out)
    return rows.select(said("input_link", "input_link"), said("source_stage", "stage_name"), said("stage_type", "stage_type"), said("name", "output_link"), said("target_stage", "next_stage_name"), said("next_stage_type", "next_stage_type"))


def generated_sql(lineage: DataFrame) -> DataFrame:
    """(target_table, sql): a SELECT for each target, of its columns' transforms from all of its sources."""
    item = F.concat(F.coalesce("transform", F.concat_ws(".", "source_table", "source_column")), F.lit(" AS "), F.col("target_column"))
    per = lineage.filter("source_table is not null").groupBy("target_table").agg(F.array_sort(F.collect_set(item)).alias("items"), F.array_sort(F.collect_set("source_table")).alias("sources"))
    return per.select("target_table", F.concat(F.lit("SELECT "), F.array_join("items", ", "), F.lit(" FROM "), F.array_join("sources", ", ")).alias("sql"))


def source_to_target(lineage: DataFrame, tiers: DataFrame) -> DataFrame:
    """A register row for each column mapping, with type, cardinality and the medallion tier of its target (tiers: table_name, tier)."""
    t = tiers.select(F.col("table_name").alias("target_table"), F.col("tier"))
    rows = lineage.join(t, "target_table", "left")
    schema = lambda c: F.when(F.col(c).contains("."), F.substring_index(c, ".", 1)).otherwise(F.lit(""))
    return rows.select(schema("source_table").alias("source_schema"), "source_table", "source_column", schema("target_table").alias("target_schema"), "target_table", "target_column", "transform", expression_type(F.col("transform")).alias("transform_type"), cardinality(F.col("transform")).alias("cardinality"), "confidence", F.coalesce("tier", F.lit("bronze")).alias("tier"))


def matches_name(name: Column, wanted: str) -> Column:
    """Whether a name, or a part of it between `->` and commas, holds the wanted one or lies in it, in any case."""
    parts = F.filter(F.transform(F.split(F.upper(name), r"->|,"), F.trim), lambda p: p != "")
    w = wanted.strip().upper()
    return F.exists(parts, lambda p: p.contains(w) | F.lit(w).contains(p)) if w else F.lit(False)

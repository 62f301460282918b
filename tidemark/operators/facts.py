"""Facts about an estate, each with its evidence: (type, fqn, snippet, confidence, source_ref)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Named columns that a table's fact shows, and letters of a view's text.
SHOWN, LETTERS = 5, 120


def _fact(kind: str, fqn: Column, snippet: Column, confidence: Column | float, source: Column) -> list[Column]:
    return [F.lit(kind).alias("type"), fqn.alias("fqn"), snippet.alias("snippet"), (F.lit(confidence) if isinstance(confidence, float) else confidence).alias("confidence"), source.alias("source_ref")]


def table_facts(columns: DataFrame) -> DataFrame:
    """Of columns (fqn, name, ordinal): how many a table has, and the first ones' names."""
    n = F.row_number().over(Window.partitionBy("fqn").orderBy("ordinal", "name"))
    first = F.sort_array(F.collect_list(F.when(F.col("n") <= SHOWN, F.struct("n", "name"))))
    t = columns.withColumn("n", n).groupBy("fqn").agg(F.count("*").alias("columns"), F.array_join(F.transform(first, lambda x: x["name"]), ", ").alias("names"))
    return t.select(*_fact("table", F.col("fqn"), F.concat(F.col("columns").cast("string"), F.lit(" columns: "), "names"), 0.95, F.concat(F.lit("DDL:"), "fqn")))


def view_facts(views: DataFrame) -> DataFrame:
    """Of views (fqn, sql, unresolved): the beginning of their text; less sure where it hides references."""
    short = F.when(F.length("sql") > LETTERS, F.concat(F.substring("sql", 1, LETTERS), F.lit("…"))).otherwise(F.col("sql"))
    return views.select(*_fact("view", F.col("fqn"), short, F.when(F.col("unresolved"), 0.5).otherwise(0.9), F.concat(F.lit("VIEW:"), "fqn")))


def job_facts(jobs: DataFrame) -> DataFrame:
    """Of jobs (fqn, source, target, dialect)."""
    return jobs.select(*_fact("etl_job", F.col("fqn"), F.concat("source", F.lit(" → "), "target", F.lit(" ("), "dialect", F.lit(")")), 0.9, F.col("fqn")))


def schedule_facts(schedules: DataFrame) -> DataFrame:
    """Of schedules (fqn, expr, frequency): when they run."""
    return schedules.select(*_fact("operational", F.col("fqn"), F.concat_ws(" ", "expr", "frequency"), 0.8, F.col("fqn")))


def procedure_failures(procedures: DataFrame) -> DataFrame:
    """Of procedures (fqn, has_cursor, has_dynamic, complexity): cursors, and dynamic SQL in complex ones."""
    cursor = procedures.filter("has_cursor").select(*_fact("failure_path", F.col("fqn"), F.lit("CURSOR"), 0.85, F.col("fqn")))
    dynamic = procedures.filter("has_dynamic and complexity = 'high'").select(*_fact("failure_path", F.col("fqn"), F.lit("dynamic SQL, high complexity"), 0.9, F.col("fqn")))
    return cursor.unionByName(dynamic)


def dependencies(edges: DataFrame, kinds: tuple[str, ...] = ("SCHEDULE_DEPENDS", "SP_CALLS")) -> DataFrame:
    """Edges (src, dst, kind) of control flow."""
    return edges.filter(F.col("kind").isin(*kinds)).select(*_fact("dependency", F.concat("src", F.lit(" -> "), "dst"), F.col("kind"), 0.9, F.concat("src", F.lit("->"), "dst")))


def rejects(flows: DataFrame) -> DataFrame:
    """Of reject routes (job, route, target, artifact): where rejected rows go."""
    return flows.select(*_fact("reject_handling", F.col("job"), F.concat("route", F.lit(" route -> "), "target"), 0.9, F.col("artifact")))


def run_facts(runs: DataFrame) -> DataFrame:
    """Of runs (job, artifact, status, failed_steps, ran_on): those not completed or with failed steps, and a summary
    of each artifact on its first day. A run without a status has not completed."""
    status = F.coalesce(F.upper("status"), F.lit("UNKNOWN"))
    steps = F.coalesce(F.array_join("failed_steps", ", "), F.lit(""))
    detail = F.concat(status, F.when(steps != "", F.concat(F.lit(" (failed steps: "), steps, F.lit(")"))).otherwise(""), F.lit(" on run "), F.coalesce("ran_on", F.lit("unknown")), F.lit(" via "), F.col("artifact"))
    failed = runs.filter((status != "COMPLETED") | (steps != "")).select(*_fact("runtime_failure", F.col("job"), detail, 0.95, F.col("artifact")))
    by = runs.groupBy("artifact").agg(F.count("*").alias("n"), F.count_if(status == "COMPLETED").alias("done"), F.min("ran_on").alias("on"))
    said = F.concat(F.col("n").cast("string"), F.lit(" jobs ran, "), F.col("done").cast("string"), F.lit(" completed ("), F.coalesce("on", F.lit("unknown run")), F.lit(")"))
    return failed.unionByName(by.select(*_fact("operational", F.col("artifact"), said, 0.95, F.col("artifact"))))

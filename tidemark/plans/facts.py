"""Facts about structure and behaviour, with orders as runs of jobs and as columns of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facts
from .registry import query, table


@query("""WITH r AS (SELECT CAST(o_orderkey AS VARCHAR) AS job, o_orderpriority AS artifact, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' ELSE upper(o_orderstatus) END AS status, strftime(o_orderdate, '%Y-%m-%d') AS ran_on FROM orders)
SELECT 'runtime_failure' AS type, job AS fqn, concat(status, ' on run ', ran_on, ' via ', artifact) AS snippet, 0.95::DOUBLE AS confidence, artifact AS source_ref FROM r WHERE status <> 'COMPLETED'
UNION ALL SELECT 'operational', artifact, concat(COUNT(*), ' jobs ran, ', COUNT(*) FILTER (status = 'COMPLETED'), ' completed (', MIN(ran_on), ')'), 0.95, artifact FROM r GROUP BY artifact""")
def behavior_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").otherwise(F.col("o_orderstatus"))
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("job"), F.col("o_orderpriority").alias("artifact"), status.alias("status"), F.array().cast("array<string>").alias("failed_steps"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("ran_on"))
    return facts.run_facts(runs)


@query("""WITH c AS (SELECT CAST(o_custkey AS VARCHAR) AS fqn, CAST(o_orderkey AS VARCHAR) AS name, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
SELECT 'table' AS type, fqn, concat(COUNT(*), ' columns: ', string_agg(name, ', ' ORDER BY n) FILTER (n <= 5)) AS snippet, 0.95::DOUBLE AS confidence, concat('DDL:', fqn) AS source_ref FROM c GROUP BY fqn""")
def structure_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("fqn"), F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderkey").alias("ordinal"))
    return facts.table_facts(columns)

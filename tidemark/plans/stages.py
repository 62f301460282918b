"""The stage algebra on the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import computed
from ..functions.dialect import money
from ..operators import stages
from ..sources import estate
from .registry import query, table


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def stage_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    return stages.join(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k")), c, ["k"], "inner").select("o_orderkey", "c_name")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey")
def stage_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.sort(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), [("c_acctbal", "desc"), ("c_custkey", "asc")])


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax) AS a, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'first' AS kept FROM r WHERE a = 1 UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'last' FROM r WHERE b = 1""")
def dedup_keep_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, order = table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax"]
    columns = ["l_orderkey", "l_linenumber", *order]
    return stages.first_and_last(li.select(*columns), columns[:2], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "kept")


@query("SELECT l_suppkey, COUNT(*) AS lines, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM lineitem GROUP BY l_suppkey")
def stage_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.aggregate(table(spark, sf_dir, "lineitem"), ["l_suppkey"], {"lines": F.count("*"), "value": F.sum(money(F.col("l_extendedprice"))).cast("double")})


@query("SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey < 3")
def stage_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("k"), "n_name")
    return stages.lookup(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k")), n, ["k"]).select("s_suppkey", "n_name")


@query("SELECT (SELECT COUNT(*) FROM lineitem WHERE l_quantity >= 5 AND l_discount < 0.1) AS kept, (SELECT COUNT(*) FROM lineitem WHERE NOT coalesce(l_quantity >= 5 AND l_discount < 0.1, false)) AS rejected")
def stage_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, rejected = stages.filter_rows(table(spark, sf_dir, "lineitem"), (F.col("l_quantity") >= 5) & (F.col("l_discount") < 0.1))
    return kept.agg(F.count("*").alias("kept")).crossJoin(rejected.agg(F.count("*").alias("rejected")))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'default' END AS route FROM orders")
def stage_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = {"large": F.col("o_totalprice") > 200000, "closed": F.col("o_orderstatus") == "F"}
    return stages.router(table(spark, sf_dir, "orders"), routes).select("o_orderkey", "route")


@query("SELECT c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_nationkey, NULL FROM supplier")
def stage_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return stages.union(c, table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross FROM lineitem")
def stage_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = stages.transform(table(spark, sf_dir, "lineitem"), {"net": F.col("l_extendedprice") * (1 - F.col("l_discount")), "gross": F.col("net") * (1 + F.col("l_tax"))})
    return done.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "net", "gross")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS sk FROM part")
def surrogate_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.surrogate_key(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), ["p_retailprice", "p_partkey"]).select("p_partkey", "sk")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def stage_insert_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing = table(spark, sf_dir, "orders").filter("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return stages.insert_new(table(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey"), existing, ["c_custkey"])


@query("""WITH a AS (SELECT *, CASE WHEN l_quantity > 25 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS rate, l_quantity * l_extendedprice AS net FROM lineitem), b AS (SELECT *, net * (1 + rate) AS gross FROM a)
SELECT l_orderkey, l_linenumber, rate, net, gross, CASE WHEN gross > 100000 THEN 'large' ELSE concat('small ', l_linenumber) END AS label FROM b""")
def computed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the columns that a table's definition computes, which name each other in no order."""
    ddl = "CREATE TABLE DW.LINES (label AS (CASE WHEN GROSS > 100000 THEN 'large' ELSE concat('small ', l_linenumber) END), gross AS ([net] * (1 + rate)), net AS (l_quantity * l_extendedprice), rate AS (CASE WHEN l_quantity > 25 THEN 0.5D ELSE 0.25D END))"
    columns = estate.tables(spark.createDataFrame([("lines.sql", ddl)], "path string, text string"))
    rows = computed.with_computed(table(spark, sf_dir, "lineitem"), computed.definitions_of(columns, "DW.LINES"))
    return rows.select("l_orderkey", "l_linenumber", "rate", "net", "gross", "label")

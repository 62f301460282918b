"""Open ends of a migration: worklist, proposals, overrides and the first scope, over the star schema as an estate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import overrides, remediation
from .registry import query, table

SCHEMAS = "CASE s_nationkey % 5 WHEN 0 THEN 'ERP' WHEN 1 THEN 'DW_AUDIT' WHEN 2 THEN 'BI' ELSE 'DW' END"
ITEMS = f"items AS (SELECT concat({SCHEMAS}, '.', s_name) AS fqn, CASE WHEN s_acctbal < 0 THEN 'unresolved_view' ELSE 'missing_object' END AS kind FROM supplier)"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(f"concat({SCHEMAS}, '.', s_name) AS fqn", "CASE WHEN s_acctbal < 0 THEN 'unresolved_view' ELSE 'missing_object' END AS kind")


@query("""WITH x AS (SELECT concat('BI.', o_orderpriority) AS fqn, 'missing_object' AS kind, o_orderstatus AS reason, CAST(o_custkey AS VARCHAR) AS referenced_by FROM orders
UNION ALL SELECT c_name, 'unresolved_view', 'dynamic statements hide references', 'view definition' FROM customer WHERE c_acctbal < 0)
SELECT fqn, kind, reason, referenced_by FROM (SELECT *, row_number() OVER (PARTITION BY fqn, kind ORDER BY reason, referenced_by) AS n FROM x) WHERE n = 1""")
def unresolved_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "orders").select(F.concat(F.lit("BI."), "o_orderpriority").alias("fqn"), F.col("o_orderstatus").alias("reason"), F.col("o_custkey").cast("string").alias("referenced_by"))
    objects = table(spark, sf_dir, "customer").select(F.col("c_name").alias("fqn"), F.lit("view").alias("kind"), (F.col("c_acctbal") < 0).alias("unresolved"))
    return remediation.worklist(refs, objects)


@query(f"""WITH {ITEMS}, known AS (SELECT concat('MART.', s_name) AS candidate, upper(s_name) AS leaf FROM supplier)
SELECT fqn, kind, action, CASE WHEN action IN ('correct_reference', 'map_alias') THEN candidate END AS target, confidence FROM (
SELECT fqn, kind, candidate, CASE WHEN kind LIKE 'unresolved%' THEN 'capture_runtime_sql' WHEN fqn LIKE 'ERP.%' OR fqn LIKE 'DW_AUDIT.%' THEN 'confirm_external' WHEN fqn LIKE 'BI.%' THEN 'correct_reference' WHEN candidate IS NOT NULL THEN 'map_alias' ELSE 'define_ddl' END AS action,
CAST(CASE WHEN kind LIKE 'unresolved%' THEN 0.7 WHEN fqn LIKE 'ERP.%' THEN 0.6 WHEN fqn LIKE 'DW_AUDIT.%' THEN 0.65 WHEN fqn LIKE 'BI.%' THEN 0.55 WHEN candidate IS NOT NULL THEN 0.7 ELSE 0.6 END AS DOUBLE) AS confidence
FROM items LEFT JOIN known ON upper(split_part(fqn, '.', 2)) = leaf)""")
def remediation_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    known = table(spark, sf_dir, "supplier").select(F.concat(F.lit("MART."), "s_name").alias("fqn"))
    targets = remediation.exact_candidates(items, known).withColumn("rank", F.lit(1))
    return remediation.proposals(items, targets, ("ERP",))


@query("""WITH a AS (SELECT c_custkey AS alias, c_custkey - c_custkey % 10 AS target FROM customer WHERE c_acctbal < 1000)
SELECT coalesce(a.target, o_custkey) AS src, o_orderpriority AS dst, 'OWNS' AS kind, MAX(o_totalprice) AS confidence FROM orders LEFT JOIN a ON a.alias = o_custkey GROUP BY 1, 2""")
def alias_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderpriority").alias("dst"), F.lit("OWNS").alias("kind"), F.col("o_totalprice").alias("confidence"))
    customers = table(spark, sf_dir, "customer").filter("c_acctbal < 1000")
    aliases = customers.selectExpr("c_custkey AS alias", "c_custkey - c_custkey % 10 AS target", "c_custkey AS seq")
    # names of the two ends are of different kinds here, so both are compared as text
    text = lambda df, *cs: df.withColumns({c: F.col(c).cast("string") for c in cs})
    return remediation.apply_aliases(text(edges, "src"), text(aliases, "alias", "target")).withColumn("src", F.col("src").cast("bigint"))


@query("""WITH q AS (SELECT c_name AS fqn, COUNT(o_orderkey) AS value, c_nationkey % 5 AS risk FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_name, c_nationkey),
n AS (SELECT COUNT(*) FILTER (risk <= 1) AS one, COUNT(*) FILTER (risk <= 2) AS two FROM q), s AS (SELECT fqn FROM q, n WHERE CASE WHEN one >= 10 THEN risk <= 1 WHEN two >= 10 THEN risk <= 2 ELSE TRUE END ORDER BY value DESC, fqn LIMIT 18)
SELECT fqn, 'chosen' AS role FROM s UNION ALL SELECT DISTINCT concat('order:', o_orderkey), 'feeding' FROM orders JOIN customer ON c_custkey = o_custkey JOIN s ON s.fqn = c_name""")
def wedge_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    value = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("value"))
    quadrant = customers.join(value, "c_custkey", "left").select(F.col("c_name").alias("fqn"), F.coalesce("value", F.lit(0)).alias("value"), (F.col("c_nationkey") % 5).alias("risk"))
    feeds = orders.join(customers.select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("touches")), "o_custkey").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("fqn"), "touches")
    return remediation.wedge(quadrant, customers.select(F.col("c_name").alias("fqn")), feeds)


@query()
def close_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspelled names of suppliers and parts and the known ones that are nearest; difflib's ratios have no SQL."""
    named = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name")).unionByName(table(spark, sf_dir, "part").select(F.col("p_name").alias("name"))).distinct()
    items = named.select(F.concat(F.lit("OLD."), F.regexp_replace(F.translate("name", ".", "_"), "er#0|e", "x")).alias("fqn"))
    return remediation.candidates(items, named.select(F.concat(F.lit("DW."), F.translate("name", ".", "_")).alias("fqn")))


#: Decisions over customers' names: a third move to another name, some are stubs; their order is that of a shuffled key.
_MOVED = "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat('C', (c_custkey * 7 + c_nationkey) % 1000) END"
_DECIDED = f"SELECT concat('C', c_custkey % 1000) AS subject, CASE WHEN c_custkey % 5 = 0 THEN 'stub' ELSE 'alias' END AS kind, {_MOVED} AS target, c_custkey * 37 % 10007 * 1000000 + c_custkey AS seq FROM customer WHERE c_custkey % 3 = 0"


@query(f"""WITH RECURSIVE o AS (SELECT subject, kind, coalesce(target, subject) AS t, row_number() OVER (ORDER BY seq) AS pos FROM ({_DECIDED})),
made AS (SELECT fqn, MIN(made) AS made FROM (SELECT concat('C', c_custkey % 1000) AS fqn, 0 AS made FROM customer WHERE c_acctbal > 0 UNION ALL SELECT t, pos FROM o WHERE kind = 'stub') GROUP BY fqn),
good AS (SELECT o.* FROM o JOIN made ON made.fqn = o.t WHERE kind = 'stub' OR made < pos), m AS (SELECT pos, subject AS f, t FROM good WHERE subject <> t),
nx AS (SELECT a.pos, a.t, MIN(b.pos) AS n FROM m a LEFT JOIN m b ON b.f = a.t AND b.pos > a.pos GROUP BY a.pos, a.t),
e AS (SELECT DISTINCT concat('C', o_custkey % 1000) AS src, o_orderpriority AS dst, o_orderstatus = 'O' AS u FROM orders),
s AS (SELECT x.src, MIN(m.pos) AS n FROM (SELECT DISTINCT src FROM e) x LEFT JOIN m ON m.f = x.src GROUP BY x.src),
w AS (SELECT src, src AS name, 0 AS since, n FROM s UNION ALL SELECT w.src, nx.t, nx.pos, nx.n FROM w JOIN nx ON nx.pos = w.n),
f AS (SELECT src, arg_max(name, since) AS final, bool_or(since > 0 OR EXISTS (SELECT 1 FROM good g WHERE (g.kind = 'stub' OR g.subject = g.t AND g.kind = 'alias') AND g.t = w.name AND g.pos >= w.since AND (w.n IS NULL OR g.pos < w.n))) AS touched FROM w GROUP BY src)
SELECT final AS src, dst, CAST(MAX(CASE WHEN u AND NOT touched THEN 0.5 ELSE 1.0 END) AS DOUBLE) AS confidence, MIN(CASE WHEN u AND NOT touched THEN 1 ELSE 0 END) = 1 AS unresolved FROM e JOIN f USING (src) GROUP BY final, dst""")
def override_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' edges after decisions on customers' names, one after the other: names move on, back, and into stubs."""
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    decided = spark.sql(_DECIDED.replace("customer", "{customer}"), customer=customers).withColumn("sources", F.lit(None).cast("array<string>"))
    nodes = customers.filter("c_acctbal > 0").select(F.concat(F.lit("C"), F.col("c_custkey") % 1000).alias("fqn"), F.lit("TABLE").alias("kind")).distinct()
    loose = F.col("o_orderstatus") == "O"
    edges = orders.select(F.concat(F.lit("C"), F.col("o_custkey") % 1000).alias("src"), F.col("o_orderpriority").alias("dst"), F.lit("OWNS").alias("kind"), F.when(loose, 0.5).otherwise(1.0).alias("confidence"), loose.alias("unresolved"))
    return overrides.replay(nodes, edges, decided).edges.select("src", "dst", "confidence", "unresolved")

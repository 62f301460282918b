"""Analytics, column lineage and fingerprints over the star schema as an estate.

Regions are tables, nations and customers views of what owns them, orders dashboards of their customer, suppliers
procedures; an order's transform is an expression over what it comes from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics, columns, diff, portfolio, retrieval, semantic
from ..streaming import velocity
from .lineage import star_edges
from .registry import query, table

KINDS = {"region": ("r_regionkey", "TABLE"), "nation": ("n_nationkey", "VIEW"), "customer": ("c_custkey", "VIEW"), "orders": ("o_orderkey", "DASHBOARD"), "supplier": ("s_suppkey", "PROCEDURE")}


def star_nodes(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    out = None
    for t in kinds:
        key, kind = KINDS[t]
        rows = table(spark, sf_dir, t).select(F.concat(F.lit(f"{t}:"), F.col(key).cast("string")).alias("fqn"), F.lit(kind).alias("kind"))
        out = rows if out is None else out.unionByName(rows)
    return out


def estate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("kind") == "OWNS_ORDERS", "DASHBOARD_RENDERS").otherwise("VIEW_DEPENDS")
    return star_edges(spark, sf_dir).select("src", "dst", kind.alias("kind"), F.lit(1.0).alias("confidence"), F.col("dst").isin("nation:0", "nation:7").alias("unresolved"))


NODES = """nodes AS (SELECT concat('region:', r_regionkey) AS fqn, 'TABLE' AS kind FROM region UNION ALL SELECT concat('nation:', n_nationkey), 'VIEW' FROM nation
UNION ALL SELECT concat('customer:', c_custkey), 'VIEW' FROM customer UNION ALL SELECT concat('orders:', o_orderkey), 'DASHBOARD' FROM orders UNION ALL SELECT concat('supplier:', s_suppkey), 'PROCEDURE' FROM supplier)"""


@query("""SELECT concat('orders:', o_orderkey) AS dashboard, concat('region:', n_regionkey) AS upstream_table
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""")
def dashboard_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.dashboard_tables(star_nodes(spark, sf_dir), estate_edges(spark, sf_dir))


@query("SELECT concat('nation:', n_nationkey) AS view, 1 AS depth FROM nation UNION ALL SELECT concat('customer:', c_custkey), 2 FROM customer")
def view_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.view_depth(star_nodes(spark, sf_dir), estate_edges(spark, sf_dir))


@query("""SELECT concat('nation:', n_nationkey) AS fqn, 1 AS value, CASE WHEN n_nationkey % 5 = 0 THEN 2 WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END AS risk, 1 AS fan_in, 0 AS dashboards FROM nation
UNION ALL SELECT concat('customer:', c_custkey), 1, 0, 1, 0 FROM customer""")
def risk_value_quadrant(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("fqn"), F.when(F.col("n_nationkey") % 2 == 0, "join").otherwise("simple").alias("complexity"), (F.col("n_nationkey") % 5 == 0).alias("unresolved"))
    nodes, edges = star_nodes(spark, sf_dir), estate_edges(spark, sf_dir)
    return analytics.quadrant(nodes, edges, views, analytics.dashboard_tables(nodes, edges))


@query("""WITH c AS (SELECT (SELECT COUNT(*) FROM region) + (SELECT COUNT(*) FROM nation) + (SELECT COUNT(*) FROM customer) + (SELECT COUNT(*) FROM orders) + (SELECT COUNT(*) FROM supplier) AS total, (SELECT COUNT(*) FROM supplier) AS s, (SELECT COUNT(*) FROM supplier WHERE s_acctbal < 0) AS high),
h AS (SELECT *, ROUND(100.0::DOUBLE * (total - s) / total, 1) AS coverage_pct, CAST(greatest(0, least(100, round_even(100 - (2 * 8 + 50.0::DOUBLE * s / total + 70.0::DOUBLE * high / s), 0))) AS INT) AS health FROM c)
SELECT total, s AS orphans, 2 AS unresolved, 0 AS circular, coverage_pct, health, CASE WHEN health >= 80 THEN 'Healthy' WHEN health >= 60 THEN 'Moderate Risk' ELSE 'At Risk' END AS label,
ROUND((1 - 2.0::DOUBLE / total) * (coverage_pct / 100) * 100, 1) AS readiness, s * 500 AS orphan_cost FROM h""")
def health_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    procedures = table(spark, sf_dir, "supplier").select(F.when(F.col("s_acctbal") < 0, "high").otherwise("low").alias("complexity"))
    return analytics.health(star_nodes(spark, sf_dir), estate_edges(spark, sf_dir), procedures)


@query("""WITH n AS (SELECT s_name AS fqn, CASE WHEN s_acctbal < 0 THEN 'high' WHEN s_acctbal < 5000 THEN 'medium' ELSE 'low' END AS complexity, CASE WHEN s_acctbal < 0 THEN 3 WHEN s_acctbal < 5000 THEN 2 ELSE 1 END AS w, s_nationkey % 4 + 1 AS n FROM supplier)
SELECT fqn, complexity, CAST(w * 10 + n AS INT) AS score FROM n""")
def complexity_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("s_acctbal") < 0, "high").when(F.col("s_acctbal") < 5000, "medium").otherwise("low")
    reads = F.transform(F.sequence(F.lit(0), F.col("s_nationkey") % 4), lambda i: F.concat(F.lit("T"), i.cast("string")))
    return analytics.complexity_ranking(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("fqn"), kind.alias("complexity"), reads.alias("reads"), F.array().cast("array<string>").alias("writes")))


@query("SELECT DISTINCT o_orderpriority AS dashboard, CASE o_orderpriority WHEN '1-URGENT' THEN 'regulatory' WHEN '2-HIGH' THEN 'revenue' ELSE 'ops' END AS criticality, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'daily 06:00' ELSE 'weekly' END AS last_run FROM orders")
def dashboard_criticality(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("1-URGENT", "regulatory"), ("2-HIGH", "revenue")], "dashboard string, criticality string")
    return analytics.criticality(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("dashboard")), known)


@query(f"""WITH {NODES}, o AS (SELECT fqn, kind, row_number() OVER (ORDER BY CASE kind WHEN 'DASHBOARD' THEN 4 WHEN 'TABLE' THEN 0 ELSE 1 END, fqn) - 1 AS pos FROM nodes)
SELECT fqn, kind, pos % 6 * 220 AS x, CAST(floor(pos / 6) AS BIGINT) * 85 AS y FROM o""")
def graph_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = star_nodes(spark, sf_dir)
    return analytics.layout(nodes, [f"region:{i}" for i in range(5)])


@query("SELECT 'Datasets' AS name, COUNT(*) AS items FROM region UNION ALL SELECT 'Metadata', (SELECT COUNT(*) FROM nation) + (SELECT COUNT(*) FROM customer) UNION ALL SELECT 'Lineage', COUNT(*) FROM orders")
def knowledge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.knowledge_counts({"Datasets": table(spark, sf_dir, "region"), "Metadata": star_nodes(spark, sf_dir, ("nation", "customer")), "Lineage": table(spark, sf_dir, "orders")})


def column_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners' columns to owned ones: REGION.<key> to NATION.<key> to CUSTOMER.<key>."""
    n = table(spark, sf_dir, "nation").select(F.lit("NATION").alias("target_table"), F.col("n_nationkey").cast("string").alias("target_column"), F.lit("REGION").alias("source_table"), F.col("n_regionkey").cast("string").alias("source_column"), F.concat(F.lit("REGION."), F.col("n_name")).alias("transform"), F.lit(0.95).alias("confidence"))
    c = table(spark, sf_dir, "customer").select(F.lit("CUSTOMER").alias("target_table"), F.col("c_custkey").cast("string").alias("target_column"), F.lit("NATION").alias("source_table"), F.col("c_nationkey").cast("string").alias("source_column"), F.concat(F.lit("UPPER(NATION."), F.col("c_mktsegment"), F.lit(")")).alias("transform"), F.lit(0.9).alias("confidence"))
    return n.unionByName(c)


@query("""SELECT concat('CUSTOMER.', c_custkey) AS column_name, 2 AS upstream, 0 AS downstream, 2 AS hops_ref, 2 AS depth FROM customer
UNION ALL SELECT concat('NATION.', n_nationkey), 1, COUNT(c_custkey), greatest(1, COUNT(c_custkey)), 1 FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey""")
def column_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.hops(column_lineage(spark, sf_dir))


@query("""SELECT 'upstream' AS direction, concat('REGION.', n_regionkey) AS fqn, 1 AS hops, concat('REGION.', n_name) AS transform, 0.95::DOUBLE AS confidence FROM nation WHERE n_nationkey = 3
UNION ALL SELECT 'downstream', concat('CUSTOMER.', c_custkey), 1, concat('UPPER(NATION.', c_mktsegment, ')'), 0.9::DOUBLE FROM customer WHERE c_nationkey = 3""")
def column_journey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.journey(column_lineage(spark, sf_dir), "NATION.3")


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@query(f"""WITH c AS (SELECT upper(table_name) AS t, regexp_replace(upper(regexp_replace(column_name, '^[a-z]{{1,2}}_', '')), 'KEY$', '_KEY') AS c FROM information_schema.columns WHERE table_name IN {TABLES}),
n AS (SELECT DISTINCT lower(regexp_replace(c, '(_ID|_KEY|_FK)$', '_ID')) AS canonical_id, concat(t, '.', c) AS fqn FROM c),
g AS (SELECT canonical_id, list(fqn ORDER BY fqn) AS members FROM n GROUP BY 1 HAVING COUNT(*) > 1), e AS (SELECT canonical_id, unnest(members) AS fqn, members FROM g)
SELECT canonical_id, fqn, array_to_string(list_filter(members, lambda m: m <> fqn), ',') AS aliases, CASE WHEN canonical_id LIKE '%\\_id' ESCAPE '\\' THEN 1.0::DOUBLE ELSE 0.85::DOUBLE END AS confidence FROM e""")
def column_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    import re

    named = [(t.upper(), re.sub("KEY$", "_KEY", re.sub("^[a-z]{1,2}_", "", c).upper())) for t in TABLES for c in table(spark, sf_dir, t).columns]
    found = columns.identities(spark.createDataFrame(named, "table_name string, column_name string"))
    return found.withColumn("aliases", F.array_join("aliases", ","))


@query("""WITH e AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN concat('LNK.', replace(p_brand, '#', '_')) WHEN 1 THEN 'IF L.A > 1 THEN M.B ELSE 0' WHEN 2 THEN 'TRIM(L.A)' WHEN 3 THEN 'L.A + L.B * 2' WHEN 4 THEN '''x''' ELSE '' END AS e FROM part)
SELECT p_partkey, CASE WHEN e = '' THEN 'passthrough' WHEN regexp_matches(e, '^[A-Za-z_]\\w*\\.[A-Za-z_]\\w*$') THEN 'direct' WHEN regexp_matches(upper(e), 'IF|ELSE') THEN 'conditional' WHEN contains(e, '(') THEN 'function' WHEN regexp_matches(e, '[-+*/%]') THEN 'expression' WHEN starts_with(e, '''') THEN 'constant' ELSE 'expression' END AS type,
CASE WHEN len(list_distinct(regexp_extract_all(e, '[A-Za-z_]\\w*\\.[A-Za-z_]\\w*'))) > 1 THEN 'N->1' ELSE '1->1' END AS cardinality FROM e""")
def expression_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size") % 6
    e = F.when(n == 0, F.concat(F.lit("LNK."), F.replace("p_brand", F.lit("#"), F.lit("_")))).when(n == 1, "IF L.A > 1 THEN M.B ELSE 0").when(n == 2, "TRIM(L.A)").when(n == 3, "L.A + L.B * 2").when(n == 4, "'x'").otherwise("")
    return table(spark, sf_dir, "part").withColumn("e", e).select("p_partkey", columns.expression_type(F.col("e")).alias("type"), columns.cardinality(F.col("e")).alias("cardinality"))


@query("""WITH links AS (SELECT concat('L', c_custkey) AS name, concat('N', c_nationkey) AS source_stage, c_mktsegment AS target_stage FROM customer UNION ALL SELECT concat('R', n_nationkey), n_name, concat('N', n_nationkey) FROM nation)
SELECT coalesce((SELECT MIN(name) FROM links i WHERE i.target_stage = l.source_stage), '') AS input_link, source_stage AS stage_name, coalesce(CASE WHEN source_stage LIKE 'N%' AND length(source_stage) <= 3 THEN 'NATION' END, '') AS stage_type, name AS output_link, target_stage AS next_stage_name, CASE WHEN name LIKE 'R%' THEN 'NATION' ELSE '' END AS next_stage_type FROM links l""")
def stage_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    named = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    links = customer.select(named("L", "c_custkey").alias("name"), named("N", "c_nationkey").alias("source_stage"), F.col("c_mktsegment").alias("target_stage")).unionByName(nation.select(named("R", "n_nationkey").alias("name"), F.col("n_name").alias("source_stage"), named("N", "n_nationkey").alias("target_stage")))
    return columns.stage_lineage(nation.select(named("N", "n_nationkey").alias("name"), F.lit("NATION").alias("type")), links)


@query("""SELECT 'NATION' AS target_table, concat('SELECT ', string_agg(item, ', ' ORDER BY item), ' FROM REGION') AS sql FROM (SELECT DISTINCT concat('REGION.', n_name, ' AS ', n_nationkey) AS item FROM nation)
UNION ALL SELECT 'CUSTOMER', concat('SELECT ', string_agg(item, ', ' ORDER BY item), ' FROM NATION') FROM (SELECT DISTINCT concat('UPPER(NATION.', c_mktsegment, ') AS ', c_custkey) AS item FROM customer)""")
def generated_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.generated_sql(column_lineage(spark, sf_dir))


@query("""WITH m AS (SELECT 'REGION' AS source_table, n_regionkey AS source_column, 'NATION' AS target_table, n_nationkey AS target_column, concat('REGION.', n_name) AS transform, 0.95::DOUBLE AS confidence, 'silver' AS tier FROM nation
UNION ALL SELECT 'NATION', c_nationkey, 'CUSTOMER', c_custkey, concat('UPPER(NATION.', c_mktsegment, ')'), 0.9, 'bronze' FROM customer)
SELECT '' AS source_schema, source_table, CAST(source_column AS VARCHAR) AS source_column, '' AS target_schema, target_table, CAST(target_column AS VARCHAR) AS target_column, transform,
CASE WHEN regexp_full_match(transform, '[A-Za-z_][A-Za-z0-9_]*\\.[A-Za-z_][A-Za-z0-9_]*') THEN 'direct' WHEN regexp_matches(upper(transform), 'IF|ELSE') THEN 'conditional' WHEN contains(transform, '(') THEN 'function' ELSE 'expression' END AS transform_type, '1->1' AS cardinality, confidence, tier FROM m""")
def source_to_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.source_to_target(column_lineage(spark, sf_dir), spark.createDataFrame([("NATION", "silver")], "table_name string, tier string"))


@query("SELECT p_partkey FROM part WHERE contains(upper(p_brand), 'BRAND#1') OR contains('BRAND#1', upper(p_brand)) OR contains(upper(p_type), 'BRAND#1') OR contains('BRAND#1', upper(p_type))")
def name_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(columns.matches_name(F.concat("p_brand", F.lit(" -> "), "p_type"), " Brand#1 ")).select("p_partkey")


@query(f"""WITH {NODES}, a AS (SELECT fqn FROM nodes), b AS (SELECT fqn FROM nodes WHERE kind <> 'TABLE' UNION ALL SELECT 'new:1')
SELECT 'object' AS section, fqn AS key, 'removed' AS change, '' AS old, NULL AS new FROM a WHERE fqn NOT IN (SELECT fqn FROM b) UNION ALL SELECT 'object', fqn, 'added', NULL, '' FROM b WHERE fqn NOT IN (SELECT fqn FROM a)
UNION ALL SELECT 'logic', concat('view:', c_custkey), 'changed', concat('SUM(x) / ', c_nationkey), concat('SUM(x) / ', c_nationkey + 1) FROM customer WHERE c_custkey % 7 = 0""")
def fingerprint_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = star_nodes(spark, sf_dir)
    none = spark.createDataFrame([], "key string, value string")
    edges = estate_edges(spark, sf_dir)
    c = table(spark, sf_dir, "customer")
    logic = lambda n: c.select(F.concat(F.lit("view:"), F.col("c_custkey").cast("string")).alias("key"), F.concat(F.lit("SUM(x)\n  / "), n.cast("string")).alias("value"))
    before = diff.fingerprint(nodes, edges, logic(F.col("c_nationkey")), none)
    after = diff.fingerprint(nodes.filter("kind <> 'TABLE'").unionByName(spark.createDataFrame([("new:1", "VIEW")], nodes.schema)), edges, logic(F.col("c_nationkey") + (F.col("c_custkey") % 7 == 0).cast("int")), none)
    return diff.fingerprint_drift(before, after)


@query("""WITH c AS (SELECT (SELECT COUNT(*) FROM customer) + (SELECT COUNT(*) FROM nation) AS n, (SELECT COUNT(*) FROM customer WHERE c_custkey % 10 = 0) AS m)
SELECT n AS rows_compared, m AS mismatched_rows, ROUND(100.0::DOUBLE * m / n, 4) AS pct, m = 0 AS passed, CASE WHEN m = 0 THEN ROUND(3.0::DOUBLE / n, 6) END AS bound_95 FROM c""")
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    moved = c.withColumn("c_acctbal", F.col("c_acctbal") + F.when(F.col("c_custkey") % 10 == 0, 5).otherwise(0))
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return diff.summary(diff.rollup("customer", c, moved, ["c_custkey"]).unionByName(diff.rollup("nation", n, n, ["n_nationkey"])))


_INTENTS = " ".join(f"WHEN {' OR '.join(f"contains(lower(text), '{w}')" for w in words)} THEN '{name}'" for name, words, _ in retrieval.INTENTS)
_REFUSED = " OR ".join(f"regexp_matches(lower(text), '{p}')" for p in retrieval.REFUSED)


@query(f"SELECT conv_id, turn, coalesce({_REFUSED}, FALSE) AS refused, CASE {_INTENTS} ELSE 'vague' END AS intent FROM conversations")
def question_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", retrieval.refused(F.col("text")).alias("refused"), retrieval.intent(F.col("text"))["intent"].alias("intent"))


@query("""WITH b AS (SELECT c_nationkey AS job, ROUND(SUM(CAST(c_custkey % 7 AS DECIMAL(18,4)))::DOUBLE, 2) AS base_days FROM customer GROUP BY 1), u AS (SELECT s_nationkey AS job, SUM(CAST(s_suppkey % 5 AS DECIMAL(18,4)))::DOUBLE AS up FROM supplier GROUP BY 1), r AS (SELECT n_nationkey AS job, n_regionkey::DOUBLE AS risk FROM nation WHERE n_nationkey % 2 = 0),
a AS (SELECT b.job, base_days, coalesce(up, 0) AS uplift_pct, coalesce(risk, 0) AS risk_days, ROUND(base_days * (1 + coalesce(up, 0) / 100) + coalesce(risk, 0), 2) AS adjusted_days FROM b LEFT JOIN u USING (job) LEFT JOIN r USING (job))
SELECT *, CASE WHEN adjusted_days < 15 THEN 'low' WHEN adjusted_days < 40 THEN 'medium' ELSE 'high' END AS tier FROM a""")
def effort_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("job"), (F.col("c_custkey") % 7).alias("days"))
    up = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("job"), (F.col("s_suppkey") % 5).alias("uplift_pct"))
    risk = table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("job"), F.col("n_regionkey").alias("impact_days"))
    return portfolio.effort(days, up, risk)


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e) SELECT strftime(MIN(ts), '%Y-%m-%d %H:%M:%S') AS began, user_id, COUNT(*) AS n FROM s GROUP BY user_id, s""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return velocity.sessions(table(spark, sf_dir, "events")).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("began"), "user_id", "n")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events), r AS (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM g)
SELECT user_id, event_id, COUNT(*) OVER w AS n, CAST(SUM(CAST(value AS DECIMAL(18,4))) OVER w AS DOUBLE) AS total FROM r WINDOW w AS (PARTITION BY user_id, run ORDER BY ts, event_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""")
def last_24_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return velocity.last_events(table(spark, sf_dir, "events"), idle_seconds=6 * 3600)


@query("""SELECT c_custkey AS id, concat('DW.', n_name) AS fqn FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def named_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    asked = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.concat(F.lit("what feeds dw."), F.lower("n_name"), F.lit("?")).alias("text"))
    return retrieval.named_objects(asked, nations.select(F.concat(F.lit("DW."), "n_name").alias("fqn"))).select("id", "fqn")


def part_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as columns: made from their brand by an expression over their size."""
    e = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("CASE  when size < "), F.col("p_size").cast("string"), F.lit(" THEN 1 END"))).otherwise(F.concat(F.lit("trim( "), F.col("p_type"), F.lit(")")))
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("target_table"), F.col("p_type").alias("target_column"), F.lit("PART").alias("source_table"), F.col("p_name").alias("source_column"), e.alias("transform"), (F.col("p_size") / 50.0).alias("confidence"))


RULES = "r AS (SELECT p_brand AS t, p_type AS c, CASE WHEN p_size % 3 = 0 THEN concat('CASE  when size < ', p_size, ' THEN 1 END') ELSE concat('trim( ', p_type, ')') END AS e FROM part), n AS (SELECT *, upper(regexp_replace(e, '\\s+', ' ', 'g')) AS x FROM r)"


@query(f"WITH {RULES} SELECT DISTINCT 'business_rule' AS type, concat(t, '.', c) AS fqn, substr(e, 1, 80) AS snippet, 0.85::DOUBLE AS confidence, concat(t, ':', c) AS source_ref FROM n WHERE x LIKE '%CASE WHEN%'")
def case_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.case_rules(part_rules(spark, sf_dir))


@query(f"WITH {RULES}, g AS (SELECT x, COUNT(DISTINCT concat(t, '.', c)) AS columns, list_sort(list(DISTINCT concat(t, '.', c)))[1:3] AS names FROM n GROUP BY x) SELECT x AS expression, columns, array_to_string(names, ', ') AS names FROM g WHERE columns > 1".replace(" AS columns,", " AS cols,").replace("expression, columns,", "expression, cols AS n_columns,").replace("WHERE columns", "WHERE cols"))
def similar_logic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.similar_logic(part_rules(spark, sf_dir)).withColumnRenamed("columns", "n_columns")


@query(f"WITH {RULES} SELECT c AS target_column, COUNT(DISTINCT x) AS expressions FROM n GROUP BY c HAVING COUNT(DISTINCT x) > 1")
def conflicting_logic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.conflicting_logic(part_rules(spark, sf_dir))

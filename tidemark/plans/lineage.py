"""Graph queries: the star schema as an ownership graph, and event types as a transition graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import estate_lineage, graph
from .registry import query, table

NAMED = [("region", "r_regionkey", None, None), ("nation", "n_nationkey", "region", "n_regionkey"), ("customer", "c_custkey", "nation", "c_nationkey"), ("orders", "o_orderkey", "customer", "o_custkey")]


def _node(kind: str, column: str):
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def star_edges(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = ("nation", "customer", "orders")) -> DataFrame:
    """src owns dst: region, nation, customer, orders."""
    parts = [table(spark, sf_dir, t).select(_node(up, fk).alias("src"), _node(t, key).alias("dst"), F.lit(f"OWNS_{t.upper()}").alias("kind")) for t, key, up, fk in NAMED if up and t in kinds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


EDGES = """edges AS (
SELECT concat('region:', n_regionkey) AS src, concat('nation:', n_nationkey) AS dst FROM nation
UNION ALL SELECT concat('nation:', c_nationkey), concat('customer:', c_custkey) FROM customer
UNION ALL SELECT concat('customer:', o_custkey), concat('orders:', o_orderkey) FROM orders)"""
CLOSURE = "reach AS (SELECT src AS root, dst AS node, 1 AS hops FROM edges UNION ALL SELECT r.root, e.dst, r.hops + 1 FROM reach r JOIN edges e ON e.src = r.node)"


@query(f"WITH RECURSIVE {EDGES}, {CLOSURE} SELECT root, COUNT(DISTINCT node) AS reached, CAST(MAX(hops) AS BIGINT) AS depth FROM reach GROUP BY root")
def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.blast_radius(star_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {EDGES}, {CLOSURE} SELECT root, node, MIN(hops) AS hops FROM reach WHERE root LIKE 'region:%' GROUP BY root, node")
def lineage_hops_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = table(spark, sf_dir, "region").select(_node("region", "r_regionkey").alias("root"))
    return graph.closure(star_edges(spark, sf_dir), roots)


@query(f"WITH RECURSIVE {EDGES}, {CLOSURE} SELECT node AS root, root AS node, MIN(hops) AS hops FROM reach GROUP BY 1, 2")
def lineage_hops_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(graph.reversed_edges(star_edges(spark, sf_dir)))


@query(f"WITH RECURSIVE {EDGES}, {CLOSURE} SELECT node, MIN(hops) AS hops, MIN(via) AS via FROM (SELECT r.node, r.hops, e.src AS via FROM reach r JOIN edges e ON e.dst = r.node WHERE r.root = 'region:1') GROUP BY node")
def blast_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.blast_parents(star_edges(spark, sf_dir), "region:1")


@query(f"""WITH RECURSIVE {EDGES}, {CLOSURE}, sizes AS (SELECT COUNT(DISTINCT node) AS v FROM reach GROUP BY root), o AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM sizes)
SELECT MAX(CASE WHEN i = CAST(floor(n * 0.5) AS BIGINT) THEN v END) AS p50, MAX(CASE WHEN i = CAST(floor(n * 0.9) AS BIGINT) THEN v END) AS p90, MAX(v) AS largest, ROUND(CAST(SUM(v) AS DOUBLE) / COUNT(*), 4) AS mean FROM o""")
def closure_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.index_percentiles(graph.reach_sizes(star_edges(spark, sf_dir)), "reached")


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ownership graph, with suppliers below their nation and below one of the regions."""
    s = table(spark, sf_dir, "supplier")
    below = lambda up: s.select(up.alias("src"), _node("supplier", "s_suppkey").alias("dst"))
    home = below(_node("nation", "s_nationkey"))
    return star_edges(spark, sf_dir).select("src", "dst").unionByName(home).unionByName(below(F.concat(F.lit("region:"), (F.col("s_suppkey") % 5).cast("string"))))


@query(f"""WITH RECURSIVE {EDGES.replace("edges AS", "star AS")}, edges AS (SELECT * FROM star UNION ALL SELECT concat('nation:', s_nationkey), concat('supplier:', s_suppkey) FROM supplier UNION ALL SELECT concat('region:', s_suppkey % 5), concat('supplier:', s_suppkey) FROM supplier),
{CLOSURE} SELECT root, COUNT(DISTINCT node) AS reached FROM reach GROUP BY root""")
def reach_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reach_sizes(supply_edges(spark, sf_dir))


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select(before.alias("src"), F.col("event_type").alias("dst"), F.col("user_id")).filter("src is not null")


TRANSITIONS = "moves AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS src, event_type AS dst FROM events), edges AS (SELECT DISTINCT src, dst FROM moves WHERE src IS NOT NULL)"


@query(f"""WITH RECURSIVE {TRANSITIONS}, reach AS (SELECT src AS root, dst AS node FROM edges UNION SELECT r.root, e.dst FROM reach r JOIN edges e ON e.src = r.node),
both_ AS (SELECT a.root, MIN(a.node) AS component FROM reach a JOIN reach b ON a.root = b.node AND a.node = b.root GROUP BY a.root)
SELECT component, COUNT(*) AS members FROM both_ GROUP BY component""")
def cycles_self_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycles(transitions(spark, sf_dir))


@query(f"WITH {EDGES}, ends AS (SELECT dst AS node, 1 AS i, 0 AS o FROM edges UNION ALL SELECT src, 0, 1 FROM edges) SELECT node, CAST(SUM(i) AS BIGINT) AS fan_in, CAST(SUM(o) AS BIGINT) AS fan_out FROM ends GROUP BY node")
def node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(star_edges(spark, sf_dir))


@query(f"WITH {EDGES}, ends AS (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) SELECT node, COUNT(*) AS degree FROM ends GROUP BY node ORDER BY degree DESC, node LIMIT 10")
def hot_nodes_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = graph.degrees(star_edges(spark, sf_dir)).select("node", (F.col("fan_in") + F.col("fan_out")).alias("degree"))
    return d.orderBy(F.desc("degree"), "node").limit(10)


@query("SELECT concat('part:', p_partkey) AS node FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def orphan_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").select(_node("part", "p_partkey").alias("node"))
    edges = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(_node("part", "l_partkey").alias("src"), _node("orders", "l_orderkey").alias("dst"))
    return graph.orphans(nodes, edges)


@query("""WITH n AS (SELECT concat('customer:', c_custkey) AS node FROM customer), e AS (SELECT DISTINCT concat('customer:', o_custkey) AS node FROM orders WHERE o_totalprice > 200000)
SELECT COUNT(*) AS nodes, COUNT(e.node) AS linked, ROUND(100.0::DOUBLE * COUNT(e.node) / COUNT(*), 4) AS pct FROM n LEFT JOIN e ON e.node = n.node""")
def coverage_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "customer").select(_node("customer", "c_custkey").alias("node"))
    large = table(spark, sf_dir, "orders").filter("o_totalprice > 200000").select(_node("customer", "o_custkey").alias("src"), _node("orders", "o_orderkey").alias("dst"))
    return graph.coverage(nodes, large)


@query(f"WITH RECURSIVE {EDGES}, {CLOSURE} SELECT node, CAST(MAX(hops) AS BIGINT) AS level FROM (SELECT node, hops FROM reach UNION ALL SELECT src, 0 FROM edges) GROUP BY node")
def topo_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.levels(star_edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {EDGES}, p AS (SELECT concat(src, '>', dst) AS path, dst AS last, 2 AS hops FROM edges WHERE src NOT IN (SELECT dst FROM edges) UNION ALL SELECT concat(p.path, '>', e.dst), e.dst, hops + 1 FROM p JOIN edges e ON e.src = p.last)
SELECT path, CAST(hops AS BIGINT) AS hops FROM p WHERE last NOT IN (SELECT src FROM edges)""")
def simple_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.simple_paths(star_edges(spark, sf_dir))


@query(f"WITH {EDGES} SELECT dst AS node, 'fan_in' AS pattern FROM edges GROUP BY dst HAVING COUNT(*) > 4 UNION ALL SELECT src, 'fan_out' FROM edges GROUP BY src HAVING COUNT(*) > 4")
def high_fan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = graph.degrees(star_edges(spark, sf_dir))
    return d.filter("fan_in > 4").select("node", F.lit("fan_in").alias("pattern")).unionByName(d.filter("fan_out > 4").select("node", F.lit("fan_out").alias("pattern")))


@query("SELECT user_id, event_type, COUNT(*) AS times FROM events GROUP BY user_id, event_type HAVING COUNT(*) > 3")
def repeated_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("times")).filter("times > 3")


@query("""WITH m AS (SELECT user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS src, event_type AS dst FROM events)
SELECT concat(src, '>', dst) AS signature, COUNT(DISTINCT user_id) AS jobs FROM m WHERE src IS NOT NULL GROUP BY 1 ORDER BY jobs DESC, signature LIMIT 20""")
def recurring_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transitions(spark, sf_dir).groupBy(F.concat_ws(">", "src", "dst").alias("signature")).agg(F.countDistinct("user_id").alias("jobs"))
    return t.orderBy(F.desc("jobs"), "signature").limit(20)


def _definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): for each nation a table with a column for each of its suppliers, a view that passes on the columns
    of solvent ones, doubles the others, counts and tells a constant, and a view of that view."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("id"), (F.col("s_acctbal") < 0).alias("owes"))
    column = F.concat(F.lit("C_"), F.col("id"))
    made = F.when(F.col("owes"), F.concat(F.lit("t."), column, F.lit(" * 2 AS D_"), F.col("id"))).otherwise(F.concat(F.lit("t."), column))
    parts = s.groupBy("k").agg(F.array_sort(F.collect_list(F.concat(column, F.lit(" NUMBER(12,2)")))).alias("ddl"), F.array_sort(F.collect_list(made)).alias("said"), F.array_sort(F.collect_list(F.when(~F.col("owes"), column))).alias("passed"))
    text = F.concat(F.lit("CREATE TABLE DW.N_"), F.col("k"), F.lit(" ("), F.concat_ws(", ", "ddl"), F.lit(");\nCREATE OR REPLACE VIEW V_"), F.col("k"), F.lit(" AS WITH c AS (SELECT * FROM DW.N_"), F.col("k"), F.lit(") SELECT "), F.concat_ws(", ", "said"), F.lit(", (SELECT COUNT(*) FROM DW.N_0) AS TOTAL, 'fixed' AS KIND FROM c t;\nCREATE VIEW MART.W_"), F.col("k"), F.lit(" AS SELECT 1 AS ONE"), F.array_join(F.transform("passed", lambda c: F.concat(F.lit(", "), c)), ""), F.lit(" FROM V_"), F.col("k"), F.lit(";"))
    return parts.select(F.concat(F.lit("nation_"), F.col("k"), F.lit(".sql")).alias("path"), text.alias("text"))


@query("""WITH s AS (SELECT concat('V_', s_nationkey) AS v, concat('MART.W_', s_nationkey) AS w, concat('DW.N_', s_nationkey) AS t, s_suppkey AS id, s_acctbal < 0 AS owes FROM supplier)
SELECT v AS target_table, concat(CASE WHEN owes THEN 'D_' ELSE 'C_' END, id) AS target_column, t AS source_table, concat('C_', id) AS source_column, CASE WHEN owes THEN 0.9::DOUBLE ELSE 0.95::DOUBLE END AS confidence, CAST(NULL AS VARCHAR) AS reason FROM s
UNION ALL SELECT w, concat('C_', id), v, concat('C_', id), 0.95::DOUBLE, NULL FROM s WHERE NOT owes
UNION ALL SELECT DISTINCT v, 'KIND', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 0.0::DOUBLE, 'no source column: a literal or a constant' FROM s
UNION ALL SELECT DISTINCT v, 'TOTAL', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 0.0::DOUBLE, 'no source column: a literal or a constant' FROM s
UNION ALL SELECT DISTINCT w, 'ONE', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 0.0::DOUBLE, 'no source column: a literal or a constant' FROM s""")
def estate_column_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estate_lineage.of_estate(_definitions(spark, sf_dir)).drop("transform")

"""Relational patterns of warehouse views, procedures and mappings, on the star schema."""

from __future__ import annotations

from .registry import sql

MONEY = "CAST({} AS DECIMAL(18,2))"


def total(x: str) -> str:
    """A sum of money that doesn't depend on the order of rows."""
    return f"CAST(SUM(CAST({x} AS DECIMAL(18,2))) AS DOUBLE)"


sql("revenue_daily", f"SELECT CAST(CAST(o_orderdate AS DATE) AS STRING) AS day, COUNT(*) AS orders, {total('o_totalprice')} AS revenue, MIN(o_totalprice) AS least, MAX(o_totalprice) AS most FROM {{orders}} GROUP BY 1")
sql("projection_arithmetic", "SELECT o_orderkey, o_totalprice * 1.25 AS with_tax, o_totalprice / 1000 AS thousands, o_orderstatus AS status FROM {orders} WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderstatus <> 'P'")
sql("filters", "SELECT c_custkey, c_name FROM {customer} WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal IS NOT NULL AND (c_acctbal < 0 OR c_acctbal > 5000)")
sql("not_in_nullable", "SELECT c_custkey FROM {customer} WHERE c_mktsegment NOT IN ('BUILDING', CASE WHEN c_acctbal < 0 THEN NULL ELSE 'MACHINERY' END)")
sql("order_summary_3way", f"SELECT n.n_name AS nation, COUNT(*) AS orders, {total('o.o_totalprice')} AS total FROM {{orders}} o JOIN {{customer}} c ON o.o_custkey = c.c_custkey JOIN {{nation}} n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name")
sql("left_join_chain", "SELECT c.c_custkey, n.n_name AS nation, r.r_name AS region, s.suppliers FROM {customer} c LEFT JOIN {nation} n ON c.c_nationkey = n.n_nationkey LEFT JOIN {region} r ON n.n_regionkey = r.r_regionkey LEFT JOIN (SELECT s_nationkey, COUNT(*) AS suppliers FROM {supplier} WHERE s_acctbal > 0 GROUP BY s_nationkey) s ON s.s_nationkey = n.n_nationkey")
sql("left_null_predicate", "SELECT c.c_custkey, o.o_orderkey FROM {customer} c LEFT JOIN (SELECT * FROM {orders} WHERE o_totalprice > 200000) o ON c.c_custkey = o.o_custkey WHERE o.o_orderstatus = 'O' OR o.o_orderkey IS NULL")
sql("left_on_predicate", "SELECT c.c_custkey, COUNT(o.o_orderkey) AS open_orders FROM {customer} c LEFT JOIN {orders} o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'O' GROUP BY c.c_custkey")
sql("customer_360", f"""
SELECT c.c_custkey, c.c_mktsegment, COALESCE(o.orders, 0) AS orders, COALESCE(o.spent, 0.0) AS spent, COALESCE(l.lines, 0) AS lines, COALESCE(u.urgent, 0) AS urgent
FROM {{customer}} c
LEFT JOIN (SELECT o_custkey, COUNT(*) AS orders, {total('o_totalprice')} AS spent FROM {{orders}} GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey
LEFT JOIN (SELECT o_custkey, COUNT(*) AS lines FROM {{orders}} JOIN {{lineitem}} ON l_orderkey = o_orderkey GROUP BY o_custkey) l ON l.o_custkey = c.c_custkey
LEFT JOIN (SELECT o_custkey, COUNT(*) AS urgent FROM {{orders}} WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey) u ON u.o_custkey = c.c_custkey""")
sql("kpi_crossjoin", f"""
WITH a AS (SELECT COUNT(*) AS customers, COUNT(DISTINCT c_mktsegment) AS segments FROM {{customer}}),
b AS (SELECT COUNT(*) AS orders, COALESCE({total('o_totalprice')}, 0) AS revenue FROM {{orders}}),
c AS (SELECT COUNT(*) AS late FROM {{lineitem}} WHERE l_returnflag = 'R'), d AS (SELECT COALESCE({total('s_acctbal')}, 0) AS supplier_balance FROM {{supplier}} WHERE s_acctbal > 1000000)
SELECT * FROM a CROSS JOIN b CROSS JOIN c CROSS JOIN d""")
sql("dim_grid_left", """
SELECT g.n_name AS nation, g.y AS year_, COALESCE(f.orders, 0) AS orders
FROM (SELECT n_nationkey, n_name, y FROM {nation} CROSS JOIN (VALUES (1995), (1996), (1997), (1998), (1999), (2000), (2001)) AS t(y)) g
LEFT JOIN (SELECT c_nationkey, CAST(YEAR(o_orderdate) AS INT) AS y, COUNT(*) AS orders FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY 1, 2) f ON f.c_nationkey = g.n_nationkey AND f.y = g.y""")
sql("debit_credit_fanout", "SELECT o_orderkey, side, amount FROM {orders} LATERAL VIEW stack(2, 'DEBIT', o_totalprice, 'CREDIT', -o_totalprice) AS side, amount",
    "SELECT o_orderkey, 'DEBIT' AS side, o_totalprice AS amount FROM orders UNION ALL SELECT o_orderkey, 'CREDIT', -o_totalprice FROM orders")
sql("exists_semi", "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
sql("in_subquery", "SELECT p_partkey, p_brand FROM {part} WHERE p_partkey IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity >= 50)")
sql("not_exists_anti", "SELECT p_partkey FROM {part} p WHERE NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 40 AND l.l_discount > 0.05)")
sql("having_not_exists", "SELECT g.o_custkey, g.orders FROM (SELECT o_custkey, COUNT(*) AS orders FROM {orders} GROUP BY o_custkey HAVING COUNT(*) > 5) g WHERE NOT EXISTS (SELECT 1 FROM {customer} c WHERE c.c_custkey = g.o_custkey AND c.c_acctbal < 0)")
sql("insert_where_not_exists", "SELECT o_orderkey, o_custkey FROM {orders} o WHERE NOT EXISTS (SELECT 1 FROM {orders} t WHERE t.o_orderkey = o.o_orderkey AND t.o_orderstatus = 'F')")
sql("count_distinct", "SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS parts, COUNT(DISTINCT l_suppkey) AS suppliers FROM {lineitem} GROUP BY l_returnflag")
sql("conditional_aggregates", f"SELECT o_orderpriority, SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS finished, COUNT(CASE WHEN o_totalprice > 100000 THEN 1 END) AS large, {total('CASE WHEN o_orderstatus <> ' + chr(39) + 'F' + chr(39) + ' THEN o_totalprice ELSE 0 END')} AS open_value FROM {{orders}} GROUP BY o_orderpriority",
    f"SELECT o_orderpriority, CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS finished, COUNT(CASE WHEN o_totalprice > 100000 THEN 1 END) AS large, {total('CASE WHEN o_orderstatus <> ' + chr(39) + 'F' + chr(39) + ' THEN o_totalprice ELSE 0 END')} AS open_value FROM orders GROUP BY o_orderpriority")
sql("ecl_ratio", f"SELECT l_suppkey, ROUND({total('CASE WHEN l_returnflag = ' + chr(39) + 'R' + chr(39) + ' THEN l_extendedprice ELSE 0 END')} / NULLIF({total('l_extendedprice')}, 0), 6) AS returned_share FROM {{lineitem}} GROUP BY l_suppkey")
sql("risk_weight_sum", "SELECT c_mktsegment, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 1.5 WHEN '2-HIGH' THEN 1.0 ELSE 0.5 END AS DECIMAL(3,1))) AS DOUBLE) AS weighted FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_mktsegment")
sql("arrears_banding", "SELECT band, COUNT(*) AS loans FROM (SELECT CASE WHEN l_quantity < 10 THEN 'CURRENT' WHEN l_quantity < 25 THEN '1-30' WHEN l_quantity < 40 THEN '31-90' ELSE 'NPL' END AS band FROM {lineitem}) GROUP BY band")
sql("concentration_flag", f"""
WITH per AS (SELECT c_nationkey, c_custkey, {total('o_totalprice')} AS spent FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey GROUP BY c_nationkey, c_custkey),
agg AS (SELECT c_nationkey, COUNT(*) AS customers, MAX(spent) AS most, {total('spent')} AS all_spent FROM per GROUP BY c_nationkey)
SELECT c_nationkey, customers, most, CASE WHEN most > 0.05 * all_spent THEN 'CONCENTRATED' ELSE 'SPREAD' END AS flag FROM agg""")
sql("having_duplicates", "SELECT l_orderkey, l_linenumber, COUNT(*) AS copies FROM {lineitem} GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1")
sql("distinct_pairs", "SELECT DISTINCT l_returnflag, l_linestatus FROM {lineitem}")
sql("latest_snapshot", "SELECT event_id, user_id FROM {events} WHERE CAST(ts AS DATE) = (SELECT MAX(CAST(ts AS DATE)) FROM {events})")
sql("latest_row", "SELECT o_orderkey, o_custkey FROM {orders} ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
sql("topk_customers", f"SELECT o_custkey, {total('o_totalprice')} AS spent FROM {{orders}} GROUP BY o_custkey ORDER BY spent DESC, o_custkey LIMIT 50")
sql("pagination", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
sql("row_counts_union", "SELECT 'orders' AS t, COUNT(*) AS n FROM {orders} UNION ALL SELECT 'customer', COUNT(*) FROM {customer} UNION ALL SELECT 'lineitem', COUNT(*) FROM {lineitem}")
sql("set_except", "SELECT c_nationkey AS k FROM {customer} WHERE c_acctbal < 0 EXCEPT SELECT s_nationkey FROM {supplier} WHERE s_acctbal < 0")
sql("set_intersect", "SELECT l_partkey AS k FROM {lineitem} WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM {lineitem} WHERE l_returnflag = 'A'")
sql("grouping_sets", f"SELECT c_mktsegment, o_orderpriority, COUNT(*) AS n, {total('o_totalprice')} AS total FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey GROUP BY GROUPING SETS ((c_mktsegment), (o_orderpriority), ())")
sql("rollup_cube", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)")
sql("window_row_number_latest", "SELECT user_id, event_id FROM (SELECT user_id, event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM {events}) WHERE rn = 1")
sql("window_count_partition", "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey) AS of_customer FROM {orders}")
sql("lag_prev", "SELECT event_id, LAG(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM {events}")
sql("window_rows_23", f"SELECT event_id, COUNT(*) OVER w AS n, CAST(SUM(CAST(value AS DECIMAL(18,4))) OVER w AS DOUBLE) AS total FROM {{events}} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)")
sql("window_range_24h", "SELECT event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS n FROM {events}")
sql("window_rank_family", "SELECT c_custkey, RANK() OVER w AS rnk, DENSE_RANK() OVER w AS dense, CAST(NTILE(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS INT) AS quartile FROM {customer} WINDOW w AS (PARTITION BY c_nationkey ORDER BY CAST(c_acctbal / 1000 AS INT))",
    "SELECT c_custkey, CAST(RANK() OVER w AS INT) AS rnk, CAST(DENSE_RANK() OVER w AS INT) AS dense, CAST(NTILE(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS INT) AS quartile FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY CAST(TRUNC(c_acctbal / 1000) AS INT))")
sql("sequential_derivation", "SELECT l_orderkey, l_linenumber, l_partkey, prob, CASE WHEN prob >= 0.7 THEN 'A' WHEN prob >= 0.4 THEN 'B' ELSE 'C' END AS band, ROUND(10 + 14 * (1 - prob), 4) AS rate FROM (SELECT l_orderkey, l_linenumber, l_partkey, ROUND(0.3 + l_discount * 4 + l_tax, 4) AS prob FROM {lineitem})")
sql("fraud_score_bands", "SELECT event_id, score, CASE WHEN score >= 0.75 THEN 'FLAG' WHEN score >= 0.4 THEN 'REVIEW' ELSE 'CLEAR' END AS decision, CASE WHEN score >= 0.9 THEN 'CRITICAL' WHEN score >= 0.7 THEN 'HIGH' WHEN score >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM (SELECT event_id, CAST(LEAST(1.0, CASE event_type WHEN 'purchase' THEN 0.4 ELSE 0.1 END + CASE WHEN value > 50 THEN 0.5 ELSE 0.0 END + CASE WHEN HOUR(ts) < 6 THEN 0.2 ELSE 0.0 END) AS DOUBLE) AS score FROM {events})")
sql("night_hours", "SELECT event_id FROM {events} WHERE date_format(ts, 'HH:mm:ss') BETWEEN '00:00:00' AND '05:59:59'", "SELECT event_id FROM events WHERE strftime(ts, '%H:%M:%S') BETWEEN '00:00:00' AND '05:59:59'")
sql("null_functions", "SELECT o_orderkey, COALESCE(NULLIF(o_orderpriority, '5-LOW'), 'NONE') AS priority, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS decoded FROM {orders}")
sql("string_functions", "SELECT c_custkey, UPPER(TRIM(c_name)) AS up, REPLACE(c_name, '#', '-') AS replaced, CONCAT(c_mktsegment, '/', c_name) AS joined FROM {customer}")
sql("date_key_parts", "SELECT o_orderkey, CAST(date_format(o_orderdate, 'yyyyMMdd') AS INT) AS day_key, CAST(YEAR(o_orderdate) AS INT) AS y, CAST(MONTH(o_orderdate) AS INT) AS m FROM {orders}", "SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m%d') AS INT) AS day_key, CAST(YEAR(o_orderdate) AS INT) AS y, CAST(MONTH(o_orderdate) AS INT) AS m FROM orders")
sql("math_rounding", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(ROUND(CAST(l_extendedprice AS DECIMAL(18,4)), 1) AS DOUBLE) AS r1, ABS(l_discount - 0.05) < 0.011 AS near FROM {lineitem}")
sql("json_props", "SELECT event_id, get_json_object(props, '$.k') AS k, props IS NULL AS missing FROM {events}", "SELECT event_id, json_extract_string(props, '$.k') AS k, props IS NULL AS missing FROM events")
sql("try_cast_rejects", "SELECT event_id FROM {events} WHERE TRY_CAST(get_json_object(props, '$.k') AS INT) IS NULL OR TRY_CAST(get_json_object(props, '$.k') AS INT) <= 0", "SELECT event_id FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS INT) IS NULL OR TRY_CAST(json_extract_string(props, '$.k') AS INT) <= 0")
sql("dq_checks", """
SELECT 'unallocated' AS check_name, COUNT(*) AS bad FROM {orders} o LEFT ANTI JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey
UNION ALL SELECT 'imbalance', COUNT(*) FROM {lineitem} WHERE l_extendedprice <= 0
UNION ALL SELECT 'null_risk', COUNT(*) FROM {customer} WHERE c_acctbal IS NULL""", """
SELECT 'unallocated' AS check_name, COUNT(*) AS bad FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)
UNION ALL SELECT 'imbalance', COUNT(*) FROM lineitem WHERE l_extendedprice <= 0
UNION ALL SELECT 'null_risk', COUNT(*) FROM customer WHERE c_acctbal IS NULL""")
sql("reconciliation_variance", f"""
WITH s AS (SELECT COUNT(*) AS n, {total('o_totalprice')} AS v FROM {{orders}}), t AS (SELECT COUNT(*) AS n, {total('o_totalprice')} AS v FROM {{orders}} WHERE o_totalprice >= 2000)
SELECT metric, source_value, target_value, pct, CASE WHEN ABS(pct) > 0.5 THEN 'ALERT' ELSE 'OK' END AS status FROM (
SELECT metric, source_value, target_value, CASE WHEN source_value = 0 THEN 0.0 ELSE ROUND(100 * (source_value - target_value) / source_value, 4) END AS pct FROM (
SELECT 'rows' AS metric, CAST(s.n AS DOUBLE) AS source_value, CAST(t.n AS DOUBLE) AS target_value FROM s CROSS JOIN t UNION ALL SELECT 'value', s.v, t.v FROM s CROSS JOIN t))""")
sql("portfolio_rollup", "SELECT c_mktsegment AS domain, COUNT(*) AS jobs, COUNT(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS done, ROUND(CAST(COUNT(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS DOUBLE) * 100 / COUNT(*), 2) AS coverage_pct FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_mktsegment")
sql("sla_overdue", "SELECT o_custkey, COUNT(*) AS overdue FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey WHERE datediff(CAST(l_shipdate AS DATE), CAST(o_orderdate AS DATE)) > 2 GROUP BY o_custkey",
    "SELECT o_custkey, COUNT(*) AS overdue FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) > 2 GROUP BY o_custkey")
sql("business_rules_conflicting", "SELECT p_brand, COUNT(DISTINCT p_type) AS types, COUNT(*) AS parts FROM {part} GROUP BY p_brand HAVING COUNT(DISTINCT p_type) > 1")
sql("html_refs_extract", "SELECT page_id, href FROM {pages} LATERAL VIEW explode(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href", "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")
sql("redact_secrets", "SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+[.][a-z]+', '<EMAIL>'), '(password|secret|token)( *= *)\"[^\"]*\"', '$1$2<REDACTED>')) AS redacted_md5 FROM {documents}",
    "SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+[.][a-z]+', '<EMAIL>', 'g'), '(password|secret|token)( *= *)\"[^\"]*\"', '\\1\\2<REDACTED>', 'g')) AS redacted_md5 FROM documents")
sql("refusal_and_intent", """
SELECT conv_id, turn, regexp_like(LOWER(text), '(cannot|unable to|not able to|no information)') AS refusal,
CASE WHEN LOWER(text) LIKE '%impact%' THEN 'impact' WHEN LOWER(text) LIKE '%lineage%' THEN 'lineage' WHEN LOWER(text) LIKE '%orphan%' THEN 'orphan' WHEN LENGTH(text) < 30 THEN 'vague' ELSE 'other' END AS intent FROM {conversations}""", """
SELECT conv_id, turn, regexp_matches(LOWER(text), '(cannot|unable to|not able to|no information)') AS refusal,
CASE WHEN LOWER(text) LIKE '%impact%' THEN 'impact' WHEN LOWER(text) LIKE '%lineage%' THEN 'lineage' WHEN LOWER(text) LIKE '%orphan%' THEN 'orphan' WHEN LENGTH(text) < 30 THEN 'vague' ELSE 'other' END AS intent FROM conversations""")
sql("exact_mention", """
SELECT e.name AS name, COUNT(*) AS mentions FROM (SELECT DISTINCT LOWER(regexp_extract(text, '^([A-Za-z]+)', 1)) AS name FROM {benchmark}) e
JOIN (SELECT DISTINCT conv_id, turn, word FROM (SELECT conv_id, turn, explode(split(LOWER(text), '[^a-z]+')) AS word FROM {conversations})) w ON w.word = e.name WHERE e.name <> '' GROUP BY e.name""", """
SELECT e.name AS name, COUNT(*) AS mentions FROM (SELECT DISTINCT LOWER(regexp_extract(text, '^([A-Za-z]+)', 1)) AS name FROM benchmark) e
JOIN (SELECT DISTINCT conv_id, turn, word FROM (SELECT conv_id, turn, unnest(regexp_split_to_array(LOWER(text), '[^a-z]+')) AS word FROM conversations)) w ON w.word = e.name WHERE e.name <> '' GROUP BY e.name""")
sql("medallion_tiers", """
SELECT COALESCE(s.k, t.k) AS node, CASE WHEN s.k IS NOT NULL AND t.k IS NOT NULL THEN 'silver' WHEN t.k IS NOT NULL THEN 'gold' ELSE 'bronze' END AS tier
FROM (SELECT DISTINCT l_suppkey AS k FROM {lineitem} WHERE l_quantity > 49) s FULL JOIN (SELECT DISTINCT l_suppkey AS k FROM {lineitem} WHERE l_quantity < 2) t ON s.k = t.k""")
sql("low_confidence_queue", "SELECT event_id, value FROM {events} WHERE value < 0.6 ORDER BY value, event_id")

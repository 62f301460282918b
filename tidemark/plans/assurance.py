"""Migration assurance: diffs, continuity, drift, sampling, history, ledger and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dialect
from ..operators import diff, history, ledger, retrieval
from .registry import query, table

MIGRATED = "o_orderkey, o_custkey, CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 0.05 ELSE o_totalprice + 0.004 END AS o_totalprice"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders, and orders after a migration that changed some prices by more than the tolerance."""
    o = _orders(spark, sf_dir)
    return o.select("o_orderkey", "o_custkey", "o_totalprice"), o.selectExpr(*[c.strip() for c in MIGRATED.split(", ", 2)])


@query(f"WITH t AS (SELECT {MIGRATED} FROM orders) SELECT o_orderkey, o_custkey, o_totalprice FROM orders s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.o_orderkey = s.o_orderkey AND t.o_custkey = s.o_custkey AND abs(t.o_totalprice - s.o_totalprice) <= 0.01)")
def epsilon_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return diff.epsilon_missing(a, b, ["o_orderkey", "o_custkey"])


@query("""WITH a AS (SELECT o_orderpriority, o_totalprice FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT lower(o_orderpriority) AS p, o_totalprice + 0.004 AS v FROM orders WHERE o_orderkey % 3 = 0)
SELECT a.* FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE lower(a.o_orderpriority) = b.p AND abs(a.o_totalprice - b.v) <= 0.5)""")
def near_missing_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of every other order for which those of every third have none of the same priority within 0.5; no keys."""
    o = _orders(spark, sf_dir)
    a, b = o.filter("o_orderkey % 2 = 0").select("o_orderpriority", "o_totalprice"), o.filter("o_orderkey % 3 = 0").select(F.lower("o_orderpriority").alias("o_orderpriority"), (F.col("o_totalprice") + F.lit(0.004)).alias("o_totalprice"))
    return diff.near_missing(a, b, diff.Tolerances(numeric_epsilon=0.5))


@query("""WITH RECURSIVE a AS (SELECT lower(o_orderpriority) AS p, o_totalprice AS v, COUNT(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2), b AS (SELECT lower(o_orderpriority) AS p, o_totalprice AS w FROM orders WHERE o_orderkey % 3 = 0),
s AS (SELECT p, v, n, (SELECT COUNT(*) FROM b WHERE b.p = a.p AND w < v::DOUBLE - 25) AS low, (SELECT COUNT(*) FROM b WHERE b.p = a.p AND w <= v::DOUBLE + 25) AS high, row_number() OVER (PARTITION BY p ORDER BY v) AS i FROM a),
r AS (SELECT p, v, i, n, least(low + n, high) AS used, n - (least(low + n, high) - low) AS missing FROM s WHERE i = 1
UNION ALL SELECT s.p, s.v, s.i, s.n, least(greatest(r.used, s.low) + s.n, s.high), s.n - (least(greatest(r.used, s.low) + s.n, s.high) - greatest(r.used, s.low)) FROM r JOIN s ON s.p = r.p AND s.i = r.i + 1)
SELECT p AS o_orderpriority, v AS o_totalprice, CAST(missing AS BIGINT) AS missing FROM r WHERE missing > 0""")
def unmatched_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of every other order that get no price of every third of the same priority, within 25, for themselves."""
    o = _orders(spark, sf_dir).select("o_orderkey", "o_orderpriority", "o_totalprice")
    a, b = o.filter("o_orderkey % 2 = 0").drop("o_orderkey"), o.filter("o_orderkey % 3 = 0").drop("o_orderkey")
    return diff.unmatched_once(a, b, diff.Tolerances(numeric_epsilon=25.0))


@query("""WITH a AS (SELECT lower(c_name) AS n, c_nationkey FROM customer WHERE c_acctbal > 0), b AS (SELECT lower(upper(c_name)) AS n, c_nationkey FROM customer WHERE c_acctbal < 9000),
x AS (SELECT COUNT(*) AS only_source FROM (SELECT * FROM a EXCEPT SELECT * FROM b)), y AS (SELECT COUNT(*) AS only_target FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) SELECT only_source, only_target, greatest(only_source, only_target) AS mismatched FROM x CROSS JOIN y""")
def except_diff_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return diff.except_both(c.filter("c_acctbal > 0").select("c_name", "c_nationkey"), c.filter("c_acctbal < 9000").select(F.upper("c_name").alias("c_name"), "c_nationkey"))


@query(f"""WITH t AS (SELECT {MIGRATED} FROM orders), m AS (SELECT COUNT(*) AS m FROM orders s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.o_orderkey = s.o_orderkey AND t.o_custkey = s.o_custkey AND abs(t.o_totalprice - s.o_totalprice) <= 0.01)), n AS (SELECT COUNT(*) AS n FROM orders)
SELECT 'orders' AS table_name, n AS source_rows, n AS target_rows, m AS mismatched, ROUND(100.0::DOUBLE * m / n, 4) AS pct, CASE WHEN m = 0 THEN 'passed' ELSE 'failed' END AS status FROM m CROSS JOIN n
UNION ALL SELECT 'orders_masked', n, n, 0, 0.0, 'passed' FROM n UNION ALL SELECT 'nothing', 0, 0, 0, NULL, 'no_data'""")
def diff_rollup_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    keys = ["o_orderkey", "o_custkey"]
    none = a.filter(F.lit(False))
    return diff.rollup("orders", a, b, keys).unionByName(diff.rollup("orders_masked", a, b, keys, diff.Tolerances(masked=("o_totalprice",)))).unionByName(diff.rollup("nothing", none, none, keys))


@query("SELECT o_orderkey FROM orders WHERE substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 1) < '4'")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.hash_sample(_orders(spark, sf_dir).select("o_orderkey"), "o_orderkey", 4)


@query("""WITH a AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_acctbal > 0), b AS (SELECT c_custkey AS k, CASE WHEN c_acctbal > 8000 THEN 'PRIME' ELSE c_mktsegment END AS v FROM customer WHERE c_acctbal < 9000)
SELECT coalesce(a.k, b.k) AS c_custkey, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v IS DISTINCT FROM b.v""")
def drift_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    after = c.filter("c_acctbal < 9000").withColumn("c_mktsegment", F.when(F.col("c_acctbal") > 8000, "PRIME").otherwise(F.col("c_mktsegment")))
    return diff.drift(c.filter("c_acctbal > 0"), after, "c_custkey", "c_mktsegment")


@query("""WITH a AS (SELECT n_nationkey AS k, lower(n_name) AS v FROM nation WHERE n_nationkey > 2), b AS (SELECT n_nationkey AS k, CASE WHEN n_regionkey = 1 THEN 'renamed' ELSE lower(n_name) END AS v FROM nation WHERE n_nationkey < 22)
SELECT coalesce(a.k, b.k) AS n_nationkey, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'extra' WHEN a.v = b.v THEN 'matched' ELSE 'mismatched' END AS status FROM a FULL JOIN b ON a.k = b.k""")
def continuity_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    target = n.filter("n_nationkey < 22").withColumn("n_name", F.when(F.col("n_regionkey") == 1, "renamed").otherwise(F.upper("n_name")))
    return diff.continuity(n.filter("n_nationkey > 2"), target, "n_nationkey", "n_name").drop("confidence")


@query()
def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's name against its type; difflib has no SQL form."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(diff.similarity(F.lower("p_name"), F.lower("p_type")), 6).alias("ratio"))


HISTORY = "h AS (SELECT o_orderkey, o_custkey, row_number() OVER w AS version, strftime(o_orderdate, '%Y-%m-%d') AS effective_from, coalesce(strftime(lead(o_orderdate) OVER w, '%Y-%m-%d'), '9999-12-31') AS effective_to, lead(o_orderdate) OVER w IS NULL AS is_current FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.scd2(_orders(spark, sf_dir), "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey", "version", "effective_from", "effective_to", "is_current")


@query(f"WITH {HISTORY} SELECT * FROM h")
def scd2_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir)


@query(f"WITH {HISTORY} SELECT * FROM h WHERE is_current")
def scd2_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).filter("is_current")


@query(f"WITH {HISTORY} SELECT * FROM h WHERE effective_from <= '1998-06-30' AND effective_to > '1998-06-30'")
def scd2_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.as_of(_history(spark, sf_dir), "1998-06-30")


@query("""WITH t AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_acctbal > 1000), s AS (SELECT c_custkey AS k, upper(c_name) AS v FROM customer WHERE c_acctbal < 3000)
SELECT coalesce(s.k, t.k) AS k, CASE WHEN s.k IS NOT NULL THEN s.v ELSE t.v END AS v, CASE WHEN s.k IS NOT NULL AND t.k IS NOT NULL THEN 'update' WHEN s.k IS NOT NULL THEN 'insert' ELSE 'keep' END AS action FROM t FULL JOIN s ON s.k = t.k""")
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    t = c.filter("c_acctbal > 1000").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    s = c.filter("c_acctbal < 3000").select(F.col("c_custkey").alias("k"), F.upper("c_name").alias("v"))
    return history.merge(t, s, ["k"], ["v"])


@query("SELECT o.o_orderkey, o.o_custkey, CASE WHEN c.c_custkey IS NOT NULL THEN 'CREDIT' ELSE o.o_orderpriority END AS o_orderpriority FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_acctbal < 0")
def update_from_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"), F.lit("CREDIT").alias("o_orderpriority"))
    return history.update_from(_orders(spark, sf_dir).select("o_orderkey", "o_custkey", "o_orderpriority"), s, ["o_custkey"], ["o_orderpriority"])


@query("SELECT o_orderkey, date_diff('month', CAST(o_orderdate AS DATE), DATE '2002-01-15') AS months, date_diff('year', CAST(o_orderdate AS DATE), DATE '2002-01-15') AS years, date_part('year', age(TIMESTAMP '2002-01-15', CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP))) AS age FROM orders")
def month_diff_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, on = F.col("o_orderdate").cast("date"), F.lit("2002-01-15").cast("date")
    return _orders(spark, sf_dir).select("o_orderkey", dialect.month_boundaries(day, on).alias("months"), dialect.year_boundaries(day, on).alias("years"), dialect.age(day, on).alias("age"))


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.concat_ws("|", F.col("event_type"), F.coalesce("props", F.lit(""))).alias("payload"))
    return ledger.build(e, "user_id", "event_id", "payload")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, concat_ws('|', event_type, coalesce(props, '')) AS payload, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
c AS (SELECT user_id, event_id, payload, n, 'GENESIS' AS prev_hash, sha256('GENESIS:' || sha256(payload)) AS event_hash FROM e WHERE n = 1
UNION ALL SELECT e.user_id, e.event_id, e.payload, e.n, c.event_hash, sha256(c.event_hash || ':' || sha256(e.payload)) FROM c JOIN e ON e.user_id = c.user_id AND e.n = c.n + 1)
SELECT user_id, event_id, payload, prev_hash, event_hash FROM c""")
def ledger_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger(spark, sf_dir)


@query("""WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id) AS events FROM events)
SELECT user_id, MAX(events) AS events, COUNT(CASE WHEN n = 2 THEN 1 END) AS broken, MIN(CASE WHEN n = 2 THEN event_id END) AS first_broken FROM e GROUP BY user_id""")
def ledger_tamper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chain's second event is changed after the fact; verification finds just those."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    changed = _ledger(spark, sf_dir).withColumn("payload", F.when(nth == 2, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    return ledger.verify(changed, "user_id", "event_id", "payload")


@query("""SELECT user_id, coalesce(bool_or(event_type = 'click' AND value > 1), false) AND coalesce(bool_or(event_type = 'view' AND value > 1), false) AND coalesce(bool_or(event_type = 'purchase' AND value > 1), false) AS promotable FROM events GROUP BY user_id""")
def promote_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "diff_run").when(F.col("event_type") == "view", "continuity").when(F.col("event_type") == "purchase", "plan_approved").otherwise("other")
    e = table(spark, sf_dir, "events").select("user_id", kind.alias("kind"), (F.col("value") > 1).alias("passed"))
    return ledger.can_promote(e, "user_id", "kind", "passed")


@query(retrieval.ORACLE)
def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.tfidf_topk(table(spark, sf_dir, "benchmark"), "item_id", table(spark, sf_dir, "documents"), "doc_id")

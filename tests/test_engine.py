"""Micro graphs, diffs, the ledger, stages and parsers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dialect
from tidemark.operators import column_lineage, diff, facts, graph, history, ledger, remediation, scoring, stages
from tidemark.sources import estate
from tidemark.streaming import velocity


def edges(spark, *pairs):
    return spark.createDataFrame([tuple(p) for p in pairs], "src string, dst string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_closure_on_diamond_cycle_and_nothing(spark):
    e = edges(spark, "ab", "ac", "bd", "cd", "de", "xx", "pq", "qp", (None, "a"))
    reach = {(r["root"], r["node"]): r["hops"] for r in graph.closure(e).collect()}
    assert reach["a", "e"] == 3 and reach["a", "d"] == 2 and reach["x", "x"] == 1 and reach["p", "p"] == 2 and ("e", "a") not in reach
    assert rows(graph.cycles(e)) == [("p", 2), ("x", 1)]
    assert rows(graph.blast_radius(e))[0] == ("a", 4, 3)
    assert rows(graph.blast_parents(e, "a")) == [("b", 1, "a"), ("c", 1, "a"), ("d", 2, "b"), ("e", 3, "d")]
    assert graph.closure(e.filter("false")).count() == 0


def test_levels_paths_orphans(spark):
    e = edges(spark, "ab", "bc", "ac", "cd")
    assert rows(graph.levels(e)) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert rows(graph.simple_paths(e)) == [("a>b>c>d", 4), ("a>c>d", 3)]
    nodes = spark.createDataFrame([("a",), ("z",)], "node string")
    assert rows(graph.orphans(nodes, e)) == [("z",)]
    assert rows(graph.degrees(edges(spark, "ab", "ab"))) == [("a", 0, 2), ("b", 2, 0)]


def test_diff_rules(spark):
    a = spark.createDataFrame([(1, "A", 100.0), (2, "B", 200.0), (3, None, None)], "k int, s string, v double")
    near = spark.createDataFrame([(1, "a", 100.005), (2, "b", 200.009), (3, None, None)], "k int, s string, v double")
    far = near.withColumn("v", F.col("v") + F.when(F.col("k") == 2, 0.05).otherwise(0.0))
    assert diff.epsilon_missing(a, a, ["k"]).count() == 0
    assert diff.epsilon_missing(a, near, ["k"]).count() == 0
    assert rows(diff.epsilon_missing(a, far, ["k"]).select("k")) == [(2,)]
    assert diff.epsilon_missing(a, far, ["k"], diff.Tolerances(masked=("V",))).count() == 0
    assert diff.epsilon_missing(a, near, ["k"], diff.Tolerances(case_insensitive=False)).count() == 2
    empty = a.filter("false")
    assert [r["status"] for r in diff.rollup("t", empty, empty, ["k"]).collect()] == ["no_data"]
    assert [r["status"] for r in diff.rollup("t", a, empty, ["k"]).collect()] == ["failed"]
    assert diff.rollup("t", a, far, ["k"]).first()["mismatched"] == diff.rollup("t", far, a, ["k"]).first()["mismatched"] == 1
    assert [round(r[0], 3) for r in spark.createDataFrame([("abcd", "bcde"), (None, "a")], "a string, b string").select(diff.similarity(F.col("a"), F.col("b"))).collect() if r[0] is not None] == [0.75]


@pytest.mark.parametrize("field", ["payload", "prev_hash", "event_hash"])
def test_ledger_finds_tampering(spark, field):
    e = spark.createDataFrame([("x", i, f"p{i}") for i in range(5)] + [("y", 9, "q")], "chain string, at long, payload string")
    built = ledger.build(e, "chain", "at", "payload")
    assert {r["broken"] for r in ledger.verify(built, "chain", "at", "payload").collect()} == {0}
    bad = built.withColumn(field, F.when(F.col("at") == 3, F.concat(field, F.lit("!"))).otherwise(F.col(field)))
    found = {r["chain"]: r["first_broken"] for r in ledger.verify(bad, "chain", "at", "payload").collect()}
    assert found == {"x": 3, "y": None}


def test_gate_needs_all_three(spark):
    e = spark.createDataFrame([("a", "diff_run", True), ("a", "continuity", True), ("a", "plan_approved", True), ("b", "diff_run", True), ("c", "diff_run", False), ("c", "continuity", True), ("c", "plan_approved", True)], "chain string, kind string, ok boolean")
    assert rows(ledger.can_promote(e, "chain", "kind", "ok")) == [("a", True), ("b", False), ("c", False)]


def test_stages_and_history(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", 5), (1, "y", 3), (2, None, 1)], "k int, s string, v int")
    assert rows(stages.dedup(df, ["k"], ["v"], "last")) == [(1, "x", 5), (2, None, 1)]
    kept, rejected = stages.filter_rows(df, F.col("s") == "x")
    assert (kept.count(), rejected.count()) == (1, 2)
    assert rows(stages.surrogate_key(df, ["v"]).select("v", "sk")) == [(1, 1), (3, 2), (5, 3)]
    stages.sink(df, f"file:{tmp_path}/t")
    stages.sink(df, f"file:{tmp_path}/t", "append")
    assert stages.source(spark, f"file:{tmp_path}/t", ["k"]).count() == 6
    assert rows(history.merge(df.select("k", "v").filter("k = 2"), df.select("k", "v").filter("v = 5"), ["k"], ["v"])) == [(1, 5, "insert"), (2, 1, "keep")]


DDL = """CREATE TABLE DW.FACT_X ( -- comment, with comma
  ID NUMBER(18,0) NOT NULL PRIMARY KEY, AMT DECIMAL(18,2), [Full Name] AS (A + ISNULL(B, '')), NAME VARCHAR2(100 CHAR), CONSTRAINT pk PRIMARY KEY (ID, AMT));
GO
CREATE OR REPLACE VIEW DW.VW_X AS WITH c AS (SELECT * FROM DW.FACT_X) SELECT c.id, SUM(amt) t FROM c JOIN stg.Dim d ON d.id = c.id GROUP BY c.id;
"""
PROC = """-- PROCEDURE: DW.PROC_A
-- READS: DW.FACT_X, DW.DIM_Y
-- WRITES: DW.OUT
-- CALLS:
BEGIN EXEC DW.PROC_B; END
"""


def test_parsers(spark):
    t = lambda path, text: spark.createDataFrame([(path, text)], "path string, text string")
    cols = estate.tables(t("a.sql", DDL)).orderBy("ordinal").collect()
    assert [(r["name"], r["data_type"]) for r in cols][:2] == [("ID", "NUMBER(18,0)"), ("AMT", "DECIMAL(18,2)")] and cols[0]["pk"] and cols[0]["fqn"] == "DW.FACT_X" and len(cols) == 4
    v = estate.views(t("a.sql", DDL)).first()
    assert (v["fqn"], sorted(v["sources"]), v["complexity"]) == ("DW.VW_X", ["DW.FACT_X", "STG.DIM"], "cross_system")
    p = estate.procedures(t("p.sql", PROC)).first()
    assert (p["fqn"], p["reads"], p["writes"], p["calls"]) == ("DW.PROC_A", ["DW.FACT_X", "DW.DIM_Y"], ["DW.OUT"], ["DW.PROC_B"])
    e = estate.edges(estate.views(t("a.sql", DDL)), estate.procedures(t("p.sql", PROC)))
    assert e.count() == 6
    assert rows(estate.unresolved(e, spark.createDataFrame([("DW.FACT_X",), ("DW.VW_X",), ("DW.PROC_A",)], "fqn string")).select("fqn")) == [("DW.DIM_Y",), ("DW.OUT",), ("DW.PROC_B",), ("STG.DIM",)]
    s = estate.schedules(t("s.xml", '<Schedule name="J" type="t" schedule="0 1 * * *" frequency="daily"><DependsOn>A</DependsOn><DependsOn>B</DependsOn></Schedule>')).first()
    assert (s["name"], s["depends_on"]) == ("J", ["A", "B"])
    assert rows(estate.dashboards(t("d.twb", '<workbook><dashboard name="D"/><relation table="[DW].[VW_X]"/></workbook>')).select("name", "source")) == [("D", "DW.VW_X")]
    q = estate.etl_statements(t("x.dtsx", '<a DTS:SqlStatementSource="SELECT 1 WHERE 1 &lt; 2"/><TABLEATTRIBUTE NAME="Sql Query" VALUE="SELECT 2"/><p name="QUERY" value="&quot;SELECT 3&quot;"/>'))
    assert [r["statement"] for r in q.collect()] == ["SELECT 1 WHERE 1 < 2", "SELECT 2", '"SELECT 3"']
    assert rows(estate.informatica_endpoints(t("m.xml", '<SOURCE NAME="SQ_A" OWNERNAME="STG"/><TARGET OWNERNAME="DW" NAME="TGT_B"/>')).select("role", "fqn")) == [("source", "STG.A"), ("target", "DW.B")]
    j = estate.orchestration(t("c.json", '{"S": {"J1": {"Type": "Job", "Source": "A", "Target": "B", "DependsOn": [{"JobName": "J0"}]}}}')).first()
    assert (j["job"], j["depends_on"]) == ("J1", ["J0"])
    assert estate.runs(t("r.json", '{"run_time": "t", "jobs": [{"job": "J", "status": "OK", "elapsed_s": 1.5, "nodes": 3}]}')).first()["nodes"] == 3
    assert rows(estate.row_estimates(t("i.json", '{"tables": [{"table_schema": "dw", "table_name": "x", "row_count": 7}]}'))) == [("DW.X", 7)]
    assert estate.ml_scripts(t("m.py", 'FEATURE_COLS = ["a", "b"]\n"""\nReads: ml.f\nWrites: ml.s\n"""\nX / "m.pkl"')).first()["features"] == ["a", "b"]
    d = estate.datastage_records(t("j.dsx", 'BEGIN DSJOB\n Name "J"\n BEGIN DSRECORD\n  Sql =+=+=+=\nSELECT 1\nFROM t\n=+=+=+=\n END\nEND')).collect()
    assert [(r["kind"], r["properties"]) for r in d] == [("DSJOB", {"Name": "J"}), ("DSRECORD", {"Sql": "SELECT 1\nFROM t"})]
    assert [r["dialect"] for r in estate.dialect_of(t("a.xml", "<POWERMART>")).collect()] == ["informatica"]


def test_dialect(spark):
    assert dialect.to_spark_sql("SELECT TOP 5 ISNULL(a, 0) FROM t WITH (NOLOCK);") == "SELECT coalesce(a, 0) FROM t  LIMIT 5"
    assert spark.sql(dialect.to_spark_sql("SELECT NVL(NULL, IIF(1 > 2, 3, 4)) AS x, DATEDIFF(MONTH, DATE'2024-01-31', DATE'2024-02-28') AS m")).first()[:] == (4, 1)
    assert [dialect.spark_type(x) for x in ("NUMBER(*,0)", "VARCHAR2(10 CHAR)", "BIT", "DECIMAL(18,2)", "TIMESTAMP(6) WITH TIME ZONE", "ODD")] == ["decimal(38,0)", "string", "boolean", "decimal(18,2)", "timestamp", "string"]


def test_column_lineage(spark):
    spark.createDataFrame([], "id int, region string").createOrReplaceTempView("dim_branch")
    spark.createDataFrame([], "id int, revenue double, cost double").createOrReplaceTempView("perf")
    sql = "WITH p AS (SELECT id, revenue - cost AS margin FROM perf) SELECT b.region, p.margin, SUM(p.margin) OVER (PARTITION BY b.region) AS total, 1 AS one FROM dim_branch b JOIN p ON p.id = b.id"
    found = column_lineage.of_query(spark, "V", sql).collect()
    by = {}
    for r in found:
        by.setdefault(r["target_column"], set()).add((r["source_table"], r["source_column"]))
    assert by["margin"] == {("PERF", "revenue"), ("PERF", "cost")} and ("DIM_BRANCH", "region") in by["region"] | by["total"]
    assert by["region"] == {("DIM_BRANCH", "region")} and by["one"] == {(None, None)}


def test_stream_matches_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    later = spark.createDataFrame([(10**9, "2030-01-01 00:00:00", 1, "click", 0.0, None)], "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.write.parquet(f"{tmp_path}/in")
    for n in (1, 2):
        later.write.mode("append").parquet(f"{tmp_path}/in")
        velocity.run(velocity.windows(velocity.read_stream(spark, f"{tmp_path}/in", events.schema)), f"{tmp_path}/out", f"{tmp_path}/state")
    want = velocity.windows(events)
    assert rows(spark.read.parquet(f"{tmp_path}/out").filter("start < '2029-01-01'")) == rows(want)


def test_scoring(spark):
    data = spark.createDataFrame([(i, "ab"[i % 2], float(i % 7), int(i % 2 == 0 and i % 7 > 2)) for i in range(200)], "i int, c string, v double, y int")
    scored = scoring.score(scoring.fit(data, ["c"], ["v"], "y"), data)
    assert scored.filter("(decision = 'FLAG') <> (y = 1)").count() < 10


def test_candidates_against_difflib(spark):
    from difflib import SequenceMatcher, get_close_matches

    names = ["DW.FACT_LOAN", "MART.FACT_LOANS", "RAW.FACT_LOAN", "DW.DIM_DATE", "DW.DIM_DATES", "X.AB", "X.ABC", "X.A", "X.BA", "DW.CUSTOMER", "DW.CUSTOMERS_ALL", "STG.FACT_LAON"]
    wanted = ["OLD.FACT_LOAN", "OLD.DIM_DAT", "OLD.AB", "OLD.CUSTOMRE", "OLD.ZZZ", "DW.FACT_LOAN"]
    as_rows = lambda ns: spark.createDataFrame([(n,) for n in ns], "fqn string")
    got = {(r["fqn"], r["candidate"].split(".")[1]) for r in remediation.near_candidates(as_rows(wanted), as_rows(names)).collect()}
    want = {(w, m) for w in wanted for m in get_close_matches(w.split(".")[1], {n.split(".")[1] for n in names if n != w}, n=3, cutoff=0.75)}
    assert got == want and SequenceMatcher(None, "AB", "ABC").ratio() >= 0.75
    best = [r["candidate"] for r in remediation.candidates(as_rows(["OLD.FACT_LOAN"]), as_rows(names)).orderBy("rank").collect()]
    assert best == ["DW.FACT_LOAN", "RAW.FACT_LOAN", "MART.FACT_LOANS"]
    assert remediation.candidates(as_rows([]), as_rows(names)).count() == 0


def test_candidates_of_whole_tables_against_difflib(spark):
    import random
    from difflib import SequenceMatcher

    sf = "/root/testdata/sf0.01"
    names = {r[0].upper().replace(".", "_") for t, c in (("supplier", "s_name"), ("part", "p_name")) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(c).distinct().collect()}
    names = sorted(names) + ["", "A", "AB", "ABC", "ABCD", "ABCDE", "ABCDEF", "BCDEFG", "É", "ÉÈ"]
    rng = random.Random(4)
    wanted = sorted({n[:i] + rng.choice(["", "X", "0", n[i : i + 1] * 2]) + n[i + rng.randrange(3) :] for n in names for i in (rng.randrange(len(n) + 1),)} | {"", "AB", "BA", "XBCDE"})
    as_rows = lambda ns, schema: spark.createDataFrame([(f"{schema}.{n}",) for n in ns] + [(None,)], "fqn string")
    got = {(r["fqn"], r["candidate"], round(r["ratio"], 9)) for r in remediation.near_candidates(as_rows(wanted, "OLD"), as_rows(names, "DW")).collect()}
    want = set()
    for w in wanted:
        near = sorted(((round(SequenceMatcher(None, n, w).ratio(), 9), n) for n in names if n and w), reverse=True)
        want |= {(f"OLD.{w}", f"DW.{n}", r) for r, n in near[:3] if r >= 0.75}
    assert sorted(got - want) == sorted(want - got) == [] and len(got) > 300


def test_candidates_of_numbered_names(spark):
    """Names that differ in a digit only, all within the cutoff: each has its nearest without all pairs."""
    import time
    from difflib import SequenceMatcher

    names = [f"SUPPLIER#{i:09d}" for i in range(3000)] + ["N" * 70 + str(i) for i in range(5)]
    wanted = [n.replace("ER#0", "X") for n in names]
    as_rows = lambda ns, schema: spark.createDataFrame([(f"{schema}.{n}",) for n in ns], "fqn string")
    began = time.time()
    got = {(r["fqn"], r["candidate"], r["ratio"]) for r in remediation.near_candidates(as_rows(wanted, "OLD"), as_rows(names, "DW")).collect()}
    assert time.time() - began < 90
    assert len(got) == 3 * len(wanted)
    for w in (*wanted[:3000:499], wanted[-1]):
        near = sorted(((SequenceMatcher(None, n, w).ratio(), n) for n in names), reverse=True)[:3]
        assert {(c, r) for f, c, r in got if f == f"OLD.{w}"} == {(f"DW.{n}", r) for r, n in near}


def test_wedge_fills_and_costs(spark):
    quadrant = spark.createDataFrame([("a", 9, 1), ("b", 8, 3)], "fqn string, value int, risk int")
    names = spark.createDataFrame([(c,) for c in "abcdefghijklmn"], "fqn string")
    feeds = spark.createDataFrame([("job", "a"), ("job", "b"), ("idle", "z")], "fqn string, touches string")
    scope = remediation.wedge(quadrant, names, feeds)
    assert rows(scope) == [("a", "chosen"), ("b", "chosen"), *[(c, "filled") for c in "cdefghij"], ("job", "feeding")]
    cost = remediation.wedge_cost(scope, edges(spark, "ab", "yz"), spark.createDataFrame([("c",)], "fqn string")).first()
    assert tuple(cost) == (11, 1, 1, 29.5, 18.2, "medium")


def test_aliases(spark):
    e = spark.createDataFrame([("a", "x", "R", 0.5), ("b", "x", "R", 0.9), ("a", "c", "R", 1.0), ("q", "q", "R", 1.0)], "src string, dst string, kind string, confidence double")
    aliases = spark.createDataFrame([("a", "z", 1), ("a", "b", 2), ("c", "b", 1)], "alias string, target string, seq int")
    assert rows(remediation.apply_aliases(e, aliases)) == [("b", "x", "R", 0.9), ("q", "q", "R", 1.0)]


def test_facts(spark):
    runs = spark.createDataFrame([("j1", "a.json", "Completed", [], "2026-01-02"), ("j2", "a.json", "completed", ["s1", "s2"], "2026-01-01"), ("j3", "b.json", None, None, None)], "job string, artifact string, status string, failed_steps array<string>, ran_on string")
    assert {(r["type"], r["fqn"], r["snippet"]) for r in facts.run_facts(runs).collect()} == {
        ("runtime_failure", "j2", "COMPLETED (failed steps: s1, s2) on run 2026-01-01 via a.json"),
        ("runtime_failure", "j3", "UNKNOWN on run unknown via b.json"),
        ("operational", "a.json", "2 jobs ran, 2 completed (2026-01-01)"),
        ("operational", "b.json", "1 jobs ran, 0 completed (unknown run)"),
    }
    views = spark.createDataFrame([("v", "s" * 130, False), ("w", "EXEC(x)", True)], "fqn string, sql string, unresolved boolean")
    assert {(r["fqn"], len(r["snippet"]), r["confidence"]) for r in facts.view_facts(views).collect()} == {("v", 121, 0.9), ("w", 7, 0.5)}
    procedures = spark.createDataFrame([("p", True, True, "high"), ("q", False, True, "low")], "fqn string, has_cursor boolean, has_dynamic boolean, complexity string")
    assert sorted(r["confidence"] for r in facts.procedure_failures(procedures).collect()) == [0.85, 0.9]
    flows = spark.createDataFrame([("j", "REJECT", "AUDIT.X", "f")], "job string, route string, target string, artifact string")
    assert facts.rejects(flows).first()["snippet"] == "REJECT route -> AUDIT.X"
    calls = spark.createDataFrame([("a", "b", "SP_CALLS"), ("a", "c", "VIEW_DEPENDS")], "src string, dst string, kind string")
    assert [r["fqn"] for r in facts.dependencies(calls).collect()] == ["a -> b"]
    jobs = spark.createDataFrame([("j", "s", "t", "ssis")], "fqn string, source string, target string, dialect string")
    assert facts.job_facts(jobs).first()["snippet"] == "s → t (ssis)"
    times = spark.createDataFrame([("x", "02:00", "daily")], "fqn string, expr string, frequency string")
    assert facts.schedule_facts(times).first()["snippet"] == "02:00 daily"

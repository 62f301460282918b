"""Job graphs, statements, overrides, ledgers that go on, dialect helpers, sinks and streams, against values by hand."""

from __future__ import annotations

import datetime
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dialect
from tidemark.operators import column_lineage, ledger, portfolio, remediation, retrieval
from tidemark.sources import dataflow, estate, sinks
from tidemark.streaming import velocity

DSX = """BEGIN DSJOB
   BEGIN DSRECORD
      Identifier "V0S1"
      OLEType "CCustomStage"
      Name "Read"
      StageType "PxSeq"
      OutputPins "V0S1P1|V0S1P2"
   END DSRECORD
   BEGIN DSRECORD
      Identifier "V0S1P1"
      OLEType "CCustomOutput"
      Name "lnk"
      Partner "V0S2|V0S2P1"
      Partner "V0S9|V0S9P1"
   END DSRECORD
   BEGIN DSRECORD
      Identifier "V0S2"
      OLEType "CTransformerStage"
      Name "Make"
      InputPins "V0S2P1"
   END DSRECORD
END DSJOB
"""
SSIS = r"""<DTS:Executable DTS:refId="Package" DTS:ObjectName="P"><DTS:Executable DTS:refId="Package\T" DTS:ObjectName="Clean" DTS:CreationName="SQLTask"/>
<component refId="Package\F\Src" name="Src" componentClassID="OLE"/><component refId="Package\F\Dst" name="Dst" componentClassID="OLE"/>
<path refId="x" name="p1" startId="Package\F\Src.Outputs[Out]" endId="Package\F\Dst.Inputs[In]"/></DTS:Executable>"""
INFA = """<POWERMART><INSTANCE NAME="S" TYPE="SOURCE"/><INSTANCE NAME="E" TYPE="TRANSFORMATION"/><TRANSFORMATION NAME="E" TYPE="Expression"/>
<CONNECTOR FROMFIELD="A" FROMINSTANCE="S" TOFIELD="A1" TOINSTANCE="E"/><CONNECTOR FROMFIELD="B" FROMINSTANCE="S" TOFIELD="B1" TOINSTANCE="E"/></POWERMART>"""


def test_job_graphs(spark):
    texts = lambda t: spark.createDataFrame([("f", t)], "path string, text string")
    got = sorted((r["link_name"], r["source"], r["source_pin"], r["target"], r["target_pin"]) for r in dataflow.datastage_links(texts(DSX)).collect())
    assert got == [("lnk", "Read", "V0S1P1", "Make", "V0S2P1"), ("lnk", "Read", "V0S1P1", "Unknown", "V0S9P1")]
    (r,) = dataflow.ssis_links(texts(SSIS)).collect()
    assert (r["link_name"], r["source"], r["target"]) == ("p1", "Src", "Dst")
    assert sorted(r["name"] for r in dataflow.ssis_stages(texts(SSIS)).collect()) == ["Clean", "Dst", "Src"]
    (r,) = dataflow.informatica_links(texts(INFA)).collect()
    assert (r["link_name"], [tuple(f) for f in r["fields"]]) == ("S -> E", [("A", "A1"), ("B", "B1")])
    assert {r["name"]: r["type"] for r in dataflow.informatica_stages(texts(INFA)).collect()} == {"S": "Source Definition", "E": "Expression"}


XML_DSX = """<DSExport><Job Identifier="load_a"><Record Identifier="S1" Type="x"><Property Name="sql_query"><![CDATA[SELECT * FROM DW.SRC WHERE A &lt; 1]]></Property></Record>
<Record Identifier="S2"><Property Name="table_name">dw.tgt</Property><Property Name="write_mode">append</Property></Record><Record Identifier="S4"><Property Name="table_name">DW.BAD</Property></Record>
<Link SourceStage="S1" TargetStage="S2" Route="MAIN"/><Link SourceStage="S2" TargetStage="S3" Route="Reject_rows"/><Link SourceStage="S3" TargetStage="S4"/><Link SourceStage="S4" TargetStage="S3"/></Job>
<Job Identifier="cut"><Record Identifier="T1"><Property Name="table_name">DW.LOST"""


def test_datastage_in_xml(spark):
    texts = spark.createDataFrame([("f", XML_DSX)], "path string, text string")
    records = dataflow.datastage_records_xml(texts)
    assert {(r["job"], r["stage"], r["table_name"]) for r in records.collect()} == {("LOAD_A", "S1", None), ("LOAD_A", "S2", "DW.TGT"), ("LOAD_A", "S4", "DW.BAD")}
    assert {tuple(r) for r in dataflow.datastage_refs(records).collect()} == {("LOAD_A", "DW.SRC", "read"), ("LOAD_A", "DW.TGT", "write"), ("LOAD_A", "DW.BAD", "write")}
    assert [tuple(r) for r in dataflow.reject_targets(texts).collect()] == [("LOAD_A", "DW.BAD", "REJECT_ROWS")]


def test_datastage_in_the_graph(spark):
    ddl = "CREATE TABLE DW.SRC (A INT); CREATE TABLE DW.TGT (A INT); CREATE TABLE DW.BAD (A INT);"
    other = '<DSExport><Job Identifier="next_job"><Record Identifier="S1"><Property Name="sql_query">INSERT INTO DW.TGT SELECT A FROM DW.GONE</Property></Record></Job></DSExport>'
    files = spark.createDataFrame([("a/SRC_TO_X.dsx", XML_DSX), ("b/jobs.xml", other), ("t.sql", ddl), ("c/PLAIN_TO_FILE.dsx", "BEGIN DSJOB\nEND"), ("d/empty.xml", ""), ("e/none.dsx", None)], "path string, text string")
    nodes, edges, lost = estate.graph(files)
    kinds = {r["fqn"]: r["kind"] for r in nodes.collect()}
    assert {n for n, k in kinds.items() if k == "ETL_JOB"} >= {"LOAD_A", "CUT", "NEXT_JOB", "PLAIN_TO_FILE"} and not {"SRC_TO_X", "JOBS"} & set(kinds)
    got = {(r["src"], r["dst"], r["kind"], r["unresolved"]) for r in edges.collect()}
    assert got >= {("DW.SRC", "LOAD_A", "ETL_READS", False), ("LOAD_A", "DW.TGT", "ETL_WRITES", False), ("LOAD_A", "DW.BAD", "ETL_WRITES", False), ("DW.GONE", "NEXT_JOB", "ETL_READS", True), ("NEXT_JOB", "DW.TGT", "ETL_WRITES", False)}
    assert "DW.GONE" in {r["fqn"] for r in lost.collect()}


def test_inefficient_jobs(spark):
    stages = spark.createDataFrame([(f"s{i}", "T") for i in range(9)] + [("alone", "U")], "name string, type string")
    links = spark.createDataFrame([(f"s{i}", f"s{i + 1}") for i in range(8)] + [(f"x{i}", "s0") for i in range(5)], "source string, target string")
    got = {(r["pattern"], r["subject"], r["amount"]) for r in dataflow.inefficiencies(stages, links).collect()}
    assert {g for g in got if g[0] != "long_derivation_chain"} == {("high_fan_in_out", "s0", 5), ("orphan_stage", "alone", 0), ("repeated_stage_type", "T", 9)}
    assert {g[2] for g in got if g[0] == "long_derivation_chain"} == {9} and len(got) == 8


def test_lineage_of_statements(spark):
    spark.createDataFrame([(1, "x", 2.0)], "id int, name string, amount double").createOrReplaceTempView("src_t")
    rows = lambda sql: sorted((r["target"], r["target_column"], r["source_table"], r["source_column"], r["confidence"]) for r in column_lineage.of_statement(spark, sql).collect())
    assert rows("INSERT INTO dw.t (a, b) SELECT id, upper(name) FROM src_t") == [("DW.T", "a", "SRC_T", "id", 0.95), ("DW.T", "b", "SRC_T", "name", 0.9)]
    merge = "MERGE INTO dw.t AS t USING (SELECT id, amount * (1 + 1) AS total FROM src_t) s ON t.id = s.id WHEN MATCHED THEN UPDATE SET t.sum_all = s.total WHEN NOT MATCHED THEN INSERT (id, sum_all) VALUES (s.id, s.total)"
    assert rows(merge) == [("DW.T", "id", "SRC_T", "id", 0.75), ("DW.T", "sum_all", "SRC_T", "amount", 0.75)]
    assert rows("DELETE FROM dw.t") == []


def test_overrides(spark):
    nodes = spark.createDataFrame([("T1", "TABLE"), ("P", "PROCEDURE"), ("V", "VIEW")], "fqn string, kind string")
    edges = spark.createDataFrame([("OLD", "V", "VIEW_DEPENDS", 0.6, True), ("T1", "V", "VIEW_DEPENDS", 1.0, False), ("GONE", "V", "VIEW_DEPENDS", 1.0, True), ("P", "UNRESOLVED_DYNAMIC", "UNRESOLVED", 0.0, True)], "src string, dst string, kind string, confidence double, unresolved boolean")
    over = spark.createDataFrame([("OLD", "alias", "NO", None, 1), ("OLD", "alias", "T1", None, 2), ("GONE", "stub", None, None, 1), ("P", "runtime_sources", None, ["T1", "NOWHERE"], 1), ("ABSENT", "stub", None, None, 1), ("Q", "runtime_sources", None, ["T1"], 1)], "subject string, kind string, target string, sources array<string>, seq int")
    n, e, stale = remediation.apply_overrides(nodes, edges, over)
    assert {(r["fqn"], r["kind"]) for r in n.collect()} == {("T1", "TABLE"), ("P", "PROCEDURE"), ("V", "VIEW"), ("GONE", "TABLE")}
    assert {(r["src"], r["dst"], r["kind"], r["confidence"], r["unresolved"]) for r in e.collect()} == {("T1", "V", "VIEW_DEPENDS", 1.0, False), ("GONE", "V", "VIEW_DEPENDS", 1.0, False), ("P", "UNRESOLVED_DYNAMIC", "UNRESOLVED", 0.0, False), ("T1", "P", "SP_READS", 1.0, False)}
    assert {(r["subject"], r["reason"]) for r in stale.collect()} == {("ABSENT", "nothing refers to the subject"), ("Q", "subject is no object")}


def test_ledger_goes_on(spark):
    every = spark.createDataFrame([(c, i, f"{c}{i}") for c in "ab" for i in range(6)], "chain string, at long, payload string")
    whole = ledger.build(every, "chain", "at", "payload")
    old = ledger.build(every.filter("at < 3 and chain = 'a'"), "chain", "at", "payload")
    new = ledger.append(old, every.filter("at >= 3 or chain = 'b'"), "chain", "at", "payload")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(old.unionByName(new)) == key(whole)
    events = spark.createDataFrame([("diff_run", "kim", 1, "T"), ("odd_thing", None, 2, None)], "kind string, actor string, at int, subject string")
    assert [(r["who"], r["what"], r["relationship"]) for r in ledger.audit(events, "kind", "actor", "at", "subject").orderBy("at").collect()] == [("kim", "Source and target were compared", "kim -> diff_run -> T"), ("system", "Odd Thing", "system -> odd_thing")]
    assert ledger.has(events, "kind", "diff_run") and not ledger.has(events, "kind", "diff_run", F.col("actor").isNull())


def test_dialect_helpers(spark):
    row = spark.createDataFrame([(datetime.datetime(2024, 1, 31, 23, 59, 58), datetime.datetime(2024, 3, 1, 0, 0, 1), 1234567.891)], "a timestamp_ntz, b timestamp_ntz, x double")
    a, b = F.col("a"), F.col("b")
    got = row.select(
        dialect.convert(a, 108).alias("time"), dialect.convert(a, 121).alias("full"), *[dialect.boundaries(p, a, b).alias(p) for p in ("YEAR", "MONTH", "DAY", "HOUR", "SECOND")], dialect.weekday(a).alias("weekday"),
        dialect.format_n2(F.col("x")).alias("n2"), dialect.to_char(a, "YYYYMMDDHHMMSS").alias("stamp"), dialect.uuid5(F.lit("http://a.b/c")).alias("uuid"), dialect.date_add("HOUR", 2, a).alias("later"), dialect.date_add("MONTH", 1, a.cast("date")).alias("month"),
    ).first()
    assert (got["time"], got["full"], got["stamp"], got["n2"], got["weekday"]) == ("23:59:58", "2024-01-31 23:59:58.000", "20240131235958", "1,234,567.89", 4)
    assert (got["YEAR"], got["MONTH"], got["DAY"], got["HOUR"], got["SECOND"]) == (0, 2, 30, 697, 2505603)
    assert got["uuid"] == str(uuid.uuid5(uuid.NAMESPACE_URL, "http://a.b/c"))
    assert got["later"] == datetime.datetime(2024, 2, 1, 1, 59, 58) and got["month"] == datetime.date(2024, 2, 29)
    assert dialect.to_spark_sql("SELECT TOP 3 GETDATE() FROM t", "2024-05-06 07:08:09") == "SELECT TIMESTAMP_NTZ '2024-05-06 07:08:09' FROM t LIMIT 3"
    one = spark.createDataFrame([(7,)], "c int")
    said = {t: dialect.datastage_expression(t) for t in ("lnk.c", "'x'", "12", "1.5", "@TRUE", "SetNull()", "a + b")}
    assert said.pop("a + b") is None
    assert list(one.select(*[c.alias(f"c{i}") for i, c in enumerate(said.values())]).first()) == [7, "x", 12, 1.5, True, None]


def test_sinks(spark, tmp_path):
    nodes, edges = spark.createDataFrame([("a", "TABLE")], "fqn string, kind string"), spark.createDataFrame([("a", "b")], "src string, dst string")
    for estate in ("x", "y", "x"):
        sinks.write_graph(nodes, edges, str(tmp_path / "g"), estate)
    assert [df.count() for df in sinks.read_graph(spark, str(tmp_path / "g"), "x")] == [1, 1]
    assert spark.read.parquet(str(tmp_path / "g" / "nodes")).count() == 2
    assert [sinks.create_if_missing(spark, "made_once", "a int") for _ in range(2)] == [True, False]
    spark.sql("DROP TABLE made_once")
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, s string")
    assert [tuple(r) for r in sinks.update_where(df, F.col("s") == "a", {"k": F.col("k") * 10}).collect()] == [(10, "a"), (2, None)]
    assert [r["status"] for r in sinks.step_row(df, "load").union(sinks.step_row(df.filter("false"), "load")).collect()] == ["OK", "WARN"]


def test_registry_of_parsers(spark):
    texts = spark.createDataFrame([("a.ml", "x")], "path string, text string")
    portfolio.register_parser("notebooks", lambda t: t.select(F.lit("unknown").alias("type"), F.col("path").alias("fqn")))
    assert [tuple(r) for r in portfolio.unknown_facts(texts).collect()] == [("unknown", "a.ml", "notebooks")]
    with pytest.raises(ValueError):
        portfolio.register_parser("notebooks", lambda t: t)


def test_questions(spark):
    asked = spark.createDataFrame([(1, "What breaks if DW.FACT_ORDERS changes?"), (2, "tell me of fact_orders"), (3, "which orders are there"), (4, "What is the admin password"), (5, None)], "id int, text string")
    known = spark.createDataFrame([("DW.FACT_ORDERS",), ("DW.DIM_DAY",)], "fqn string")
    assert {(r["id"], r["fqn"], r["how"]) for r in retrieval.named_objects(asked, known).collect()} == {(1, "DW.FACT_ORDERS", "full"), (2, "DW.FACT_ORDERS", "leaf"), (3, "DW.FACT_ORDERS", "part")}
    said = {r["id"]: (r["r"], r["i"]["intent"]) for r in asked.select("id", retrieval.refused(F.col("text")).alias("r"), retrieval.intent(F.col("text")).alias("i")).collect()}
    assert said == {1: (False, "impact"), 2: (False, "vague"), 3: (False, "vague"), 4: (True, "vague"), 5: (False, "vague")}


def test_ways_of_asking(spark):
    texts = {"what feeds DW.X": "lineage", "Which views read it": "lineage", "what depends on DW.X": "impact", "What should we migrate first, downstream": "wedge", "most depended on tables": "hot", "the riskiest one": "complex", "dead code?": "orphan", "hello": "vague"}
    asked = spark.createDataFrame(list(texts.items()), "text string, want string")
    assert asked.filter(retrieval.intent(F.col("text"))["intent"] != F.col("want")).isEmpty()


def test_sliding_windows_and_sessions(spark):
    at = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)
    events = spark.createDataFrame([(1, at(0), 1.0), (1, at(0, 20), 2.0), (1, at(2), 4.0)], "user_id int, ts timestamp_ntz, value double")
    assert {r["n"] for r in velocity.sliding(events, "3 hours", "1 hour").collect()} == {1, 2, 3}
    assert sorted(r["n"] for r in velocity.sessions(events).collect()) == [1, 2]


def test_vocabulary_without_counting_every_pair(spark, monkeypatch):
    """The chosen terms are those of full counts, whether hash values collide or not, and rare pairs aren't counted."""
    import collections
    import random

    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefghijklmnop"[: rng.choice((3, 16))]) * 2 for _ in range(40)) for _ in range(60)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    count = collections.Counter(w for t in texts if t for ws in [t.split()] for w in [*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:]))])
    ranked = sorted(count, key=lambda w: (-count[w], w))
    for cells in (1 << 20, 7):
        monkeypatch.setattr(retrieval, "CELLS", cells)
        for features in (5, 14, 40, 10_000):
            assert [r["term"] for r in retrieval.vocabulary(docs, features).orderBy("t").collect()] == ranked[:features]

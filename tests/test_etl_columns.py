"""Elements of XML, tasks of nested SSIS packages, and lineage through the ports of mappings, against values by hand."""

from __future__ import annotations

import pytest

from tidemark.functions.scratch import cut
from tidemark.operators import ports
from tidemark.sources import ssis
from tidemark.sources.elements import ERROR, elements, nearest


def texts(spark, *files):
    return spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(files)], "path string, text string")


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_elements(spark):
    deep = "<a>" * 300 + "</a>" * 300
    entity = '<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>'
    got = elements(texts(spark, '<r x:k="1&lt;2"> t<n:b/><![CDATA[ <u> ]]></r>', "<r><b/><c>", "", None, deep, entity, '<!DOCTYPE r SYSTEM "r.dtd"><r/>'))
    by = {}
    for r in got.collect():
        by.setdefault(r["path"], []).append(r)
    assert sorted((r["nr"], tuple(r["up"]), r["tag"], dict(r["attributes"]), r["text"]) for r in by["f0"]) == [(0, (), "r", {"k": "1<2"}, "t <u>"), (1, (0,), "b", {}, "")]
    assert [r["tag"] for r in by["f1"]] == ["b", ERROR] and by["f1"][1]["up"] == [0, 2]
    assert "f2" not in by and "f3" not in by
    assert [(r["tag"], r["text"]) for r in by["f4"]] == [(ERROR, "nested deeper than 200")]
    assert [(r["tag"], r["text"]) for r in by["f5"]] == [(ERROR, "declares entities")]
    assert [r["tag"] for r in by["f6"]] == ["r"]


def test_a_file_of_many_elements(spark):
    many = "<r>" + "".join(f'<c n="{i}">{i}</c>' for i in range(20_000)) + "</r>"
    got = elements(texts(spark, many))
    assert got.count() == 20_001 and got.filter("tag = 'c' and attributes['n'] = text and nr = text + 1 and up = array(0L)").count() == 20_000


PACKAGE = r"""<?xml version="1.0"?>
<DTS:Executable xmlns:DTS="www.microsoft.com/SqlServer/Dts" DTS:refId="Package" DTS:ObjectName="P" DTS:ExecutableType="SSIS.Package.3">
<DTS:ConnectionManagers><DTS:ConnectionManager DTS:refId="Package.ConnectionManagers[C]" DTS:ObjectName="C" DTS:CreationName="OLEDB"><DTS:ObjectData><DTS:ConnectionManager DTS:ConnectionString="Data Source=h;Password=hush;Initial Catalog=d"/></DTS:ObjectData></DTS:ConnectionManager></DTS:ConnectionManagers>
<DTS:Variables><DTS:Variable DTS:Namespace="User" DTS:ObjectName="From"><DTS:VariableValue DTS:DataType="8">1 &amp; 2</DTS:VariableValue></DTS:Variable>
<DTS:Variable DTS:Namespace="User" DTS:ObjectName="Key"><DTS:VariableValue DTS:Sensitive="1">hush</DTS:VariableValue></DTS:Variable></DTS:Variables>
<DTS:Executables>
 <DTS:Executable DTS:refId="Package\A" DTS:ObjectName="A" DTS:CreationName="SQL"><DTS:ObjectData><S:SqlTaskData xmlns:S="s" S:SqlStatementSource="SELECT '&lt;component name=&quot;no&quot;/&gt;'"/></DTS:ObjectData></DTS:Executable>
 <DTS:Executable DTS:refId="Package\L" DTS:ObjectName="L" DTS:CreationName="STOCK:FOREACHLOOP">
  <DTS:Variables><DTS:Variable DTS:Namespace="User" DTS:ObjectName="File"><DTS:VariableValue/></DTS:Variable></DTS:Variables>
  <DTS:Executables>
   <DTS:Executable DTS:refId="Package\L\S" DTS:ObjectName="S" DTS:CreationName="STOCK:SEQUENCE"><DTS:Executables>
     <DTS:Executable DTS:refId="Package\L\S\F" DTS:ObjectName="F" DTS:CreationName="Microsoft.Pipeline"><DTS:ObjectData><pipeline><components>
       <component refId="x\Src" name="Src" componentClassID="OLE"><properties><property name="OpenRowset">dbo.T</property></properties><connections><connection name="c" connectionManagerRefId="Package.ConnectionManagers[C]"/></connections>
        <outputs><output refId="x\Src.Outputs[O]" name="O"><outputColumns><outputColumn refId="x\Src.O.A" name="A" dataType="wstr" length="5" lineageId="x\Src.O.A"/></outputColumns></output></outputs></component>
       <component refId="x\Drv" name="Drv" componentClassID="Derived"><inputs><input refId="x\Drv.Inputs[I]"><inputColumns><inputColumn refId="x\Drv.I.A" cachedName="A" lineageId="x\Src.O.A"/></inputColumns></input></inputs>
        <outputs><output refId="x\Drv.Outputs[O]"><outputColumns><outputColumn refId="x\Drv.O.B" name="B" dataType="i4" lineageId="x\Drv.O.B"><properties><property name="Expression">UPPER(#1)</property><property name="FriendlyExpression">UPPER(A)</property></properties></outputColumn></outputColumns></output></outputs></component>
      </components><paths><path refId="x.Paths[go]" name="go" startId="x\Src.Outputs[O]" endId="x\Drv.Inputs[I]"/><path refId="x.Paths[lost]" name="lost" startId="x\Drv.Outputs[O]" endId="x\Gone.Inputs[I]"/></paths></pipeline></DTS:ObjectData></DTS:Executable>
     <DTS:Executable DTS:refId="Package\L\S\G" DTS:ObjectName="G" DTS:CreationName="SQL" DTS:Disabled="True"/>
    </DTS:Executables><DTS:PrecedenceConstraints><DTS:PrecedenceConstraint DTS:From="Package\L\S\F" DTS:To="Package\L\S\G" DTS:Value="1" DTS:LogicalAnd="False" DTS:Expression="@x &gt; 1"/></DTS:PrecedenceConstraints></DTS:Executable>
  </DTS:Executables></DTS:Executable>
</DTS:Executables>
<DTS:PrecedenceConstraints><DTS:PrecedenceConstraint DTS:From="Package\A" DTS:To="Package\L"/></DTS:PrecedenceConstraints>
</DTS:Executable>"""


@pytest.fixture(scope="module")
def package(spark):
    return cut(elements(texts(spark, PACKAGE, "<other/>")))


def test_tasks_of_a_nested_package(package):
    got = rows(ssis.tasks(package), "name", "role", "container", "depth", "disabled")
    assert got == [("A", "task", "Package", 1, False), ("F", "data_flow", r"Package\L\S", 3, False), ("G", "task", r"Package\L\S", 3, True), ("L", "container", "Package", 1, False), ("S", "container", r"Package\L", 2, False)]
    (sql,) = [r["properties"] for r in ssis.tasks(package).filter("name = 'A'").collect()]
    assert sql == {"SqlStatementSource": "SELECT '<component name=\"no\"/>'"}


def test_order_of_tasks(package):
    assert rows(ssis.constraints(package), "container", "before", "after", "outcome", "expression", "all_needed") == [("Package", r"Package\A", r"Package\L", "success", None, True), (r"Package\L\S", r"Package\L\S\F", r"Package\L\S\G", "failure", "@x > 1", False)]
    assert rows(ssis.task_order(package), "name", "step", "route") == [("A", 0, [0]), ("F", 0, [1, 0, 0]), ("G", 1, [1, 0, 1]), ("L", 1, [1]), ("S", 0, [1, 0])]


def test_variables_and_connections(package):
    assert rows(ssis.variables(package), "scope", "name", "value") == [("Package", "From", "1 & 2"), ("Package", "Key", "***"), (r"Package\L", "File", "")]
    assert rows(ssis.connections(package), "name", "type", "connection_string") == [("C", "OLEDB", "Data Source=h;Password=***;Initial Catalog=d")]


def test_data_flows(package):
    assert rows(ssis.components(package), "task", "name", "properties", "connections") == [(r"Package\L\S\F", "Drv", {}, []), (r"Package\L\S\F", "Src", {"OpenRowset": "dbo.T"}, ["Package.ConnectionManagers[C]"])]
    assert rows(ssis.flow_links(package), "link_name", "source", "target") == [("go", "Src", "Drv"), ("lost", "Drv", "Unknown")]
    assert rows(ssis.component_columns(package), "component", "side", "name", "lineage_id", "expression") == [(r"x\Drv", "input", "A", r"x\Src.O.A", None), (r"x\Drv", "output", "B", r"x\Drv.O.B", "UPPER(A)"), (r"x\Src", "output", "A", r"x\Src.O.A", None)]


MAPPING = """<?xml version="1.0"?><!DOCTYPE POWERMART SYSTEM "powrmart.dtd"><POWERMART><REPOSITORY NAME="R"><FOLDER NAME="F">
<SOURCE NAME="CUST"><SOURCEFIELD NAME="ID"/><SOURCEFIELD NAME="FIRST"/><SOURCEFIELD NAME="LAST"/></SOURCE><TARGET NAME="DIM"><TARGETFIELD NAME="KEY"/><TARGETFIELD NAME="NAME"/><TARGETFIELD NAME="RUN"/><TARGETFIELD NAME="CITY"/><TARGETFIELD NAME="FREE"/></TARGET>
<TRANSFORMATION NAME="EXP" TYPE="Expression" REUSABLE="YES"><TRANSFORMFIELD NAME="WRONG" PORTTYPE="OUTPUT" EXPRESSION="1"/></TRANSFORMATION>
<MAPPING NAME="m1">
<TRANSFORMATION NAME="SQ" TYPE="Source Qualifier"><TRANSFORMFIELD NAME="ID" PORTTYPE="INPUT/OUTPUT"/><TRANSFORMFIELD NAME="FIRST" PORTTYPE="INPUT/OUTPUT"/><TRANSFORMFIELD NAME="LAST" PORTTYPE="INPUT/OUTPUT"/></TRANSFORMATION>
<TRANSFORMATION NAME="EXP" TYPE="Expression"><TRANSFORMFIELD NAME="ID" PORTTYPE="INPUT/OUTPUT" EXPRESSION="ID"/><TRANSFORMFIELD NAME="IN_A" PORTTYPE="INPUT"/><TRANSFORMFIELD NAME="IN_B" PORTTYPE="INPUT"/>
 <TRANSFORMFIELD NAME="V_FULL" PORTTYPE="LOCAL VARIABLE" EXPRESSION="in_a || ' IN_B ' || LTRIM(IN_B)"/><TRANSFORMFIELD NAME="V_N" PORTTYPE="LOCAL VARIABLE" EXPRESSION="V_N + 1"/>
 <TRANSFORMFIELD NAME="O_NAME" PORTTYPE="OUTPUT" EXPRESSION="UPPER(V_FULL)"/><TRANSFORMFIELD NAME="O_RUN" PORTTYPE="OUTPUT" EXPRESSION="SYSDATE"/></TRANSFORMATION>
<TRANSFORMATION NAME="LKP" TYPE="Lookup Procedure"><TRANSFORMFIELD NAME="IN_ID" PORTTYPE="INPUT"/><TRANSFORMFIELD NAME="CITY" PORTTYPE="LOOKUP/OUTPUT"/><TABLEATTRIBUTE NAME="Lookup table name" VALUE="TOWNS"/></TRANSFORMATION>
<TRANSFORMATION NAME="UN" TYPE="Custom Transformation"><TRANSFORMFIELD NAME="K1" PORTTYPE="INPUT"/><TRANSFORMFIELD NAME="K2" PORTTYPE="INPUT"/><TRANSFORMFIELD NAME="K" PORTTYPE="OUTPUT"/><FIELDDEPENDENCY INPUTFIELD="K1" OUTPUTFIELD="K"/><FIELDDEPENDENCY INPUTFIELD="K2" OUTPUTFIELD="K"/></TRANSFORMATION>
<INSTANCE NAME="CUST1" TRANSFORMATION_NAME="CUST" TYPE="SOURCE"/><INSTANCE NAME="SQ" TRANSFORMATION_NAME="SQ" TYPE="TRANSFORMATION"/><INSTANCE NAME="EXP1" TRANSFORMATION_NAME="EXP" TYPE="TRANSFORMATION"/><INSTANCE NAME="LKP" TYPE="TRANSFORMATION"/><INSTANCE NAME="UN" TYPE="TRANSFORMATION"/><INSTANCE NAME="DIM1" TRANSFORMATION_NAME="DIM" TYPE="TARGET"/>
""" + "".join(f'<CONNECTOR FROMINSTANCE="{a.split(".")[0]}" FROMFIELD="{a.split(".")[1]}" TOINSTANCE="{b.split(".")[0]}" TOFIELD="{b.split(".")[1]}"/>' for a, b in [("CUST1.ID", "SQ.ID"), ("CUST1.FIRST", "SQ.FIRST"), ("CUST1.LAST", "SQ.LAST"), ("SQ.ID", "EXP1.ID"), ("SQ.FIRST", "EXP1.IN_A"), ("SQ.LAST", "EXP1.IN_B"), ("EXP1.ID", "UN.K1"), ("SQ.ID", "UN.K2"), ("UN.K", "DIM1.KEY"), ("EXP1.O_NAME", "DIM1.NAME"), ("EXP1.O_RUN", "DIM1.RUN"), ("SQ.ID", "LKP.IN_ID"), ("LKP.CITY", "DIM1.CITY")]) + "</MAPPING></FOLDER></REPOSITORY></POWERMART>"


def test_lineage_through_ports(spark):
    parsed = cut(elements(texts(spark, MAPPING)))
    got = ports.port_lineage(*ports.informatica_ports(parsed))
    whole = "UPPER(CUST.FIRST || ' IN_B ' || LTRIM(CUST.LAST))"
    first = "in_a || ' IN_B ' || LTRIM(IN_B)"
    assert rows(got, "target_table", "target_column", "source_table", "source_column", "transform", "first", "hops", "confidence", "reason") == sorted(
        [
            ("DIM", "KEY", "CUST", "ID", "CUST.ID", None, 5, 0.95, None),
            ("DIM", "NAME", "CUST", "FIRST", whole, first, 6, 0.9, None),
            ("DIM", "NAME", "CUST", "LAST", whole, first, 6, 0.9, None),
            ("DIM", "RUN", None, None, "SYSDATE", None, None, 0.0, "constant"),
            ("DIM", "CITY", "TOWNS", "CITY", "TOWNS.CITY", None, 2, 0.95, None),
            ("DIM", "FREE", None, None, None, None, None, 0.0, "unconnected"),
        ],
        key=str,
    )


def _record(kind, *lines):
    return f"BEGIN {kind}\n" + "\n".join(lines) + f"\nEND {kind}\n"


def _columns(*cols):
    return tuple(_record("DSSUBRECORD", f'Name "{n}"', *(f'{k} "{v}"' for k, v in more.items())).rstrip() for n, more in cols)


JOB = 'BEGIN DSJOB\nIdentifier "j"\n' + "".join(
    [
        _record("DSRECORD", 'Identifier "S1"', 'OLEType "CCustomStage"', 'Name "ORDERS"', 'OutputPins "S1P1"'),
        _record("DSRECORD", 'Identifier "S1P1"', 'OLEType "CCustomOutput"', 'Name "in"', 'Partner "S2|S2P1"', *_columns(("A", {}), ("B", {"Derivation": "B"}), ("C", {}))),
        _record("DSRECORD", 'Identifier "S2"', 'OLEType "CTransformerStage"', 'Name "Make"', 'InputPins "S2P1"', 'OutputPins "S2P2"'),
        _record("DSRECORD", 'Identifier "S2P1"', 'OLEType "CTrxInput"', 'Name "in"'),
        _record("DSRECORD", 'Identifier "S2P2"', 'OLEType "CTrxOutput"', 'Name "mid"', 'Partner "S3|S3P1"', *_columns(("X", {"Derivation": "in.A + in.B"}), ("C", {"Derivation": "in.C"}), ("K", {"Derivation": "1"}))),
        _record("DSRECORD", 'Identifier "S3"', 'OLEType "CCustomStage"', 'Name "Sort"', 'InputPins "S3P1"', 'OutputPins "S3P2"'),
        _record("DSRECORD", 'Identifier "S3P1"', 'OLEType "CCustomInput"', 'Name "mid"'),
        _record("DSRECORD", 'Identifier "S3P2"', 'OLEType "CCustomOutput"', 'Name "out"', 'Partner "S4|S4P1"', *_columns(("X", {"SourceColumn": "mid.X"}), ("C", {}), ("K", {"Derivation": "mid.K * 2"}))),
        _record("DSRECORD", 'Identifier "S4"', 'OLEType "CCustomStage"', 'Name "FACT"', 'InputPins "S4P1"'),
        _record("DSRECORD", 'Identifier "S4P1"', 'OLEType "CCustomInput"', 'Name "out"'),
    ]
) + "END DSJOB\n"


def test_lineage_through_links(spark):
    got = ports.port_lineage(*ports.datastage_ports(texts(spark, JOB, "", None)))
    assert rows(got, "mapping", "target_table", "target_column", "source_table", "source_column", "transform", "first", "hops", "reason") == sorted(
        [
            ("j", "FACT", "X", "ORDERS", "A", "ORDERS.A + ORDERS.B", "in.A + in.B", 4, None),
            ("j", "FACT", "X", "ORDERS", "B", "ORDERS.A + ORDERS.B", "in.A + in.B", 4, None),
            ("j", "FACT", "C", "ORDERS", "C", "ORDERS.C", None, 4, None),
            ("j", "FACT", "K", None, None, "1 * 2", None, None, "constant"),
        ],
        key=str,
    )


def test_wires_in_circles_and_twice(spark):
    p = spark.createDataFrame([("f", "m", "s.a", "s", "a", "source", None), ("f", "m", "x.a", "x", "a", None, "a + b"), ("f", "m", "x.b", "x", "b", None, "a"), ("f", "m", "t.a", "t", "a", "target", None)] * 2, "path string, mapping string, port string, owner string, field string, end string, expression string")
    w = spark.createDataFrame([("f", "m", "s.a", "x.a", "a"), ("f", "m", "x.b", "x.a", "b"), ("f", "m", "x.a", "x.b", "a"), ("f", "m", "x.b", "t.a", None)] * 2, "path string, mapping string, src string, dst string, name string")
    got = ports.port_lineage(p, w)
    assert rows(got, "target_column", "source_column", "transform", "first", "hops", "confidence") == [("a", "a", None, "a + b", 4, 0.9)]
    assert ports.port_lineage(p.limit(0), w.limit(0)).count() == 0


PORTS = "path string, mapping string, port string, owner string, field string, end string, expression string"
WIRES = "path string, mapping string, src string, dst string, name string"


def test_ways_longer_than_the_steps_between_shuffles(spark):
    n = 3 * ports.STEPS + 2
    p = spark.createDataFrame([("f", "m", f"p{i}.a", f"p{i}", "a", "source" if i == 0 else "target" if i == n else None, f"a + {i}" if i in (3, 5) else None) for i in range(n + 1)], PORTS)
    w = spark.createDataFrame([("f", "m", f"p{i}.a", f"p{i + 1}.a", "a") for i in range(n)] + [("f", "m", "p1.a", "x.a", "a"), ("f", "m", "x.a", "y.a", "a"), ("f", "m", "y.a", "x.a", "a"), ("g", "m", "s.a", "s.a", None)], WIRES)
    got = ports.port_lineage(p, w)
    assert rows(got, "path", "target_column", "source_table", "transform", "first", "hops", "reason") == [("f", "a", "p0", "(p0.a + 3) + 5", "a + 3", n + 1, None), ("g", "a", None, "s.a", None, None, "constant")]


def test_circles_behind_columns_of_several_ways(spark):
    # The circle is reached at x.a by two ways of the same length, one of which passes a column on, and left at y.a.
    p = spark.createDataFrame([("f", "m", "s.a", "s", "a", "source", None), ("f", "m", "v.a", "v", "a", None, "a + 1"), ("f", "m", "u.a", "u", "a", None, None), ("f", "m", "x.a", "x", "a", None, None), ("f", "m", "y.a", "y", "a", None, None), ("f", "m", "t.a", "t", "a", "target", None)], PORTS)
    w = spark.createDataFrame([("f", "m", a, b, "a") for a, b in [("s.a", "u.a"), ("s.a", "v.a"), ("u.a", "x.a"), ("v.a", "x.a"), ("x.a", "y.a"), ("y.a", "x.a"), ("y.a", "t.a")]], WIRES)
    got = ports.port_lineage(p, w)
    assert rows(got, "target_column", "source_column", "transform", "first", "hops", "confidence", "reason") == [("a", "a", None, "a + 1", 5, 0.9, None)]


def _stages(spark):
    """Records that each stage so far has written for others, by its id."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    none = spark._jvm.java.util.ArrayList
    stages = sc.statusStore().stageList(none(), False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none())
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_ports_and_wires_are_shuffled_once(spark):
    m = spark.range(200).selectExpr("concat('m', id) as mapping")
    p = spark.createDataFrame([("f", "s.a", "s", "a", "source", None), ("f", "x.a", "x", "a", None, "a + 1"), ("f", "y.a", "y", "a", None, "a * 2"), ("f", "t.a", "t", "a", "target", None)], PORTS.replace("mapping string, ", ""))
    w = spark.createDataFrame([("f", "s.a", "x.a", "a"), ("f", "x.a", "y.a", "a"), ("f", "y.a", "t.a", None)], WIRES.replace("mapping string, ", ""))
    p, w = cut(p.crossJoin(m)), cut(w.crossJoin(m))
    before = max(_stages(spark))
    got = [tuple(r) for r in ports.port_lineage(p, w).select("transform", "first", "hops").collect()]
    assert got == [("(s.a + 1) * 2", "a + 1", 4)] * 200
    # The rows themselves, and a few of emptiness tests.
    assert 200 * 7 <= sum(n for i, n in _stages(spark).items() if i > before) < 200 * 7 + 100


def test_nearest_elements_around(spark):
    got = elements(texts(spark, "<a><b><c/><a><c/></a></b></a>")).filter("tag = 'c'").select("nr", nearest("a").alias("a"), nearest("a", "b").alias("ab"), nearest("z").alias("z"))
    assert rows(got, "nr", "a", "ab", "z") == [(2, 0, 1, None), (4, 3, 3, None)]

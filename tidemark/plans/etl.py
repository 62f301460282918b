"""ETL files that are made of the star schema's rows, one a row, and what is read out of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import cut
from ..operators import ports
from ..sources import ssis
from ..sources.elements import elements
from .registry import query, table

#: Customers to a task that makes files of them, for a table may lie in one piece.
PER_TASK = 8192

_MAPPING = """<POWERMART><FOLDER NAME="F"><SOURCE NAME="CUSTOMER"><SOURCEFIELD NAME="C_NAME"/><SOURCEFIELD NAME="C_SEGMENT"/></SOURCE>
<TARGET NAME="DIM_CUSTOMER"><TARGETFIELD NAME="SEGMENT"/><TARGETFIELD NAME="LABEL"/><TARGETFIELD NAME="NATION"/></TARGET><MAPPING NAME="m_%s">
<TRANSFORMATION NAME="EXP" TYPE="Expression"><TRANSFORMFIELD NAME="IN_NAME" PORTTYPE="INPUT"/><TRANSFORMFIELD NAME="IN_SEGMENT" PORTTYPE="INPUT"/>
<TRANSFORMFIELD NAME="V_LABEL" PORTTYPE="LOCAL VARIABLE" EXPRESSION="IN_NAME || &apos;%s&apos; || IN_SEGMENT"/>
<TRANSFORMFIELD NAME="O_LABEL" PORTTYPE="OUTPUT" EXPRESSION="SUBSTR(V_LABEL, 1, %s)"/><TRANSFORMFIELD NAME="O_NATION" PORTTYPE="OUTPUT" EXPRESSION="%s"/></TRANSFORMATION>
<INSTANCE NAME="CUSTOMER" TYPE="SOURCE"/><INSTANCE NAME="EXP" TYPE="TRANSFORMATION"/><INSTANCE NAME="DIM_CUSTOMER" TYPE="TARGET"/>
<CONNECTOR FROMINSTANCE="CUSTOMER" FROMFIELD="C_NAME" TOINSTANCE="EXP" TOFIELD="IN_NAME"/><CONNECTOR FROMINSTANCE="CUSTOMER" FROMFIELD="C_SEGMENT" TOINSTANCE="EXP" TOFIELD="IN_SEGMENT"/>
<CONNECTOR FROMINSTANCE="CUSTOMER" FROMFIELD="C_SEGMENT" TOINSTANCE="DIM_CUSTOMER" TOFIELD="SEGMENT"/><CONNECTOR FROMINSTANCE="EXP" FROMFIELD="O_LABEL" TOINSTANCE="DIM_CUSTOMER" TOFIELD="LABEL"/>%s</MAPPING></FOLDER></POWERMART>"""


@query("""WITH c AS (SELECT concat('m_', c_custkey) AS mapping, c_custkey, c_nationkey, concat('SUBSTR(CUSTOMER.C_NAME || ''', c_mktsegment, ''' || CUSTOMER.C_SEGMENT, 1, ', c_nationkey, ')') AS e, concat('IN_NAME || ''', c_mktsegment, ''' || IN_SEGMENT') AS f FROM customer)
SELECT mapping, 'SEGMENT' AS target_column, 'C_SEGMENT' AS source_column, 'CUSTOMER.C_SEGMENT' AS transform, NULL AS first, 2 AS hops, 0.95::DOUBLE AS confidence, NULL AS reason FROM c
UNION ALL SELECT mapping, 'LABEL', s, e, f, 5, 0.9, NULL FROM c, (VALUES ('C_NAME'), ('C_SEGMENT')) v(s)
UNION ALL SELECT mapping, 'NATION', NULL, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_nationkey AS VARCHAR) END, NULL, NULL, 0.0, CASE WHEN c_custkey % 3 = 0 THEN 'constant' ELSE 'unconnected' END FROM c""")
def mapping_port_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer as a mapping in XML: a column passed on, one made by two expressions, one constant or unconnected."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    customers = customers.repartition(1 + customers.count() // PER_TASK, "c_custkey")
    wired = F.when(F.col("c_custkey") % 3 == 0, '<CONNECTOR FROMINSTANCE="EXP" FROMFIELD="O_NATION" TOINSTANCE="DIM_CUSTOMER" TOFIELD="NATION"/>').otherwise("")
    text = F.format_string(_MAPPING, F.col("c_custkey").cast("string"), "c_mktsegment", F.col("c_nationkey").cast("string"), F.col("c_nationkey").cast("string"), wired)
    files = customers.select(F.col("c_custkey").cast("string").alias("path"), text.alias("text"))
    found = ports.port_lineage(*ports.informatica_ports(cut(elements(files))))
    return found.select("mapping", "target_column", "source_column", "transform", "first", "hops", "confidence", "reason")


@query("""WITH t AS (SELECT s_suppkey, unnest(range(s_nationkey % 4 + 1)) AS i FROM supplier)
SELECT CAST(s_suppkey AS VARCHAR) AS path, concat('T', i) AS name, i AS step, concat('1.', i) AS route FROM t UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'FIRST', 0, '0' FROM supplier UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'LOOP', 1, '1' FROM supplier""")
def package_task_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier as a package in XML: a task, then a container with a chain of tasks."""
    n = F.sequence(F.lit(0), F.col("s_nationkey") % 4)
    joined = lambda items: F.array_join(items, "")
    task = joined(F.transform(n, lambda i: F.concat(F.lit('<DTS:Executable DTS:refId="Package\\L\\T'), i.cast("string"), F.lit('" DTS:ObjectName="T'), i.cast("string"), F.lit('"/>'))))
    wait = joined(F.transform(F.filter(n, lambda i: i > 0), lambda i: F.concat(F.lit('<DTS:PrecedenceConstraint DTS:From="Package\\L\\T'), (i - 1).cast("string"), F.lit('" DTS:To="Package\\L\\T'), i.cast("string"), F.lit('"/>'))))
    text = F.concat(F.lit('<DTS:Executable xmlns:DTS="d" DTS:refId="Package" DTS:ObjectName="P"><DTS:Executables><DTS:Executable DTS:refId="Package\\F" DTS:ObjectName="FIRST"/><DTS:Executable DTS:refId="Package\\L" DTS:ObjectName="LOOP"><DTS:Executables>'), task, F.lit("</DTS:Executables><DTS:PrecedenceConstraints>"), wait, F.lit('</DTS:PrecedenceConstraints></DTS:Executable></DTS:Executables><DTS:PrecedenceConstraints><DTS:PrecedenceConstraint DTS:From="Package\\F" DTS:To="Package\\L"/></DTS:PrecedenceConstraints></DTS:Executable>'))
    files = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), text.alias("text"))
    order = ssis.task_order(cut(elements(files)))
    return order.select("path", "name", "step", F.array_join(F.transform("route", lambda s: s.cast("string")), ".").alias("route"))

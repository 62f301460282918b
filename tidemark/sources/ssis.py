"""SSIS packages: tasks in their containers, the order that precedence constraints give them, variables, connections,
and components, columns and links of data flows. All take the rows of elements.elements().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import cut
from ..operators.graph import levels
from .elements import enclosed
from .estate import MASK

#: What a precedence constraint waits for.
OUTCOMES = {"0": "success", "1": "failure", "2": "completion"}


def _at(name: str, row: str = "attributes") -> Column:
    return F.col(row)[name]


def _of(elements: DataFrame, tag: str) -> DataFrame:
    return elements.filter(F.col("tag") == tag)


def _parent(elements: DataFrame) -> DataFrame:
    """Elements with the number of what directly encloses them."""
    return elements.withColumn("parent", F.try_element_at("up", F.lit(-1)))


def _executables(elements: DataFrame) -> DataFrame:
    """(path, nr, up, ref_id, name, kind, disabled): executables that have a name or an id, packages too."""
    found = _of(elements, "Executable")
    return found.select("path", "nr", "up", F.coalesce(_at("refId"), _at("DTSID"), _at("ObjectName")).alias("ref_id"), _at("ObjectName").alias("name"), F.coalesce(_at("CreationName"), _at("ExecutableType")).alias("kind"), (F.lower(F.coalesce(_at("Disabled"), F.lit(""))).isin("true", "1", "-1")).alias("disabled"))


def tasks(elements: DataFrame) -> DataFrame:
    """(path, ref_id, name, type, role, container, depth, disabled, properties): all executables below a package.

    role is container where others are in it, data_flow where a pipeline is, else task; container is the ref_id of the
    nearest executable around it, so that those of event handlers belong to what the handler belongs to. depth is 1
    directly in the package. properties are the attributes in a task's own data; of repeated ones the last in the file.
    """
    every = cut(_executables(elements))
    placed = enclosed(every, every, "outer").join(every.select("path", F.col("nr").alias("outer"), F.col("ref_id").alias("container")), ["path", "outer"], "left")
    depth = every.select("path", "nr", F.explode("up").alias("_o")).join(every.select("path", F.col("nr").alias("_o")), ["path", "_o"], "left_semi").groupBy("path", "nr").agg(F.count("*").cast("int").alias("depth"))
    holding = placed.select("path", F.col("outer").alias("nr")).distinct().withColumn("holds", F.lit(True))
    flows = enclosed(_of(elements, "pipeline").select("path", "nr", "up"), every, "outer").select("path", F.col("outer").alias("nr")).distinct().withColumn("flows", F.lit(True))
    below = _of(elements, "ObjectData").select("path", F.col("nr").alias("_data"))
    inside = elements.select("path", "nr", "up", "attributes", F.explode("up").alias("_data")).join(below, ["path", "_data"], "left_semi").select("path", "nr", "up", "attributes").dropDuplicates(["path", "nr"])
    said = enclosed(inside, every, "outer").select("path", "outer", "nr", F.explode("attributes").alias("k", "v"))
    own = said.groupBy("path", F.col("outer").alias("nr"), "k").agg(F.max_by("v", "nr").alias("v")).groupBy("path", "nr").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("properties"))
    rows = placed.filter("outer is not null").join(depth, ["path", "nr"]).join(holding, ["path", "nr"], "left").join(flows, ["path", "nr"], "left").join(own, ["path", "nr"], "left")
    role = F.when(F.col("flows"), "data_flow").when(F.col("holds"), "container").otherwise("task")
    plain = F.when(role == "task", F.coalesce("properties", F.create_map().cast("map<string,string>"))).otherwise(F.create_map().cast("map<string,string>"))
    return rows.select("path", "ref_id", "name", F.col("kind").alias("type"), role.alias("role"), "container", "depth", "disabled", plain.alias("properties"))


def constraints(elements: DataFrame) -> DataFrame:
    """(path, container, before, after, outcome, expression, all_needed): precedence constraints by their tasks' ref_ids."""
    every = _executables(elements)
    found = enclosed(_of(elements, "PrecedenceConstraint").filter(_at("From").isNotNull() & _at("To").isNotNull()), every, "outer")
    held = every.select("path", F.col("nr").alias("outer"), F.col("ref_id").alias("container"))
    outcome = F.create_map(*[F.lit(x) for pair in OUTCOMES.items() for x in pair])[F.coalesce(_at("Value"), F.lit("0"))]
    every_one = ~F.lower(F.coalesce(_at("LogicalAnd"), F.lit("true"))).isin("false", "0")
    return found.join(held, ["path", "outer"], "left").select("path", "container", _at("From").alias("before"), _at("To").alias("after"), F.coalesce(outcome, F.lit("unknown")).alias("outcome"), _at("Expression").alias("expression"), every_one.alias("all_needed"))


def task_order(elements: DataFrame) -> DataFrame:
    """(path, ref_id, name, step, route): when each task runs, as far as its constraints tell.

    step is the longest way of constraints to it inside its container (0: it waits for nothing); null on or behind a
    cycle. route are the steps of the containers around it, outermost first, then its own: routes sort in running order,
    and equal ones may run side by side.
    """
    every = cut(tasks(elements))
    key = lambda c: F.concat_ws("\n", "path", c)
    waits = constraints(elements).select(key("before").alias("src"), key("after").alias("dst"))
    step = levels(waits).select(F.col("node").alias("_k"), "level", F.lit(True).alias("linked"))
    stepped = cut(every.withColumn("_k", key("ref_id")).join(step, "_k", "left").select("path", "ref_id", "name", "container", "depth", F.when(F.col("linked"), F.col("level")).otherwise(F.lit(0)).cast("int").alias("step")).dropDuplicates(["path", "ref_id"]))
    # Containers are followed outwards; a round is a level of nesting.
    walk = stepped.select("path", "ref_id", "name", "step", F.array("step").alias("route"), F.col("container").alias("at"))
    outer = stepped.select("path", F.col("ref_id").alias("at"), F.col("step").alias("_s"), F.col("container").alias("_c"))
    deepest = stepped.agg(F.coalesce(F.max("depth"), F.lit(1))).first()[0]
    for _ in range(deepest - 1):
        walk = walk.join(outer, ["path", "at"], "left").select("path", "ref_id", "name", "step", F.when(F.col("_c").isNotNull(), F.concat(F.array("_s"), "route")).otherwise(F.col("route")).alias("route"), F.col("_c").alias("at"))
    return walk.select("path", "ref_id", "name", "step", "route")


def variables(elements: DataFrame) -> DataFrame:
    """(path, scope, namespace, name, value, sensitive): variables with the ref_id of the executable that declares them.

    What is marked as sensitive has MASK for its value.
    """
    every = _executables(elements)
    held = every.select("path", F.col("nr").alias("outer"), F.col("ref_id").alias("scope"))
    values = _parent(_of(elements, "VariableValue")).groupBy("path", F.col("parent").alias("nr")).agg(F.max_by(F.struct(F.col("text").alias("value"), F.lower(F.coalesce(_at("Sensitive"), F.lit("0"))).isin("1", "true").alias("sensitive")), "nr").alias("v"))
    found = enclosed(_of(elements, "Variable"), every, "outer").join(held, ["path", "outer"], "left").join(values, ["path", "nr"], "left")
    secret = F.coalesce("v.sensitive", F.lit(False))
    return found.filter(_at("ObjectName").isNotNull() | _at("Name").isNotNull()).select("path", "scope", _at("Namespace").alias("namespace"), F.coalesce(_at("ObjectName"), _at("Name")).alias("name"), F.when(secret, MASK).otherwise(F.col("v.value")).alias("value"), secret.alias("sensitive"))


def connections(elements: DataFrame) -> DataFrame:
    """(path, ref_id, name, type, connection_string): connection managers; passwords in strings are MASK."""
    outer = _of(elements, "ConnectionManager")
    # A manager's string stands on an element of the same name in its data.
    inner = enclosed(outer.filter(_at("ConnectionString").isNotNull()), outer, "outer").select("path", F.coalesce("outer", "nr").alias("nr"), _at("ConnectionString").alias("s")).groupBy("path", "nr").agg(F.max("s").alias("s"))
    masked = F.regexp_replace("s", r"(?i)((?:password|pwd)\s*=\s*)[^;]*", f"$1{MASK}")
    return outer.filter(_at("ObjectName").isNotNull()).join(inner, ["path", "nr"], "left").select("path", _at("refId").alias("ref_id"), _at("ObjectName").alias("name"), _at("CreationName").alias("type"), masked.alias("connection_string"))


def components(elements: DataFrame) -> DataFrame:
    """(path, task, ref_id, name, type, properties, connections): components of data flows, with their task's ref_id."""
    every = _executables(elements)
    held = every.select("path", F.col("nr").alias("outer"), F.col("ref_id").alias("task"))
    found = _of(elements, "component").filter(_at("refId").isNotNull() | _at("id").isNotNull())
    placed = enclosed(found, every, "outer").join(held, ["path", "outer"], "left")
    said = enclosed(_of(elements, "property").filter(_at("name").isNotNull()), found, "of")
    # Properties of columns and of inputs are not the component's own, those stand two levels below it.
    own = said.filter(F.try_element_at("up", F.lit(-2)) == F.col("of")).select("path", F.col("of").alias("nr"), F.concat_ws(".", _at("name"), F.nullif(_at("name1"), F.lit(""))).alias("k"), F.col("text").alias("v"), F.col("nr").alias("_n"))
    properties = own.groupBy("path", "nr", "k").agg(F.max_by("v", "_n").alias("v")).groupBy("path", "nr").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("properties"))
    used = enclosed(_of(elements, "connection"), found, "of").groupBy("path", F.col("of").alias("nr")).agg(F.array_sort(F.collect_set(F.coalesce(_at("connectionManagerRefId"), _at("connectionManagerID"), _at("name")))).alias("connections"))
    rows = placed.join(properties, ["path", "nr"], "left").join(used, ["path", "nr"], "left")
    return rows.select("path", "task", F.coalesce(_at("refId"), _at("id")).alias("ref_id"), _at("name").alias("name"), _at("componentClassID").alias("type"), F.coalesce("properties", F.create_map().cast("map<string,string>")).alias("properties"), F.coalesce("connections", F.array().cast("array<string>")).alias("connections"))


def component_columns(elements: DataFrame) -> DataFrame:
    """(path, component, side, port, name, data_type, length, lineage_id, expression): columns of inputs and outputs.

    lineage_id is, on an input, the output column that it comes from; expression what a derived one is made by.
    """
    found = _of(elements, "component")
    names = found.select("path", F.col("nr").alias("of"), F.coalesce(_at("refId"), _at("id")).alias("component"))
    out = None
    for side in ("input", "output"):
        ports = _of(elements, side)
        held = ports.select("path", F.col("nr").alias("port_nr"), F.coalesce(_at("refId"), _at("id")).alias("port"))
        columns = enclosed(enclosed(_of(elements, f"{side}Column"), found, "of"), ports, "port_nr").join(names, ["path", "of"]).join(held, ["path", "port_nr"])
        said = enclosed(_of(elements, "property").filter(_at("name").isin("FriendlyExpression", "Expression")), columns, "at").groupBy("path", F.col("at").alias("nr")).agg(F.max_by("text", F.struct((_at("name") == "FriendlyExpression"), "nr")).alias("expression"))
        rows = columns.join(said, ["path", "nr"], "left").select("path", "component", F.lit(side).alias("side"), "port", F.coalesce(_at("name"), _at("cachedName")).alias("name"), F.coalesce(_at("dataType"), _at("cachedDataType")).alias("data_type"), F.coalesce(_at("length"), _at("cachedLength")).alias("length"), F.coalesce(_at("lineageId"), _at("refId")).alias("lineage_id"), F.nullif("expression", F.lit("")).alias("expression"))
        out = rows if out is None else out.unionByName(rows)
    return out


def flow_links(elements: DataFrame) -> DataFrame:
    """(path, task, link_name, source, source_port, target, target_port): paths of data flows between components' names.

    A port is found among the components of its own file; an end that isn't there is `Unknown`.
    """
    every, found = _executables(elements), _of(elements, "component")
    held = every.select("path", F.col("nr").alias("outer"), F.col("ref_id").alias("task"))
    names = found.select("path", F.col("nr").alias("of"), _at("name").alias("name"))
    ports = enclosed(elements.filter(F.col("tag").isin("input", "output")), found, "of").join(names, ["path", "of"]).select("path", F.coalesce(_at("refId"), _at("id")).alias("port"), "name").dropDuplicates(["path", "port"])
    links = enclosed(_of(elements, "path").filter(_at("startId").isNotNull()), every, "outer").join(held, ["path", "outer"], "left").select("path", "task", F.coalesce(_at("name"), F.substring_index(_at("refId"), "\\", -1)).alias("link_name"), _at("startId").alias("source_port"), _at("endId").alias("target_port"))
    for end in ("source", "target"):
        links = links.join(ports.select("path", F.col("port").alias(f"{end}_port"), F.col("name").alias(end)), ["path", f"{end}_port"], "left").withColumn(end, F.coalesce(end, F.lit("Unknown")))
    return links.select("path", "task", "link_name", "source", "source_port", "target", "target_port")

"""Lineage from field to field through the transformations of ETL mappings.

Ports have rows (path, mapping, port, owner, field, end, expression): one field of an instance or link. owner and field
are what it is called as a column; end is `source` or `target` where it is one, else null. Wires have rows
(path, mapping, src, dst, name): dst is made of src, which its expression calls `name` (null: dst passes src on).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import cut
from ..sources.elements import nearest
from ..sources.estate import datastage_records

#: Literals, numbers, names with at most one dot, and single signs of an expression.
TOKEN = r"(?s)'[^']*'|\"[^\"]*\"|\d[\w.]*|[A-Za-z_$#][\w$#]*(?:\.[A-Za-z_$#][\w$#]*)?|."
#: A composed expression beyond so many characters isn't put into the next one, which keeps the port's name instead.
LONGEST = 32_768
#: Steps along wires between two shuffles.
STEPS = 4
#: Ports to a task, about. The steps sort within a task side by side, so that with many more they would spill.
PER_TASK = 32_768
#: Tokens that name nothing: literals, numbers and signs.
NAMELESS = r"(?s)^(?:['\"].*|\d[\d.]*|[\x00-\x7F&&[^\w$#]])$"
#: Certainties: a column passed on, a computed one, one without a source.
PASSED, COMPUTED, NONE = 0.95, 0.9, 0.0
UNIT = ["path", "mapping"]


def tokens(expression: Column) -> Column:
    return F.regexp_extract_all(expression, F.lit(TOKEN), F.lit(0))


def _filled(every: Column, named: Column) -> Column:
    """An expression, given as its tokens, whose names (in upper case, with what stands for them) are replaced, in parentheses where needed."""
    plain = r"^(?:[\w.$#]+|\w+\([^()]*\)|'[^']*')$"

    def of(token: Column, i: Column) -> Column:
        said = F.try_element_at(F.filter(named, lambda e: e["name"] == F.upper(token)), F.lit(1))["said"]
        # The whole expression, or a whole argument, needs none.
        whole = F.coalesce(F.get(every, i - 1), F.lit("(")).isin("(", ",") & F.coalesce(F.get(every, i + 1), F.lit(")")).isin(")", ",")
        return F.coalesce(F.when(whole | said.rlike(plain), said).otherwise(F.concat(F.lit("("), said, F.lit(")"))), token)

    return F.array_join(F.transform(every, of), "")


def _nodes(ports: DataFrame, wires: DataFrame, tasks: int) -> DataFrame:
    """A row for each port, with the wires into it: (path, mapping, port, node, said, came, moved, stuck, ins).

    All of a mapping is dealt out here at once, so that grouping and windows within it need no shuffle from here on.
    """
    none = F.lit(None).cast("string")
    rows = ports.select(*UNIT, "port", "owner", "field", "end", "expression", none.alias("src"), none.alias("dst"), none.alias("name")).unionByName(wires.select(*UNIT, none.alias("port"), none.alias("owner"), none.alias("field"), none.alias("end"), none.alias("expression"), "src", "dst", F.upper("name").alias("name")))
    listed, apart = F.col("port").isNotNull(), F.coalesce(F.col("src") != F.col("dst"), F.lit(False))

    def row(port: str, into: Column, out: Column) -> Column:
        wire = F.when(into & apart, F.struct("src", "name"))
        return F.struct(F.col(port).alias("port"), "owner", "field", "end", "expression", listed.alias("listed"), wire.alias("wire"), into.alias("into"), (out & apart).alias("out"))

    yes, no = F.lit(True), F.lit(False)
    every = rows.repartition(tasks, *UNIT).select(*UNIT, F.inline(F.when(listed, F.array(row("port", no, no))).otherwise(F.array(row("dst", yes, no), row("src", no, yes))))).filter("port is not null")
    target = F.col("end") == "target"
    one = every.groupBy(*UNIT, "port").agg(
        F.max("owner").alias("owner"), F.max("field").alias("field"), F.max(F.when(F.col("listed"), F.concat_ws(".", "owner", "field"))).alias("label"), F.max("end").alias("end"), F.max("expression").alias("expression"), F.max("listed").alias("listed"),
        F.max(F.when(target, F.col("owner"))).alias("target_table"), F.max(F.when(target, F.col("field"))).alias("target_column"), F.coalesce(F.max(target), no).alias("marked"), F.max("into").alias("wired"), F.max("out").alias("out"), F.collect_set("wire").alias("wires"),
    )
    # Ends of wires that no definition lists are ports too.
    owner = F.when(F.col("listed"), F.col("owner")).otherwise(F.substring_index("port", ".", 1))
    field = F.when(F.col("listed"), F.col("field")).otherwise(F.expr("substring(port, length(substring_index(port, '.', 1)) + 2)"))
    one = one.withColumns({"owner": owner, "field": field}).withColumn("label", F.coalesce("label", F.concat_ws(".", "owner", "field")))
    one = one.withColumn("some", F.max("marked").over(Window.partitionBy(*UNIT)))
    aim = F.when(F.col("some"), F.col("marked")).otherwise(F.col("wired") & ~F.col("out"))
    node = F.struct("expression", F.when(F.col("some"), F.col("target_table")).otherwise(F.col("owner")).alias("table"), F.when(F.col("some"), F.col("target_column")).otherwise(F.col("field")).alias("column"), aim.alias("aim"), "wired")
    root = F.size("wires") == 0
    # A root is a column unless an expression makes it of nothing; a target that nothing is wired to is none.
    column = root & F.col("expression").isNull() & (F.coalesce(F.col("end"), F.lit("")) != "target")
    came = F.filter(F.array(F.struct(F.col("port").alias("root"), F.lit(1).alias("hops"), yes.alias("plain"), none.alias("first"), F.col("owner").alias("table"), F.col("field").alias("column"))), lambda _: column)
    ins = F.transform("wires", lambda w: F.struct(w["src"].alias("src"), w["name"].alias("name"), none.alias("said"), F.filter(came, lambda _: F.lit(False)).alias("came")))
    return one.select(*UNIT, "port", node.alias("node"), F.when(root, F.coalesce("expression", "label")).alias("said"), came.alias("came"), no.alias("moved"), no.alias("stuck"), ins.alias("ins"))


def _one_of_each(entries: str, *by: str) -> Column:
    """The first entry of each group of a column of sorted ones."""
    before = lambda i: F.get(F.col(entries), i - 1)

    def new(e: Column, i: Column) -> Column:
        same = F.lit(True)
        for name in by:
            same = same & e[name].eqNullSafe(before(i)[name])
        return (i == 0) | ~same

    return F.filter(entries, new)


def _passed_on(nodes: DataFrame) -> DataFrame:
    """One step along all wires: a port is told once all that it is made of are told, and then needs its wires no more.

    Wires keep what they were given, so that a port that has told them goes, unless it is a target.
    came has an entry for each column that a port comes from: hops counts the ports of the shortest way, both ends too,
    and first is the first expression on it that does more than pass a column on (of several shortest ways the least
    one), null where none does. In a mapping that is stuck, ports on and behind cycles are told where they come from too.
    """
    none = F.lit(None).cast("string")
    to = dict((f.name, f.dataType) for f in nodes.schema)
    held = F.array(F.struct(F.col("port").alias("key"), none.alias("dst"), none.alias("name"), "said", "came", "moved", "stuck", "node"))
    wires = F.transform("ins", lambda w: F.struct(w["src"].alias("key"), F.col("port").alias("dst"), w["name"].alias("name"), w["said"].alias("said"), w["came"].alias("came"), F.lit(False).alias("moved"), F.lit(False).alias("stuck"), F.lit(None).cast(to["node"]).alias("node")))
    rows = nodes.select(*UNIT, F.inline(F.concat(held, wires)))
    own = F.col("dst").isNull()
    given = F.when(own, F.struct(F.when(F.length("said") <= LONGEST, F.col("said")).when(F.col("said").isNotNull(), F.col("key")).alias("said"), "came"))
    rows = rows.withColumn("given", F.first(given, ignorenulls=True).over(Window.partitionBy(*UNIT, "key")))
    wire = F.when(~own, F.struct(F.col("key").alias("src"), "name", F.coalesce("said", "given.said").alias("said"), F.coalesce("given.came", "came").alias("came")))
    mine = F.max_by(F.struct("node", "said", "came", "stuck"), own)
    met = rows.groupBy(*UNIT, F.coalesce("dst", "key").alias("port")).agg(mine.alias("m"), F.collect_list(wire).alias("ins")).select(*UNIT, "port", "m.*", "ins").filter("said is null or node.aim")

    ready = F.col("said").isNull() & ~F.exists("ins", lambda w: w["said"].isNull())
    met = met.withColumn("ready", ready)
    reached = F.flatten(F.transform("ins", lambda w: F.transform(w["came"], lambda e: F.struct(e["root"].alias("root"), (e["hops"] + 1).alias("hops"), (e["plain"] & F.col("node.expression").isNull()).alias("plain"), F.coalesce(e["first"], F.col("node.expression")).alias("first"), e["table"].alias("table"), e["column"].alias("column")))))
    named = F.array_sort(F.array_distinct(F.transform("ins", lambda w: F.struct(w["name"].alias("name"), w["said"].alias("said")))))
    met = met.withColumns({"named": F.when(F.col("ready"), named), "every": F.when(F.col("ready"), tokens(F.trim("node.expression"))), "reached": F.when(F.col("said").isNull() & (F.col("ready") | F.col("stuck")), F.array_sort(reached))})
    made = F.when(F.col("every").isNotNull(), _filled(F.col("every"), F.col("named"))).otherwise(F.array_join(F.array_distinct(F.transform("named", lambda e: e["said"])), " | "))
    now = F.coalesce(_one_of_each("reached", "root"), F.col("came"))
    moved = F.col("ready") | ~now.eqNullSafe(F.col("came"))
    left = F.when(F.col("ready"), F.array().cast(to["ins"])).otherwise(F.col("ins"))
    return met.select(*UNIT, "port", "node", F.when(F.col("ready"), made).otherwise(F.col("said")).alias("said"), now.alias("came"), moved.alias("moved"), "stuck", left.alias("ins"))


def port_lineage(ports: DataFrame, wires: DataFrame) -> DataFrame:
    """(path, mapping, target_table, target_column, source_table, source_column, transform, first, hops, confidence, reason).

    One row for each column of a target and each column that it comes from, transform being its whole expression over
    all of them: inputs filled in, several without an expression joined by ` | `. Targets are ports marked so or, in a
    mapping that marks none, those that nothing is made of. A target column that comes from none has one row without a
    source and a reason: `constant` where an expression makes it, `unconnected`, or `cycle`; what lies on or behind a
    cycle has no transform. Rows that are given twice count once.

    Ports and wires are shuffled once, by mapping; STEPS along the wires then take place without a shuffle, and what is
    left of mappings with longer ways is written and dealt out again for as many steps more.
    """
    tasks = 1 + ports.count() // PER_TASK
    nodes, found = _nodes(ports, wires, tasks), None
    unit = Window.partitionBy(*UNIT)
    while True:
        for _ in range(STEPS):
            nodes = _passed_on(nodes)
        nodes = nodes.withColumns({"behind": F.max(F.col("said").isNull()).over(unit), "going": F.max("moved").over(unit)})
        nodes = nodes.withColumns({"open": F.col("behind") & (F.col("going") | ~F.col("stuck")), "stuck": F.col("stuck") | ~F.col("going")})
        nodes = cut(nodes.filter("open or node.aim").drop("behind", "going"))
        done = nodes.filter("not open")
        found = done if found is None else found.unionByName(done)
        nodes = nodes.filter("open").drop("open")
        if nodes.isEmpty():
            break
        nodes = nodes.repartition(tasks, *UNIT)
    # Several ports may be called alike as columns; none comes from itself.
    entries = F.array_sort(F.transform(F.filter("came", lambda e: e["root"] != F.col("port")), lambda e: F.struct(e["table"].alias("table"), e["column"].alias("column"), e["hops"].alias("hops"), e["first"].alias("first"))))
    rows = found.filter("node.aim").withColumn("entries", entries).select(*UNIT, "node", "said", F.explode_outer(_one_of_each("entries", "table", "column")).alias("e"))
    none = F.col("e.column").isNull()
    reason = F.when(~none, None).when(~F.col("node.wired"), "unconnected").when(F.col("said").isNull(), "cycle").otherwise("constant")
    sure = F.when(none, NONE).when(F.col("said").isNull() | F.col("e.first").isNotNull(), COMPUTED).otherwise(PASSED)
    transform = F.when(F.col("node.wired"), F.col("said"))
    return rows.select(*UNIT, F.col("node.table").alias("target_table"), F.col("node.column").alias("target_column"), F.col("e.table").alias("source_table"), F.col("e.column").alias("source_column"), transform.alias("transform"), F.col("e.first").alias("first"), F.col("e.hops").alias("hops"), sure.alias("confidence"), reason.alias("reason"))


def informatica_ports(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ports and wires of Informatica mappings, from elements.elements().

    Connectors wire instances; inside one, an expression wires the ports that it names, REF_FIELD, REF_SOURCE_FIELD and
    FIELDDEPENDENCY what they name. Outputs of a lookup are columns of its table, and its condition is no lineage. A
    mapping's own transformation goes before a reusable one of the same name. What a variable port is told from itself,
    or from one that stands after it, is the row before's value: the name stays in its expression and gives no wire. Literals, numbers and signs name no port.
    """
    at = lambda name: F.col("attributes")[name]
    of = lambda *names: elements.filter(F.col("tag").isin(*names))
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    maps = of("MAPPING", "MAPPLET")
    named = maps.select("path", F.col("nr").alias("_m"), at("NAME").alias("mapping"))
    inside = lambda rows: rows.withColumn("_m", nearest("MAPPING", "MAPPLET")).join(named, ["path", "_m"])
    defined = nearest("TRANSFORMATION", "SOURCE", "TARGET")
    held = of("TRANSFORMATION", "SOURCE", "TARGET").withColumn("_m", nearest("MAPPING", "MAPPLET")).select("path", F.col("nr").alias("_d"), "_m", F.col("tag").alias("_role"), at("NAME").alias("definition"), at("TYPE").alias("kind"))
    looked = of("TABLEATTRIBUTE").filter(F.lower(at("NAME")) == "lookup table name").withColumn("_d", defined).groupBy("path", "_d").agg(F.max(at("VALUE")).alias("looked_up"))
    fields = of("TRANSFORMFIELD", "SOURCEFIELD", "TARGETFIELD").withColumn("_d", defined).filter("_d is not null and attributes['NAME'] is not null").select("path", "_d", F.col("nr").alias("_f"), at("NAME").alias("field"), F.upper(F.coalesce(at("PORTTYPE"), F.lit(""))).alias("_type"), text(at("EXPRESSION")).alias("expression"), F.coalesce(text(at("REF_FIELD")), text(at("REF_SOURCE_FIELD"))).alias("_ref"))
    instances = inside(of("INSTANCE")).select("path", "_m", "mapping", at("NAME").alias("instance"), F.coalesce(at("TRANSFORMATION_NAME"), at("NAME")).alias("definition"), F.when(F.upper(at("TYPE")).isin("SOURCE", "TARGET"), F.upper(at("TYPE"))).otherwise("TRANSFORMATION").alias("_role")).dropDuplicates(["path", "_m", "instance"])
    fitting = instances.join(held.withColumnRenamed("_m", "_own"), ["path", "definition", "_role"], "left").filter("_own is null or _own = _m")
    # Its own definition has a number, so it is the largest; of several reusable ones the last in the file counts.
    chosen = fitting.groupBy("path", "_m", "mapping", "instance", "definition", "_role").agg(F.max_by(F.struct("_d", "kind"), F.struct("_own", "_d")).alias("_c")).select("*", "_c._d", "_c.kind").drop("_c").join(looked, ["path", "_d"], "left")
    chosen = cut(chosen)
    every = chosen.join(fields, ["path", "_d"])
    port = lambda field: F.concat_ws(".", "instance", field)
    is_lookup = F.coalesce(F.col("kind"), F.lit("")).startswith("Lookup") & F.col("_type").contains("OUTPUT") & F.col("_type").contains("LOOKUP")
    end = F.when(is_lookup | (F.col("_role") == "SOURCE"), "source").when(F.col("_role") == "TARGET", "target")
    owner = F.when(is_lookup, F.coalesce("looked_up", "instance")).when(F.col("_role").isin("SOURCE", "TARGET"), F.col("definition")).otherwise(F.col("instance"))
    own = (F.upper("expression") == F.upper("field")) | ~F.col("_type").contains("OUTPUT") & ~F.col("_type").contains("VARIABLE") | is_lookup
    known = cut(every.withColumn("expression", F.when(~own, F.col("expression"))))
    ports = known.select("path", "mapping", port("field").alias("port"), owner.alias("owner"), "field", end.alias("end"), "expression")

    key = ["path", "mapping", "instance"]
    called = known.filter("expression is not null").select(*key, "field", "_f", "_type", F.explode(F.filter(F.array_distinct(F.transform(tokens(F.col("expression")), F.upper)), lambda t: ~t.rlike(NAMELESS))).alias("_name"))
    others = known.select(*key, F.upper("field").alias("_name"), F.col("field").alias("_from"), F.col("_f").alias("_g"), F.col("_type").alias("_kind"))
    late = F.col("_kind").contains("VARIABLE") & F.col("_type").contains("VARIABLE") & (F.col("_g") >= F.col("_f"))
    # Outputs alone can't be named in expressions of their instance.
    by_name = called.join(others, [*key, "_name"]).filter(~late & ((F.col("_kind") != "OUTPUT") | (F.col("_from") == F.col("field")))).select("path", "mapping", port("_from").alias("src"), port("field").alias("dst"), F.col("_from").alias("name"))
    by_ref = known.filter("_ref is not null and expression is null").select("path", "mapping", port("_ref").alias("src"), port("field").alias("dst"), F.lit(None).cast("string").alias("name"))
    depends = of("FIELDDEPENDENCY").withColumn("_d", defined).select("path", "_d", at("INPUTFIELD").alias("_from"), at("OUTPUTFIELD").alias("field")).filter("_from is not null and field is not null")
    by_field = chosen.join(depends, ["path", "_d"]).select("path", "mapping", port("_from").alias("src"), port("field").alias("dst"), F.lit(None).cast("string").alias("name"))
    joined = inside(of("CONNECTOR")).select("path", "mapping", F.concat_ws(".", at("FROMINSTANCE"), at("FROMFIELD")).alias("src"), F.concat_ws(".", at("TOINSTANCE"), at("TOFIELD")).alias("dst"), F.lit(None).cast("string").alias("name"))
    return ports, joined.unionByName(by_name).unionByName(by_ref).unionByName(by_field)


def datastage_ports(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ports and wires of DataStage jobs in their block format; a port is a column of a link, a mapping the job.

    A derivation wires the columns of links that it names; without one the SourceColumn does, or else columns of the
    same name on the stage's links in. Links of a stage with no links in have the stage's columns, and a stage without
    links out is a target with the columns of its links in.
    """
    at = lambda k: F.col("properties")[k]
    file = Window.partitionBy("path").orderBy("ordinal")
    last = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("ordinal"))).over(file)
    records = cut(datastage_records(texts).withColumns({"_job": last("DSJOB"), "_record": last("DSRECORD")}))
    jobs = records.filter("kind = 'DSJOB'").select("path", "_job", F.coalesce(at("Identifier"), F.concat(F.lit("job "), "_job")).alias("mapping"))
    blocks = records.filter("kind = 'DSRECORD'").join(jobs, ["path", "_job"])
    stage_rows = blocks.filter(at("InputPins").isNotNull() | at("OutputPins").isNotNull())
    pins = None
    for side in ("Input", "Output"):
        rows = stage_rows.select("path", "mapping", at("Name").alias("stage"), F.explode(F.split(at(f"{side}Pins"), r"\|")).alias("pin"), F.lit(side.lower()).alias("side"))
        pins = rows if pins is None else pins.unionByName(rows)
    pins = cut(pins.withColumn("pin", F.trim("pin")).filter("pin <> ''").distinct())
    links = cut(blocks.filter(at("Name").isNotNull()).select("path", "mapping", at("Identifier").alias("pin"), at("Name").alias("link"), "_record").join(pins, ["path", "mapping", "pin"]))
    columns = records.filter("kind = 'DSSUBRECORD'").select("path", "_record", at("Name").alias("field"), F.nullif(F.trim(F.coalesce(at("ParsedDerivation"), at("Derivation"))), F.lit("")).alias("expression"), F.nullif(F.trim(at("SourceColumn")), F.lit("")).alias("_source")).filter("field is not null")
    out = cut(links.filter("side = 'output'").join(columns, ["path", "_record"]).dropDuplicates(["path", "mapping", "link", "field"]))
    into = links.filter("side = 'input'").select("path", "mapping", "stage", F.col("link").alias("_in")).distinct()
    fed = into.select("path", "mapping", "stage", F.lit(True).alias("fed")).distinct()
    giving = links.filter("side = 'output'").select("path", "mapping", "stage").distinct()
    port = lambda link, field: F.concat_ws(".", link, field)
    marked = cut(out.join(fed, ["path", "mapping", "stage"], "left"))
    # A derivation that is one name passes a column on, wherever the link's own stage has links in.
    single = F.col("expression").rlike(r"^[\w$#]+\.[\w$#]+$")
    made = F.when(F.col("fed") & ~single, F.col("expression"))
    ports = marked.select("path", "mapping", port("link", "field").alias("port"), F.when(F.col("fed"), F.col("link")).otherwise(F.col("stage")).alias("owner"), "field", F.when(F.col("fed").isNull(), "source").alias("end"), made.alias("expression"))

    every = marked.select("path", "mapping", F.upper(port("link", "field")).alias("_name"), port("link", "field").alias("src"))
    called = marked.filter("fed and coalesce(expression, _source) is not null").select("path", "mapping", port("link", "field").alias("dst"), F.explode(F.array_distinct(F.transform(tokens(F.coalesce("expression", "_source")), F.upper))).alias("_name"), (F.col("expression").isNotNull() & ~single).alias("_named"))
    by_name = called.join(every, ["path", "mapping", "_name"]).select("path", "mapping", "src", "dst", F.when(F.col("_named"), F.col("src")).alias("name"))
    silent = marked.filter("fed and expression is null and _source is null").join(into, ["path", "mapping", "stage"])
    same = silent.select("path", "mapping", F.upper(port("_in", "field")).alias("_name"), port("link", "field").alias("dst")).join(every, ["path", "mapping", "_name"]).select("path", "mapping", "src", "dst", F.lit(None).cast("string").alias("name"))
    sinks = into.join(giving, ["path", "mapping", "stage"], "left_anti").withColumnRenamed("_in", "link").join(out.select("path", "mapping", "link", "field"), ["path", "mapping", "link"])
    ends = sinks.select("path", "mapping", port("stage", "field").alias("port"), F.col("stage").alias("owner"), "field", F.lit("target").alias("end"), F.lit(None).cast("string").alias("expression")).distinct()
    final = sinks.select("path", "mapping", port("link", "field").alias("src"), port("stage", "field").alias("dst"), F.lit(None).cast("string").alias("name"))
    return ports.unionByName(ends), by_name.unionByName(same).unionByName(final)

"""Stages and links of ETL jobs: DataStage pins and partners, SSIS components and paths, Informatica connectors.

Stages are (path, id, name, type), links (path, link_name, source, source_pin, target, target_pin); an end that can't be
resolved is `Unknown`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import fqn
from ..functions.scratch import cut
from .estate import attribute, datastage_records, references, tags, unescaped, writes

#: Kinds of records that are stages although they aren't named so.
ACTIVITIES = ("CJSJobActivity", "CJSRoutineActivity", "CJSSequencer")


def _named(links: DataFrame, stages: DataFrame, key: str) -> DataFrame:
    """Links whose ends are stage ids with the stages' names."""
    for end in ("source", "target"):
        at = stages.select("path", F.col(key).alias(f"{end}_id"), F.col("name").alias(end)).dropDuplicates(["path", f"{end}_id"])
        links = links.join(at, ["path", f"{end}_id"], "left")
    said = lambda c: F.coalesce(c, F.lit("Unknown")).alias(c)
    return links.select("path", "link_name", said("source"), "source_pin", said("target"), "target_pin")


def datastage_stages(records: DataFrame) -> DataFrame:
    at = lambda k: F.col("properties")[k]
    is_stage = at("OLEType").contains("Stage") | at("OLEType").isin(*ACTIVITIES)
    return records.filter(is_stage & at("Identifier").isNotNull()).select("path", at("Identifier").alias("id"), at("Name").alias("name"), F.coalesce(at("StageType"), at("OLEType")).alias("type"), F.split(F.concat_ws("|", at("InputPins"), at("OutputPins")), r"\|").alias("pins"))


def datastage_links(texts: DataFrame) -> DataFrame:
    """A link for each partner (`stage|pin`) of each output pin; the pin's own stage is the one that lists it."""
    records = datastage_records(texts)
    stages = datastage_stages(records)
    at = lambda k: F.col("properties")[k]
    pins = stages.select("path", F.explode("pins").alias("source_pin"), F.col("id").alias("source_id")).withColumn("source_pin", F.trim("source_pin")).filter("source_pin <> ''").dropDuplicates(["path", "source_pin"])
    outputs = records.filter(at("OLEType").contains("Output") & (at("Name") != "") & at("Partner").contains("|"))
    partners = outputs.select("path", at("Identifier").alias("source_pin"), at("Name").alias("link_name"), F.explode(F.split(at("Partner"), "\n")).alias("p")).filter(F.col("p").contains("|"))
    links = partners.select("path", "source_pin", "link_name", F.trim(F.split_part("p", F.lit("|"), F.lit(1))).alias("target_id"), F.trim(F.split_part("p", F.lit("|"), F.lit(2))).alias("target_pin"))
    return _named(links.join(pins, ["path", "source_pin"], "left"), stages, "id")


def ssis_stages(texts: DataFrame) -> DataFrame:
    """Components of data flows, and other tasks."""
    parts = texts.select("path", F.explode(tags(F.col("text"), "component")).alias("t")).select("path", attribute(F.col("t"), "refId").alias("id"), attribute(F.col("t"), "name").alias("name"), attribute(F.col("t"), "componentClassID").alias("type"))
    every = texts.select("path", F.explode(tags(F.col("text"), "Executable")).alias("t")).select("path", attribute(F.col("t"), "DTS:refId").alias("id"), attribute(F.col("t"), "DTS:ObjectName").alias("name"), attribute(F.col("t"), "DTS:CreationName").alias("type"))
    return parts.unionByName(every.filter("id is not null and id <> 'Package' and not (type like 'SSIS.Pipeline%')")).filter("id is not null")


def ssis_links(texts: DataFrame) -> DataFrame:
    """A link for each path of a data flow, from the component of its output to that of its input."""
    found = texts.select("path", F.explode(tags(F.col("text"), "path")).alias("t"))
    owner = lambda c: F.regexp_extract(c, r"^(.*)\.(?:Outputs|Inputs)\[", 1)
    links = found.select("path", attribute(F.col("t"), "name").alias("link_name"), attribute(F.col("t"), "startId").alias("source_pin"), attribute(F.col("t"), "endId").alias("target_pin"))
    return _named(links.filter("source_pin is not null").withColumns({"source_id": owner(F.col("source_pin")), "target_id": owner(F.col("target_pin"))}), ssis_stages(texts), "id")


def informatica_stages(texts: DataFrame) -> DataFrame:
    """Instances with the type of their transformation; sources and targets are definitions."""
    at = lambda a: attribute(F.col("t"), a)
    kinds = texts.select("path", F.explode(tags(F.col("text"), "TRANSFORMATION")).alias("t")).select("path", at("NAME").alias("name"), at("TYPE").alias("kind")).dropDuplicates(["path", "name"])
    found = texts.select("path", F.explode(tags(F.col("text"), "INSTANCE")).alias("t")).select("path", at("NAME").alias("name"), at("TYPE").alias("role"))
    role = F.when(F.col("role") == "SOURCE", "Source Definition").when(F.col("role") == "TARGET", "Target Definition")
    return found.join(kinds, ["path", "name"], "left").select("path", F.col("name").alias("id"), "name", F.coalesce(role, "kind", F.lit("Transformation")).alias("type")).distinct()


def informatica_links(texts: DataFrame) -> DataFrame:
    """One link for each pair of instances that connectors join, with their fields (from_field, to_field)."""
    at = lambda a: attribute(F.col("t"), a)
    c = texts.select("path", F.explode(tags(F.col("text"), "CONNECTOR")).alias("t")).select("path", at("FROMINSTANCE").alias("source"), at("TOINSTANCE").alias("target"), F.struct(at("FROMFIELD").alias("from_field"), at("TOFIELD").alias("to_field")).alias("f"))
    return c.groupBy("path", "source", "target").agg(F.array_sort(F.collect_set("f")).alias("fields")).select("path", F.concat("source", F.lit(" -> "), "target").alias("link_name"), "source", "target", "fields")


def exported_jobs(texts: DataFrame) -> DataFrame:
    """(path, job, body) of DataStage exports in XML; a job that is cut off ends where the next one begins or the file."""
    parts = texts.filter(F.col("text").rlike(r"<Job\s")).select("path", F.explode(F.split("text", r"(?=<Job\s)")).alias("body")).filter(F.col("body").startswith("<Job"))
    body = F.split("body", "</Job>")[0]
    return parts.select("path", F.upper(attribute(F.regexp_extract("body", r"<Job(\s[^>]*)>", 1), "Identifier")).alias("job"), body.alias("body"))


def datastage_records_xml(texts: DataFrame) -> DataFrame:
    """(path, job, stage, table_name, sql_query, write_mode) of whole <Record> elements; one that is cut off has no row."""
    records = exported_jobs(texts).select("path", "job", F.explode(F.split("body", r"(?=<Record\s)")).alias("r")).filter(F.col("r").startswith("<Record") & F.col("r").contains("</Record>"))

    def of(name: str):
        said = F.regexp_extract(F.split("r", "</Record>")[0], rf'(?s)<Property\s+Name="{name}"\s*>(.*?)</Property>', 1)
        return F.nullif(F.trim(unescaped(F.replace(F.replace(said, F.lit("<![CDATA["), F.lit("")), F.lit("]]>"), F.lit("")))), F.lit("")).alias(name)

    table = of("table_name")
    return records.select("path", "job", attribute(F.regexp_extract("r", r"<Record(\s[^>]*)>", 1), "Identifier").alias("stage"), fqn(table).alias("table_name"), of("sql_query"), of("write_mode"))


def datastage_refs(records: DataFrame) -> DataFrame:
    """(job, fqn, role) of XML records: what their SQL reads and writes, and tables that they write to."""
    wrote = writes(F.col("sql_query"))
    said = records.filter("sql_query is not null").select("job", F.array_except(references(F.col("sql_query")), wrote).alias("reads"), wrote.alias("writes"))
    reads = said.select("job", F.explode("reads").alias("fqn")).distinct()
    named = records.filter("table_name is not null").select("job", F.col("table_name").alias("fqn"), F.col("write_mode").isNotNull().alias("sure"))
    only = named.join(reads.withColumn("read", F.lit(True)), ["job", "fqn"], "left").filter("sure or read is null").select("job", "fqn")
    out = said.select("job", F.explode("writes").alias("fqn")).unionByName(only).distinct()
    return reads.withColumn("role", F.lit("read")).unionByName(out.withColumn("role", F.lit("write")))


def reject_targets(texts: DataFrame) -> DataFrame:
    """(job, table_name, route): the nearest tables that links with REJECT in their route lead to, stage by stage."""
    tables = datastage_records_xml(texts).filter("table_name is not null").groupBy("job", F.col("stage").alias("at")).agg(F.min("table_name").alias("table_name"))
    t = exported_jobs(texts).select("job", F.explode(F.regexp_extract_all("body", F.lit(r"<Link(\s[^>]*)/>"), F.lit(1))).alias("t"))
    links = cut(t.select("job", attribute(F.col("t"), "SourceStage").alias("source"), attribute(F.col("t"), "TargetStage").alias("target"), F.upper(F.coalesce(attribute(F.col("t"), "Route"), F.lit(""))).alias("route")))
    tables = cut(tables)
    frontier = cut(links.filter(F.col("route").contains("REJECT")).select("job", "route", F.col("target").alias("root"), F.col("target").alias("at")).distinct())
    seen, found = frontier, None
    while not frontier.isEmpty():
        here = frontier.join(tables, ["job", "at"], "left")
        hit = cut(here.filter("table_name is not null").select("job", "route", "root", "table_name"))
        found = hit if found is None else found.unionByName(hit)
        done = found.select("job", "route", "root").distinct()  # a walk ends at the first tables it comes to
        ahead = frontier.join(done, ["job", "route", "root"], "left_anti").join(links.select("job", F.col("source").alias("at"), F.col("target").alias("next")), ["job", "at"]).select("job", "route", "root", F.col("next").alias("at")).distinct()
        frontier = cut(ahead.join(seen, ["job", "route", "root", "at"], "left_anti"))
        seen = seen.unionByName(frontier)
    empty = tables.select("job", "table_name", F.lit("").alias("route")).filter("false")
    return empty if found is None else found.select("job", "table_name", "route").distinct()


#: Links at a stage, hops of a chain, and stages of one type beyond which a job looks inefficient.
FAN, CHAIN, SAME = 4, 6, 3


def inefficiencies(stages: DataFrame, links: DataFrame) -> DataFrame:
    """(pattern, subject, amount): stages with over FAN links in or out, chains of over CHAIN hops from a stage without
    links in to one without links out, stages without links, and types of over SAME stages. Stages: name, type."""
    from ..operators.graph import degrees, orphans, simple_paths

    edges = links.select(F.col("source").alias("src"), F.col("target").alias("dst"))
    most = F.greatest("fan_in", "fan_out")
    wide = degrees(edges.distinct()).filter(most > FAN).select(F.lit("high_fan_in_out").alias("pattern"), F.col("node").alias("subject"), most.cast("long").alias("amount"))
    deep = simple_paths(edges).filter(F.col("hops") - 1 > CHAIN).select(F.lit("long_derivation_chain").alias("pattern"), F.replace("path", F.lit(">"), F.lit(" -> ")).alias("subject"), (F.col("hops") - 1).alias("amount"))
    alone = orphans(stages.select(F.col("name").alias("node")).distinct(), edges).select(F.lit("orphan_stage").alias("pattern"), F.col("node").alias("subject"), F.lit(0).cast("long").alias("amount"))
    same = stages.groupBy("type").agg(F.count("*").alias("amount")).filter(F.col("amount") > SAME).select(F.lit("repeated_stage_type").alias("pattern"), F.col("type").alias("subject"), "amount")
    return wide.unionByName(deep).unionByName(alone).unionByName(same)

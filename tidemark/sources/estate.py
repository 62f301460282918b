"""Reading warehouse artifacts as tables of text, and the definitions in them as DataFrames.

Each reader takes (path, text) rows and returns rows; none gathers an estate on the driver. Names are canonical
SCHEMA.OBJECT in upper case.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import fqn
from ..functions.scratch import cut

NAME = r"([\w.\[\]\"]+)"


def read_texts(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, text) of every file below a folder, or of those whose names fit a pattern; one row a file."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


#: Attributes that mark an element's content as secret, elements and named values that are secrets.
SECRET_MARKS, SECRET_ELEMENTS, SECRET_VALUES = ("Sensitive", "Encrypted"), ("DTS:Password",), ("db_password",)
MASK = "***"


def _masked(text: Column, pattern: str, into: str) -> tuple[Column, Column]:
    """Text with what a pattern finds masked, and how often it did."""
    return F.regexp_replace(text, pattern, into), F.regexp_count(text, F.lit(pattern))


def redacted(texts: DataFrame) -> DataFrame:
    """Files (path, text) with secrets as ***, and how many there were; CSV files keep their header line alone.

    Secret is the content of an element that a mark of SECRET_MARKS is set to 1 for or that SECRET_ELEMENTS lists, the
    `value` of a tag named as one of SECRET_VALUES, wherever in the tag it stands, and what a `password` is set to.
    """
    csv = F.lower("path").endswith(".csv")
    marks, values = "|".join(SECRET_MARKS), "|".join(SECRET_VALUES)
    content = r"(?s)(<({name})\b(?:[^>]*[^>/])?{mark}[^>]*(?<!/)>)((?:(?!</\2>).)*)(</\2>)"
    rules = [(content.format(name=r"[\w:.-]+", mark=rf"\b(?:{marks})\s*=\s*[\"']1[\"']"), f"$1{MASK}$4")]
    rules += [(content.format(name=name, mark=""), f"$1{MASK}$4") for name in SECRET_ELEMENTS]
    named = rf"\bname\s*=\s*[\"'](?:{values})[\"']"
    rules += [(rf"(<[^<>]*{named}[^<>]*\bvalue\s*=\s*[\"'])[^\"'<>]*", f"$1{MASK}"), (rf"(<[^<>]*\bvalue\s*=\s*[\"'])[^\"'<>]*(?=[\"'][^<>]*{named})", f"$1{MASK}")]
    rules.append((r"(?i)(\bpassword\s*=\s*)(?:'[^']+'|\"[^\"]+\")", f"$1'{MASK}'"))
    text, found = F.col("text"), F.lit(0)
    for pattern, into in rules:
        text, n = _masked(text, pattern, into)
        found = found + n
    head = F.substring_index("text", "\n", 1)
    return texts.select("path", F.when(csv, head).otherwise(text).alias("text"), F.when(csv, 0).otherwise(found).cast("int").alias("redactions"))


def stem(path: Column) -> Column:
    """A file's name without folder and ending."""
    return F.regexp_extract(path, r"([^/]*?)(?:\.\w+)?$", 1)


def dialect_of(texts: DataFrame) -> DataFrame:
    """Adds `dialect`, by file ending, then by root element."""
    end = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))
    by_end = F.when(end == "sql", "sql").when(end == "dtsx", "ssis").when(end == "dsx", "datastage").when(end == "item", "talend").when(end == "twb", "tableau").when(end == "json", "json").when(end == "py", "ml_script")
    by_root = F.when(F.col("text").rlike("<POWERMART"), "informatica").when(F.col("text").rlike("DTS:Executable"), "ssis").when(F.col("text").rlike("(?i)<Schedule[ >]"), "schedule").when(F.col("text").rlike("(?i)<(?:cognosReport|report)[ >]"), "cognos")
    return texts.withColumn("dialect", F.coalesce(by_end, by_root, F.lit("unknown")))


def plain_sql(text: Column) -> Column:
    """SQL without comments and markdown fences."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", " "), r"--[^\n]*", ""), r"(?m)^[ \t]*```\w*[ \t]*$", "")


def _statements(text: Column) -> Column:
    """Batches, parted by GO lines (with or without a count)."""
    return F.split(plain_sql(text), r"(?im)^[ \t]*GO(?:[ \t]+\d+)?[ \t]*;?[ \t]*\r?$")


def objects(texts: DataFrame) -> DataFrame:
    """(path, ordinal, sql): each batch, parted before every CREATE of an object; what precedes the first is dropped."""
    begins = r"(?i)(?=\bCREATE\s+(?:OR\s+\w+\s+)?(?:MATERIALIZED\s+)?(?:VIEW|PROC|PROCEDURE|TABLE|FUNCTION|TRIGGER|SCHEMA|(?:UNIQUE\s+)?(?:CLUSTERED\s+|NONCLUSTERED\s+)?INDEX)\b)"
    parts = F.flatten(F.transform(_statements(F.col("text")), lambda s: F.split(s, begins)))
    return texts.select("path", F.posexplode(F.filter(parts, lambda s: s.rlike(r"(?i)^CREATE\b"))).alias("ordinal", "sql"))


def _items(body: str) -> list[str]:
    """The parts of what follows an opening parenthesis, up to its closing one, at commas outside of others and of quotes."""
    out, depth, begin, quote = [], 1, 0, ""
    for i, c in enumerate(body):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return [*out, body[begin:i]]
        elif c == "," and depth == 1:
            out.append(body[begin:i])
            begin = i + 1
    return [*out, body[begin:]]  # cut off


def _split_items(body: Column) -> Column:
    @F.arrow_udf("array<string>")
    def of(bodies: pa.Array) -> pa.Array:
        return pa.array([_items(b or "") for b in bodies.to_pylist()], pa.list_(pa.string()))

    return of(body)


def tables(texts: DataFrame) -> DataFrame:
    """(path, fqn, ordinal, name, data_type, nullable, pk, computed): a row for each column of CREATE TABLE.

    Commas within parentheses don't part columns; table constraints are no columns; a computed column has no type.
    Parentheses are matched by a scan of the text, so that tables may have any number of columns.
    """
    head = rf"(?is)^CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?{NAME}\s*\("
    found = objects(texts).filter(F.col("sql").rlike(head))
    name, after = F.regexp_extract("sql", head, 1), F.expr("substr(sql, instr(sql, '(') + 1)")
    parts = found.select("path", fqn(name).alias("fqn"), F.posexplode(_split_items(after)).alias("ordinal", "c"))
    c = F.trim(F.regexp_replace("c", r"\s+", " "))
    rows = parts.withColumn("c", c).filter(~F.col("c").rlike(r"(?i)^(CONSTRAINT|PRIMARY KEY|FOREIGN KEY|UNIQUE|CHECK|INDEX)\b") & (F.col("c") != ""))
    called = r"(?:\[[^\]]*\]|\"[^\"]*\"|\S+)"  # a name in brackets or quotes may have spaces
    computed = F.regexp_extract("c", rf"(?is)^{called}\s+AS\s*\((.*)\)", 1)
    kind = F.upper(F.regexp_extract("c", rf"^{called}\s+(\w+(?:\s*\([^)]*\))?)", 1))
    return rows.select("path", "fqn", "ordinal", F.regexp_replace(F.regexp_extract("c", rf"^({called})", 1), r"[\[\]\"]", "").alias("name"), F.when(computed == "", kind).alias("data_type"), (~F.col("c").rlike(r"(?i)NOT NULL|PRIMARY KEY")).alias("nullable"), F.col("c").rlike(r"(?i)PRIMARY KEY").alias("pk"), F.nullif(computed, F.lit("")).alias("computed"))


#: Schemas and tables of the database systems themselves, and endings of file names.
SYSTEM_SCHEMAS = ("SYS", "INFORMATION_SCHEMA", "MASTER", "TEMPDB", "PG_CATALOG")
SYSTEM_TABLES, FILES = ("DUAL",), ("CSV", "TXT", "DAT", "XML", "JSON", "PARQUET", "XLSX", "PKL")


def is_object(name: Column) -> Column:
    """Whether a name may be one of an estate: not of a system's own schemas, not DUAL in any schema, not a file's."""
    last = F.substring_index(name, ".", -1)
    return (name != "") & ~F.substring_index(name, ".", 1).isin(*SYSTEM_SCHEMAS) & ~last.isin(*SYSTEM_TABLES) & ~((F.instr(name, ".") > 0) & last.isin(*FILES))


def references(sql: Column) -> Column:
    """Names after FROM and JOIN, without those of common table expressions."""
    names = F.array_distinct(F.transform(F.regexp_extract_all(sql, F.lit(rf"(?i)\b(?:FROM|JOIN)\s+{NAME}"), F.lit(1)), fqn))
    own = F.transform(F.regexp_extract_all(sql, F.lit(r"(?i)(?:\bWITH|,)\s*(\w+)\s+AS\s*\("), F.lit(1)), fqn)
    return F.filter(F.array_except(names, own), is_object)


def writes(sql: Column) -> Column:
    """Names after INSERT INTO, UPDATE, MERGE INTO, DELETE FROM, TRUNCATE TABLE and SELECT INTO; an alias is its table."""
    found = F.concat(
        F.regexp_extract_all(sql, F.lit(rf"(?i)\b(?:INSERT\s+INTO|MERGE\s+INTO|MERGE|UPDATE|DELETE\s+FROM|TRUNCATE\s+TABLE)\s+(?!INTO\b|SET\b){NAME}"), F.lit(1)),
        F.regexp_extract_all(sql, F.lit(rf"(?i)\bINTO\s+{NAME}\s+FROM\b"), F.lit(1)),
    )
    named = rf"(?i)\b(?:FROM|JOIN)\s+{NAME}\s+(?:AS\s+)?(\w+)"
    known = F.arrays_zip(F.regexp_extract_all(sql, F.lit(named), F.lit(1)).alias("name"), F.regexp_extract_all(sql, F.lit(named), F.lit(2)).alias("alias"))
    real = lambda n: F.coalesce(F.try_element_at(F.filter(known, lambda k: F.upper(k["alias"]) == F.upper(n)), F.lit(1))["name"], n)
    return F.filter(F.array_distinct(F.transform(found, lambda n: fqn(real(n)))), is_object)


def views(texts: DataFrame) -> DataFrame:
    """(path, fqn, sql, is_materialized, listed, sources, complexity) of every view; listed: its list of columns, or none."""
    head = rf"(?is)^CREATE\s+(?:OR\s+\w+\s+)?(MATERIALIZED\s+)?VIEW\s+{NAME}\s*(?:\(([^)]*)\)\s*)?(?:WITH\s+\w+\s+)?AS\s+([^;]*)"
    v = objects(texts).filter(F.col("sql").rlike(head)).select("path", fqn(F.regexp_extract("sql", head, 2)).alias("fqn"), F.trim(F.regexp_extract("sql", head, 4)).alias("sql"), (F.regexp_extract("sql", head, 1) != "").alias("is_materialized"), F.filter(F.split(F.regexp_extract("sql", head, 3), r"\s*,\s*"), lambda c: c != "").alias("listed"))
    v = v.withColumn("sources", references(F.col("sql")))
    schemas = F.size(F.array_distinct(F.transform("sources", lambda n: F.substring_index(n, ".", 1))))
    kind = F.when(F.col("sql").rlike(r"(?i)EXECUTE IMMEDIATE|sp_executesql"), "dynamic").when(F.exists("sources", lambda n: n.rlike(r"(^|\.)V(W|IEW)?_")), "nested_view").when(schemas > 1, "cross_system").when(F.col("sql").rlike(r"(?i)\bGROUP\s+BY\b"), "aggregate").when(F.size("sources") > 1, "join").otherwise("simple")
    return v.withColumn("complexity", kind)


def procedures(texts: DataFrame) -> DataFrame:
    """(path, fqn, reads, writes, calls, has_dynamic, has_cursor, truncated, complexity) of every procedure.

    A file with a comment header is one procedure as the header says, where NONE means none; else each CREATE PROCEDURE
    is read. truncated: its last END is missing.
    """
    head = lambda k: F.nullif(F.regexp_extract("text", rf"(?m)^--[ \t]*{k}[ \t]*:[ \t]*(.*?)[ \t\r]*$", 1), F.lit(""))
    listed = lambda k: F.filter(F.transform(F.split(F.coalesce(head(k), F.lit("")), ","), fqn), lambda n: ~n.isin("", "NONE"))
    flag = lambda k: F.coalesce(F.lower(head(k)) == "true", F.lit(False))
    declared = texts.filter(head("PROCEDURE").isNotNull()).withColumn("body", plain_sql(F.col("text"))).select("path", fqn(head("PROCEDURE")).alias("fqn"), "body", *[listed(k).alias(k.lower()) for k in ("READS", "WRITES", "CALLS")], flag("HAS_DYNAMIC").alias("dynamic"), flag("HAS_CURSOR").alias("cursor"))
    created = rf"(?is)^CREATE\s+(?:OR\s+\w+\s+)?PROC(?:EDURE)?\s+{NAME}"
    none = F.array().cast("array<string>")
    found = objects(texts.filter(head("PROCEDURE").isNull())).filter(F.col("sql").rlike(created)).select("path", fqn(F.regexp_extract("sql", created, 1)).alias("fqn"), F.col("sql").alias("body"), none.alias("reads"), none.alias("writes"), none.alias("calls"), F.lit(False).alias("dynamic"), F.lit(False).alias("cursor"))
    p = declared.unionByName(found)
    calls = F.transform(F.regexp_extract_all("body", F.lit(rf"(?i)\b(?:EXEC|EXECUTE|CALL)\s+(?!IMMEDIATE\b|sp_executesql\b){NAME}"), F.lit(1)), fqn)
    either = lambda a, b: F.when(F.size(a) > 0, a).otherwise(b)
    is_dynamic = F.col("body").rlike(r"(?i)EXECUTE IMMEDIATE|sp_executesql|EXEC(?:UTE)?\s*\(") | F.col("dynamic")
    wrote = writes(F.col("body"))
    p = p.select("path", "fqn", either(F.col("reads"), F.array_except(references(F.col("body")), wrote)).alias("reads"), either(F.col("writes"), wrote).alias("writes"), F.array_distinct(either(F.col("calls"), calls)).alias("calls"), is_dynamic.alias("has_dynamic"), (F.col("body").rlike(r"(?i)\bCURSOR\b") | F.col("cursor")).alias("has_cursor"), (F.col("body").rlike(r"(?i)\bBEGIN\b") & ~F.col("body").rlike(r"(?is)\bEND\b[\s\w.;/]{0,200}$")).alias("truncated"))
    n = F.size("reads") + F.size("writes")
    return p.withColumn("complexity", F.when(F.col("has_dynamic") | F.col("has_cursor") | (n > 6), "high").when(n > 2, "medium").otherwise("low"))


#: What XML writes for the characters that it reserves, in the order in which they are read back.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#xA;", "\n"), ("&#10;", "\n"), ("&#xD;", ""), ("&#13;", ""), ("&amp;", "&"))


def unescaped(text: Column) -> Column:
    for entity, sign in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def attribute(tag: Column, name: str) -> Column:
    """An attribute of a start tag, null where it lacks one. Tags are found as text: no DTD or entity is ever fetched."""
    return F.nullif(unescaped(F.coalesce(F.nullif(F.regexp_extract(tag, rf'(?:^|\s){name}\s*=\s*"([^"]*)"', 1), F.lit("")), F.regexp_extract(tag, rf"(?:^|\s){name}\s*=\s*'([^']*)'", 1))), F.lit(""))


def tags(text: Column, name: str) -> Column:
    """What stands in each start tag of that name."""
    return F.regexp_extract_all(text, F.lit(rf"<(?:\w+:)?{name}(\s[^>]*)>"), F.lit(1))


def schedules(texts: DataFrame) -> DataFrame:
    """(path, name, type, schedule, frequency, depends_on) of <Schedule> files."""
    tag = F.regexp_extract("text", r"<Schedule(\s[^>]*)>", 1)
    needs = F.transform(F.regexp_extract_all("text", F.lit(r"<DependsOn>\s*([^<]*?)\s*</DependsOn>"), F.lit(1)), lambda d: unescaped(F.upper(d)))
    found = texts.filter(F.col("text").rlike(r"<Schedule\s")).select("path", *[attribute(tag, a).alias(a) for a in ("name", "type", "schedule", "frequency")], F.filter(needs, lambda d: d != "").alias("depends_on"))
    return found.withColumn("name", F.upper(F.coalesce("name", stem(F.col("path")))))


def dashboards(texts: DataFrame) -> DataFrame:
    """(path, name, source) of Tableau and Cognos files: the first table of a relation, a source, or any tag."""
    first = lambda name, a: attribute(F.try_element_at(F.filter(tags(F.col("text"), name), lambda t: attribute(t, a).isNotNull()), F.lit(1)), a)
    any_table = F.nullif(F.regexp_extract("text", r"\stable\s*=\s*[\"']([^\"']*)", 1), F.lit(""))
    bi = texts.filter(F.lower("path").rlike(r"\.twbx?$") | F.col("text").rlike(r"(?i)<(?:cognosReport|report)[\s>]"))
    name = F.coalesce(first("dashboard", "name"), first("cognosReport", "name"), first("report", "name"), first("workbook", "name"), stem(F.col("path")))
    return bi.select("path", F.upper(name).alias("name"), fqn(F.coalesce(first("relation", "table"), first("source", "table"), any_table)).alias("source"))


def etl_statements(texts: DataFrame) -> DataFrame:
    """(path, statement): SQL in SSIS, Informatica and Talend files, with XML entities read."""
    found = F.concat(F.regexp_extract_all("text", F.lit(r'SqlStatementSource="([^"]*)"'), F.lit(1)), F.regexp_extract_all("text", F.lit(r'NAME\s*=\s*"Sql Query"\s+VALUE\s*=\s*"([^"]*)"'), F.lit(1)), F.regexp_extract_all("text", F.lit(r'name="QUERY"\s+value="([^"]*)"'), F.lit(1)))
    return texts.select("path", F.explode(found).alias("statement")).withColumn("statement", unescaped(F.col("statement")))


def informatica_endpoints(texts: DataFrame) -> DataFrame:
    """(path, role, fqn) of POWERMART sources and targets."""
    out = None
    for role in ("SOURCE", "TARGET"):
        found = texts.select("path", F.explode(tags(F.col("text"), role)).alias("t"))
        name = F.regexp_replace(attribute(F.col("t"), "NAME"), "^(SQ_|TGT_|SRC_)", "")
        rows = found.select("path", F.lit(role.lower()).alias("role"), fqn(F.concat_ws(".", attribute(F.col("t"), "OWNERNAME"), name)).alias("fqn"))
        out = rows if out is None else out.unionByName(rows)
    return out.filter("fqn <> ''")


def etl_endpoints(texts: DataFrame) -> DataFrame:
    """(path, job, dialect, source, target) of ETL files that name their ends and have no SQL.

    Ends are stages X_Source and X_Target, FROMINSTANCE (without SQ_) and TOINSTANCE, the first two OLEDB_ components,
    or the parts of a file name A_TO_B.
    """
    etl = dialect_of(texts).filter(F.col("dialect").isin("ssis", "informatica", "datastage", "talend"))
    pick = lambda p, i=1: F.nullif(F.regexp_extract("text", p, i), F.lit(""))
    component = F.regexp_extract_all("text", F.lit(r'name="OLEDB_([^"]+)"'), F.lit(1))
    by_name = lambda i: F.nullif(F.regexp_extract(stem(F.col("path")), r"^(?:ETL_)?(.+?)_TO_(.+)$", i), F.lit(""))
    source = F.coalesce(pick(r'Name\s+"([^"]+)_Source"'), F.regexp_replace(pick(r'FROMINSTANCE="([^"]+)"'), "^SQ_", ""), F.try_element_at(component, F.lit(1)), by_name(1))
    target = F.coalesce(pick(r'Name\s+"([^"]+)_Target"'), F.try_element_at(F.filter(F.regexp_extract_all("text", F.lit(r'TOINSTANCE="([^"]+)"'), F.lit(1)), lambda t: ~t.rlike("(?i)^EXP_")), F.lit(1)), F.try_element_at(component, F.lit(2)), by_name(2))
    return etl.select("path", F.upper(stem(F.col("path"))).alias("job"), "dialect", fqn(source).alias("source"), fqn(target).alias("target"))


def orchestration(texts: DataFrame) -> DataFrame:
    """(schedule, job, type, artifact, source, target, depends_on) of job definitions in JSON."""
    job = "struct<Type:string,Tool:string,Artifact:string,Source:string,Target:string,DependsOn:array<struct<JobName:string>>>"
    groups = texts.select(F.explode(F.from_json("text", f"map<string,map<string,{job}>>")).alias("schedule", "jobs"))
    return groups.select("schedule", F.explode("jobs").alias("job", "j")).select("schedule", "job", F.col("j.Type").alias("type"), F.col("j.Artifact").alias("artifact"), F.col("j.Source").alias("source"), F.col("j.Target").alias("target"), F.transform("j.DependsOn", lambda d: d["JobName"]).alias("depends_on"))


def runs(texts: DataFrame) -> DataFrame:
    """(run_time, job, status, elapsed_s, nodes, mappings, failed, skipped) of run summaries in JSON."""
    schema = "run_time string, total_elapsed_s double, jobs array<struct<job:string,status:string,elapsed_s:double,nodes:bigint,mappings:bigint,failed:array<string>,skipped:array<string>>>"
    return texts.select(F.from_json("text", schema).alias("r")).select("r.run_time", F.explode("r.jobs").alias("j")).select("run_time", "j.*")


def runs_of_jobs(run_rows: DataFrame, jobs: DataFrame) -> DataFrame:
    """Runs with the job of orchestration() whose artifact has the run's name, else the run's own name, and its steps."""
    by_artifact = jobs.select(F.upper(stem(F.col("artifact"))).alias("_artifact"), F.upper("job").alias("_job")).groupBy("_artifact").agg(F.min("_job").alias("_job"))
    joined = run_rows.join(by_artifact, F.upper("job") == F.col("_artifact"), "left")
    return joined.withColumns({"job": F.coalesce("_job", F.upper("job")), "steps": F.coalesce("nodes", "mappings")}).drop("_artifact", "_job")


def with_row_counts(node_rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Nodes (fqn) with the row_count of an inventory, null where it has none."""
    return node_rows.join(estimates.groupBy("fqn").agg(F.max("row_count").alias("row_count")), "fqn", "left")


def row_estimates(texts: DataFrame) -> DataFrame:
    """(fqn, row_count) of an inventory in JSON."""
    schema = "tables array<struct<table_schema:string,table_name:string,row_count:bigint>>"
    return texts.select(F.explode(F.from_json("text", schema)["tables"]).alias("t")).select(fqn(F.concat_ws(".", "t.table_schema", "t.table_name")).alias("fqn"), "t.row_count")


def ml_scripts(texts: DataFrame) -> DataFrame:
    """(path, features, reads, writes, models) named in training scripts."""
    listed = lambda k: F.transform(F.split(F.regexp_extract("text", rf"(?m)^\s*{k}:\s*(.*?)\s*$", 1), r"\s*,\s*"), fqn)
    return texts.select("path", F.regexp_extract_all(F.regexp_extract("text", r"(?s)FEATURE_COLS\s*=\s*\[(.*?)\]", 1), F.lit(r"[\"']([^\"']+)[\"']"), F.lit(1)).alias("features"), listed("Reads").alias("reads"), listed("Writes").alias("writes"), F.regexp_extract_all("text", F.lit(r"[\"']([\w.-]+\.pkl)[\"']"), F.lit(1)).alias("models"))


def datastage_records(texts: DataFrame) -> DataFrame:
    """(path, ordinal, kind, properties): the BEGIN/END blocks of exported jobs; a value may run over lines in =+=+=+=.

    Blocks nest, so each file goes through a small line parser. Values of a repeated key are joined by line ends.
    """
    @F.arrow_udf("array<struct<kind: string, properties: map<string,string>>>")
    def parse(column: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("properties", pa.map_(pa.string(), pa.string()))]))
        return pa.array([_blocks(t or "") for t in column.to_pylist()], kind)

    return texts.select("path", F.posexplode(parse(F.col("text"))).alias("ordinal", "r")).select("path", "ordinal", "r.kind", "r.properties")


def _blocks(text: str) -> list[dict]:
    done, stack, lines = [], [], iter(text.splitlines())
    for line in lines:
        word, _, rest = line.strip().partition(" ")
        if word == "BEGIN":
            stack.append({"kind": rest.strip(), "properties": {}})
            done.append(stack[-1])
        elif word == "END" and stack:
            stack.pop()
        elif word and stack:
            value = rest.strip()
            if value == "=+=+=+=":
                held = []
                for more in lines:
                    if more.strip() == "=+=+=+=":
                        break
                    held.append(more)
                value = "\n".join(held)
            held = stack[-1]["properties"]
            held[word] = f"{held[word]}\n{value.strip(chr(34))}" if word in held else value.strip(chr(34))
    return [{"kind": b["kind"], "properties": list(b["properties"].items())} for b in done]


def edges(view_rows: DataFrame, procedure_rows: DataFrame) -> DataFrame:
    """(src, dst, kind, confidence), producer to consumer, the most certain of equal ones."""
    v = view_rows.select(F.explode("sources").alias("src"), F.col("fqn").alias("dst"), F.lit("VIEW_DEPENDS").alias("kind"), F.when(F.col("complexity") == "dynamic", 0.0).otherwise(1.0).alias("confidence"))
    sure = F.when(F.col("has_dynamic"), 0.0).otherwise(1.0).alias("confidence")
    p = procedure_rows
    out = v.unionByName(p.select(F.explode("reads").alias("src"), F.col("fqn").alias("dst"), F.lit("SP_READS").alias("kind"), sure))
    out = out.unionByName(p.select(F.col("fqn").alias("src"), F.explode("writes").alias("dst"), F.lit("SP_WRITES").alias("kind"), sure)).unionByName(p.select(F.col("fqn").alias("src"), F.explode("calls").alias("dst"), F.lit("SP_CALLS").alias("kind"), sure))
    return strongest(out)


def strongest(edge_rows: DataFrame) -> DataFrame:
    """One row for each (src, dst, kind), with the highest confidence."""
    return edge_rows.groupBy("src", "dst", "kind").agg(F.max("confidence").alias("confidence"))


def jobs_in_xml() -> Column:
    """Whether a file is a DataStage export in XML: its jobs have names of their own, and records that say what they do."""
    return F.lower("path").rlike(r"\.(dsx|xml)$") & F.col("text").rlike(r"<Job\s") & F.col("text").rlike(r"<Record\s")


def etl_edges(texts: DataFrame) -> DataFrame:
    """(src, dst, kind, confidence): ETL_READS from tables to jobs, ETL_WRITES from jobs to tables."""
    job = F.upper(stem(F.col("path")))
    etl = dialect_of(texts).filter(F.col("dialect").isin("ssis", "informatica", "talend")).select("path", "text")
    said = etl_statements(etl).withColumn("statement", plain_sql(F.col("statement")))
    wrote = writes(F.col("statement"))
    said = said.select(job.alias("job"), F.array_except(references(F.col("statement")), wrote).alias("reads"), wrote.alias("writes"))
    ends = etl_endpoints(texts).join(etl_statements(etl).select("path").distinct(), "path", "left_anti").join(texts.filter(jobs_in_xml()).select("path"), "path", "left_anti")
    named = informatica_endpoints(etl)
    read = said.select(F.explode("reads").alias("src"), F.col("job").alias("dst")).unionByName(ends.filter("source <> ''").select(F.col("source").alias("src"), F.col("job").alias("dst"))).unionByName(named.filter("role = 'source'").select(F.col("fqn").alias("src"), job.alias("dst")))
    wrote_ = said.select(F.col("job").alias("src"), F.explode("writes").alias("dst")).unionByName(ends.filter("target <> ''").select(F.col("job").alias("src"), F.col("target").alias("dst"))).unionByName(named.filter("role = 'target'").select(job.alias("src"), F.col("fqn").alias("dst")))
    return read.select("*", F.lit("ETL_READS").alias("kind"), F.lit(1.0).alias("confidence")).unionByName(wrote_.select("*", F.lit("ETL_WRITES").alias("kind"), F.lit(1.0).alias("confidence")))


def declared_edges(jobs: DataFrame, texts: DataFrame) -> DataFrame:
    """(src, dst, kind, confidence) that an orchestration declares, more certain where the job's artifact names them.

    0.8 where the artifact's text holds the leaf name, 0.3 where it doesn't, 0.6 where there is no artifact text.
    """
    ref = F.lit(r"([A-Za-z_]\w*\.(?:\w+|\*))")
    said = jobs.select(F.upper("job").alias("job"), F.upper(stem(F.col("artifact"))).alias("file"), "source", "target")
    refs = said.select("job", "file", F.explode(F.regexp_extract_all(F.coalesce("source", F.lit("")), ref, F.lit(1))).alias("ref"), F.lit(True).alias("reads")).unionByName(said.select("job", "file", F.explode(F.regexp_extract_all(F.coalesce("target", F.lit("")), ref, F.lit(1))).alias("ref"), F.lit(False).alias("reads")))
    files = texts.select(F.upper(stem(F.col("path"))).alias("file"), F.upper("text").alias("body"))
    found = refs.join(files, "file", "left").groupBy("job", "ref", "reads").agg(F.max(F.col("body").contains(F.upper(F.substring_index("ref", ".", -1)))).alias("named"), F.max(F.col("body").isNotNull()).alias("known"))
    sure = F.when(~F.col("known"), 0.6).when(F.col("named"), 0.8).otherwise(0.3)
    return found.select(F.when(F.col("reads"), fqn(F.col("ref"))).otherwise(F.col("job")).alias("src"), F.when(F.col("reads"), F.col("job")).otherwise(fqn(F.col("ref"))).alias("dst"), F.when(F.col("reads"), "ETL_READS").otherwise("ETL_WRITES").alias("kind"), sure.alias("confidence"))


def resolve(edge_rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are nodes where a name leads to one: SCHEMA.* to all of a schema, a bare name to the only node
    with that leaf (views before others). What leads nowhere stays as it is."""
    leaf = nodes.withColumn("name", F.substring_index("fqn", ".", -1)).filter("name <> fqn")
    best = leaf.groupBy("name").agg(F.min(F.struct((F.col("kind") != "VIEW").alias("later"), "fqn")).alias("one"), F.sum((F.col("kind") == "VIEW").cast("int")).alias("views"), F.count("*").alias("n"))
    bare = best.filter("n = 1 or views = 1").select("name", F.col("one.fqn").alias("to"))
    star = leaf.filter("kind in ('TABLE', 'VIEW')").select(F.concat(F.substring_index("fqn", ".", 1), F.lit(".*")).alias("name"), F.col("fqn").alias("to"))
    known = nodes.select(F.col("fqn").alias("name"))
    names = bare.join(known, "name", "left_anti").unionByName(star)
    for end in ("src", "dst"):
        edge_rows = edge_rows.join(names, edge_rows[end] == names["name"], "left").withColumn(end, F.coalesce("to", end)).drop("name", "to")
    return edge_rows


def unresolved(edge_rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(fqn, seen_from): ends of edges that are no node (column fqn), each once."""
    ends = edge_rows.select(F.col("src").alias("fqn"), F.col("dst").alias("seen_from")).unionByName(edge_rows.select(F.col("dst").alias("fqn"), F.col("src").alias("seen_from")))
    return ends.join(nodes.select("fqn"), "fqn", "left_anti").groupBy("fqn").agg(F.min("seen_from").alias("seen_from"))


def graph(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An estate's files (path, text) as nodes (fqn, kind), edges (src, dst, kind, confidence, unresolved) and the names
    that are no node (fqn, seen_from).

    Views, procedures, ETL files, training scripts, schedules, dashboards and orchestrations give edges, always from
    producer to consumer; tables are also those that statements in ETL files create. A DataStage export in XML gives a
    node for each of its jobs, and edges by its records' statements and tables and by the ways of its rejects. What a view reads is told by its
    parse tree, by patterns only where its dialect is not understood. A name that several readers give is one node, of
    the first kind in the order TABLE, VIEW, PROCEDURE, ETL_JOB, ROUTINE, SCHEDULE, DASHBOARD. Objects of the database
    systems, DUAL and files are none. Files of other kinds give nothing; no files give empty tables.
    """
    from ..operators.estate_lineage import references as parsed
    from . import dataflow

    exports = texts.filter(jobs_in_xml())
    refs = dataflow.datastage_refs(dataflow.datastage_records_xml(exports)).select("job", "fqn", "role")
    refs = cut(refs.unionByName(dataflow.reject_targets(exports).select("job", F.col("table_name").alias("fqn"), F.lit("write").alias("role"))).filter(F.col("job").isNotNull() & (F.col("job") != "")).filter(is_object(F.col("fqn"))).distinct())
    is_read = F.col("role") == "read"
    staged = refs.select(F.when(is_read, F.col("fqn")).otherwise(F.col("job")).alias("src"), F.when(is_read, F.col("job")).otherwise(F.col("fqn")).alias("dst"), F.when(is_read, "ETL_READS").otherwise("ETL_WRITES").alias("kind"), F.lit(1.0).alias("confidence"))

    sql = texts.filter(F.lower("path").endswith(".sql"))
    v, p, s, d = views(sql), procedures(sql), schedules(texts), dashboards(texts)
    named = parsed(texts.sparkSession, v.select(F.col("fqn").alias("id"), "sql")).filter("role = 'reads'").groupBy(F.col("id").alias("fqn")).agg(F.collect_set("name").alias("named"))
    v = v.join(named, "fqn", "left").withColumn("sources", F.coalesce("named", F.array().cast("array<string>"))).drop("named")
    scripts = ml_scripts(texts.filter(F.lower("path").endswith(".py"))).select(F.upper(stem(F.col("path"))).alias("fqn"), *[F.filter(c, is_object).alias(c) for c in ("reads", "writes")]).filter("size(reads) + size(writes) > 0")
    made = tables(etl_statements(texts).select("path", F.col("statement").alias("text"))).select("fqn").filter(is_object(F.col("fqn")))
    jobs = orchestration(texts.filter(F.lower("path").endswith(".json") & F.col("text").contains('"DependsOn"')))
    etl = etl_edges(texts)
    kinds = ["TABLE", "VIEW", "PROCEDURE", "ETL_JOB", "ROUTINE", "SCHEDULE", "DASHBOARD"]
    job_names = dialect_of(texts.filter(~F.coalesce(jobs_in_xml(), F.lit(False)))).filter(F.col("dialect").isin("ssis", "informatica", "datastage", "talend")).select(F.upper(stem(F.col("path"))).alias("fqn"))
    job_names = job_names.unionByName(dataflow.exported_jobs(exports).select(F.col("job").alias("fqn")))
    parts = [tables(sql).select("fqn").unionByName(made), v.select("fqn"), p.select("fqn"), job_names, scripts.select("fqn"), s.select(F.col("name").alias("fqn")).unionByName(jobs.select(F.upper("job").alias("fqn"))), d.select(F.col("name").alias("fqn"))]
    nodes = None
    for i, part in enumerate(parts):
        part = part.select("fqn", F.lit(i).alias("i"))
        nodes = part if nodes is None else nodes.unionByName(part)
    nodes = nodes.filter("fqn <> ''").groupBy("fqn").agg(F.min("i").alias("i")).select("fqn", F.element_at(F.array(*map(F.lit, kinds)), F.col("i") + 1).alias("kind"))
    dynamic = p.filter("has_dynamic").select(F.col("fqn").alias("src"), F.lit("UNRESOLVED_DYNAMIC").alias("dst"), F.lit("UNRESOLVED").alias("kind"), F.lit(0.0).alias("confidence"))
    needs = s.select(F.explode("depends_on").alias("src"), F.col("name").alias("dst")).unionByName(jobs.select(F.explode(F.transform("depends_on", F.upper)).alias("src"), F.upper("job").alias("dst")))
    needs = needs.select("*", F.lit("SCHEDULE_DEPENDS").alias("kind"), F.lit(1.0).alias("confidence"))
    shown = d.filter("source <> ''").select(F.col("source").alias("src"), F.col("name").alias("dst"), F.lit("DASHBOARD_RENDERS").alias("kind"), F.lit(1.0).alias("confidence"))
    learnt = scripts.select(F.explode("reads").alias("src"), F.col("fqn").alias("dst"), F.lit("ETL_READS").alias("kind"), F.lit(0.9).alias("confidence")).unionByName(scripts.select(F.col("fqn").alias("src"), F.explode("writes").alias("dst"), F.lit("ETL_WRITES").alias("kind"), F.lit(0.9).alias("confidence")))
    found = edges(v, p)
    for more in (etl, staged, declared_edges(jobs, texts).filter(is_object(F.col("src")) & is_object(F.col("dst"))), needs, shown, learnt, dynamic):
        found = found.unionByName(more)
    nodes = cut(nodes)
    found = cut(strongest(resolve(found, nodes)))
    lost = unresolved(found.filter("kind <> 'UNRESOLVED'"), nodes)
    gone = lost.select(F.col("fqn").alias("end"))
    flagged = found.join(gone, F.col("src") == F.col("end"), "left").withColumn("a", F.col("end").isNotNull()).drop("end").join(gone, F.col("dst") == F.col("end"), "left")
    flagged = flagged.select("src", "dst", "kind", "confidence", (F.col("a") | F.col("end").isNotNull() | (F.col("kind") == "UNRESOLVED") | (F.col("confidence") == 0)).alias("unresolved"))
    return nodes, flagged, lost

"""Tables whose versions are numbered commits, so that writers can't undo each other's work.

A table is a folder with data/<id>/ (Parquet, one folder a commit) and _commits/<number>.json, which says what the commit
adds and whether it replaces what was there. Data is written first; the commit appears by a rename that fails where its
number is taken. What a writer that was killed has written belongs to no commit, and nobody reads it. The rename is
atomic where the file system's is (HDFS); an object store needs a committer that offers it.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import ledger

_ACTION = "version long, folder string, replaces boolean, columns string"


class Conflict(RuntimeError):
    """Another writer has made the version first."""


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _store(spark: SparkSession, name: str):
    return _path(spark, name).getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, table: str) -> int:
    """The number of the last commit, 0 where there is none."""
    store, where = _store(spark, table), _path(spark, f"{table}/_commits")
    names = [s.getPath().getName() for s in store.listStatus(where)] if store.exists(where) else []
    return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)


def _actions(spark: SparkSession, table: str, version: int) -> list:
    """The commits from the last replacing one up to a version; compact() keeps them few."""
    said = spark.read.text(f"{table}/_commits/*.json", wholetext=True).select(F.from_json("value", _ACTION).alias("a")).select("a.*").filter(F.col("version") <= version)
    begin = said.filter("replaces").agg(F.coalesce(F.max("version"), F.lit(0)).alias("_from"))
    return said.crossJoin(F.broadcast(begin)).filter("version >= _from").orderBy("version").drop("_from").collect()


def read(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """The table as of a version, the current one if none is given; FileNotFoundError where there is no such version."""
    last = current(spark, table)
    at = last if version is None else version
    if not 1 <= at <= last:
        raise FileNotFoundError(f"{table} has no version {at}")
    actions = _actions(spark, table, at)
    return spark.read.schema(StructType.fromJson(json.loads(actions[-1]["columns"]))).parquet(*[f"{table}/data/{a['folder']}" for a in actions])


def commit(df: DataFrame, table: str, base: int, replace: bool = False) -> int:
    """Writes df as version base + 1, added to version base or in its place, and returns that number.

    Raises Conflict, and changes nothing, if another writer has made that version since base was current; base must be
    the current version or one that was. Added rows have the columns of what is there.
    """
    spark, number, folder = df.sparkSession, base + 1, uuid.uuid4().hex
    if not replace and base and read(spark, table, base).schema.simpleString() != df.schema.simpleString():
        raise ValueError("columns differ from those of the table")
    df.write.parquet(f"{table}/data/{folder}")
    if current(spark, table) < base:
        raise ValueError(f"{table} has no version {base}")
    store, made = _store(spark, table), f"{table}/_commits/.{folder}.tmp"
    out = store.create(_path(spark, made), False)
    out.write(json.dumps({"version": number, "folder": folder, "replaces": replace or base == 0, "columns": df.schema.json()}).encode())
    out.close()
    files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, table).toUri(), spark._jsc.hadoopConfiguration())
    no_overwrite = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        files.rename(_path(spark, made), _path(spark, f"{table}/_commits/{number:020d}.json"), no_overwrite)
    except Py4JJavaError as error:
        if not error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            raise
        for name in (made, f"{table}/data/{folder}"):
            store.delete(_path(spark, name), True)
        raise Conflict(f"{table}: version {number} is there already") from error
    return number


def compact(spark: SparkSession, table: str) -> int:
    """The current version in one folder; versions before it stay readable."""
    base = current(spark, table)
    return commit(read(spark, table, base), table, base, replace=True)


def append_events(events: DataFrame, table: str, chain: str, order: str, payload: str, tries: int = 5) -> int:
    """Events hashed onto the last ones of their chains in a ledger that is such a table, and its new version.

    If another writer was first, they are hashed anew onto what it wrote, so that a chain never forks; after so many
    tries Conflict is raised. The chains' order is the writers': an event's order column must not be before stored ones.
    """
    spark = events.sparkSession
    for left in reversed(range(tries)):
        base = current(spark, table)
        rows = ledger.append(read(spark, table, base), events, chain, order, payload) if base else ledger.build(events, chain, order, payload)
        try:
            return commit(rows, table, base)
        except Conflict:
            if not left:
                raise
    raise ValueError("tries must be 1 or more")

"""Versions of tables under several writers and killed ones; computed columns against DuckDB's generated ones."""

from __future__ import annotations

import os
import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import computed
from tidemark.operators import ledger
from tidemark.sources import commits, estate


@pytest.fixture
def folder(spark):
    return f"{spark.conf.get('spark.checkpoint.dir')}/table-{uuid.uuid4().hex}"


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_versions(spark, folder):
    with pytest.raises(FileNotFoundError):
        commits.read(spark, folder)
    assert commits.commit(spark.range(2), folder, 0) == 1
    assert commits.commit(spark.range(5, 7), folder, 1) == 2
    assert commits.commit(spark.range(9, 10), folder, 2, replace=True) == 3
    assert commits.commit(spark.range(0), folder, 3) == 4
    assert [ids(commits.read(spark, folder, v)) for v in (1, 2, 3, 4)] == [[0, 1], [0, 1, 5, 6], [9], [9]]
    assert commits.compact(spark, folder) == 5 and ids(commits.read(spark, folder)) == [9] and ids(commits.read(spark, folder, 2)) == [0, 1, 5, 6]
    with pytest.raises(ValueError):
        commits.commit(spark.range(1).withColumn("more", F.lit(1)), folder, 5)
    with pytest.raises(FileNotFoundError):
        commits.read(spark, folder, 6)


def test_the_second_of_two_writers_fails(spark, folder):
    commits.commit(spark.range(1), folder, 0)
    base = commits.current(spark, folder)
    commits.commit(spark.range(1, 2), folder, base)
    for replace in (False, True):
        with pytest.raises(commits.Conflict):
            commits.commit(spark.range(7, 8), folder, base, replace)
    assert commits.current(spark, folder) == 2 and ids(commits.read(spark, folder)) == [0, 1]
    root = folder.removeprefix("file:")
    assert len(os.listdir(f"{root}/data")) == 2 and not [n for n in os.listdir(f"{root}/_commits") if n.endswith(".tmp")]


def test_a_killed_write_changes_nothing(spark, folder):
    commits.commit(spark.range(3), folder, 0)
    broken = spark.range(8).select(F.when(F.col("id") == 7, F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="killed"):
        commits.commit(broken, folder, 1, replace=True)
    spark.range(50).write.parquet(f"{folder}/data/left-by-a-dead-writer")
    assert commits.current(spark, folder) == 1 and ids(commits.read(spark, folder)) == [0, 1, 2]


def test_chains_never_fork(spark, folder, monkeypatch):
    events = lambda *at: spark.createDataFrame([(c, i, f"{c}{i}") for c in "xy" for i in at], "chain string, seq int, payload string")
    assert commits.append_events(events(1, 2), folder, "chain", "seq", "payload") == 1
    true, stale = commits.current, [1]
    assert commits.append_events(events(3), folder, "chain", "seq", "payload") == 2
    # A writer that saw version 1 only is refused once and then goes on from version 2.
    monkeypatch.setattr(commits, "current", lambda spark, table: stale.pop() if stale else true(spark, table))
    assert commits.append_events(events(4), folder, "chain", "seq", "payload") == 3
    found = commits.read(spark, folder)
    assert {(r["chain"], r["events"], r["broken"]) for r in ledger.verify(found, "chain", "seq", "payload").collect()} == {("x", 4, 0), ("y", 4, 0)}
    assert found.groupBy("prev_hash").count().filter("count > 2 or (count > 1 and prev_hash <> 'GENESIS')").isEmpty()


DDL = "CREATE TABLE DW.SALES (qty INT, price DOUBLE, [Gross Amount] AS (NET * (1 + rate)), net AS (qty * PRICE), rate AS (CASE WHEN qty > 2 THEN 0.5 ELSE 0.25 END), label AS ('net' || CAST([Gross Amount] AS VARCHAR(20))))"


def test_computed_columns(spark):
    columns = estate.tables(spark.createDataFrame([("f.sql", DDL)], "path string, text string"))
    found = computed.definitions_of(columns, "DW.SALES")
    assert list(found) == ["Gross Amount", "net", "rate", "label"]
    stored = spark.createDataFrame([(3, 2.0), (1, 4.0)], "qty int, price double")
    got = sorted(tuple(r) for r in computed.with_computed(stored, found).select("qty", "net", "rate", "Gross Amount", "label").collect())
    assert got == [(1, 4.0, 0.25, 5.0, "net5.0"), (3, 6.0, 0.5, 9.0, "net9.0")]


def test_chained_columns_equal_generated_ones(spark):
    texts = {"d": "c || '-' || b", "c": "concat('b', \"B\")", "b": "a * 2 + [x y]", "e": "CASE WHEN D LIKE '%4' THEN b END", "none": None}
    rows = [(1, 2), (2, 0), (None, 3), (-5, 9)]
    got = computed.with_computed(spark.createDataFrame(rows, "a int, `x y` int"), texts).select("a", "b", "c", "d", "e")
    con = duckdb.connect()
    con.execute("""CREATE TABLE t (a INT, "x y" INT, b INT GENERATED ALWAYS AS (a * 2 + "x y"), c VARCHAR GENERATED ALWAYS AS ('b' || CAST(b AS VARCHAR)), d VARCHAR GENERATED ALWAYS AS (c || '-' || b), e INT GENERATED ALWAYS AS (CASE WHEN d LIKE '%4' THEN b END))""")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, con.execute("SELECT a, b, c, d, e FROM t").fetchall()))


def test_circles_of_columns_are_refused(spark):
    for texts in ({"a": "b + 1", "b": "A"}, {"a": "a + 1"}):
        with pytest.raises(computed.Circular):
            computed.with_computed(spark.range(1), texts)
    assert computed.with_computed(spark.range(1), {"a": "'b'", "b": "a"}).first()["b"] == "b"


def test_columns_of_another_dialect(spark):
    people = spark.sql("SELECT 'Ann' AS FirstName, 'Lee' AS LastName, date'1990-05-01' AS Born, 7 AS n UNION ALL SELECT NULL, 'Day', NULL, 1")
    texts = {"FullName": "FirstName + ' + ' + LastName", "Greeting": "'Dear ' + [FullName]", "Age": "DATEDIFF(YEAR, Born, GETDATE())", "Level": "ISNULL(n + 1, 0)", "Band": "IIF(n >= 5, 'High', 'Low')"}
    got = computed.with_computed(people, texts).withColumn("right", F.col("Age").eqNullSafe(F.year(F.current_date()) - F.year("Born")))
    assert sorted(map(str, (tuple(r) for r in got.select("FullName", "Greeting", "Level", "Band", "right").collect()))) == sorted(map(str, [("Ann + Lee", "Dear Ann + Lee", 8, "High", True), (None, None, 2, "Low", True)]))

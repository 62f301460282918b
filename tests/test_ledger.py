"""Long chains of the ledger, event by event against hashlib."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tidemark.operators import ledger


def test_long_chain_streams(spark):
    n = 25_000  # more than an Arrow batch
    events = spark.range(n).select(F.when(F.col("id") % 50 == 7, None).when(F.col("id") % 50 == 9, "b").otherwise("a").alias("chain"), (n - F.col("id")).alias("at"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("payload"))
    built = ledger.build(events, "chain", "at", "payload")
    assert "collect_list" not in built._jdf.queryExecution().toString()  # no chain is gathered in a row
    sha, last, want = lambda s: hashlib.sha256(s.encode()).hexdigest(), {}, []
    for i in reversed(range(n)):
        chain, payload = {7: None, 9: "b"}.get(i % 50, "a"), f"p{i}"
        before = last.get(chain, "GENESIS")
        last[chain] = sha(f"{before}:{sha(payload)}")
        want.append((chain, n - i, payload, before, last[chain]))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in built.collect())


def test_null_payload_breaks_its_chain(spark):
    events = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("a", 3, "z"), ("b", 1, "y")], "chain string, at long, payload string")
    found = {(r["chain"], r["at"]): (r["prev_hash"] is None, r["event_hash"] is None) for r in ledger.build(events, "chain", "at", "payload").collect()}
    assert found == {("a", 1): (False, False), ("a", 2): (False, True), ("a", 3): (True, True), ("b", 1): (False, False)}

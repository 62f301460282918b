"""A hash-chained evidence ledger: building, verifying and gating."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

GENESIS = "GENESIS"
#: Of no chain. A type, so that it is the same object after pickling.
_START = type


def link_hash(previous: Column, payload: Column) -> Column:
    """sha256 of the previous hash, a colon, and the payload's own sha256."""
    return F.sha2(F.concat(previous, F.lit(":"), F.sha2(payload.cast("binary"), 256)).cast("binary"), 256)


def _links(at: int):
    """Adds prev_hash and event_hash to rows sorted by chain (column 0); column `at` has the payloads' own hashes, the
    next one, if there is one, what a chain goes on from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, last = _START, None
        for batch in batches:
            before, after = [], []
            begin = batch.column(at + 1).to_pylist() if batch.num_columns > at + 1 else [GENESIS] * batch.num_rows
            for key, own, first in zip(batch.column(0).to_pylist(), batch.column(at).to_pylist(), begin):
                if here is _START or not (key == here or (key != key and here != here)):
                    here, last = key, first
                before.append(last)
                last = None if last is None or own is None else hashlib.sha256(f"{last}:{own}".encode()).hexdigest()
                after.append(last)
            columns = [batch.column(i) for i in range(at)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(before, pa.string()), pa.array(after, pa.string())], names=[*batch.schema.names[:at], "prev_hash", "event_hash"])

    return run


def build(events: DataFrame, chain: str, order: str, payload: str) -> DataFrame:
    """Adds prev_hash and event_hash, each event's hash covering the one before it in its chain.

    A chain is sequential by nature: payloads are hashed in parallel, then each chain's events stream through one task in
    order, which holds no more than the last hash. Chains run in parallel.
    """
    rows = events.select(chain, order, payload)
    hashed = rows.withColumn("_tm_own", F.sha2(F.col(payload).cast("binary"), 256))
    dealt = hashed.repartition(chain).sortWithinPartitions(chain, order, payload)
    schema = StructType([*rows.schema.fields, StructField("prev_hash", StringType()), StructField("event_hash", StringType())])
    return dealt.mapInArrow(_links(len(rows.columns)), schema)


def verify(ledger: DataFrame, chain: str, order: str, payload: str) -> DataFrame:
    """(chain, events, broken, first_broken): hashes against stored predecessors, and those against the event before."""
    before = F.lag("event_hash").over(Window.partitionBy(chain).orderBy(order))
    bad = (F.col("event_hash") != link_hash(F.col("prev_hash"), F.col(payload))) | (F.col("prev_hash") != F.coalesce(before, F.lit(GENESIS)))
    return ledger.withColumn("bad", F.coalesce(bad, F.lit(True))).groupBy(chain).agg(F.count("*").alias("events"), F.count_if("bad").alias("broken"), F.min(F.when(F.col("bad"), F.col(order))).alias("first_broken"))


def can_promote(ledger: DataFrame, chain: str, kind: str, passed: str) -> DataFrame:
    """(chain, promotable): a passed diff run, a passed continuity check and an approved plan are all on record."""
    has = lambda k: F.coalesce(F.bool_or((F.col(kind) == k) & F.col(passed)), F.lit(False))
    return ledger.groupBy(chain).agg((has("diff_run") & has("continuity") & has("plan_approved")).alias("promotable"))


def append(ledger: DataFrame, events: DataFrame, chain: str, order: str, payload: str) -> DataFrame:
    """The new rows of a ledger: events hashed onto the last stored event of their chain, or onto the beginning.

    One writer at a time may append; the rows go to the ledger's folder in mode append.
    """
    last = ledger.groupBy(chain).agg(F.max_by("event_hash", order).alias("_tm_from"))
    rows = events.select(chain, order, payload)
    hashed = rows.join(last, chain, "left").select(*rows.columns, F.sha2(F.col(payload).cast("binary"), 256).alias("_tm_own"), F.coalesce("_tm_from", F.lit(GENESIS)).alias("_tm_from"))
    dealt = hashed.repartition(chain).sortWithinPartitions(chain, order, payload)
    schema = StructType([*rows.schema.fields, StructField("prev_hash", StringType()), StructField("event_hash", StringType())])
    return dealt.mapInArrow(_links(len(rows.columns)), schema)


#: What an event of the ledger means to a reader.
SAID = {
    "estate_extracted": "The estate was read", "drift_detected": "The estate has changed", "plan_created": "A migration was planned", "plan_approved": "A plan was approved",
    "diff_run": "Source and target were compared", "continuity": "Lineage was checked", "override_added": "A reference was corrected", "promoted": "A migration was promoted",
}


def audit(ledger: DataFrame, kind: str, actor: str, at: str, subject: str) -> DataFrame:
    """(at, who, what, subject, relationship): the ledger in words; other events are told by their own name."""
    what = F.initcap(F.replace(F.col(kind), F.lit("_"), F.lit(" ")))
    for event, text in SAID.items():
        what = F.when(F.col(kind) == event, text).otherwise(what)
    said = F.concat(F.coalesce(actor, F.lit("system")), F.lit(" -> "), F.col(kind), F.when(F.col(subject).isNotNull(), F.concat(F.lit(" -> "), F.col(subject))).otherwise(F.lit("")))
    return ledger.select(F.col(at).alias("at"), F.coalesce(actor, F.lit("system")).alias("who"), what.alias("what"), F.col(subject).alias("subject"), said.alias("relationship"))


def has(ledger: DataFrame, kind: str, event: str, test: Column | None = None) -> bool:
    """Whether the ledger holds an event of a kind that passes a test; reads no further than the first one."""
    found = ledger.filter(F.col(kind) == event)
    return not (found if test is None else found.filter(test)).isEmpty()

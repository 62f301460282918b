"""The last events of each user, told by a stream that is stopped and goes on, against a window over the table."""

from __future__ import annotations

import datetime
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import velocity


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.select("user_id", "event_id", "n", "total").collect())))


@pytest.mark.parametrize("idle", [None, 20_000])
def test_a_restarted_stream_equals_the_window(spark, sf_dir, idle):
    base = f"{spark.conf.get('spark.checkpoint.dir')}/stream-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value").filter("user_id % 5 = 0").withColumn("value", F.when(F.col("event_id") % 11 > 0, F.col("value")))
    low, high = events.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    part = F.least(F.floor((F.unix_micros("ts") - low) * 4 / (high - low)), F.lit(3))
    # Neighbouring parts mix within the allowed lateness.
    mixed = events.withColumn("part", F.when(F.col("event_id") % 3 == 0, F.least(F.floor((F.unix_micros("ts") - low + 3_600_000_000) * 4 / (high - low)), F.lit(3))).otherwise(part)).persist()
    last = datetime.datetime.fromtimestamp(high / 1e6) + datetime.timedelta(days=9)
    closing = spark.createDataFrame([(-1, last, -1, 0.0)], events.schema)
    late = spark.createDataFrame([(-2, datetime.datetime.fromtimestamp(low / 1e6), 0, 1.0)], events.schema)

    def arrive(df):
        df.select(*events.columns).coalesce(1).write.mode("append").parquet(f"{base}/in")

    def advance():
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        velocity.run(velocity.last_events(stream, 24, "3 hours", idle), f"{base}/out", f"{base}/state")

    arrive(mixed.filter("part = 0"))
    arrive(mixed.filter("part = 1"))
    advance()
    assert 0 < spark.read.parquet(f"{base}/out").count() < events.count()
    arrive(mixed.filter("part = 2"))
    arrive(mixed.filter("part = 3"))
    arrive(late)
    arrive(closing)
    advance()
    want = rows(velocity.last_events(events, 24, idle_seconds=idle))
    assert len(want) == events.count() and rows(spark.read.parquet(f"{base}/out")) == want

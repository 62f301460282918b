"""Event velocity as a stream: counts and sums in time windows, with late data up to a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def windows(events: DataFrame, size: str = "1 day", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total): works on a stream and on a table alike."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("at", late) if events.isStreaming else timed
    return timed.groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "24 hours", every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, user_id, n, total): each user's events in overlapping windows, on a stream and on a table alike."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("at", late) if events.isStreaming else timed
    return timed.groupBy(F.window("at", size, every).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total")).select(F.col("w.start").alias("start"), "user_id", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(start, end, user_id, n): runs of a user's events with no longer gap between them."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("at", late) if events.isStreaming else timed
    return timed.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


#: Decimal places that values are summed with.
PLACES = 4
_STATE = "at array<bigint>, id array<bigint>, units array<bigint>, given array<bigint>, last_units array<bigint>, last_given array<bigint>, last_at bigint"


def _framed(size: int, idle: int | None):
    """Emits a user's events that the watermark has passed, in order, each with its frame; keeps the others and the last frame."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        waiting, frame, last_at = [], [], None
        if state.exists:
            at, ids, units, given, last_units, last_given, last_at = state.get
            waiting = [tuple(map(int, e)) for e in zip(at, ids, units, given)]
            frame = [tuple(map(int, e)) for e in zip(last_units, last_given)]
            last_at = None if last_at is None else int(last_at)
        for batch in batches:
            waiting += [tuple(map(int, e)) for e in zip(batch["at_us"], batch["event_id"], batch["units"], batch["given"])]
        waiting.sort()
        passed, done = state.getCurrentWatermarkMs(), []
        ready = sum(e[0] <= passed * 1000 for e in waiting)
        for at, event, units, given in waiting[:ready]:
            if idle is not None and last_at is not None and at - last_at > idle:
                frame = []
            frame, last_at = [*frame, (units, given)][-size:], at
            done.append((key[0], event, len(frame), sum(u for u, _ in frame), sum(g for _, g in frame)))
        waiting = waiting[ready:]
        due = waiting[0][0] // 1000 + 1 if waiting else (last_at + idle) // 1000 + 1 if idle is not None and last_at is not None else None
        if not waiting and due is not None and due <= passed:
            if state.exists:
                state.remove()
        else:
            state.update((*([e[i] for e in waiting] for i in range(4)), [u for u, _ in frame], [g for _, g in frame], last_at))
            if due is not None:
                state.setTimeoutTimestamp(max(due, passed + 1))
        if done:
            yield pd.DataFrame(done, columns=["user_id", "event_id", "n", "units", "given"])

    return run


def last_events(events: DataFrame, size: int = 24, late: str = "2 hours", idle_seconds: int | None = None) -> DataFrame:
    """(user_id, event_id, n, total): each event with the count and sum of its user's last `size` ones, itself included.

    Order is by time, then id; works on a table, by a window, and on a stream, by state. There an event is told once the
    watermark has passed it, so that the order is final; what comes after it has is dropped. State holds a user's events
    that the watermark hasn't passed and the last `size`. With idle_seconds a longer gap begins a new frame, and a user's
    state goes when it can no longer matter; else it stays. Events without a time take no part; values that are null
    count as events and add nothing, and a frame of them alone has no total. ids are whole numbers.
    """
    units = F.col("value").cast(f"decimal(18,{PLACES})")
    timed = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("at"), F.coalesce((units * 10**PLACES).cast("long"), F.lit(0)).alias("units"), units.isNotNull().cast("long").alias("given")).filter("at is not null")
    timed = timed.withColumn("at_us", F.unix_micros("at"))
    idle = None if idle_seconds is None else idle_seconds * 1_000_000
    if events.isStreaming:
        columns = "user_id %s, event_id bigint, n bigint, units bigint, given bigint" % timed.schema["user_id"].dataType.simpleString()
        rows = timed.withWatermark("at", late).groupBy("user_id").applyInPandasWithState(_framed(size, idle), columns, _STATE, "append", "EventTimeTimeout")
    else:
        order = Window.partitionBy("user_id").orderBy("at_us", "event_id")
        fresh = F.coalesce(F.col("at_us") - F.lag("at_us").over(order) > F.lit(idle), F.lit(False)) if idle is not None else F.lit(False)
        runs = timed.withColumn("_fresh", fresh.cast("long")).withColumn("_run", F.sum("_fresh").over(order)) if idle is not None else timed.withColumn("_run", F.lit(0))
        frame = Window.partitionBy("user_id", "_run").orderBy("at_us", "event_id").rowsBetween(1 - size, 0)
        rows = runs.select("user_id", "event_id", F.count("*").over(frame).alias("n"), F.sum("units").over(frame).alias("units"), F.sum("given").over(frame).alias("given"))
    return rows.select("user_id", "event_id", "n", F.when(F.col("given") > 0, (F.col("units").cast(f"decimal(22,{PLACES})") / 10**PLACES).cast("double")).alias("total"))


def read_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def run(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Appends each window once its watermark has passed, for all input there is now."""
    stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

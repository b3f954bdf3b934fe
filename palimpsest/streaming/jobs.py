"""Structured Streaming forms of the stateful operators.

The watermarks, and what comes too late, are this library's own choice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LATE = "10 minutes"


def event_stream(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    """A stream of Parquet files of events, their time as TIMESTAMP."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = LATE) -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = LATE) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def episodes(events: DataFrame, gap: str = "60 minutes", late: str = LATE) -> DataFrame:
    """The chains of each user: sessions that a gap ends."""
    s = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(events: DataFrame, late: str = LATE) -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def working_memory(events: DataFrame, capacity: int = 7, late: str = LATE, idle: str = "24 hours") -> DataFrame:
    """The newest events of each user, given out whenever they change; a user who is silent for `idle` of event time is forgotten, so that state follows the users at work."""
    import pandas as pd

    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def keep(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = list(zip(*state.get)) if state.exists else []
        for p in parts:
            rows += list(zip(p["event_id"], p["ts"].astype("datetime64[us]").astype("int64")))
        rows = sorted(rows, key=lambda r: (r[1], r[0]))[-capacity:]
        state.update(tuple(map(list, zip(*rows))))
        state.setTimeoutTimestamp(max(rows[-1][1] // 1000, state.getCurrentWatermarkMs()) + wait)
        yield pd.DataFrame({"user_id": [key[0]] * len(rows), "event_id": [int(r[0]) for r in rows], "pos": list(range(len(rows), 0, -1))})

    timed = events.select("user_id", "event_id", "ts").withWatermark("ts", late)
    return timed.groupBy("user_id").applyInPandasWithState(keep, "user_id bigint, event_id bigint, pos int", "ids array<bigint>, at array<bigint>", "update", "EventTimeTimeout")


def watch(spark: SparkSession, path: str, add: Callable[[DataFrame], None], checkpoint: str, tags: tuple[str, ...] = (), every: str | None = None) -> StreamingQuery:
    """Takes in the lines of text files as they come into a folder, each file once: all that are there, or with `every` (such as "10 seconds") without end."""
    from ..sources.files import memories_of_lines

    lines = spark.readStream.text(path)
    w = lines.writeStream.foreachBatch(lambda batch, n: add(memories_of_lines(batch, tags))).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def tick(spark: SparkSession, job: Callable[[int], None], checkpoint: str, every: str) -> StreamingQuery:
    """Runs a job, such as a consolidation, at each interval until it is stopped."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(lambda batch, n: job(n)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def maintain(stream: DataFrame, job: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs a job on every batch of new rows and ends when all that is there has been seen."""
    return stream.writeStream.foreachBatch(job).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

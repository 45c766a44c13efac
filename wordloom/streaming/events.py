"""Streams of practice events: windowed counts with a watermark, deduplication, and mastery state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, files_a_trigger: int = 1) -> DataFrame:
    """The events table's files as a stream; ``ts`` becomes an instant of the session's time zone, as watermarks need."""
    schema = spark.read.parquet(folder).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, delay: str = "1 day", length: str = "1 day") -> DataFrame:
    """Events and value sums of each type and window; late events up to ``delay`` count."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def once(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each event_id once within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def next_level(level: int, ok: bool) -> int:
    """The mastery step of one answer; -1 is unseen."""
    if level < 0:
        return 3 if ok else 0
    return min(level + 1, 3) if ok else max(level - 1, 0)


def mastery_stream(events: DataFrame) -> DataFrame:
    """After each trigger the state of every (user_id, event_type) that had events (columns ok, ts, event_id)."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, seen, wrong = state.get if state.exists else (-1, 0, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for ok in rows["ok"]:
            level, seen, wrong = next_level(level, bool(ok)), seen + 1, wrong + (not ok)
        state.update((level, seen, wrong))
        yield pd.DataFrame({"user_id": [key[0]], "event_type": [key[1]], "seen": [seen], "wrong": [wrong], "level": [level]})

    return events.groupBy("user_id", "event_type").applyInPandasWithState(step, "user_id long, event_type string, seen long, wrong long, level int", "level int, seen long, wrong long", "update", GroupStateTimeout.NoTimeout)

"""State by key on streams: repeated rows dropped while they can come, and entries that are put out when they have been idle.

State grows with the keys seen within the watermark's delay, or not idle yet, never with the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A microsecond less than four hours: Spark joins sessions that touch, and a gap of four hours parts entries.
IDLE = "3 hours 59 minutes 59 seconds 999 milliseconds 999 microseconds"


def deduplicated(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Each event once: a repeat is dropped while it may come, within the watermark's delay; what comes later than that is dropped as late."""
    return events.dropDuplicatesWithinWatermark([key])


def idle_entries(events: DataFrame) -> DataFrame:
    """user_id, first_ts, last_ts, n, total: a user's events with gaps under four hours, once the user has been idle for that long by the
    watermark. Events may come in any order within the watermark's delay. State holds a row for each open entry; an entry that the
    watermark has left behind goes out of it. There is no Python for each user."""
    entry = events.groupBy("user_id", F.session_window("ts", IDLE).alias("open_"))
    out = entry.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"), F.sum(F.coalesce("value", F.lit(0.0))).alias("total"))
    return out.select("user_id", "first_ts", "last_ts", "n", "total")

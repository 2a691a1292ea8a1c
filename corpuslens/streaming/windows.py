"""Event-time windows on streams (an extension). The sink is a Parquet table in the shared folder, exactly once by its checkpoint."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.sources.shared import shared_folder

#: How late an event may be.
LATENESS = "2 hours"


def tumbling(events: DataFrame) -> DataFrame:
    return events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("v")).select(F.col("window.start").alias("window_start"), "event_type", "n", "v")


def sliding(events: DataFrame) -> DataFrame:
    return events.groupBy(F.window("ts", "1 hour", "30 minutes")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("v")).select(F.col("window.start").alias("window_start"), "n", "v")


def sessions(events: DataFrame) -> DataFrame:
    return events.groupBy(F.session_window("ts", "4 hours"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("window_start"), F.col("session_window.end").alias("window_end"), "n")


def far_end(events: DataFrame) -> DataFrame:
    """A single row far beyond all events, null but for its time: it moves a stream's watermark past everything before it."""
    last = events.agg(F.max(F.col("ts").cast("timestamp")).alias("ts")).withColumn("ts", F.col("ts") + F.expr("INTERVAL 30 DAYS"))
    return last.select(*(F.col("ts").cast(f.dataType).alias(f.name) if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema.fields)).filter("ts is not null")


def run_in_steps(spark: SparkSession, arrivals: list[DataFrame], transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream gives, in append mode, of rows that arrive in these steps: runs of one query, whose state and watermark live in its
    checkpoint. A step is a micro-batch or more; the watermark of one holds in the next."""
    at, schema = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}", arrivals[0].schema
    arrivals[0].limit(0).write.parquet(f"{at}/in")
    stream = transform(spark.readStream.schema(schema).parquet(f"{at}/in").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATENESS))
    for rows in arrivals:
        rows.write.mode("append").parquet(f"{at}/in")
        (stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def run_to_end(spark: SparkSession, sf_dir: str, windows: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All windows of the stream's present content, closed by the stream itself: the far end's own window never closes, so it is in no result."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return run_in_steps(spark, [events, far_end(events)], windows)

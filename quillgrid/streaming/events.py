"""Events as a stream: counts in windows of time, and the event bus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_events(spark: SparkSession, folder: str, schema: T.StructType, files_a_trigger: int = 16) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day", ts: str = "ts", by: str = "event_type") -> DataFrame:
    """Events by window and type; events later than ``late`` behind the newest are left out. Works on tables too."""
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp"))
    stamped = stamped.withWatermark(ts, late) if events.isStreaming else stamped
    return stamped.groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "events", "total")


def bus(events: DataFrame, handlers: dict[str, Callable[[DataFrame], None]], checkpoint: str, topic: str = "event_type"):
    """Starts a query that gives each batch's events of a topic to its handler."""

    def deliver(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            for name, handler in handlers.items():
                handler(batch.where(F.col(topic) == name))
        finally:
            batch.unpersist()

    return events.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).start()

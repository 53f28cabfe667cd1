"""Streaming twins of the event rules: the same results as in batch, with state that a watermark bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """A folder of Parquet files as a stream; new files are picked up."""
    return spark.readStream.schema(schema).parquet(path)


def idempotent_stream(events: DataFrame, key: list[str], time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Each event once, where repeats come within ``delay`` of event time; a key's state is dropped after that."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def windowed_metrics(events: DataFrame, length: str = "1 hour", slide: str | None = None, time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Events, errors and mean value per window and type; later events than ``delay`` are dropped."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    rows = events.withWatermark(time, delay).groupBy(window.alias("w"), "event_type")
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.avg("value").alias("mean_value"))


def sessions(events: DataFrame, gap: str = "30 minutes", time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Sessions of each user: events that are less than ``gap`` apart."""
    rows = events.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), "user_id")
    return rows.agg(F.count("*").alias("n"))


def payments_poll(events: DataFrame, as_of: str, minutes: int = 10) -> DataFrame:
    """Incoming amounts of the last minutes of a micro-batch's time."""
    now = F.lit(as_of).cast("timestamp")
    return events.filter((F.col("amount_in") > 0) & F.col("ts").between(now - F.expr(f"INTERVAL {minutes} MINUTES"), now))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there, write it as Parquet and stop; the next run goes on from the checkpoint."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query

"""Quality control as a stream: windowed counts and bad shares of arriving volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bad_share(events: DataFrame, late: str = "10 minutes", window: str = "1 hour", cut: float = 50.0) -> DataFrame:
    """Per window and kind: events, and the share above the cut. Works on a stream and on a table."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    grouped = (timed.withWatermark("ts", late) if events.isStreaming else timed).groupBy(F.window("ts", window).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.avg((F.col("value") > cut).cast("double")).alias("bad")).select(F.col("w.start").alias("start"), "event_type", "n", "bad")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Processes all that has arrived, appending closed windows as Parquet, and stops."""
    bad_share(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()

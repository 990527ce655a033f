"""Structured Streaming over event tables: windows with watermarks, sessions, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, time: str, by: list[str], value: str, size: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts, sums and means per event-time window; also runs on batch frames."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if events.isStreaming else rows
    out = rows.groupBy(F.window(time, size, slide) if slide else F.window(time, size), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total", "mean")


def sessions(events: DataFrame, time: str, user: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions per user, closed by a gap."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if events.isStreaming else rows
    out = rows.groupBy(F.session_window(time, gap), user).agg(F.count("*").alias("n"))
    return out.select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def write(stream: DataFrame, path: str, checkpoint: str):
    """Append closed windows to Parquet, exactly once, until the input ends."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

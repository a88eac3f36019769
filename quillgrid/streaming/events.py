"""Structured Streaming over page rows and events (an extension beside the batch operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files of a folder as they arrive; times without zone are read in that of the session."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return df.withColumns({n: df[n].cast("timestamp") for n, t in df.dtypes if t == "timestamp_ntz"})


def windowed_timings(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count, sum and largest value of each event type and window; state goes once the watermark has passed."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("most")).select("window.start", "window.end", "event_type", "n", "total", "most")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Runs of a user's events without a gap."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id")
    return s.agg(F.count("*").alias("n")).select("user_id", "s.start", "s.end", "n")

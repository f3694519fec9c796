"""Events as a stream: sessions by gap, and running daily counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def event_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    """A stream over the Parquet files that arrive under ``path``; ``ts`` becomes a UTC timestamp, as watermarks need."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def sessions(stream: DataFrame, gap: str = "4 hours", late: str = "1 day") -> DataFrame:
    """(user_id, first_ts, n) of each closed session: events of a user less than ``gap`` apart. State is dropped once the
    watermark, ``late`` behind the newest event, has passed a session; events later than that are left out."""
    s = stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("first_ts"), F.count("*").alias("n"))
    return s.select("user_id", "first_ts", "n")


def daily_counts(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """(day, event_type, n) per tumbling day."""
    s = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return s.select(F.col("w.start").alias("day"), "event_type", "n", "total")


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Processes all that is there in batches, appends it as Parquet under ``path`` and stops; a restart goes on from ``checkpoint``."""
    q = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
    q.awaitTermination()

"""Structured Streaming: the log behaviours as streams over files. Late rows are taken until the watermark passes them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

LATENESS = "10 minutes"


def read_log(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """Stream of the parquet files that appear in ``folder``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def day_counts(log: DataFrame, at: str, *by: str, lateness: str = LATENESS) -> DataFrame:
    """Tumbling days: (day, by..., n)."""
    rows = log.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", lateness)
    return rows.groupBy(F.window("_at", "1 day").alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.to_date("w.start").alias("day"), *by, "n")


def minute_excess(log: DataFrame, at: str, key: str, limit: int, lateness: str = "2 minutes") -> DataFrame:
    """Clients and minutes with more than ``limit`` requests, and how many of them a limiter rejects; state goes with the watermark."""
    rows = log.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", lateness)
    n = rows.groupBy(F.window("_at", "1 minute").alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return n.where(F.col("n") > limit).select(F.col("w.start").alias("minute"), key, "n", (F.col("n") - limit).alias("rejected"))


def sliding_counts(log: DataFrame, at: str, by: str, length: str = "7 days", slide: str = "1 day", lateness: str = LATENESS) -> DataFrame:
    """Sliding windows: (start, by, n)."""
    rows = log.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", lateness)
    return rows.groupBy(F.window("_at", length, slide).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


def gap_sessions(log: DataFrame, at: str, key: str, gap: str, lateness: str = LATENESS) -> DataFrame:
    """Sessions that end after ``gap`` without a request: (key, start, n)."""
    rows = log.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", lateness)
    return rows.groupBy(key, F.session_window("_at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), "n")


def without_repeats(log: DataFrame, at: str, key: list[str], lateness: str = LATENESS) -> DataFrame:
    """Each key once within the watermark."""
    return log.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", lateness).dropDuplicatesWithinWatermark(key).drop("_at")


def run_available(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there and stop; the checkpoint folder makes the next run go on from here, each row once."""
    return df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def merge_available(df: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Like :func:`run_available`, but each batch goes to ``merge(batch, number)``, which must accept repeats of a number."""
    return df.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()

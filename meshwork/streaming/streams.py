"""Streaming forms of the batch operators, with watermarks that bound their state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_files(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def read_topic(spark: SparkSession, servers: str, topic: str, schema: T.StructType) -> DataFrame:
    """JSON messages of a topic; needs the Kafka package on the cluster."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("m")).select("m.*")


def upserts(messages: DataFrame, key: str = "external_id", ts: str = "timestamp", delay: str = "1 hour") -> DataFrame:
    """Each id once within the watermark."""
    return messages.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def activity(events: DataFrame, by: str, ts: str = "ts", width: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts in tumbling (or sliding) windows."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, delay).groupBy(window, by).agg(F.count("*").alias("n")).select("window.start", "window.end", by, "n")


def threads(messages: DataFrame, by: str, ts: str = "timestamp", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of messages with no longer pause than ``gap``."""
    return messages.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), by).agg(F.count("*").alias("n")).select("session_window.start", "session_window.end", by, "n")


def daily_usage(usage: DataFrame, quota: int = 1_000_000, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Tokens of each day, with the quota flags."""
    day = usage.withWatermark(ts, delay).groupBy(F.window(ts, "1 day")).agg(F.sum("total_tokens").alias("tokens"))
    return day.select(F.to_date("window.start").alias("day"), "tokens", (F.col("tokens") >= 0.8 * quota).alias("near_limit"), (F.col("tokens") >= quota).alias("over_limit"))


def to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):  # noqa: ANN201
    return df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def each_batch(df: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str):  # noqa: ANN201
    """Run a batch operator on every micro-batch; ``step`` must write idempotently by batch number."""
    return df.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

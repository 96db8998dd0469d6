"""Registry of queries and what their tables stand for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

REFERENCE = "2024-01-31 00:00:00"


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def reference() -> Column:
    return F.lit(REFERENCE).cast("timestamp")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as messages: nations are their sources, times and authors follow from the id."""
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        (F.col("doc_id") % 25).alias("source_id"),
        F.col("text").alias("content"),
        F.col("source").alias("channel"),
        F.concat(F.lit("user_"), (F.col("doc_id") % 50).cast("string")).alias("author"),
        F.timestamp_add("HOUR", (F.col("doc_id") % 720).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("timestamp"),
        F.concat(F.lit("msg_"), F.col("doc_id").cast("string")).alias("external_id"),
        F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"),
        "lang",
    )


#: The same as SQL.
MESSAGES = """messages AS (SELECT doc_id AS id, doc_id % 25 AS source_id, text AS content, source AS channel,
  'user_' || CAST(doc_id % 50 AS VARCHAR) AS author,
  TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 720 AS INTEGER)) AS timestamp, lang FROM documents)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("type"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("message_id"), "embedding", F.col("label").cast("string").alias("label"))


#: Lower-cased tokens between white space.
TOKENS = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[ \\t\\n\\r\\f\\v]+'), lambda t: t <> '')"

"""Message, text-index and vector stores as Parquet tables: append, upsert, delete, read, count.

Writes are immutable files; a delete or upsert writes a new version beside the old one and then points at it, so
a reader never sees half a table and a failed write changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from meshwork.sources.textindex import TextIndex

SOURCES = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("type", T.StringType()), T.StructField("name", T.StringType()), T.StructField("config", T.StringType()), T.StructField("created_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType())])
MESSAGES = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("source_id", T.LongType()), T.StructField("content", T.StringType()), T.StructField("external_id", T.StringType()), T.StructField("author", T.StringType()), T.StructField("channel", T.StringType()), T.StructField("thread_id", T.StringType()), T.StructField("timestamp", T.TimestampType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])
VECTORS = T.StructType([T.StructField("message_id", T.LongType(), False), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("document", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])

USAGE = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("model", T.StringType()), *[T.StructField(f"{c}_tokens", T.LongType()) for c in ("input", "output", "total")], *[T.StructField(f"{c}_cost", T.DoubleType()) for c in ("input", "output", "total")]])


class Table:
    """A versioned Parquet table; the newest pointer file names the current version."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, partition_by: list[str] | None = None) -> None:
        self.spark, self.path, self.schema, self.partition_by = spark, path.rstrip("/"), schema, partition_by or []

    def _fs(self):  # noqa: ANN202
        jvm, where = self.spark.sparkContext._jvm, self.path
        root = jvm.org.apache.hadoop.fs.Path(where)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _pointers(self) -> list[str]:
        """Names of the pointer files, oldest first: the last one counts."""
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        return sorted(n for n in (f.getPath().getName() for f in fs.listStatus(path(self.path))) if n.startswith("CURRENT-"))

    def exists(self) -> bool:
        return bool(self._pointers())

    def _version(self) -> str | None:
        found = self._pointers()
        return self.spark.read.text(f"{self.path}/{found[-1]}").first()[0] if found else None

    def read(self) -> DataFrame:
        version = self._version()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{version}") if version else self.spark.createDataFrame([], self.schema)

    def _write(self, df: DataFrame, path: str, mode: str) -> None:
        out = df.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).write.mode(mode)
        (out.partitionBy(*self.partition_by) if self.partition_by else out).parquet(path)

    def _point(self, version: str) -> None:
        """Add the next pointer by one rename, then forget the older ones."""
        fs, path = self._fs()
        old = self._pointers()
        made = f"{self.path}/_next-{uuid.uuid4().hex}"
        out = fs.create(path(made), True)
        out.write(bytearray(version.encode()))
        out.close()
        number = int(old[-1].split("-")[1]) + 1 if old else 1
        fs.rename(path(made), path(f"{self.path}/CURRENT-{number:012d}"))
        for name in old:
            fs.delete(path(f"{self.path}/{name}"), False)

    def create(self) -> bool:
        """False if it is there already."""
        if self.exists():
            return False
        self.replace(self.spark.createDataFrame([], self.schema))
        return True

    def replace(self, df: DataFrame) -> None:
        version = f"v-{uuid.uuid4().hex}"
        self._write(df, f"{self.path}/{version}", "errorifexists")
        self._point(version)

    def append(self, df: DataFrame) -> None:
        version = self._version()
        if version:
            self._write(df, f"{self.path}/{version}", "append")
        else:
            self.replace(df)

    def upsert(self, df: DataFrame, key: str, newest: Column) -> None:
        """Last write wins by ``newest``; rows in ``df`` replace those of their key."""
        w = W.partitionBy(key).orderBy(newest.desc())
        fresh = df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
        self.replace(self.read().join(fresh.select(key), key, "left_anti").select(self.schema.names).unionByName(fresh.select(self.schema.names)))

    def delete(self, condition: Column) -> None:
        self.replace(self.read().where(~F.coalesce(condition, F.lit(False))))

    def delete_ids(self, ids: DataFrame, key: str) -> None:
        self.replace(self.read().join(ids.select(key), key, "left_anti"))

    def clear(self) -> None:
        self.replace(self.spark.createDataFrame([], self.schema))

    def drop(self) -> bool:
        fs, path = self._fs()
        return fs.delete(path(self.path), True)

    def count(self) -> int:
        return self.read().count()


def latest(messages: DataFrame, n: int = 100) -> DataFrame:
    return messages.orderBy(F.desc("timestamp"), "id").limit(n)


def get_or_create_source(table: Table, kind: str, name: str, now: Column) -> DataFrame:
    """The source of a kind and name, with the next free id if there was none."""
    found = table.read().where((F.col("type") == kind) & (F.col("name") == name))
    if found.isEmpty():
        free = table.read().agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"))
        table.append(free.select("id", F.lit(kind).alias("type"), F.lit(name).alias("name"), F.lit("{}").alias("config"), now.alias("created_at"), now.alias("updated_at")))
    return table.read().where((F.col("type") == kind) & (F.col("name") == name))


# Fixed value: what an empty text may hold, blanks of any width and the ends of lines.
SPACE = " \t\n\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"

Embedder = Callable[[pd.Series], pd.Series]


def hashing_embedder(dim: int = 64) -> Embedder:
    """A deterministic stand-in for a language model: signed word hashes, of unit length; empty text is zero.

    Where its words cancel out, or it has control characters only, the whole text is hashed as one word.
    """
    import zlib

    import numpy as np

    def embed(text: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[float]:
            v = np.zeros(dim, np.float32)
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % dim] += 1.0 if h >> 16 & 1 else -1.0
            if not v.any() and (whole := (t or "").lower().strip(SPACE)):
                h = zlib.crc32(whole.encode())
                v[h % dim] = 1.0 if h >> 16 & 1 else -1.0
            n = float(np.linalg.norm(v))
            return (v / n if n else v).tolist()

        return text.map(one)

    return embed


def embed(df: DataFrame, text: str, embedder: Embedder, into: str = "embedding") -> DataFrame:
    return df.withColumn(into, F.pandas_udf(embedder, "array<float>")(F.col(text)))


def populate_vectors(messages: DataFrame, table: Table, embedder: Embedder) -> int:
    """Embed all messages and append them; returns how many there are."""
    rows = embed(messages.select(F.col("id").alias("message_id"), F.col("content").alias("document"), "metadata"), "document", embedder)
    table.append(rows)
    return table.count()


def populate_text_index(messages: DataFrame, path: str) -> TextIndex:
    """Write postings by term and collection statistics."""
    return TextIndex.build(messages, path, "id", "content")


def vectors_of(ids: DataFrame, vectors: DataFrame, key: str = "message_id") -> DataFrame:
    """The ids with their embedding; null where there is none."""
    return ids.join(vectors.select(key, "embedding"), key, "left")


def vector_id(message_id: Column) -> Column:
    return F.concat(F.lit("msg_"), message_id.cast("string"))

"""Staged tables: cut lineage through Parquet in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a new temporary one only where none is set in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="meshwork-"))
        found = _local[0]
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/meshwork/{name}-{uuid.uuid4().hex}"


#: Shuffle partitions that a file of a narrow staged table holds.
PER_FILE = 8


def stage(df: DataFrame, name: str = "stage", narrow: bool = False) -> DataFrame:
    """Write ``df`` once and read it back: later plans restart from files that survive lost executors.

    ``narrow`` is for a few numbers a row and no costly step after the last shuffle: it makes fewer, larger files.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if narrow:
        df = df.coalesce(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // PER_FILE))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._meshwork_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the files behind a staged table that no later plan reads."""
    path = getattr(df, "_meshwork_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


#: Inputs up to this size may be a single row group, which one task would read.
SMALL_INPUT = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small input to all cores before costly work on them; larger inputs have splits enough."""
    spark = df.sparkSession
    jvm, conf, total = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    for file in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(file)
        total += path.getFileSystem(conf).getFileStatus(path).getLen()
        if total > SMALL_INPUT:
            return df
    return df.repartition(spark.sparkContext.defaultParallelism)

"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows handed to one vectorised step; texts of any length pass whole.
SLICE_ROWS = 512


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bytes of a batch between the JVM and Python, where the session sets none: rows may hold long texts.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Limit the bytes of Arrow batches; the built-in default limits rows only."""
    found = spark.conf.get(_BATCH, None)
    if found is None or not found.isdigit() or int(found) >= 2**31 - 1:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a step holds few rows and, single long texts aside, few megabytes."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            while n > 1 and batch.slice(at, n).nbytes > size:
                n //= 2
            yield batch.slice(at, n)
            at += n


def map_arrow(df: DataFrame, schema: str, step: Callable[[pa.RecordBatch], dict], rows: int = SLICE_ROWS) -> DataFrame:
    """Apply ``step`` to slices of ``df`` of at most ``rows`` rows; it returns columns of equal length for ``schema``."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, rows):
            out = step(part)
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (out[n] for n in names)], names)

    return df.mapInArrow(run, schema)


def annotate(df: DataFrame, schema: str, step: Callable[[pa.RecordBatch], dict], into: str, **columns: str) -> DataFrame:
    """All rows and columns of ``df`` with the columns of ``step`` as one struct ``into``; no shuffle, no join."""
    bound_batches(df.sparkSession)
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    read = [df.columns.index(c) for c in columns.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            made = step(pa.RecordBatch.from_arrays([part.column(i) for i in read], list(columns)))
            made = [x if isinstance(x, pa.Array) else pa.array(x) for x in (made[n] for n in names)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.StructArray.from_arrays(made, names)], [*part.schema.names, into])

    out = T.StructType([*df.schema.fields, T.StructField(into, T._parse_datatype_string(schema))])
    return df.mapInArrow(run, out)


def finish(df: DataFrame, schema: str, step: Callable[[pa.RecordBatch], dict], into: str | None, doc_id: str, text: str) -> DataFrame:
    """The operator's own rows, or with ``into`` the rows of ``df`` with them as a struct."""
    kind = df.schema[doc_id].dataType.simpleString()
    if into:
        return annotate(df, f"doc_id {kind}, {schema}", step, into, doc_id=doc_id, text=text)
    return map_arrow(pick(df, doc_id=doc_id, text=text), f"doc_id {kind}, {schema}", step)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of every value; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: others, and clashing names, stay out."""
    bound_batches(df.sparkSession)
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])

"""A table of bits that tells which ids may be wanted, so that only their rows are shuffled.

The table has a fixed size, whatever the number of ids: it lets all wanted ids through, and of the others the more
the fuller it is. It travels as one broadcast row and is looked up in the JVM, before an exact join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 64-bit blocks of the table: 8 MB.
BLOCKS = 1 << 20
_SHIFT = 64 - 20


def bits_of(ids: DataFrame, column: str) -> DataFrame:
    """One row ``_bits`` with the table of all values of a column."""
    h = F.xxhash64(column)
    rows = ids.select(F.shiftrightunsigned(h, _SHIFT).alias("block"), F.expr(f"shiftleft(1L, cast(xxhash64(`{column}`) & 63 as int))").alias("bit"))
    found = rows.groupBy("block").agg(F.bit_or("bit").alias("bit")).toArrow()  # a row for each block at most
    table = np.zeros(BLOCKS, np.int64)
    table[found.column(0).to_numpy()] = found.column(1).to_numpy()
    held = pa.ListArray.from_arrays(pa.array([0, BLOCKS], pa.int32()), pa.array(table))
    return ids.sparkSession.createDataFrame(pa.table({"_bits": held}))


def _held(column: str) -> Column:
    return F.expr(f"shiftright(get(_bits, cast(shiftrightunsigned(xxhash64(`{column}`), {_SHIFT}) as int)), cast(xxhash64(`{column}`) & 63 as int)) & 1 = 1")


def parted(df: DataFrame, column: str, bits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose id may be in the table, and rows whose id is not (null ids are looked up as well)."""
    both = F.broadcast(bits)
    return df.join(both, _held(column)).select(df.columns), df.join(both, ~_held(column)).select(df.columns)

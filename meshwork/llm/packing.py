"""Variable-capacity best-fit packing of documents into training sequences.

Documents of equal length are interchangeable, so packing works on the histogram of lengths: at most as many
rows as the longest permitted sequence, whatever the number of documents. Lengths are placed by falling size,
each into the open bins with the least room that fits. Where none fits, new bins are opened at the permitted
length whose cost per token, filled greedily from what remains of the histogram, is least (ties: the shorter);
``cost(length) = overhead + length``. At the end every bin is downsized to the shortest permitted length that
holds its contents. Bins of one content are one pattern with a count, so the plan stays small.

Documents are then numbered within their length (counts by length and hash bucket, running sums over buckets,
ranks within a bucket: no window holds a hot length) and looked up in the plan. Longer documents are cut into
full sequences and a rest; nothing is dropped.

Length 0 (null or empty text) is one row without a bin. Equal lengths are ordered by bucket and
id, so repeated rows get places of their own; other columns are ignored; an empty table gives an empty
table.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from meshwork.llm.common import pick, slices
from meshwork.plans.staging import stage

CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD = 32
BUCKETS = 512


@dataclass
class Bins:
    """``count`` equal bins: the room left and the chain of (size, how many) placed so far."""

    count: int
    room: int
    capacity: int
    placed: tuple = field(default=())


def _fill(capacity: int, size: int, left: dict[int, int], sizes: list[int]) -> int:
    """Tokens in one new bin filled greedily with falling sizes, ``size`` first."""
    room, i = capacity, bisect.bisect_left(sizes, size)
    while i >= 0 and room > 0:
        s = sizes[i]
        if s > room:
            i = bisect.bisect_right(sizes, room, 0, i) - 1
            continue
        room -= s * min(left[s], room // s)
        i -= 1
    return capacity - room


def pack_histogram(counts: dict[int, int], capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD) -> list[Bins]:
    """Bins for so many items of each size; all sizes are from 1 to the largest capacity."""
    caps = sorted(capacities)
    open_: list[tuple[int, int]] = []  # (room, key), sorted
    made: dict[int, Bins] = {}
    left = {s: n for s, n in counts.items() if n > 0}
    sizes = sorted(left)

    def put(bins: Bins) -> None:
        made[key := len(made)] = bins
        bisect.insort(open_, (bins.room, key))

    def place(bins: Bins, s: int, n: int) -> int:
        """Put up to ``n`` items of size ``s`` into these bins; returns how many are left."""
        each = bins.room // s
        full = min(n // each, bins.count)
        part = n - full * each if full < bins.count else 0
        for m, k in ((full, each), (int(part > 0), part), (bins.count - full - (part > 0), 0)):
            if m:
                put(Bins(m, bins.room - k * s, bins.capacity, (bins.placed, s, k) if k else bins.placed))
        return n - full * each - part

    while sizes:
        s, n = sizes[-1], left[sizes[-1]]
        while n:
            at = bisect.bisect_left(open_, (s, -1))
            if at < len(open_):
                _, key = open_.pop(at)
                n = place(made[key], s, n)
                made[key].count = 0
                continue
            left[s] = n
            cap = min((c for c in caps if c >= s), key=lambda c: ((overhead + c) / _fill(c, s, left, sizes), c))
            put(Bins(-(-n // (cap // s)), cap, cap))
        left[s] = 0
        sizes.pop()
    out = [b for b in made.values() if b.count]
    for b in out:
        used = b.capacity - b.room
        b.capacity = next(c for c in caps if c >= used)
        b.room = b.capacity - used
    return out


def contents(bins: Bins) -> list[tuple[int, int]]:
    """(size, how many) of one bin, in order of placing."""
    out, chain = [], bins.placed
    while chain:
        chain, s, k = chain
        out.append((s, k))
    return out[::-1]


class Plan:
    """For each size, runs of ranks: which bins they go to and where in them."""

    def __init__(self, bins: list[Bins]) -> None:
        rows, first, used = [], 0, {}
        for b in sorted(bins, key=lambda b: (-b.capacity, b.room, contents(b))):
            offset = 0
            for slot, (s, k) in enumerate(contents(b)):
                rows.append((s, used.get(s, 0), k, first, offset, b.capacity, slot))
                used[s] = used.get(s, 0) + k * b.count
                offset += s * k
            first += b.count
        self.bins = first
        table = np.array(sorted(rows), np.int64).reshape(-1, 7)
        self.size, self.rank, self.each, self.first, self.offset, self.capacity = (np.ascontiguousarray(table[:, i]) for i in range(6))

    def locate(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bin, offset in it and its capacity, of items by size and rank within the size."""
        lo = np.searchsorted(self.size, size)
        hi = np.searchsorted(self.size, size, side="right")
        while (hi - lo > 1).any():  # the last run that begins at or before the rank
            mid = (lo + hi) // 2
            below = self.rank[np.minimum(mid, len(self.rank) - 1)] <= rank
            wide = hi - lo > 1
            lo, hi = np.where(wide & below, mid, lo), np.where(wide & ~below, mid, hi)
        k = rank - self.rank[lo]
        return self.first[lo] + k // self.each[lo], self.offset[lo] + k % self.each[lo] * size, self.capacity[lo]


def word_length(text: str | Column) -> Column:
    """Words (runs of anything but white space) and one end mark; 0 for null, empty and blank texts."""
    n = F.regexp_count(text, F.lit("[^ \\t-\\r]+"))
    return F.when(n > 0, n + 1).otherwise(0).cast("bigint")


PLACED = "item_id bigint, part bigint, n_tokens bigint, bin_id bigint, bin_start bigint, bin_capacity bigint"


def pack(items: DataFrame, item_id: str, length: str, capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD) -> DataFrame:
    """One row per item and part: its length, bin, offset in the bin and the bin's final capacity."""
    most = max(capacities)
    rows = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.coalesce(F.col(length).cast("bigint"), F.lit(0)).alias("n"))
    cut = F.when(F.col("n") <= most, F.array(F.struct(F.lit(0).cast("bigint").alias("part"), F.col("n").alias("n_tokens")))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {most}")), lambda i: F.struct(i.alias("part"), F.least(F.lit(most), F.col("n") - i * most).cast("bigint").alias("n_tokens")))
    )
    parts = rows.select("item_id", F.explode(cut).alias("x")).select("item_id", "x.part", "x.n_tokens")
    parts = stage(parts.withColumn("bucket", F.pmod(F.xxhash64("item_id", "part"), F.lit(BUCKETS))), "parts")
    sized = parts.groupBy("n_tokens", "bucket").agg(F.count("*").alias("n")).groupBy("n_tokens").agg(F.sum("n").alias("n"))
    # As many rows as the longest sequence at most.
    plan = Plan(pack_histogram({r.n_tokens: r.n for r in sized.where("n_tokens > 0").collect()}, capacities, overhead))
    sent = items.sparkSession.sparkContext.broadcast(plan)
    within = W.partitionBy("n_tokens", "bucket").orderBy(F.col("item_id").asc_nulls_first(), "part")
    before = W.partitionBy("n_tokens").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    base = parts.groupBy("n_tokens", "bucket").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    base = base.select(F.col("n_tokens").alias("_t"), F.col("bucket").alias("_b"), "base")
    ranked = parts.withColumn("rn", F.row_number().over(within)).join(base, (F.col("n_tokens") == F.col("_t")) & (F.col("bucket") == F.col("_b")))
    ranked = ranked.select("item_id", "part", "n_tokens", (F.col("base") + F.col("rn") - 1).cast("bigint").alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = sent.value
        for part in slices(batches, rows=1 << 16):
            size, rank = (part.column(i).to_numpy() for i in (2, 3))
            real = size > 0
            found = [np.zeros(len(size), np.int64) for _ in range(3)]
            if real.any():
                for out, got in zip(found, plan.locate(size[real], rank[real]), strict=True):
                    out[real] = got
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *(pa.array(x, pa.int64(), mask=~real) for x in found)], [x.split(" ")[0] for x in PLACED.split(", ")])

    return ranked.mapInArrow(run, PLACED)


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:  # noqa: ANN003
    """Pack documents by their word counts (one end mark each)."""
    rows = pick(docs, doc_id=doc_id, text=text).select("doc_id", word_length("text").alias("length"))
    return pack(rows, "doc_id", "length", **settings).withColumnRenamed("item_id", "doc_id")

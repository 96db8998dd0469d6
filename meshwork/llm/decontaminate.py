"""Benchmark decontamination: a prefix-filtered set join on item windows.

Every item contributes its windows of ``window`` consecutive words (a shorter item is one window). A window is
a set of shingles, all of which a containing document must hold, so the necessary prefix is one shingle: the
window's rarest, by document frequency over the whole corpus. Positions of documents that hold a prefix shingle
are joined with the windows filed under it; a hit fixes where the window would start (positional bound) and end
(length bound), and the window is then compared word by word. Words are compared by 64-bit hashes, a window by
all of its words.

Documents are read twice, for frequencies and for positions, and their texts never shuffled: what leaves a task
was let through by a table of ``BITS`` bits of the shingles that matter, the only thing that is broadcast. Its size
is fixed; windows, frequencies and hits are tables and met by joins, so a benchmark of any size takes no more
memory. Frequencies are exact counts over all documents.

Null or empty texts have no words, and items without words hit nothing; repeated documents give equal rows;
rows of one item id are one item, and what rows without an item id hit is hit but counted for no item; other columns
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import map_arrow, pick, slices, text_bytes
from meshwork.llm.words import ALNUM_WORDS, batch_words, combine
from meshwork.plans.staging import drop, stage

SHINGLE = 3
#: Bits of the table that lets shingles through, and how many low bits of a shingle's hash it leaves out.
BITS = 1 << 26
_LEFT_OUT = 64 - 26

KEY = ["doc_id", "h1", "h2"]


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows under id and digest of the text: rows that agree in both are repeated documents."""
    rows = pick(docs, doc_id=doc_id, text=text)
    return rows.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")


def _same(left: str, right: str) -> Column:
    return F.expr(f"{left}doc_id <=> {right}doc_id and {left}h1 = {right}h1 and {left}h2 = {right}h2")


def windows(items: DataFrame, window: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, win) of every window, once an item; a window is the hashes of its words, 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words, at = batch_words(text_bytes(part.column(1)), ALNUM_WORDS)
            for i, ident in enumerate(part.column(0).to_pylist()):
                own = words[at[i] : at[i + 1]]
                n = min(window, len(own))
                for j in range(0, len(own) - n + 1 if n else 0, 1 << 16):
                    rows = np.unique(np.lib.stride_tricks.sliding_window_view(own[j : j + (1 << 16) + n - 1], n), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array([ident] * len(rows), pa.string()), pa.array([r.tobytes() for r in rows], pa.binary())], ["item", "win"])

    rows = pick(items, item_id=item_id, text=text).withColumn("item_id", F.col("item_id").cast("string"))
    return rows.mapInArrow(run, "item string, win binary").distinct()


def _shingles(wins: DataFrame) -> DataFrame:
    """(win, at, shingle) of every shingle of every window."""

    def step(part: pa.RecordBatch) -> dict:
        own = [np.frombuffer(w, np.uint64) for w in part.column(0).to_pylist()]
        made = [combine(w, min(SHINGLE, len(w))) for w in own]
        sizes = np.array([len(m) for m in made], np.int64)
        return {
            "win": part.column(0).take(pa.array(np.repeat(np.arange(len(own)), sizes))),
            "at": pa.array(np.concatenate([np.arange(n) for n in sizes]) if len(own) else [], pa.int32()),
            "shingle": pa.array(np.concatenate(made).view(np.int64) if len(own) else [], pa.int64()),
        }

    return map_arrow(wins.select("win"), "win binary, at int, shingle bigint", step)


class Sieve:
    """Which shingles may matter: a bit for each value of a hash's leading bits, and the lengths of shingles."""

    def __init__(self, shingles: DataFrame, sizes: list[int]) -> None:
        bit = F.shiftrightunsigned("shingle", _LEFT_OUT)
        blocks = shingles.groupBy(F.shiftright(bit, 6).alias("block")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(shingle, {_LEFT_OUT}) & 63 as int))")).alias("bits"))
        found = blocks.toArrow()  # a row for each 64 bits at most
        table = np.zeros(BITS // 64, np.int64)
        table[found.column(0).to_numpy()] = found.column(1).to_numpy()
        self.table, self.sizes = table.view(np.uint8), sizes

    def pick(self, words: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document, position, shingle) of what passes, for each length of shingle."""
        for n in self.sizes:
            probe = combine(words, n)
            bit = probe >> np.uint64(_LEFT_OUT)
            where = np.flatnonzero(self.table[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
            doc = np.searchsorted(at, where, side="right") - 1
            inside = where + n <= at[doc + 1]
            yield doc[inside], where[inside], probe[where[inside]]


def _frequencies(docs: DataFrame, sieve) -> DataFrame:  # noqa: ANN001
    """(shingle, documents holding it) of all that pass the sieve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words, at = batch_words(text_bytes(part.column(0)), ALNUM_WORDS)
            for doc, _, shingle in sieve.value.pick(words, at):
                own = np.unique(np.stack([doc.astype(np.uint64), shingle]), axis=1)[1] if len(doc) else shingle
                value, n = np.unique(own, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n, pa.int64())], ["_s", "n"])

    return docs.select("text").mapInArrow(run, "_s bigint, n bigint").groupBy("_s").agg(F.sum("n").alias("n"))


def _probe(docs: DataFrame, sieve, window: int) -> DataFrame:  # noqa: ANN001
    """A row for each document with its number of words, and one for each position that passes the sieve.

    Such a position comes with the words around it that a window over it may hold, and its own place in them.
    """
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*KEY, "n_words", "p", "shingle", "around", "place"]
        for part in slices(batches):
            words, at = batch_words(text_bytes(part.column(3)), ALNUM_WORDS)
            none = [pa.nulls(part.num_rows, t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.int32())]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(np.diff(at)), *none], names)
            for doc, where, shingle in sieve.value.pick(words, at):
                low, high = np.maximum(at[doc], where - window), np.minimum(at[doc + 1], where + window)
                around = [words[a:b].tobytes() for a, b in zip(low.tolist(), high.tolist(), strict=True)]
                own = [c.take(pa.array(doc)) for c in part.columns[:3]]
                yield pa.RecordBatch.from_arrays([*own, pa.nulls(len(doc), pa.int64()), pa.array(where - at[doc]), pa.array(shingle.view(np.int64)), pa.array(around, pa.binary()), pa.array(where - low, pa.int32())], names)

    return docs.mapInArrow(run, f"doc_id {kind.simpleString()}, h1 bigint, h2 bigint, n_words bigint, p bigint, shingle bigint, around binary, place int")


def _prefixes(shingles: DataFrame, counts: DataFrame) -> DataFrame:
    """(shingle, at, win) of each window's rarest shingle, the first of equally rare ones."""
    place = F.coalesce("n", F.lit(0)) * (1 << 20) + F.col("at")
    rare = shingles.join(counts, F.col("shingle") == F.col("_s"), "left").groupBy("win").agg((F.min(place) % (1 << 20)).alias("at"))

    def step(part: pa.RecordBatch) -> dict:
        own = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
        made = [_shingle(np.frombuffer(w, np.uint64), at) for w, at in own]
        return {"_s": pa.array(np.array(made, np.uint64).view(np.int64)), "at": part.column(1), "win": part.column(0)}

    return map_arrow(rare, "_s bigint, at bigint, win binary", step)


def _shingle(words: np.ndarray, at: int) -> int:
    n = min(SHINGLE, len(words))
    return int(combine(words[at : at + n], n)[0])


def _search(docs: DataFrame, owned: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Staged: the probed documents, and (document, start, end, win) of every occurrence of a window."""
    sc = docs.sparkSession.sparkContext
    shingles = stage(_shingles(owned.select("win").distinct()), "shingles", narrow=True)
    sizes = sorted(r.n for r in owned.select(F.least(F.lit(SHINGLE), F.length("win") / 8).cast("int").alias("n")).distinct().collect())
    counts = _frequencies(docs, sc.broadcast(Sieve(shingles.select("shingle"), sizes)))
    prefixes = stage(_prefixes(shingles, counts), "prefixes", narrow=True)
    probed = stage(_probe(docs, sc.broadcast(Sieve(prefixes.select(F.col("_s").alias("shingle")), sizes)), window), "probed")
    held = (F.col("place") >= F.col("at")) & (F.expr("substring(around, cast((place - at) * 8 + 1 as int), length(win))") == F.col("win"))
    met = probed.where("p is not null").join(prefixes, F.col("shingle") == F.col("_s")).where(held)
    start = F.col("p") - F.col("at")
    hits = stage(met.select(*KEY, start.alias("start"), (start + F.length("win") / 8).cast("bigint").alias("end"), "win"), "hits")
    drop(shingles)
    drop(prefixes)
    return probed, hits


def _summed(hits: DataFrame) -> DataFrame:
    """n_hit, n_items and items_sha256 of each document; hits are rows (document, start, end, item), an item each."""
    grouped = hits.repartition(*KEY).sortWithinPartitions(*KEY, "start")
    kind = hits.schema["doc_id"].dataType
    names = [*(f"_{c}" for c in KEY), "n_hit", "n_items", "items_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hit, free, items, out = None, 0, 0, set(), []

        def batch() -> pa.RecordBatch:
            kinds = [arrow, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        def close() -> None:
            if key is not None:
                out.append((*key, hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()))

        arrow = pa.int64()
        for part in slices(batches, rows=1 << 14):
            arrow = part.column(0).type
            for *own, start, end, item in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if own != key:
                    close()
                    key, hit, free, items = own, 0, 0, set()
                hit += max(0, end - max(start, free))
                free = max(free, end)
                if item is not None:
                    items.add(item)
            if len(out) > 1000:
                yield batch()
                out.clear()
        close()
        if out:
            yield batch()

    return grouped.mapInArrow(run, f"_doc_id {kind.simpleString()}, _h1 bigint, _h2 bigint, n_hit bigint, n_items bigint, items_sha256 string")


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """Per row: doc_id, n_words, n_hit (words inside any occurrence of an item's window), n_items, items_sha256, contaminated."""
    owned = stage(windows(items, window, item_id, item_text), "windows", narrow=True)
    probed, hits = _search(_keyed(docs, doc_id, text), owned, window)
    met = hits.join(owned.withColumnRenamed("win", "_w"), F.col("win") == F.col("_w")).select(*KEY, "start", "end", "item")
    found = stage(_summed(met), "found")
    out = probed.where("p is null").join(found, _same("", "_"), "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    drop(hits)
    drop(owned)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("doc_id", "n_words", count("n_hit"), count("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no window of an item."""
    owned = stage(windows(items, window, item_id, item_text), "windows", narrow=True)
    probed, hits = _search(_keyed(docs, doc_id, text), owned, window)
    found = stage(hits.select(*[F.col(c).alias(f"_{c}") for c in KEY]).distinct(), "found", narrow=True)
    for done in (owned, probed, hits):
        drop(done)
    ident, held = docs[f"`{doc_id}`"], docs[f"`{text}`"]
    return docs.join(found, ident.eqNullSafe(found["_doc_id"]) & (F.xxhash64(held) == found["_h1"]) & (F.xxhash64(F.lit(1), held) == found["_h2"]), "left_anti")

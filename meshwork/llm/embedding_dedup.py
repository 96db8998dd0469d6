"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors have cosine >= t exactly if their squared distance is at most ``2 - 2t``. A rotation (principal
axes of a bounded sample, dealt to ``BLOCKS`` subspaces) splits each vector; the budget ``2 - 2t`` is split over
the subspaces in proportion to their variance, so a linked pair is within budget in at least one of them. In
each subspace vectors are filed under their nearest pivot and also sent to every pivot's cell that the
perpendicular-bisector bound cannot rule out, and a cell range-joins its own vectors with all it was sent. Each
candidate is verified in double precision. A pair counts in the first subspace where it is within budget, so
links are counted without emitting pairs, and a task returns a count for each of its vectors and a spanning
forest of its links.

Exact copies of a vector are one representative with a weight before anything is compared, so a group of copies
costs one vector. Vectors of different length have no cosine; each length is joined by itself, with an index of
its own where it has more than ``CELL`` different vectors, and as one cell otherwise.

Rotation and pivots come from a sample (about ``SAMPLE`` vectors of each large length, by hash); they steer only
the work, never the result. Cells with many vectors are dealt over several tasks: a cell of h parts of its own
vectors and s parts of the others becomes h * s units of bounded size, from exact counts.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Rows of one id count
as separate vectors of one component. Rows without an id take part; a component is named by its smallest id, and
has none if no row of it has one. Other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import bound_batches, slices
from meshwork.plans.components import components
from meshwork.plans.staging import drop, stage

BLOCKS, SAMPLE, CELL, UNIT = 4, 4096, 8192, 16384
#: Most pivots of a subspace, and the length up to which a unit may hold CELL and UNIT vectors; longer ones get fewer.
PIVOTS, LENGTH = 1024, 128
SLACK = 1e-6  # on budgets while searching; what is found is decided exactly


@dataclass
class Index:
    rotation: np.ndarray
    cuts: list[tuple[int, int]]
    budget: np.ndarray
    pivots: list[np.ndarray]


def whole(dim: int, total: float) -> Index:
    """The index of few vectors: one subspace, one cell."""
    return Index(np.eye(dim), [(0, dim)], np.array([total]), [np.zeros((1, dim))])


def fit(sample: np.ndarray, total: float, cells: int) -> Index:
    """Axes by falling variance, dealt in turn to the subspaces; pivots are spread over the sample."""
    dim = sample.shape[1]
    blocks = min(BLOCKS, dim)
    value, axes = np.linalg.eigh(np.cov(sample.T) if len(sample) > 1 and dim > 1 else np.eye(dim))
    order = np.argsort(-value, kind="stable")
    dealt = [order[k::blocks] for k in range(blocks)]
    rotation = axes[:, np.concatenate(dealt)]
    ends = np.cumsum([len(d) for d in dealt])
    cuts = [(int(e - len(d)), int(e)) for d, e in zip(dealt, ends, strict=True)]
    share = np.array([max(value[d].sum(), 1e-12) for d in dealt])
    turned = sample @ rotation
    pivots = []
    for a, b in cuts:
        own = turned[:, a:b]
        far, centres = np.full(len(own), np.inf), [own[0]]
        for _ in range(cells - 1):  # the farthest vector from the pivots so far
            far = np.minimum(far, ((own - centres[-1]) ** 2).sum(axis=1))
            if far.max() <= 0:
                break
            centres.append(own[int(far.argmax())])
        for _ in range(3):  # and towards the means of what is nearest
            centre = np.stack(centres)
            near = _nearest(own, centre)
            centres = [own[near == k].mean(axis=0) if (near == k).any() else centre[k] for k in range(len(centre))]
        pivots.append(np.stack(centres))
    return Index(rotation, cuts, total * share / share.sum(), pivots)


def _nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return ((centre**2).sum(axis=1)[None] - 2 * x @ centre.T).argmin(axis=1)


def assign(index: Index, unit: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each subspace: (k, whether a cell is sent a row, the row's own cell)."""
    turned = unit @ index.rotation
    for k, (a, b) in enumerate(index.cuts):
        x, centre = turned[:, a:b], index.pivots[k]
        square = (centre**2).sum(axis=1)
        far = (x**2).sum(axis=1)[:, None] + square[None] - 2 * x @ centre.T
        own = far.argmin(axis=1)
        between = np.sqrt(np.maximum(square[:, None] + square[None] - 2 * centre @ centre.T, 0))[own]
        reach = np.sqrt(index.budget[k] * (1 + SLACK)) + 1e-9
        near = far - far[np.arange(len(x)), own][:, None] <= 2 * between * reach + 1e-9
        near[np.arange(len(x)), own] = True
        yield k, near, own


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of unit length, in double precision, without overflow of their squares."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _candidates(own: np.ndarray, others: np.ndarray, first: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within ``reach`` squared distance in one subspace, a tile at a time.

    Row i of ``own`` meets the rows of ``others`` from ``first[i]`` on, which doesn't fall. One product of
    extended vectors, (-2a, |a|^2, 1) with (b, 1, |b|^2), is a tile of squared distances.
    """
    a, b = own.astype(np.float32), others.astype(np.float32)
    left = np.hstack([-2 * a, (a * a).sum(axis=1, keepdims=True), np.ones((len(a), 1), np.float32)])
    right = np.ascontiguousarray(np.hstack([b, np.ones((len(b), 1), np.float32), (b * b).sum(axis=1, keepdims=True)]).T)
    edge = np.float32(reach + 1e-5)
    for i in range(0, len(a), 512):
        for j in range(int(first[i]) if i < len(first) else 0, len(b), 2048):
            hit = np.flatnonzero((left[i : i + 512] @ right[:, j : j + 2048]).ravel() <= edge)
            width = min(2048, len(b) - j)
            for s in range(0, len(hit), 1 << 16):
                p, q = np.divmod(hit[s : s + (1 << 16)], width)
                yield p + i, q + j


class Task:
    """Range join of one unit: ``own`` vectors of a cell with all vectors the unit was sent."""

    def __init__(self, fitted: dict[int, Index], threshold: float) -> None:
        self.fitted, self.threshold = fitted, threshold

    def index(self, dim: int) -> Index:
        return self.fitted.get(dim) or whole(dim, 2 - 2 * self.threshold)

    def join(self, k: int, rows: np.ndarray, weight: np.ndarray, vectors: np.ndarray, own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Links counted here for each vector; spanning edges (row, smallest row).

        A pair is taken where the vector of the smaller row is at home, and counts for both, with the other's weight.
        """
        index = self.index(vectors.shape[1])
        turned = vectors @ index.rotation
        a, b = index.cuts[k]
        order = np.argsort(rows, kind="stable")
        first, second, counts = order[own[order]], order[other[order]], np.zeros(len(rows), np.int64)
        later = np.searchsorted(rows[second], rows[first], side="right")
        root = np.arange(len(rows))
        rank = np.argsort(order, kind="stable")
        for p, q in _candidates(turned[first, a:b], turned[second, a:b], later, float(index.budget[k]) * (1 + SLACK)):
            p, q = first[p], second[q]
            keep = rows[p] < rows[q]
            p, q = p[keep], q[keep]
            cos = (vectors[p] * vectors[q]).sum(axis=1)
            p, q = p[cos >= self.threshold], q[cos >= self.threshold]
            if not len(p):
                continue
            gap = (turned[p] - turned[q]) ** 2
            parts = np.stack([gap[:, s:e].sum(axis=1) / index.budget[m] for m, (s, e) in enumerate(index.cuts)], axis=1)
            # Rounding may leave a pair at the very edge of all budgets: it then belongs to the relatively closest.
            owner = np.where((parts <= 1).any(axis=1), (parts <= 1).argmax(axis=1), parts.argmin(axis=1))
            np.add.at(counts, p[owner == k], weight[q[owner == k]])
            np.add.at(counts, q[owner == k], weight[p[owner == k]])
            _unite(root, p, q, rank)
        top = _flatten(root)
        edges = [(int(rows[x]), int(rows[top[x]])) for x in np.flatnonzero(top != np.arange(len(top)))]
        return counts, edges


def _flatten(root: np.ndarray) -> np.ndarray:
    while (nxt := root[root]).tobytes() != root.tobytes():
        root = nxt
    return root


def _unite(root: np.ndarray, p: np.ndarray, q: np.ndarray, rank: np.ndarray) -> None:
    """Join the trees of all pairs in place; the root of a tree is its member of the smallest rank."""
    while True:
        root[:] = _flatten(root)
        a, b = root[p], root[q]
        apart = a != b
        if not apart.any():
            return
        p, q, a, b = p[apart], q[apart], a[apart], b[apart]
        low = np.where(rank[a] < rank[b], a, b)
        high = np.where(rank[a] < rank[b], b, a)
        order = np.argsort(-rank[low], kind="stable")
        root[high[order]] = low[order]  # the last written, of the smallest rank, stays


def _indexes(reps: DataFrame, threshold: float) -> dict[int, Index]:
    """An index for each length of more than ``CELL`` vectors: that is at most one row a ``CELL`` to the driver."""
    large = reps.groupBy("d").count().where(F.col("count") > CELL).collect()
    if not large:
        return {}
    sizes = reps.sparkSession.createDataFrame([(r.d, r["count"]) for r in large], "_d int, _n bigint")
    most = max(256, SAMPLE // len(large))
    drawn = reps.join(F.broadcast(sizes), F.col("d") == F.col("_d")).where(F.pmod(F.xxhash64("v", F.lit(3)), F.ceil(F.col("_n") / most)) == 0)
    held: dict[int, list[np.ndarray]] = {}
    for batch in drawn.select("d", "v").toArrow().to_batches():
        for d, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.setdefault(d, []).append(np.array(v, np.float64))
    cells = {r.d: int(min(PIVOTS, max(2, -(-r["count"] // CELL)))) for r in large}
    return {d: fit(unit_rows(np.stack(x)), 2 - 2 * threshold, cells[d]) for d, x in held.items()}


def near_vectors(vectors: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Per row: vec_id, n_links, component_id (smallest id reachable by links), kept."""
    spark = vectors.sparkSession
    bound_batches(spark)
    element = "float" if vectors.schema[embedding].dataType.elementType.simpleString() == "float" else "double"
    kind = "<f4" if element == "float" else "<f8"  # what vectors travel as
    source = vectors.select(F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), F.col(f"`{embedding}`").cast(f"array<{element}>").alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.forall("v", finite) & F.exists("v", lambda x: x != 0)
    # Rows get names of their own, once: ids may repeat.
    keyed = stage(source.select("vec_id", F.when(usable, F.col("v")).alias("v")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    reps = stage(keyed.where("v is not null").groupBy("v").agg(F.min("row").alias("row"), F.count("*").alias("m"), F.min("vec_id").alias("least")).withColumn("d", F.size("v")), "copies")
    sent = spark.sparkContext.broadcast(Task(_indexes(reps, threshold), threshold))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for part in slices(batches, rows=1024):
            for d, (_, unit) in _lists(part.column(0)).items():
                for k, near, own in assign(sent.value.index(d), unit):
                    got = np.stack([np.bincount(own, minlength=near.shape[1]), near.sum(axis=0)])
                    total[d, k] = total[d, k] + got if (d, k) in total else got
        for (d, k), (mine, n) in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), x), pa.int32()) for x in (d, k)] + [pa.array(some, pa.int32()), pa.array(mine[some], pa.int64()), pa.array(n[some], pa.int64())], ["_d", "_k", "_c", "mine", "n"])

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, rows=1024):
            row, weight = part.column(1).to_numpy(), part.column(2).to_numpy()
            for d, (at, unit) in _lists(part.column(0)).items():
                packed = np.array([np.array(x, kind).tobytes() for x in part.column(0).take(pa.array(at)).to_pylist()], object)
                for k, near, own in assign(sent.value.index(d), unit):
                    rows, cells = np.nonzero(near)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), x), pa.int32()) for x in (d, k)] + [pa.array(cells, pa.int32()), pa.array(own[rows] == cells), pa.array(row[at][rows]), pa.array(weight[at][rows]), pa.array(packed[rows], pa.binary())], ["d", "k", "cell", "own", "row", "m", "v"])

    counts = reps.select("v").mapInArrow(tally, "_d int, _k int, _c int, mine bigint, n bigint").groupBy("_d", "_k", "_c").agg(F.sum("mine").alias("mine"), F.sum("n").alias("n"))
    share = F.lit(LENGTH) / F.greatest(F.lit(LENGTH), F.col("_d"))
    # A row for each cell of each length.
    parts = stage(counts.select("_d", "_k", "_c", F.greatest(F.lit(1), F.ceil(F.col("mine") / (CELL * share))).cast("int").alias("h"), F.ceil(F.col("n") / (UNIT * share)).cast("int").alias("s")), "cells", narrow=True)
    filed = reps.select("v", "row", "m").mapInArrow(file, "d int, k int, cell int, own boolean, row bigint, m bigint, v binary")
    dealt = filed.join(parts, (F.col("d") == F.col("_d")) & (F.col("k") == F.col("_k")) & (F.col("cell") == F.col("_c")))
    salt = F.xxhash64("row")
    mine, rest = F.pmod(salt, F.col("h")).cast("int"), F.pmod(F.xxhash64("row", F.lit(1)), F.col("s")).cast("int")
    # Each vector is in part ``rest`` of the others for all parts of own vectors, and an own vector also in its
    # own part for all parts of the others: once where both meet.
    as_other = F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda i: F.struct(i.cast("int").alias("i"), rest.alias("j"), (F.col("own") & (i == mine)).alias("mine"), F.lit(True).alias("other")))
    as_own = F.when(F.col("own"), F.transform(F.filter(F.sequence(F.lit(0), F.col("s") - 1), lambda j: j != rest), lambda j: F.struct(mine.alias("i"), j.cast("int").alias("j"), F.lit(True).alias("mine"), F.lit(False).alias("other")))).otherwise(F.expr("cast(array() as array<struct<i:int,j:int,mine:boolean,other:boolean>>)"))
    units = dealt.withColumn("u", F.explode(F.concat(as_other, as_own))).select("d", "k", "cell", "u.i", "u.j", "u.mine", "u.other", "row", "m", "v")
    unit_key = ("d", "k", "cell", "i", "j")
    grouped = units.repartition(*unit_key).sortWithinPartitions(*unit_key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if unit is None:
                return
            mine, other, rows, weight, x = (np.concatenate([h[c] for h in held]) for c in range(5))
            counts, edges = sent.value.join(unit[1], rows, weight, x, mine, other)
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(rows[some]), pa.array(counts[some]), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int64())], ["row", "n", "a", "b"])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(edges), pa.int64()), pa.nulls(len(edges), pa.int64()), pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["row", "n", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(i).to_numpy() for i in range(5)], axis=1)
            ends = np.append(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, len(key))
            begin = 0
            for end in ends.tolist():
                own_key = tuple(key[begin].tolist())
                if unit != own_key:
                    yield from close()
                    unit, held = own_key, []
                part = batch.slice(begin, end - begin)
                x = unit_rows(np.frombuffer(b"".join(part.column(9).to_pylist()), kind).reshape(-1, own_key[0]))
                held.append((part.column(5).to_numpy(zero_copy_only=False), part.column(6).to_numpy(zero_copy_only=False), part.column(7).to_numpy(), part.column(8).to_numpy(), x))
                begin = end
        yield from close()

    found = stage(grouped.mapInArrow(run, "row bigint, n bigint, a bigint, b bigint"), "links")
    drop(parts)
    roots = components(found.where("a is not null"), "a", "b")
    links = found.where("row is not null").groupBy(F.col("row").alias("_row")).agg(F.sum("n").alias("links"))
    named = reps.join(links, F.col("row") == F.col("_row"), "left").join(roots, F.col("row") == F.col("node"), "left")
    names = stage(named.select(F.col("v").alias("_v"), "least", F.coalesce("component", "row").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("links")), "named")
    first = names.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("component"))
    named = names.join(first, F.col("root") == F.col("_root")).select("_v", "links", "component")
    out = keyed.join(named, F.col("v") == F.col("_v"), "left")
    component = F.when(F.col("_v").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    out = stage(out.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id")), "near_vectors", narrow=True)
    for done in (keyed, reps, found, roots, names):
        drop(done)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _lists(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows of each length, and their vectors scaled to length 1; all are usable."""
    size = pc.list_value_length(column).to_numpy()
    flat = np.asarray(column.flatten(), np.float64)
    at = np.concatenate(([0], np.cumsum(size)))
    out = {}
    for d in np.unique(size).tolist():
        rows = np.flatnonzero(size == d)
        out[d] = rows, unit_rows(flat[at[rows][:, None] + np.arange(d)[None]])
    return out

"""Similarity joins and clusters of vectors.

``similar_pairs`` compares blocks of rows: each unit holds two blocks of bounded size, multiplied as matrices in
double precision, so no pair below the threshold ever becomes a row. Clusters with one point as core are
connected components of the similarity graph; with more, core points are, and border points join the
smallest-named neighbouring cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.functions import vector
from meshwork.plans.components import components
from meshwork.plans.staging import stage

BLOCK_ROWS = 2048
#: Beyond so many blocks rows go to larger ones instead, up to ``GROWN`` times the rows: a row is sent to each block.
FEW, GROWN = 8, 8
#: Rows and columns of a tile of cosines.
TILE = 256, 2048
#: Bands of cosines that ``pairwise`` goes through one after the other.
BANDS = 10


def _packed(rows: DataFrame) -> DataFrame:
    """Rows (g, own, blocks, id, label, v) as pieces: what a batch has of a block, in one row of binary columns.

    Vectors are in single precision where that is exact, so a piece holds a quarter to a half of what its rows would.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            g, own, blocks, ids, labels = (c.to_numpy() for c in batch.columns[:5])
            order = np.lexsort((own, g))
            cuts = np.flatnonzero((np.diff(g[order]) != 0) | (np.diff(own[order]) != 0)) + 1
            for part in np.split(order, cuts):
                v = batch.column(5).take(pa.array(part))
                x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                if len(set(v.value_lengths().to_pylist())) > 1:
                    raise ValueError("vectors of different lengths")
                with np.errstate(over="ignore"):
                    single = x.astype(np.float32)
                exact = bool((single == x).all())
                one = [int(g[part[0]]), int(own[part[0]]), int(blocks[part[0]]), ids[part].astype(np.int64).tobytes(), labels[part].astype(np.int64).tobytes(), (single if exact else x).tobytes(), exact]
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(one, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.bool_()), strict=True)], ["g", "own", "blocks", "ids", "labels", "v", "single"])

    return rows.mapInArrow(run, "g bigint, own int, blocks int, ids binary, labels binary, v binary, single boolean")


def _blocked(units: DataFrame, schema: str, reduce: Callable, parts: int | None = None, bands: int = 0, least: float = -np.inf) -> DataFrame:
    """Run ``reduce`` on every unit of (g, i, j, own, ids, labels, v, single): block i against block j of group g.

    ``reduce(g, ids, labels, sims, same)`` gets a tile of cosines: ids and labels are pairs for its rows and
    columns, ``same`` tells that both come from one block, where only pairs with smaller row id count.

    With ``bands`` it goes over the unit again for each band of cosines from ``least`` up, and gets as ``inside`` which
    are in it. Cosines near each other have few different rounded values, which Parquet's bounded dictionaries hold.
    """
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def unit_rows(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        size = np.sqrt((x * x).sum(axis=1))
        return x / np.where(size == 0, 1, size)[:, None]

    def tiles(left: list, right: list) -> Iterator[tuple]:
        for t in range(0, len(right[0]), TILE[1]):
            ids, labels, y = (c[t : t + TILE[1]] for c in right)
            y = unit_rows(y).T
            for s in range(0, len(left[0]), TILE[0]):
                part = slice(s, s + TILE[0])
                yield part, ids, labels, unit_rows(left[2][part]) @ y

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            same = unit[1] == unit[2]
            first = [h[1:] for h in held if h[0] == unit[1]]
            second = first if same else [h[1:] for h in held if h[0] != unit[1]]
            if not first or not second:
                return
            left, right = ([np.concatenate(c) for c in zip(*side, strict=True)] for side in (first, second))
            if not bands:
                for part, ids, labels, sims in tiles(left, right):
                    columns = reduce(unit[0], (left[0][part], ids), (left[1][part], labels), sims, same)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)
                return
            left, right = ([c[np.argsort(side[0], kind="stable")] for c in side] for side in (left, right))
            _, _, _, sims = next(tiles(left, right))
            above = sims[sims > max(0, least)]
            edges = [least, *np.linspace(max(0, least), np.quantile(above, 0.98) if len(above) else 1, bands + 1), np.inf]
            counts: dict[int, int] = {}
            for low, high in zip(edges, edges[1:], strict=False):
                for k, (part, ids, labels, sims) in enumerate(tiles(left, right)):
                    inside = (sims >= low) & (sims < high)
                    counts[k] = counts.get(k, 0) + np.count_nonzero(inside)
                    if high == np.inf and counts[k] != np.count_nonzero(sims >= least):
                        raise RuntimeError("cosines differ between passes")
                    columns = reduce(unit[0], (left[0][part], ids), (left[1][part], labels), sims, same, inside)
                    if len(columns[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

        for batch in batches:
            for k in range(batch.num_rows):
                g, i, j, own, ids, labels, v, single = (c[k].as_py() for c in batch.columns)
                if unit != (g, i, j):
                    yield from close()
                    unit, held = (g, i, j), []
                ids = np.frombuffer(ids, np.int64)
                x = np.frombuffer(v, np.float32 if single else np.float64)
                held.append((own, ids, np.frombuffer(labels, np.int64), x.reshape(len(ids), len(x) // len(ids))))
        yield from close()

    dealt = units.repartition("g", "i", "j") if parts is None else units.repartition(parts, "g", "i", "j")
    return dealt.sortWithinPartitions("g", "i", "j").mapInArrow(run, schema)


def _deal(rows: DataFrame, blocks: Column) -> DataFrame:
    """Units of rows (g, id, label, v): each block's pieces go to every pair of blocks that has it."""
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    pieces = _packed(rows.select(F.col("g").cast("bigint").alias("g"), own.alias("own"), blocks.cast("int").alias("blocks"), "id", "label", "v"))
    units = pieces.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return units.select("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "ids", "labels", "v", "single")


def _blocks(rows: int) -> int:
    """Blocks that so many rows are dealt to: what is sent is their number times the rows."""
    n = -(-rows // BLOCK_ROWS)
    return max(1, min(n, FEW), -(-n // GROWN))


def _rows(df: DataFrame, key: str, embedding: str) -> DataFrame:
    return df.withColumn("_v", vector.as_double(embedding)).withColumn("_id", F.col(key).cast("bigint")).where("_v is not null and _id is not null")


def similar_pairs(df: DataFrame, threshold: float, key: str = "id", embedding: str = "embedding", rows: int | None = None, bands: int = 0) -> DataFrame:
    """(a, b, sim) with a < b for all pairs of cosine at least ``threshold``; null and zero vectors have none.

    ``rows`` is the number of rows, counted if not given; the number of blocks follows from it. ``bands`` is for
    results with most of the pairs: they come out by bands of cosine, which makes them smaller as Parquet files.
    """
    clean = _rows(df, key, embedding).select(F.lit(0).alias("g"), F.col("_id").alias("id"), F.lit(0).cast("bigint").alias("label"), F.col("_v").alias("v"))
    n = _blocks(rows if rows is not None else clean.count())

    def pairs(_: object, ids: tuple, labels: tuple, sims: np.ndarray, same: bool, inside: np.ndarray | None = None) -> list:
        p, q = np.divmod(np.flatnonzero(sims >= threshold if inside is None else inside), sims.shape[1])
        a, b = ids[0][p], ids[1][q]
        keep = a < b if same else a != b
        return [np.minimum(a, b)[keep], np.maximum(a, b)[keep], np.clip(sims[p, q][keep], -1.0, 1.0)]

    return _blocked(_deal(clean, F.lit(n)), "a bigint, b bigint, sim double", pairs, parts=min(n * (n + 1), 8192), bands=bands, least=threshold)


def similar_pairs_lsh(df: DataFrame, threshold: float, key: str = "id", embedding: str = "embedding", tables: int = 24, length: float = 1.0) -> DataFrame:
    """As ``similar_pairs``, from random projections: work follows the candidates and not the square of the rows.

    What it returns is exact; of the pairs over the threshold it finds most: more ``tables`` find more, at the
    cost of as many rows a vector; a larger ``length`` of buckets finds more, at the cost of more candidates.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    unit = _rows(df, key, embedding).select(F.col("_id").alias("id"), vector.unit(F.col("_v")).alias("v")).where(vector.norm(F.col("v")) > 0)
    rows = stage(unit.select("id", array_to_vector("v").alias("x"), "v"), "units")
    model = BucketedRandomProjectionLSH(inputCol="x", outputCol="h", bucketLength=length, numHashTables=tables, seed=7).fit(rows)
    reach = (2 - 2 * threshold) ** 0.5 + 1e-9
    found = model.approxSimilarityJoin(rows, rows, reach, "distance").where("datasetA.id < datasetB.id")
    sim = vector.dot(F.col("datasetA.v"), F.col("datasetB.v"))
    return found.select(F.col("datasetA.id").alias("a"), F.col("datasetB.id").alias("b"), sim.alias("sim")).where(F.col("sim") >= threshold)


def pairwise(df: DataFrame, key: str = "id", embedding: str = "embedding") -> DataFrame:
    """The similarity matrix as rows (a, b, sim) with a < b, clipped at 0."""
    return similar_pairs(df, -2.0, key, embedding, bands=BANDS).withColumn("sim", F.greatest(F.lit(0.0), F.col("sim")))


def cluster(df: DataFrame, threshold: float = 0.85, min_samples: int = 1, key: str = "id", embedding: str = "embedding", pairs: Callable[..., DataFrame] = similar_pairs) -> DataFrame:
    """(id, cluster_id): density clusters at cosine distance 1 - threshold; noise has no row.

    ``pairs`` finds the neighbours: all of them by blocks, or most of them by ``similar_pairs_lsh``.
    """
    nodes = df.where(F.col(embedding).isNotNull()).select(F.col(key).cast("bigint").alias("id"))
    pairs = stage(pairs(df, threshold, key, embedding), "pairs")
    if min_samples <= 1:
        found = components(pairs, "a", "b")
        return nodes.join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("cluster_id"))
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    core = stage(both.groupBy("a").count().where(F.col("count") + 1 >= min_samples).select(F.col("a").alias("core")), "core")
    linked = both.join(core, F.col("b") == F.col("core"), "left_semi")
    inner = linked.join(core, F.col("a") == F.col("core"), "left_semi").where("a < b")
    found = stage(core.join(components(inner, "a", "b"), F.col("core") == F.col("node"), "left").select("core", F.coalesce("component", "core").alias("cluster_id")), "clusters")
    border = linked.join(core, F.col("a") == F.col("core"), "left_anti").join(found, F.col("b") == F.col("core")).groupBy(F.col("a").alias("id")).agg(F.min("cluster_id").alias("cluster_id"))
    return found.select(F.col("core").alias("id"), "cluster_id").unionByName(border)


def _cohesion(members: DataFrame) -> DataFrame:
    """(cluster_id, avg_similarity): mean of the clipped cosines of all pairs; sums, not pairs, leave a task."""
    rows = _rows(members, "id", "embedding").select(F.col("cluster_id").alias("g"), F.col("_id").alias("id"), F.lit(0).cast("bigint").alias("label"), F.col("_v").alias("v"))
    sizes = rows.groupBy(F.col("g").alias("_g")).agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("_h")).where("_g is not null")
    many = rows.join(sizes, F.col("g") == F.col("_g"))

    def sums(g: int, ids: tuple, labels: tuple, sims: np.ndarray, same: bool) -> list:
        real = ids[0][:, None] < ids[1][None, :] if same else np.ones_like(sims, bool)
        return [np.array([g], np.int64), np.array([np.clip(sims, 0.0, 1.0)[real].sum()]), np.array([real.sum()], np.int64)]

    total = _blocked(_deal(many, F.col("_h")), "g bigint, s double, n bigint", sums).groupBy(F.col("g").alias("cluster_id"))
    return total.agg(F.coalesce(F.try_divide(F.sum("s"), F.sum("n")), F.lit(0.0)).alias("avg_similarity"))


def cluster_metadata(members: DataFrame) -> DataFrame:
    """One row per cluster of (cluster_id, id, timestamp, author, channel, content, embedding)."""
    span = (F.unix_micros("max_ts") - F.unix_micros("min_ts")) / 86_400e6
    rate = F.col("size") / F.greatest(F.col("timespan_days"), F.lit(0.01))
    base = members.groupBy("cluster_id").agg(F.count("*").alias("size"), F.min("timestamp").alias("min_ts"), F.max("timestamp").alias("max_ts"), F.count_distinct(F.nullif(F.col("author"), F.lit(""))).alias("participant_count"), F.sort_array(F.collect_set(F.nullif(F.col("channel"), F.lit("")))).alias("channels"), F.avg(F.length("content")).alias("avg_length"))
    return base.withColumn("timespan_days", span).withColumn("messages_per_day", rate).join(_cohesion(members), "cluster_id", "left").withColumn("avg_similarity", F.coalesce("avg_similarity", F.lit(0.0)))


def separation(members: DataFrame) -> DataFrame:
    """(a, b, distance): mean cosine distance of all pairs between two clusters.

    The result has a row for each pair of clusters; within a task pairs are summed by cluster first.
    """
    rows = _rows(members, "id", "embedding").select(F.lit(0).alias("g"), F.col("_id").alias("id"), F.col("cluster_id").cast("bigint").alias("label"), F.col("_v").alias("v"))
    n = max(1, -(-rows.count() // BLOCK_ROWS))

    def sums(_: object, ids: tuple, labels: tuple, sims: np.ndarray, same: bool) -> list:
        (ra, ca), (rb, cb) = (np.unique(x, return_inverse=True) for x in labels)
        left, right = np.eye(len(ra))[ca], np.eye(len(rb))[cb]
        total, count = left.T @ (1 - np.clip(sims, 0.0, 1.0)) @ right, np.outer(left.sum(axis=0), right.sum(axis=0))
        a, b = (x.ravel() for x in np.meshgrid(ra, rb, indexing="ij"))
        keep = a < b if same else a != b
        return [np.minimum(a, b)[keep], np.maximum(a, b)[keep], total.ravel()[keep], count.ravel()[keep]]

    found = _blocked(_deal(rows, F.lit(n)), "a bigint, b bigint, s double, n double", sums)
    return found.groupBy("a", "b").agg((F.sum("s") / F.sum("n")).alias("distance"))


def _unit_rows(column: pa.Array) -> np.ndarray:
    x = np.array(column.to_pylist(), np.float64).reshape(len(column), -1)
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size == 0, 1, size)


def _sums(points: DataFrame) -> DataFrame:
    """(cluster_id, n, v): number and sum of the unit vectors of each cluster of points (id, cluster_id, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                labels, code = np.unique(batch.column(1).to_numpy(), return_inverse=True)
                x = _unit_rows(batch.column(2))
                total = np.zeros((len(labels), x.shape[1]))
                np.add.at(total, code, x)
                dim = x.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(labels, dim)), pa.array(np.tile(np.arange(dim), len(labels))), pa.array(total.ravel())], ["cluster_id", "pos", "s"])

    parts = points.mapInArrow(run, "cluster_id bigint, pos bigint, s double").groupBy("cluster_id", "pos").agg(F.sum("s").alias("s"))
    vectors = parts.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda p: p["s"]).alias("v"))
    counts = points.groupBy(F.col("cluster_id").alias("_c")).agg(F.count("*").alias("n"))
    return vectors.join(counts, F.col("cluster_id") == F.col("_c")).select("cluster_id", "n", "v")


def silhouette(members: DataFrame, embedding: str = "embedding", chunk: int = 4096) -> DataFrame:
    """One row: mean silhouette over all points (id, cluster_id, embedding), by cosine distance.

    The mean distance of a point to a cluster follows from the sum of the cluster's unit vectors, so no pair of
    points is formed: points meet clusters, which are broadcast ``chunk`` at a time. 0 for fewer than two clusters
    or as many clusters as points; a cluster of one point counts 0.
    """
    points = stage(_rows(members, "id", embedding).select(F.col("_id").alias("id"), F.col("cluster_id").cast("bigint").alias("cluster_id"), F.col("_v").alias("v")), "points")

    def meet(sent: Broadcast) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            labels, n, total = sent.value
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    x, own = _unit_rows(part.column(2)), part.column(1).to_numpy()
                    sims = x @ total.T
                    mine = own[:, None] == labels[None]
                    rest = np.where(mine, n[None] - 1, n[None])
                    mean = np.clip((sims - mine * (x * x).sum(axis=1)[:, None]) / np.maximum(rest, 1), -1.0, 1.0)
                    inner = np.where(mine & (rest > 0), mean, -np.inf).max(axis=1, initial=-np.inf)
                    outer = np.where(mine, -np.inf, mean).max(axis=1, initial=-np.inf)
                    missing = lambda y: pa.array(np.where(np.isfinite(y), 1 - y, 0.0), mask=~np.isfinite(y))
                    yield pa.RecordBatch.from_arrays([part.column(0), missing(inner), missing(outer)], ["id", "x", "y"])

        return run

    per, held = None, []
    for row in [*_sums(points).toLocalIterator(), None]:
        if row is not None:
            held.append(row)
        if held and (row is None or len(held) == chunk):
            sent = points.sparkSession.sparkContext.broadcast((np.array([r[0] for r in held]), np.array([r[1] for r in held]), np.array([r[2] for r in held])))
            part = points.mapInArrow(meet(sent), "id bigint, x double, y double")
            per, held = part if per is None else per.unionByName(part), []
    counts = points.agg(F.count_distinct("cluster_id").alias("clusters"), F.count("*").alias("points"))
    if per is None:
        return counts.select(F.lit(0.0).alias("silhouette"), "clusters", "points")
    per = per.groupBy("id").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    one = F.when(F.col("x").isNull() | F.col("y").isNull(), 0.0).otherwise(F.coalesce((F.col("y") - F.col("x")) / F.nullif(F.greatest("x", "y"), F.lit(0.0)), F.lit(0.0)))
    usable = (F.col("clusters") > 1) & (F.col("clusters") < F.col("points"))
    return counts.crossJoin(per.agg(F.avg(one).alias("s"))).select(F.when(usable, F.coalesce("s", F.lit(0.0))).otherwise(0.0).alias("silhouette"), "clusters", "points")


def quality(members: DataFrame, total: Column) -> DataFrame:
    """One row: clusters, their mean size, and the share of all messages that is clustered."""
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("clusters"), F.avg("n").alias("avg_size"), (F.coalesce(F.sum("n"), F.lit(0)) / total).alias("coverage"))


def largest(members: DataFrame, k: int = 5) -> DataFrame:
    return members.groupBy("cluster_id").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "cluster_id").limit(k)


def summary(stats: DataFrame, k: int = 5) -> str:
    """Text on the largest clusters."""
    rows = stats.orderBy(F.desc("size"), "cluster_id").limit(k).collect()
    return "\n".join(f"cluster {r.cluster_id}: {r['size']} messages, {r.participant_count} people, similarity {r.avg_similarity:.2f}" for r in rows)


def average_similarity(df: DataFrame, query: Column, embedding: str = "embedding") -> DataFrame:
    return df.agg(F.avg(vector.cosine(vector.as_double(embedding), query)).alias("avg_similarity"))


def max_similarity(df: DataFrame, query: Column, key: str = "id", embedding: str = "embedding") -> DataFrame:
    """One row: the largest similarity and the smallest id that has it."""
    sim = vector.cosine(vector.as_double(embedding), query)
    best = df.select(F.col(key).alias("id"), sim.alias("sim")).agg(F.max(F.struct("sim", (-F.col("id")).alias("n"))).alias("x"))
    return best.select((-F.col("x.n")).alias("id"), F.col("x.sim").alias("max_similarity"))

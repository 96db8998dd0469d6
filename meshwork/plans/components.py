"""Connected components of an edge table, by hooking and contraction.

Every round each vertex hooks onto its smallest smaller neighbour (a grouped ``min``, combined before the
shuffle, so a hub costs one row a map task), pointer jumping flattens the resulting forest, and the edges are
relabelled to the roots that remain. Each round's tables are staged, so lineage stays short and both sides of
every join are plain exchanges that adaptive execution may split when one vertex has most of the edges. Once at
most ``FEW`` edges remain, one task of bounded size finishes them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.plans.staging import drop, stage

FEW = 1 << 18


def _root(df: DataFrame, parents: DataFrame, col: str) -> DataFrame:
    """Replace ``col`` by its parent where it has one."""
    p = parents.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    rest = [c for c in df.columns if c != col]
    return df.join(p, F.col(col) == F.col("_n"), "left").select(*rest, F.coalesce("_r", col).alias(col))


def _edges(df: DataFrame) -> DataFrame:
    return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _finish(live: DataFrame) -> DataFrame:
    """(node, root) of every vertex of few edges, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([part.column(0).to_numpy(), part.column(1).to_numpy()]) for part in batches if part.num_rows]
        if not held:
            return
        nodes, ends = np.unique(np.concatenate(held, axis=1), return_inverse=True)
        a, b = ends.reshape(2, -1)
        root = np.arange(len(nodes))
        while (root[a] != root[b]).any():
            np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
            while (root[root] != root).any():
                root = root[root]
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])

    return live.coalesce(1).mapInArrow(run, "node bigint, root bigint")


def _merged(labels: DataFrame, parents: DataFrame) -> DataFrame:
    """Labels so far, led on by a round's parents."""
    if parents.isEmpty():
        return labels
    # Nodes that were roots so far and hook now get their first label.
    known = labels.select(F.col("node").alias("_k"))
    fresh = parents.join(known, F.col("node") == F.col("_k"), "left_anti")
    merged = stage(_root(labels, parents, "root").select("node", "root").unionByName(fresh), "labels", narrow=True)
    drop(labels)
    drop(parents)
    return merged


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` for every endpoint of ``edges``; component is the smallest node id reachable.

    The table is staged. Null endpoints and loops link nothing; repeated edges count once; no edges give an empty table.
    """
    live = stage(_edges(edges.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b")).dropna()), "edges", narrow=True)
    labels: DataFrame | None = None
    while n := live.count():
        if n <= FEW:
            last = _finish(live)
            if labels is None:
                out = stage(last.withColumnRenamed("root", "component"), "components")
                drop(live)
                return out
            labels = _merged(labels, stage(last.where("node <> root"), "parents"))
            break
        parents = stage(live.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")), "parents", narrow=True)
        while True:
            inner = parents.select(F.col("node").alias("_m"))
            if parents.join(inner, F.col("root") == F.col("_m"), "left_semi").isEmpty():
                break
            flat = stage(_root(parents, parents, "root").select("node", "root"), "parents")
            drop(parents)
            parents = flat
        rest = stage(_edges(_root(_root(live, parents, "a"), parents, "b")), "edges", narrow=True)
        drop(live)
        live = rest
        labels = parents if labels is None else _merged(labels, parents)
    if labels is None:
        labels = live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = labels.select(F.col("root").alias("node"), F.col("root").alias("component")).distinct()
    out = stage(labels.select("node", F.col("root").alias("component")).unionByName(roots), "components", narrow=True)
    drop(live)
    drop(labels)
    return out

"""Command line: generate data, generate queries, search, detect, evaluate."""

from __future__ import annotations

import argparse

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from meshwork.engine import STRATEGIES, Engine
from meshwork.operators import detect
from meshwork.operators.search import SearchRequest
from meshwork.sources import files, scenarios, stores

DIM = 64


def _tables(spark: SparkSession, root: str) -> dict[str, stores.Table]:
    kinds = {"messages": stores.MESSAGES, "sources": stores.SOURCES, "vectors": stores.VECTORS}
    return {name: stores.Table(spark, f"{root.rstrip('/')}/{name}", schema) for name, schema in kinds.items()}


def generate(spark: SparkSession, root: str, names: list[str] | None = None, clear: bool = False) -> int:
    """Write scenario messages, their source, vectors and text index; returns the number of messages."""
    t, now = _tables(spark, root), F.lit(scenarios.REFERENCE).cast("timestamp")
    if clear:
        for table in t.values():
            table.clear()
    stores.get_or_create_source(t["sources"], "slack", "scenarios", now)
    t["messages"].upsert(scenarios.messages(spark, names), "id", F.col("timestamp"))
    t["vectors"].clear()
    stores.populate_vectors(t["messages"].read(), t["vectors"], stores.hashing_embedder(DIM))
    stores.populate_text_index(t["messages"].read(), f"{root.rstrip('/')}/index")
    return t["messages"].count()


def engine(spark: SparkSession, root: str) -> Engine:
    t = _tables(spark, root)
    return Engine(t["messages"].read(), t["sources"].read(), t["vectors"].read())


def _with_vectors(spark: SparkSession, queries):  # noqa: ANN001, ANN202
    named = queries.select(F.xxhash64("query_id").alias("query_id"), F.col("query_id").alias("name"), F.col("query_text").alias("query"))
    return stores.embed(named, "query", stores.hashing_embedder(DIM), "query_vector")


def evaluate(spark: SparkSession, root: str, queries: str, judgments: str, strategies: list[str] | None = None):  # noqa: ANN201
    """Compare strategies over files of queries (JSON lines) and judgments (JSON array)."""
    e = engine(spark, root)
    j = files.read_judgments(spark, judgments).select(F.xxhash64("query_id").alias("query_id"), F.col("document_id").cast("bigint").alias("doc_id"), "relevance")
    e.add_judgments(j)
    return e.compare(_with_vectors(spark, files.read_queries(spark, queries)), tuple(strategies or STRATEGIES))


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="meshwork", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("generate", "queries", "search", "detect", "evaluate"):
        c = sub.add_parser(name)
        c.add_argument("root", help="folder of the tables")
        if name == "generate":
            c.add_argument("--scenario", action="append")
            c.add_argument("--clear", action="store_true")
        if name == "queries":
            c.add_argument("out")
            c.add_argument("--count", type=int, default=50)
        if name == "search":
            c.add_argument("query")
            c.add_argument("--strategy", default="auto")
            c.add_argument("--limit", type=int, default=10)
        if name == "detect":
            c.add_argument("--reference", default=scenarios.REFERENCE.isoformat(sep=" "))
            c.add_argument("--threshold", type=float, default=0.7)
        if name == "evaluate":
            c.add_argument("queries")
            c.add_argument("judgments")
            c.add_argument("--strategy", action="append", choices=STRATEGIES)
            c.add_argument("--format", default="table", choices=["table", "json", "csv"])
    a = p.parse_args(args)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "generate":
        print(generate(spark, a.root, a.scenario, a.clear), "messages")
    elif a.command == "queries":
        files.write_queries(files.test_queries(engine(spark, a.root).messages, a.count), a.out)
    elif a.command == "search":
        vector = stores.hashing_embedder(DIM)(pd.Series([a.query]))[0]
        found = engine(spark, a.root).search(SearchRequest(a.query, vector, a.limit, ranking_strategy=a.strategy))
        print(files.export(found.select("message_id", "channel", "author", "score", "content"), "table"))
    elif a.command == "detect":
        found = engine(spark, a.root).detect(F.lit(a.reference).cast("timestamp"), detect.DetectionConfig(similarity_threshold=a.threshold))
        print(files.export(found.select("gap_id", "title", "impact_tier", "impact_score", "confidence"), "table"))
    else:
        print(files.export(evaluate(spark, a.root, a.queries, a.judgments, a.strategy), a.format))


if __name__ == "__main__":
    main()

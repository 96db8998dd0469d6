"""Search: vector top-k, BM25, hybrid strategies, enrichment. Every search is one lazy plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from meshwork.functions import vector
from meshwork.functions.query import STRATEGIES, parse_text, words_text
from meshwork.operators import bm25, fusion
from meshwork.operators.filters import SearchFilter


class KeywordIndex(Protocol):
    def score(self, query: str) -> DataFrame:
        """(doc_id, score) of the documents of any weight for a query."""


@dataclass
class SearchRequest:
    query: str
    query_vector: list[float] | None = None
    limit: int = 10
    threshold: float = 0.0
    ranking_strategy: str = "auto"
    semantic_weight: float = 0.7
    keyword_weight: float = 0.3
    filter: SearchFilter = field(default_factory=SearchFilter)
    prefilter: bool = False

    def __post_init__(self) -> None:
        self.query = self.query.strip()
        if not 1 <= len(self.query) <= 1000:
            raise ValueError("query must have 1 to 1000 characters")
        if not 1 <= self.limit <= 100:
            raise ValueError("limit must be 1 to 100")
        if not 0 <= self.threshold <= 1:
            raise ValueError("threshold must be 0 to 1")
        if self.ranking_strategy not in STRATEGIES:
            raise ValueError(f"ranking_strategy must be one of {STRATEGIES}")
        for w in (self.semantic_weight, self.keyword_weight):
            if not 0 <= w <= 1:
                raise ValueError("weights must be 0 to 1")


def knn(vectors: DataFrame, query: Column, k: int, key: str = "doc_id", embedding: str = "embedding", where: Column | None = None) -> DataFrame:
    """(doc_id, score, rank) of the k nearest by cosine, with a partial heap in each task; metadata filters go first."""
    rows = vectors if where is None else vectors.where(where)
    scored = rows.select(F.col(key).alias("doc_id"), vector.cosine(vector.as_double(embedding), query).alias("score"))
    return fusion.ranked(bm25.top_k(scored, k))


def knn_queries(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, doc_id, score, rank) for a stated table of queries (query_id, query_vector).

    Queries are broadcast in chunks of bounded size; a task multiplies its vectors with a chunk as matrices and
    keeps its best k of each query, so it sends k rows a query whatever the number of vectors.
    """
    rows = vectors.select(F.col(key).alias("doc_id"), vector.as_double(embedding).alias("v")).where("v is not null")
    out = None
    for chunk in _chunks(queries):
        part = rows.mapInArrow(_best(vectors.sparkSession.sparkContext.broadcast(chunk), k), "query_id bigint, doc_id bigint, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = rows.select(F.col("doc_id").alias("query_id"), "doc_id", F.lit(0.0).alias("score")).limit(0)
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "doc_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _chunks(queries: DataFrame, size: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held: list = []
    for row in queries.select(F.col("query_id").cast("bigint"), vector.as_double("query_vector")).toLocalIterator():
        held.append(row)
        if len(held) == size:
            yield np.array([r[0] for r in held]), np.array([r[1] for r in held])
            held = []
    if held:
        yield np.array([r[0] for r in held]), np.array([r[1] for r in held])


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(n == 0, 1, n)


def _best(sent: Broadcast, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = sent.value
        q = _unit(q)
        ids, scores = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0))
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                own = np.broadcast_to(part.column(0).to_numpy()[None], (len(q), part.num_rows))
                sims = np.clip(q @ _unit(np.array(part.column(1).to_pylist(), np.float64)).T, 0.0, 1.0)
                ids, scores = np.hstack([ids, own]), np.hstack([scores, sims])
                order = np.lexsort((ids, -np.round(scores, 12)), axis=1)[:, :k]
                ids, scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, ids.shape[1])), pa.array(ids.ravel()), pa.array(scores.ravel())], ["query_id", "doc_id", "score"])

    return run


def enrich(hits: DataFrame, messages: DataFrame, sources: DataFrame) -> DataFrame:
    """Hits with their message and source; hits without a message go, their order stays (by score)."""
    rows = messages.alias("m").join(sources.alias("s"), F.col("m.source_id") == F.col("s.id"))
    wide = rows.select(F.col("m.id").alias("message_id"), "content", F.col("s.type").alias("source"), "channel", "author", "timestamp", "external_id")
    return hits.join(wide, F.col("doc_id") == F.col("message_id"))


def strategy_of(request: SearchRequest) -> str:
    chosen = request.ranking_strategy
    return str(parse_text(request.query)["recommended_strategy"]) if chosen == "auto" else chosen


def search(request: SearchRequest, messages: DataFrame, sources: DataFrame, vectors: DataFrame | None = None, index: KeywordIndex | None = None) -> DataFrame:
    """Results in order: message columns, score, the ranks behind it.

    With a stored ``index`` of the messages only the postings of the query's terms are read; without one, and for
    ``prefilter``, texts are counted anew.

    Twice the limit is fetched and filtered afterwards, so that a filtered search may return fewer rows;
    ``prefilter`` filters before ranking instead. Corpus statistics always cover all messages. The threshold
    applies to vector scores only. With "auto", which parses
    the query, a + or - alone before its words tells of a boolean query and is none of its terms.
    """
    chosen, n = strategy_of(request), 2 * request.limit
    if chosen != "bm25" and (vectors is None or request.query_vector is None):
        raise ValueError(f"{chosen} needs vectors and a query vector")
    pool = request.filter.apply(messages.join(sources.select(F.col("id").alias("_s"), F.col("type").alias("source")), F.col("source_id") == F.col("_s"))) if request.prefilter else messages
    texts = pool.select("id", "content")
    words = words_text(request.query) if request.ranking_strategy == "auto" else request.query

    def best(found: DataFrame) -> DataFrame:
        tied = found.where("score > 0").withColumn("_tied", F.round("score", 9))  # sums of the same terms in another order tie
        return fusion.ranked(bm25.top_k(tied, n, by="_tied"), by="_tied").drop("_tied")

    def keyword() -> DataFrame:
        if index is not None and not request.prefilter:
            return best(index.score(words))
        found = bm25.score(texts, words, "id", "content", corpus=messages.select("content") if request.prefilter else None)
        return best(found)

    def semantic() -> DataFrame:
        rows = vectors.join(texts.select(F.col("id").alias("message_id")), "message_id", "left_semi") if request.prefilter else vectors
        q = F.array(*[F.lit(float(x)) for x in request.query_vector])
        return fusion.threshold(knn(rows, q, n, "message_id"), request.threshold)

    if chosen == "bm25":
        hits = keyword().select("doc_id", "score", F.lit(None).cast("int").alias("semantic_rank"), F.col("rank").alias("keyword_rank"))
    elif chosen == "semantic":
        hits = semantic().select("doc_id", "score", F.col("rank").alias("semantic_rank"), F.lit(None).cast("int").alias("keyword_rank"))
    elif chosen == "hybrid_rrf":
        hits = fusion.rrf(semantic(), keyword()).drop("ranking_details")
    else:
        hits = fusion.weighted(semantic(), keyword(), request.semantic_weight, request.keyword_weight).drop("ranking_details")
    found = enrich(hits, messages, sources)
    if not request.prefilter:
        found = request.filter.apply(found)
    order = [F.col("keyword_rank")] if chosen == "bm25" else fusion.fusion_order()
    return found.orderBy(*order).limit(request.limit).select("message_id", "content", "source", "channel", "author", "timestamp", "external_id", "score", "semantic_rank", "keyword_rank")


def health(messages: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row of counts."""
    return messages.agg(F.count("*").alias("messages")).crossJoin(vectors.agg(F.count("*").alias("vectors")))

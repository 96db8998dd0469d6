"""Fusion of ranked lists: reciprocal ranks, weighted scores, duplicates, thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Fixed value: the constant of reciprocal rank fusion.
RRF_K = 60


def ranked(hits: DataFrame, by: str = "score", key: str = "doc_id", partition: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Ranks from 1 in score order, ids last."""
    return hits.withColumn(name, F.row_number().over(W.partitionBy(*(partition or [])).orderBy(F.desc(by), key)))


def _both(semantic: DataFrame, keyword: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    a = semantic.select(*on, *[F.col(c).alias(f"semantic_{c}") for c in columns])
    b = keyword.select(*on, *[F.col(c).alias(f"keyword_{c}") for c in columns])
    return a.join(b, on, "full_outer")


def rrf(semantic: DataFrame, keyword: DataFrame, k: int = RRF_K, on: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Sum of 1 / (k + rank) over both lists (doc_id, score, rank); ties go to the better semantic rank, then keyword rank."""
    both = _both(semantic, keyword, list(on), ["score", "rank"])
    part = lambda c: F.coalesce(1.0 / (F.lit(k) + F.col(c)), F.lit(0.0))
    out = both.withColumn("score", part("semantic_rank") + part("keyword_rank"))
    details = F.struct("semantic_rank", "keyword_rank", "semantic_score", "keyword_score", F.lit("rrf").alias("fusion_method"), F.lit(k).alias("rrf_k"))
    return out.select(*on, "score", "semantic_rank", "keyword_rank", details.alias("ranking_details"))


def minmax(hits: DataFrame, by: str = "score", partition: list[str] | None = None, name: str = "normalized") -> DataFrame:
    """Scores of a list moved to 0..1; a list of (nearly) equal scores becomes all 1."""
    w = W.partitionBy(*(partition or []))
    low, high = F.min(by).over(w), F.max(by).over(w)
    return hits.withColumn(name, F.when(high - low < 1e-10, 1.0).otherwise((F.col(by) - low) / F.nullif(high - low, F.lit(0.0))))


def check_weights(semantic: float, keyword: float) -> None:
    if abs(semantic + keyword - 1) > 0.01:
        raise ValueError("weights must sum to 1")


def weighted(semantic: DataFrame, keyword: DataFrame, semantic_weight: float = 0.7, keyword_weight: float = 0.3, on: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Weighted sum of normalized scores; a list that misses a document gives it 0."""
    check_weights(semantic_weight, keyword_weight)
    part = [c for c in on if c != "doc_id"]
    both = _both(minmax(semantic, partition=part), minmax(keyword, partition=part), list(on), ["score", "rank", "normalized"])
    score = semantic_weight * F.coalesce("semantic_normalized", F.lit(0.0)) + keyword_weight * F.coalesce("keyword_normalized", F.lit(0.0))
    details = F.struct("semantic_rank", "keyword_rank", "semantic_score", "keyword_score", F.lit("weighted").alias("fusion_method"))
    return both.select(*on, score.alias("score"), "semantic_rank", "keyword_rank", details.alias("ranking_details"))


def fusion_order() -> list:
    return [F.desc("score"), F.asc_nulls_last("semantic_rank"), F.asc_nulls_last("keyword_rank"), F.col("doc_id")]


def keep_best(hits: DataFrame, key: str = "doc_id", by: str = "score") -> DataFrame:
    """The best row of each id; rows without an id all stay."""
    known = hits.where(F.col(key).isNotNull())
    best = known.groupBy(key).agg(F.max_by(F.struct(*known.columns), F.struct(by)).alias("x")).select("x.*")
    return best.unionByName(hits.where(F.col(key).isNull()))


def threshold(hits: DataFrame, least: float, by: str = "score") -> DataFrame:
    """Rows with at least this score; a missing score is 0."""
    return hits.where(F.coalesce(F.col(by), F.lit(0.0)) >= least)

"""The engine over one set of tables: search, detection, evaluation, health."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.operators import bm25, detect, evaluation, fusion, search
from meshwork.operators.verifier import detect_gaps
from meshwork.plans.staging import stage

STRATEGIES = ("semantic", "bm25", "hybrid_rrf", "hybrid_weighted")


@dataclass
class Engine:
    """messages and sources as in ``sources.stores``; vectors: message_id, embedding; qrels: query_id, doc_id, relevance."""

    messages: DataFrame
    sources: DataFrame
    vectors: DataFrame
    qrels: DataFrame | None = None
    gaps: DataFrame | None = None

    def search(self, request: search.SearchRequest) -> DataFrame:
        return search.search(request, self.messages, self.sources, self.vectors)

    def health(self) -> DataFrame:
        return search.health(self.messages, self.vectors)

    def detect(self, reference: Column, config: detect.DetectionConfig = detect.DetectionConfig(), verifier: Callable[[DataFrame], DataFrame] = detect.heuristic_verifier) -> DataFrame:
        """Detects, keeps what was found for ``list_gaps`` and ``get_gap``, and returns it."""
        run = lambda: detect.detect(self.messages, self.vectors, reference, config, verifier)
        found, _ = detect_gaps({"duplicate_work": run}, None, config.min_impact, config.max_gaps)
        self.gaps = stage(found, "gaps")
        return self.gaps.orderBy(F.desc("impact_score"), "gap_id")

    def list_gaps(self, page: int = 1, limit: int = 20) -> DataFrame:
        return detect.page(self._known_gaps(), page, limit)

    def get_gap(self, gap_id: str) -> DataFrame:
        return detect.gap_by_id(self._known_gaps(), gap_id)

    def _known_gaps(self) -> DataFrame:
        if self.gaps is None:
            raise ValueError("nothing was detected yet")
        return self.gaps

    def add_judgments(self, qrels: DataFrame) -> None:
        fresh = evaluation.check_judgments(qrels.select("query_id", "doc_id", "relevance"))
        self.qrels = fresh if self.qrels is None else self.qrels.unionByName(fresh)

    def statistics(self) -> DataFrame:
        return evaluation.judgment_counts(self._judgments())

    def _judgments(self) -> DataFrame:
        if self.qrels is None:
            raise ValueError("there are no judgments")
        return self.qrels

    def run(self, queries: DataFrame, strategies: tuple[str, ...] = STRATEGIES, k: int = 10) -> DataFrame:
        """(strategy, query_id, doc_id, rank) of a table of queries (query_id bigint, query, query_vector): one plan for all."""
        unknown = set(strategies) - set(STRATEGIES)
        if unknown or not strategies:
            raise ValueError(f"strategies must be some of {STRATEGIES}")
        keyword = stage(bm25.score_queries(self.messages, queries, "id", "content", k), "keyword")
        semantic = stage(search.knn_queries(self.vectors, queries.where("query_vector is not null"), k, "message_id"), "semantic")
        on = ("query_id", "doc_id")
        made = {"bm25": lambda: keyword, "semantic": lambda: semantic, "hybrid_rrf": lambda: fusion.rrf(semantic, keyword, on=on), "hybrid_weighted": lambda: fusion.weighted(semantic, keyword, on=on)}
        out = None
        for name in strategies:
            one = fusion.ranked(made[name](), partition=["query_id"]).where(F.col("rank") <= k).select(F.lit(name).alias("strategy"), *on, "rank")
            out = one if out is None else out.unionByName(one)
        return out

    def compare(self, queries: DataFrame, strategies: tuple[str, ...] = STRATEGIES, k: int = 10) -> DataFrame:
        """Mean metrics by strategy, the gain over the first, the best one."""
        per = evaluation.metrics(evaluation.judged(self.run(queries, strategies, k), self._judgments()), (5, k))
        return evaluation.compare(stage(evaluation.aggregate(per), "strategies"), strategies[0])

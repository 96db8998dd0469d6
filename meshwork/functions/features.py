"""Ranking features: one projection of Catalyst expressions, driven by a table of definitions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.functions import timefn


@dataclass(frozen=True)
class Feature:
    name: str
    category: str
    normalizer: str
    default: float
    importance: float
    enabled: bool = True


# The features with their normalizers, defaults and importances.
FEATURES = [
    Feature("semantic_score", "relevance", "none", 0.0, 0.9),
    Feature("bm25_score", "relevance", "minmax", 0.0, 0.85),
    Feature("exact_match", "relevance", "none", 0.0, 0.7),
    Feature("term_coverage", "relevance", "none", 0.0, 0.75),
    Feature("title_match", "relevance", "none", 0.0, 0.65),
    Feature("entity_overlap", "relevance", "minmax", 0.0, 0.6),
    Feature("recency", "temporal", "none", 0.0, 0.7),
    Feature("activity_burst", "temporal", "none", 0.0, 0.55),
    Feature("temporal_relevance", "temporal", "none", 0.5, 0.5),
    Feature("edit_freshness", "temporal", "none", 0.0, 0.45),
    Feature("response_velocity", "temporal", "none", 0.0, 0.5),
    Feature("thread_depth", "engagement", "log", 0.0, 0.65),
    Feature("participant_count", "engagement", "log", 0.0, 0.6),
    Feature("reaction_count", "engagement", "log", 0.0, 0.55),
    Feature("reaction_diversity", "engagement", "minmax", 0.0, 0.45),
    Feature("cross_team_engagement", "engagement", "minmax", 0.0, 0.5),
    Feature("view_count", "engagement", "log", 0.0, 0.4, enabled=False),
    Feature("author_seniority", "authority", "minmax", 0.5, 0.5),
    Feature("channel_importance", "authority", "minmax", 0.5, 0.55),
    Feature("team_influence", "authority", "minmax", 0.5, 0.45),
    Feature("domain_expertise", "authority", "minmax", 0.5, 0.6),
    Feature("message_length", "content", "log", 0.0, 0.3),
    Feature("code_snippet_present", "content", "none", 0.0, 0.5),
    Feature("link_count", "content", "log", 0.0, 0.4),
]
BY_NAME = {f.name: f for f in FEATURES}


def default_features() -> list[str]:
    return [f.name for f in FEATURES if f.enabled]


def minimal_features() -> list[str]:
    return [f.name for f in FEATURES if f.enabled and f.importance >= 0.7]


def category_features(*categories: str) -> list[str]:
    return [f.name for f in FEATURES if f.enabled and f.category in categories]


def normalize(x: Column, how: str, low: float | Column = 0.0, high: float | Column = 1.0, mean: float | Column = 0.0, std: float | Column = 1.0) -> Column:
    """One of none, minmax (equal bounds: 0.5), log, zscore (no spread: 0), sigmoid."""
    lo, hi, mu, sd = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high, mean, std))
    if how == "none":
        return x
    if how == "minmax":
        return F.when(hi == lo, 0.5).otherwise(timefn.clamp((x - lo) / F.nullif(hi - lo, F.lit(0.0))))
    if how == "log":
        return F.when(x <= 0, 0.0).otherwise(F.log1p(x) / math.log(1001))
    if how == "zscore":
        return F.when(sd == 0, 0.0).otherwise((x - mu) / F.nullif(sd, F.lit(0.0)))
    if how == "sigmoid":
        return 1 / (1 + F.exp(-x))
    raise ValueError(f"unknown normalizer {how!r}")


def query_terms(query: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit(r"(?U)(\w+)"), F.lit(1)))


def _share(terms: Column, text: Column) -> Column:
    """Share of terms that occur in a text."""
    n = F.size(terms)
    return F.when(n == 0, 0.0).otherwise(F.size(F.filter(terms, lambda t: F.contains(text, t))) / F.nullif(n, F.lit(0)))


def _capitalized(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-z]+)\b"), F.lit(1)))


def raw_features(available: set[str], reference: Column) -> dict[str, Column]:
    """Raw value of every feature, from the columns there are: query, content, channel, timestamp, edited_at,
    thread_timestamps, reply_count, participants, reactions (map) or reaction_list, teams_involved, view_count,
    author_seniority, channel_importance, team_influence, domain_expertise (map), semantic_score, bm25_score,
    context_time, half_life_days."""

    def has(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in available else F.lit(None).cast(kind)

    query, content, channel = F.coalesce(has("query", "string"), F.lit("")), F.coalesce(has("content", "string"), F.lit("")), F.coalesce(has("channel", "string"), F.lit(""))
    lowered, terms, ts = F.lower(content), query_terms(query), has("timestamp", "timestamp")
    times, reactions, listed = has("thread_timestamps", "array<timestamp>"), has("reactions", "map<string,bigint>"), has("reaction_list", "array<struct<emoji:string,count:bigint>>")
    expertise, asked, said = has("domain_expertise", "map<string,double>"), _capitalized(query), _capitalized(content)
    matching = F.map_values(F.map_filter(expertise, lambda k, _: F.exists(terms, lambda t: F.contains(F.lower(k), t))))
    phrase = F.lower(F.trim(query))
    distinct = lambda name: F.coalesce(F.size(F.array_distinct(has(name, "array<string>"))), F.lit(0)).cast("double")
    count = lambda name: F.coalesce(has(name, "double"), F.lit(0.0))
    middle = lambda name: F.coalesce(has(name, "double"), F.lit(0.5))
    total = F.aggregate(F.map_values(reactions), F.lit(0).cast("bigint"), lambda s, x: s + x).cast("double")
    return {
        "semantic_score": count("semantic_score"),
        "bm25_score": count("bm25_score"),
        "exact_match": F.when((phrase != "") & F.contains(lowered, phrase), 1.0).otherwise(0.0),
        "term_coverage": _share(terms, lowered),
        "title_match": F.when(channel == "", 0.0).otherwise(_share(terms, F.lower(channel))),
        "entity_overlap": F.when(F.size(asked) == 0, 0.0).otherwise(F.size(F.array_intersect(asked, said)) / F.nullif(F.size(asked), F.lit(0))),
        "recency": timefn.recency(ts, reference, F.coalesce(has("half_life_days", "double"), F.lit(30.0))),
        "activity_burst": timefn.activity_burst(times, reference),
        "temporal_relevance": timefn.temporal_relevance(ts, F.coalesce(has("context_time", "timestamp"), reference)),
        "edit_freshness": timefn.edit_freshness(ts, has("edited_at", "timestamp"), reference),
        "response_velocity": timefn.response_velocity(times),
        "thread_depth": count("reply_count"),
        "participant_count": F.when(has("participants", "array<string>").isNull(), 0.0).otherwise(distinct("participants")),
        "reaction_count": F.coalesce(total, F.when(listed.isNotNull(), F.size(listed).cast("double")), F.lit(0.0)),
        "reaction_diversity": F.when(reactions.isNull(), 0.0).otherwise(F.size(reactions).cast("double")),
        "cross_team_engagement": F.when(has("teams_involved", "array<string>").isNull(), 0.0).otherwise(distinct("teams_involved")),
        "view_count": count("view_count"),
        "author_seniority": middle("author_seniority"),
        "channel_importance": middle("channel_importance"),
        "team_influence": middle("team_influence"),
        "domain_expertise": F.coalesce(F.array_max(matching), F.lit(0.5)),
        "message_length": F.length(content).cast("double"),
        "code_snippet_present": F.when(F.rlike(content, F.lit("`| {4}")), 1.0).otherwise(0.0),
        "link_count": F.regexp_count(content, F.lit(r"https?://\S+")).cast("double"),
    }


def extract_features(df: DataFrame, reference: Column, names: list[str] | None = None, stats: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Add one normalized column for each feature; ``stats`` gives bounds for minmax ones."""
    raw, wanted = raw_features(set(df.columns), reference), names or default_features()
    made = {}
    for name in wanted:
        f = BY_NAME[name]
        low, high = (stats or {}).get(name, (0.0, 1.0))
        made[name] = F.coalesce(normalize(raw[name], f.normalizer, low, high), F.lit(f.default))
    return df.withColumns(made)


def feature_stats(df: DataFrame, names: list[str]) -> DataFrame:
    """(feature, min, max, mean, std, n) of columns; std is of the population and 0 for fewer than two values."""
    wide = df.agg(*[F.struct(F.min(n).alias("min"), F.max(n).alias("max"), F.avg(n).alias("mean"), F.coalesce(F.stddev_pop(n), F.lit(0.0)).alias("std"), F.count(n).alias("n")).alias(n) for n in names])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("s")) for n in names])).alias("x")).select("x.feature", "x.s.*")

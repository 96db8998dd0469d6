"""Rules that a gap has to pass, as one projection: ``failures`` lists those it broke."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases that tell of working together.
COLLABORATION = ["working with", "collaborating with", "partnering with", "coordinating with", "joint effort", "together with", "helping", "supporting", "aligned with", "sync'd with", "cross-team"]

# Phrases that tell of doing something twice on purpose.
REDUNDANCY = ["a/b test", "experiment", "backup", "redundancy", "failover", "proof of concept", "poc", "prototype", "spike", "comparison", "alternative approach"]


def _any(text: Column, phrases: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(F.lower(text), p))


def collaboration(evidence: Column, teams: Column) -> Column:
    """A phrase of working together, another team named, or any of the teams mentioned with @."""

    def across(e: Column) -> Column:
        said = F.lower(e["content"])
        return F.exists(teams, lambda t: (t != e["team"]) & F.contains(said, F.lower(t)) | F.contains(said, F.concat(F.lit("@"), F.lower(t))))

    return F.exists(evidence, lambda e: _any(e["content"], COLLABORATION) | ((F.size(teams) >= 2) & (F.coalesce(e["team"], F.lit("")) != "") & across(e)))


def same_team(evidence: Column) -> Column:
    return F.size(F.array_distinct(F.transform(evidence, lambda e: e["team"]))) <= 1


def intentional(insight: Column, reasoning: Column, evidence: Column | None = None) -> Column:
    spoken = F.exists(evidence, lambda e: _any(e["content"], REDUNDANCY)) if evidence is not None else F.lit(False)
    return spoken | _any(F.concat_ws(" ", insight, reasoning), REDUNDANCY)


def evidence_quality(evidence: Column, least: float = 0.5) -> Column:
    """Why evidence is weak; null if it isn't. A mean is held against ``least`` without the noise of a sum in some order."""
    mean = F.aggregate(evidence, F.lit(0.0), lambda s, e: s + e["relevance"]) / F.nullif(F.size(evidence), F.lit(0))
    times = F.transform(evidence, lambda e: F.unix_micros(e["timestamp"]))
    close = (F.size(evidence) > 1) & (F.array_max(times) - F.array_min(times) < 60_000_000)
    return F.when(F.coalesce(F.size(evidence), F.lit(0)) <= 0, "no evidence").when(F.round(mean, 9) < least, "low relevance").when(close, "evidence within a minute")


def verification_quality(v: Column, least: float = 0.7) -> Column:
    """Why a verification is weak; null if it isn't."""
    return (
        F.when(~F.coalesce(v["is_duplicate"], F.lit(False)), "not duplicate work")
        .when(v["confidence"] < least, "low confidence")
        .when(F.coalesce(F.length(v["reasoning"]), F.lit(0)) < 20, "reasoning too short")
        .when(F.coalesce(F.size(v["evidence"]), F.lit(0)) < 1, "no supporting evidence")
    )


def validate(gaps: DataFrame, *, min_confidence: float = 0.7, min_teams: int = 2, min_evidence: int = 3, min_overlap_days: int = 3, min_overlap_ratio: float = 0.5, duplicate_work: bool = True) -> DataFrame:
    """Adds ``failures`` and ``is_valid``."""
    v, e, t = F.col("verification"), F.col("evidence"), F.col("teams_involved")
    rules = [
        (F.col("confidence") < min_confidence, "confidence too low"),
        (F.size(t) < min_teams, "too few teams"),
        (F.size(e) < min_evidence, "too little evidence"),
        (F.col("temporal_overlap").isNotNull() & (F.col("temporal_overlap.overlap_days") < min_overlap_days), "overlap too short"),
        (v.isNotNull() & ~F.coalesce(v["is_duplicate"], F.lit(False)), "verification found no duplicate work"),
        (collaboration(e, t), "collaboration"),
        (same_team(e), "one team"),
        (intentional(F.col("insight"), v["reasoning"]), "intentional redundancy"),
    ]
    if duplicate_work:
        rules += [
            (v["overlap_ratio"] < min_overlap_ratio, "overlap ratio too low"),
            (F.col("temporal_overlap").isNull(), "no temporal overlap"),
            (F.size(t) < 2, "duplicate work needs two teams"),
        ]
    failures = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), why) for bad, why in rules]))
    return gaps.withColumn("failures", failures).withColumn("is_valid", F.size("failures") == 0)

"""Impact and cost of duplicated work, as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from meshwork.functions.timefn import clamp

# Weights of the components of impact.
WEIGHTS = {"team_size": 0.25, "time_investment": 0.25, "criticality": 0.20, "velocity": 0.15, "duplicate_effort": 0.15}

# Criticality by project tag.
CRITICALITY = {"roadmap_item": 0.9, "roadmap": 0.9, "okr_related": 0.85, "okr": 0.85, "security": 0.8, "production": 0.75, "prod": 0.75, "customer_facing": 0.7, "customer": 0.7, "infrastructure": 0.6, "infra": 0.6, "internal_tool": 0.3, "internal": 0.3}


def rounded(x: Column, digits: int = 2) -> Column:
    """Half up, after the noise of binary fractions is rounded away."""
    return F.round(F.round(x, 9), digits)


def team_size(participants: Column, teams: Column) -> Column:
    """By people, or five for each team where none are known."""
    people = F.when(F.coalesce(participants, F.lit(0)) > 0, participants).otherwise(teams * 5)
    return F.when(people >= 10, 1.0).when(people >= 5, 0.7).when(people >= 2, 0.4).otherwise(0.2)


def hours_spent(evidence: Column, commits: Column, overlap_days: Column) -> Column:
    """Half an hour a message and two a commit; a fifth more for over two messages a day."""
    base = evidence * 0.5 + commits * 2.0
    dense = (F.coalesce(overlap_days, F.lit(0)) > 0) & (evidence > 2 * overlap_days)
    return F.when(dense, base * 1.2).otherwise(base)


def time_investment(evidence: Column, commits: Column, overlap_days: Column) -> Column:
    h = hours_spent(evidence, commits, overlap_days)
    score = F.when(h >= 100, 1.0).when(h >= 50, 0.7 + (h - 50) / 50 * 0.3).when(h >= 20, 0.5 + (h - 20) / 30 * 0.2).when(h >= 10, 0.3 + (h - 10) / 10 * 0.2).otherwise(F.least(F.lit(0.3), h / 10 * 0.3))
    return rounded(score)


def criticality(tags: Column) -> Column:
    """Largest weight of the known tags, 0.5 if none is known."""
    weight = F.create_map(*[F.lit(x) for pair in CRITICALITY.items() for x in pair])
    return F.coalesce(F.array_max(F.transform(tags, lambda t: F.try_element_at(weight, F.lower(t)))), F.lit(0.5))


def velocity(blocked: Column) -> Column:
    return F.when(blocked >= 5, 1.0).when(blocked >= 3, 0.7 + (blocked - 3) / 2 * 0.3).when(blocked >= 1, 0.4 + (blocked - 1) / 2 * 0.3).otherwise(0.2)


def impact(components: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted sum of the five components within 0 and 1, to two digits."""
    w = weights or WEIGHTS
    if abs(sum(w.values()) - 1) > 0.01:
        raise ValueError("weights must sum to 1")
    total = sum((components[k] * F.lit(w[k]) for k in WEIGHTS), F.lit(0.0))
    return rounded(clamp(total))


def impact_components(*, teams: Column, participants: Column, evidence: Column, commits: Column, overlap_days: Column, tags: Column, blocked: Column, overlap_ratio: Column) -> dict[str, Column]:
    return {
        "team_size": team_size(participants, teams),
        "time_investment": time_investment(evidence, commits, overlap_days),
        "criticality": criticality(tags),
        "velocity": velocity(blocked),
        "duplicate_effort": F.coalesce(overlap_ratio, F.lit(0.5)),
    }


def tier(score: Column) -> Column:
    return F.when(score >= 0.8, "CRITICAL").when(score >= 0.6, "HIGH").when(score >= 0.4, "MEDIUM").otherwise("LOW")


def team_multiplier(teams: Column) -> Column:
    grown = F.when(teams == 2, 1.8).when(teams == 3, 2.4).otherwise(2.4 + (teams - 3) * 0.4)
    return F.when(teams <= 1, 1.0).otherwise(F.least(grown, teams * 0.85))


@dataclass(frozen=True)
class CostRates:
    hourly: float = 100.0
    message_hours: float = 0.5
    commit_hours: float = 2.0
    least_hours: float = 5.0
    overhead: float = 1.15


def cost_hours(teams: Column, evidence: Column, commits: Column, rates: CostRates = CostRates()) -> Column:
    base = F.greatest(F.lit(rates.least_hours), evidence * rates.message_hours + commits * rates.commit_hours)
    return base * team_multiplier(teams) * rates.overhead


def cost(teams: Column, evidence: Column, commits: Column, rates: CostRates = CostRates()) -> Column:
    """Struct of hours (one digit), dollars (two digits) and a sentence that explains them."""
    hours = cost_hours(teams, evidence, commits, rates)
    text = F.format_string("%d teams, %d messages and %d commits: %.1f hours at $%.0f an hour", teams.cast("int"), evidence.cast("int"), commits.cast("int"), hours, F.lit(rates.hourly))
    return F.struct(F.round(hours, 1).alias("hours"), rounded(hours * rates.hourly).alias("dollars"), text.alias("explanation"))


def simple_cost(impact_score: Column, evidence: Column, hours_each: float = 10.0, hourly: float = 100.0) -> Column:
    """Impact times evidence times hours times rate."""
    return rounded(impact_score * evidence * hours_each * hourly)

"""Time functions as columns. The reference time is always an argument."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY, HOUR = 86_400.0, 3_600.0


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Within the bounds; null stays null (greatest and least alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def recency(ts: Column, reference: Column, half_life_days: float | Column = 30.0) -> Column:
    """Exponential decay by age; 1 for the future, 0 without a time."""
    age = (seconds(reference) - seconds(ts)) / DAY
    life = half_life_days if isinstance(half_life_days, Column) else F.lit(float(half_life_days))
    return F.coalesce(clamp(F.exp(F.lit(-math.log(2)) / life * age)), F.lit(0.0))


def activity_burst(times: Column, reference: Column, window_hours: float = 24.0, multiplier: float = 3.0) -> Column:
    """Recent event rate against the earlier rate, as 0 to 1 with 0.5 at an equal rate."""
    ref, width = seconds(reference), F.lit(float(window_hours))
    total = F.size(times).cast("double")
    recent = F.size(F.filter(times, lambda t: seconds(t) >= ref - width * HOUR)).cast("double")
    hours = (ref - seconds(F.array_min(times))) / HOUR
    past = F.when(hours > width, (total - recent) / (hours - width)).when(hours > 0, total / hours).otherwise(0.0)
    ratio = recent / width / F.nullif(past, F.lit(0.0))
    score = F.when(ratio < 1, 0.5 * ratio).otherwise(0.5 + 0.5 * F.least(F.lit(1.0), (ratio - 1) / (multiplier - 1)))
    quiet = F.when(recent > 0, 1.0).otherwise(0.0)
    return F.when(times.isNull() | (F.size(times) == 0), 0.0).when(past == 0, quiet).otherwise(clamp(score))


def response_velocity(times: Column) -> Column:
    """Replies an hour, a tenth of it, at most 1; 1 if all come at once, 0 for fewer than two events."""
    span = (seconds(F.array_max(times)) - seconds(F.array_min(times))) / HOUR
    rate = (F.size(times) - 1) / F.nullif(span, F.lit(0.0)) / 10
    return F.when(times.isNull() | (F.size(times) < 2), 0.0).when(span == 0, 1.0).otherwise(clamp(rate))


def temporal_relevance(ts: Column, context: Column, window_days: float = 90.0) -> Column:
    """1 within half the window, falling to 0.5 at its end, then halving with every further window."""
    gap = F.abs(seconds(context) - seconds(ts)) / DAY
    half = window_days / 2
    falling = 1 - 0.5 * (gap - half) / half
    beyond = 0.5 * F.exp(F.lit(-math.log(2) / window_days) * (gap - window_days))
    return F.when(ts.isNull(), 0.5).when(gap <= half, 1.0).when(gap <= window_days, falling).otherwise(clamp(beyond))


def edit_freshness(created: Column, edited: Column, reference: Column, half_life_days: float = 7.0) -> Column:
    return recency(F.coalesce(edited, created), reference, half_life_days)


def window_overlap(start1: Column, end1: Column, start2: Column, end2: Column) -> tuple[Column, Column]:
    """Whether two windows overlap (touching ones don't), and the overlap as a share of the shorter."""
    over = F.least(seconds(end1), seconds(end2)) - F.greatest(seconds(start1), seconds(start2))
    shorter = F.least(seconds(end1) - seconds(start1), seconds(end2) - seconds(start2))
    share = F.when(over <= 0, 0.0).when(shorter == 0, 1.0).otherwise(over / F.nullif(shorter, F.lit(0.0)))
    return over > 0, share


def overlap_days(start1: Column, end1: Column, start2: Column, end2: Column) -> Column:
    """Whole dates between the later start and the earlier end; 0 for disjoint windows and single days."""
    return F.greatest(F.lit(0), F.datediff(F.least(end1, end2).cast("date"), F.greatest(start1, start2).cast("date")))


def parse_iso(text: Column) -> Column:
    """ISO time, with or without Z, in UTC; null if it can't be read."""
    return F.when(F.rlike(text, F.lit(r"^\s*\d{4}-\d{2}-\d{2}")), F.try_to_timestamp(text))

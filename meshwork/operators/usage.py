"""Ledger of model usage: price, summaries, daily quota."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Dollars for a million input and output tokens by size of model; unknown models cost as the middle one.
PRICES = {"small": (0.80, 4.00), "medium": (3.00, 15.00), "large": (15.00, 75.00)}


def priced(usage: DataFrame, prices: dict[str, tuple[float, float]] = PRICES, default: str = "medium") -> DataFrame:
    """Adds total tokens and costs to (ts, model, input_tokens, output_tokens)."""
    table = F.create_map(*[F.lit(x) for m, (i, o) in prices.items() for x in (m, i)])
    out = F.create_map(*[F.lit(x) for m, (i, o) in prices.items() for x in (m, o)])
    rate = lambda m, k: F.coalesce(F.try_element_at(m, F.col("model")), F.lit(prices[default][k]))
    return usage.withColumns({"total_tokens": F.col("input_tokens") + F.col("output_tokens"), "input_cost": F.col("input_tokens") / 1e6 * rate(table, 0), "output_cost": F.col("output_tokens") / 1e6 * rate(out, 1)}).withColumn("total_cost", F.col("input_cost") + F.col("output_cost"))


def summary(ledger: DataFrame, cutoff: Column) -> DataFrame:
    """One row of sums since the cutoff."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return ledger.where(F.col("ts") >= cutoff).agg(F.count("*").alias("calls"), s("input_tokens").alias("input_tokens"), s("output_tokens").alias("output_tokens"), s("total_tokens").alias("total_tokens"), s("total_cost").alias("total_cost"), F.avg("total_tokens").alias("tokens_per_call"))


def running_quota(ledger: DataFrame, quota: int = 1_000_000, key: str = "id") -> DataFrame:
    """Usage since the day's start, and whether it is near (80 %) or over the quota.

    Rows are summed within minutes, and minutes within days, so a heavy day is spread over as many groups.
    """
    minute = F.date_trunc("minute", F.col("ts"))
    rows = ledger.withColumn("_minute", minute)
    sums = rows.groupBy(F.col("_minute").alias("_m")).agg(F.sum("total_tokens").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(F.to_date("_m")).orderBy("_m").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    w = W.partitionBy("_minute").orderBy("ts", key).rowsBetween(W.unboundedPreceding, 0)
    used = rows.withColumn("used", F.sum("total_tokens").over(w)).join(sums, F.col("_minute").eqNullSafe(F.col("_m")), "left")
    used = used.withColumn("used", F.col("used") + F.coalesce("_before", F.lit(0))).drop("_minute", "_m", "_before")
    return used.withColumn("near_limit", F.col("used") >= 0.8 * quota).withColumn("over_limit", F.col("used") >= quota)


def used_today(ledger: DataFrame, now: Column) -> DataFrame:
    """One row: tokens of the day of ``now``."""
    return ledger.where(F.to_date("ts") == F.to_date(now)).agg(F.coalesce(F.sum("total_tokens"), F.lit(0)).cast("bigint").alias("used"))


def daily(ledger: DataFrame, quota: int = 1_000_000) -> DataFrame:
    """Per day: calls, tokens, cost, and the quota flags at its end."""
    day = ledger.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("calls"), F.sum("total_tokens").alias("tokens"), F.sum("total_cost").alias("cost"))
    return day.withColumn("near_limit", F.col("tokens") >= 0.8 * quota).withColumn("over_limit", F.col("tokens") >= quota)


def daily_counts(events: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """(day, n) of every day from start to end, zero-filled."""
    calendar = events.sparkSession.sql(f"select explode(sequence(date'{start}', date'{end}')) as day")
    counted = events.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    return calendar.join(counted, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))

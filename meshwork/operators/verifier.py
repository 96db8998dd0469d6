"""Verification by an external model, and the service that runs detectors."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from meshwork.functions import prompts
from meshwork.functions.text import message_tokens, token_estimate
from meshwork.operators import usage
from meshwork.operators.detect import VERIFICATION, heuristic_verifier
from meshwork.plans.staging import stage
from meshwork.sources.stores import Table


class Transient(Exception):  # noqa: N818
    """What a client raises if asking again may help."""


def ask(complete: Callable[[str], str], text: str, tries: int = 3, wait: float = 2.0, longest: float = 60.0) -> str | None:
    """One answer, asked again with doubled pauses; None if it fails for good."""
    for k in range(tries):
        try:
            return complete(text)
        except Transient:
            if k + 1 < tries:
                time.sleep(min(longest, wait * 2**k))
        except Exception:
            return None
    return None


def external_verifier(complete: Callable[[str], str], tries: int = 3, wait: float = 2.0) -> Callable[[DataFrame], DataFrame]:
    """A verifier for ``detect`` that asks a model once per gap; failed or unreadable answers use the heuristic.

    ``complete`` must be picklable: it runs on the executors, one call a gap. The detector stages its output, so
    no gap is asked about twice.
    """

    def verify(gaps: DataFrame) -> DataFrame:
        text = prompts.prompt("verification", teams=prompts.format_teams(F.col("teams")), timeframe=prompts.format_timeframe(F.col("overlap.start"), F.col("overlap.end")), messages=prompts.format_messages(F.col("evidence")))
        asked = gaps.select("cluster_id", text.alias("prompt"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"cluster_id": b.cluster_id, "answer": [ask(complete, p, tries, wait) for p in b.prompt]})

        kind = asked.schema["cluster_id"].dataType.simpleString()
        answers = asked.mapInPandas(run, f"cluster_id {kind}, answer string").select(F.col("cluster_id").alias("_c"), prompts.parse_verification(F.col("answer")).cast(VERIFICATION).alias("_v"))
        done = heuristic_verifier(gaps).join(answers, F.col("cluster_id") == F.col("_c"), "left")
        return done.withColumn("verification", F.coalesce("_v", "verification")).drop("_c", "_v")

    return verify


def metered_verifier(complete: Callable[[str], str], ledger: Table, now: Column, model: str = "medium", quota: int = 1_000_000, tries: int = 3, wait: float = 2.0) -> Callable[[DataFrame], DataFrame]:
    """As ``external_verifier``, within a daily quota of tokens, and with a row in the ledger for each call.

    Gaps are asked about in the order of their cluster while the tokens used today and those of the prompts so far
    stay within the quota; the others are left to the heuristic. The ledger is a store of (ts, model, input_tokens,
    output_tokens, total_tokens, input_cost, output_cost, total_cost).
    """

    def verify(gaps: DataFrame) -> DataFrame:
        text = prompts.prompt("verification", teams=prompts.format_teams(F.col("teams")), timeframe=prompts.format_timeframe(F.col("overlap.start"), F.col("overlap.end")), messages=prompts.format_messages(F.col("evidence")))
        asked = gaps.select("cluster_id", text.alias("prompt")).withColumn("input_tokens", message_tokens(token_estimate("prompt")).cast("bigint"))
        used = usage.used_today(ledger.read(), now).first()["used"]
        # One row a gap that passed all gates: these are few.
        spent = F.sum("input_tokens").over(W.orderBy("cluster_id").rowsBetween(W.unboundedPreceding, 0))
        asked = asked.withColumn("_spent", spent).where(F.col("_spent") + used <= quota).select("cluster_id", "prompt", "input_tokens")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"cluster_id": b.cluster_id, "input_tokens": b.input_tokens, "answer": [ask(complete, p, tries, wait) for p in b.prompt]})

        kind = asked.schema["cluster_id"].dataType.simpleString()
        answers = stage(asked.mapInPandas(run, f"cluster_id {kind}, input_tokens bigint, answer string"), "answers")
        calls = answers.where("answer is not null").select(now.alias("ts"), F.lit(model).alias("model"), "input_tokens", token_estimate("answer").cast("bigint").alias("output_tokens"))
        ledger.append(usage.priced(calls))
        found = answers.select(F.col("cluster_id").alias("_c"), prompts.parse_verification(F.col("answer")).cast(VERIFICATION).alias("_v"))
        done = heuristic_verifier(gaps).join(found, F.col("cluster_id") == F.col("_c"), "left")
        return done.withColumn("verification", F.coalesce("_v", "verification")).drop("_c", "_v")

    return verify


Detector = Callable[[], DataFrame]


def detect_gaps(detectors: dict[str, Detector], types: list[str] | None = None, min_impact: float = 0.0, max_gaps: int | None = None) -> tuple[DataFrame | None, list[str]]:
    """Gaps of all wanted detectors by falling impact, and the types that were skipped.

    Types without a detector are skipped, as are detectors that fail to build their plan.
    """
    out, skipped = None, []
    for name in types or list(detectors):
        try:
            found = detectors[name]()
        except Exception:
            skipped.append(name)
            continue
        found = found.where(F.col("impact_score") >= min_impact)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return None, skipped
    ordered = out.orderBy(F.desc("impact_score"), "gap_id")
    return (ordered.limit(max_gaps) if max_gaps else ordered), skipped

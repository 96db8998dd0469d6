"""Invented messages of ten scenarios around a fixed reference time, for tests and demonstrations."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from meshwork.sources.stores import MESSAGES

REFERENCE = datetime(2024, 6, 30)

#: name: (days before the reference, hours between messages, [(channel, topic, messages)], style, detected)
SCENARIOS = {
    "login_discussion": (7, 6, [("platform", "login provider", 4), ("auth-team", "login provider", 4)], "talk", False),
    "choosing_a_queue": (5, 4, [("backend-eng", "message queue", 4), ("data-team", "message queue", 1)], "talk", False),
    "outage": (3, 1, [("incidents", "checkout outage", 4), ("backend-eng", "checkout outage", 1)], "alert", False),
    "planning": (10, 12, [("product", "export button", 4), ("frontend", "export button", 1), ("engineering", "export button", 1)], "talk", False),
    "login_twice": (15, 26, [("platform", "oauth gateway", 12), ("auth-team", "oauth gateway", 12), ("engineering", "oauth gateway", 1)], "build", True),
    "api_twice": (21, 44, [("platform", "graphql schema", 9), ("backend-eng", "graphql schema", 9)], "build", True),
    "migration_twice": (11, 40, [("security", "session migration", 5), ("platform", "session migration", 5)], "build", True),
    "different_scope": (8, 24, [("frontend", "login form colours", 2), ("platform", "login token storage", 2)], "scope", False),
    "one_after_another": (90, 460, [("web-team", "cache headers", 2), ("mobile", "cache headers", 2)], "build", False),
    "joint_work": (12, 48, [("engineering", "billing events", 3), ("platform", "billing events", 2), ("auth-team", "billing events", 1)], "joint", False),
}

_STYLES = {
    "talk": ["Should we look at the {t} this quarter?", "I read about the {t} and have notes", "The {t} came up in planning again", "Can somebody summarise the {t}?"],
    "alert": ["We see errors in the {t}", "Rolled back, watching the {t}", "The {t} is over, writing it up", "Root cause of the {t} found"],
    "build": ["We are implementing the {t} now", "Implementing the {t}: first part is done", "The {t} we are implementing needs tests", "Our {t} implementation is in review"],
    "scope": ["Our work on {t} starts today", "Finished a draft for {t}"],
    "joint": ["We are working with @platform-team on {t}", "Together with @engineering-team we plan {t}", "Joint effort on {t} goes well"],
}


def rows(names: list[str] | None = None, per_channel: int = 3) -> list[tuple]:
    """Message tuples in MESSAGES order; every scenario's messages alternate between its channels."""
    out = []
    for name in names or list(SCENARIOS):
        days, hours, parts, style, _ = SCENARIOS[name]
        at, turns = REFERENCE - timedelta(days=days), []
        for channel, topic, n in parts:
            turns += [(i, channel, topic) for i in range(n)]
        for k, (i, channel, topic) in enumerate(sorted(turns)):
            texts = _STYLES[style]
            author = f"{channel.split('-')[0]}_{i % per_channel}"
            when = at + timedelta(hours=hours / max(1, len(parts)) * k)
            out.append((len(out) + 1, 1, texts[i % len(texts)].format(t=topic), f"{name}-{k}", author, channel, name, when, {"scenario": name}))
    return out


def messages(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    unknown = set(names or []) - set(SCENARIOS)
    if unknown:
        raise ValueError(f"unknown scenarios: {sorted(unknown)}")
    return spark.createDataFrame(rows(names), MESSAGES)


def expected_detections() -> dict[str, bool]:
    return {name: parts[4] for name, parts in SCENARIOS.items()}

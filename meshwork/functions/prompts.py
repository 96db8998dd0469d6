"""Prompts for an external model, as columns, and parsing of what it answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TEMPLATES = {
    "verification": "Messages of several teams follow. Decide whether the teams do the same work twice.\nTeams: {teams}\nTimes: {timeframe}\nMessages:\n{messages}\nAnswer as JSON with is_duplicate, confidence (0 to 1), reasoning, evidence (list), recommendation, overlap_ratio (0 to 1).",
    "insight": "Explain in two sentences what the teams {teams} do twice.\nEvidence:\n{evidence}",
    "missing_context": "Which facts would a newcomer to these messages lack?\n{messages}",
    "stale_docs": "Which statements in these messages are out of date by {timeframe}?\n{messages}",
    "entities": "List people, teams, projects and topics of these messages as JSON.\n{messages}",
    "cluster_label": "Name the common topic of these messages in at most five words.\n{messages}",
    "recommendation": "Recommend one next step for the teams {teams}.\nEvidence:\n{evidence}",
}

VERIFICATION = "is_duplicate boolean, confidence double, reasoning string, evidence array<string>, recommendation string, overlap_ratio double"


def format_messages(messages: Column, limit: int = 10) -> Column:
    """Numbered lines of the first messages: structs of timestamp, channel, author, content."""
    one = lambda m, i: F.concat((i + 1).cast("string"), F.lit(". ["), F.date_format(m["timestamp"], "yyyy-MM-dd HH:mm"), F.lit("] #"), F.coalesce(m["channel"], F.lit("?")), F.lit(" "), F.coalesce(m["author"], F.lit("?")), F.lit(": "), m["content"])
    return F.array_join(F.transform(F.slice(messages, 1, limit), one), "\n")


def format_evidence(evidence: Column, length: int = 200) -> Column:
    """Lines of team and shortened content."""
    return F.array_join(F.transform(evidence, lambda e: F.concat(F.lit("- "), e["team"], F.lit(": "), F.when(F.length(e["content"]) > length, F.concat(F.substring(e["content"], 1, length), F.lit("..."))).otherwise(e["content"]))), "\n")


def format_teams(teams: Column) -> Column:
    return F.array_join(teams, ", ")


def format_timeframe(start: Column, end: Column) -> Column:
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return F.concat(day(start), F.lit(" to "), day(end), F.lit(" ("), F.datediff(end.cast("date"), start.cast("date")).cast("string"), F.lit(" days)"))


def prompt(name: str, **parts: Column) -> Column:
    """A template with its parts filled in; text in the parts is never read as a template."""
    out, rest = [], TEMPLATES[name]
    while "{" in rest:
        head, _, tail = rest.partition("{")
        key, _, rest = tail.partition("}")
        out += [F.lit(head), F.coalesce(parts[key], F.lit(""))]
    return F.concat(*out, F.lit(rest))


def parse_verification(answer: Column) -> Column:
    """The struct of a JSON answer, also from a fenced block; null if a field is missing or out of range."""
    body = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    v = F.from_json(body, VERIFICATION)
    known = v["is_duplicate"].isNotNull() & v["reasoning"].isNotNull() & v["confidence"].between(0, 1) & F.coalesce(v["overlap_ratio"], F.lit(0.0)).between(0, 1)
    return F.when(known, v)

"""People, teams, projects and topics in messages, as arrays of structs built from regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meshwork.functions.text import normalize_team_name, normalize_username

# Patterns of mentions, addresses, channels, team mentions, project codes and acronyms.
MENTION = r"(?<![a-zA-Z0-9._-])@([a-zA-Z0-9_-]+)(?![a-zA-Z0-9._-])"
EMAIL = r"\b([a-zA-Z0-9._-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})\b"
CHANNEL = r"#([a-zA-Z0-9_-]+)"
TEAM_MENTION = r"(?i)(?<![a-zA-Z0-9._-])@([a-zA-Z0-9_-]*team[a-zA-Z0-9_-]*)"
PROJECT_CODE = r"\b([A-Z]{2,10}-\d+)\b"
ACRONYM = r"\b([A-Z]{2,6})\b"

# Technical terms.
TERMS = ["oauth", "oauth2", "api", "rest", "graphql", "microservices", "kubernetes", "docker", "redis", "postgres", "elasticsearch", "authentication", "authorization", "jwt", "sso", "saml", "rbac", "ci/cd", "devops", "frontend", "backend", "database", "security", "encryption", "migration", "refactor", "deployment"]

# Departments.
DEPARTMENTS = ["engineering", "product", "design", "platform", "backend", "frontend", "mobile", "data", "security", "infrastructure", "devops", "qa", "testing", "operations", "marketing"]

# Verbs that are topics.
VERBS = ["implementing", "building", "designing", "refactoring", "migrating", "deploying", "testing", "debugging", "optimizing", "scaling", "monitoring", "fixing"]

# Channels that name no team, and words that are no acronyms.
GENERIC_CHANNELS = ["general", "random", "announcements", "social"]
NO_ACRONYMS = ["I", "A", "AN", "THE", "OK", "PR", "MR"]

ENTITY = "array<struct<text:string,normalized:string,confidence:double,source:string>>"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def _item(text: Column, normalized: Column, confidence: float, source: str) -> Column:
    return F.struct(text.alias("text"), normalized.alias("normalized"), F.lit(confidence).alias("confidence"), F.lit(source).alias("source"))


def _first_seen(items: Column) -> Column:
    """The first of each normalized form, in order."""
    return F.aggregate(items, F.lit(None).cast(ENTITY), lambda kept, x: F.when(F.exists(F.coalesce(kept, F.array().cast(ENTITY)), lambda k: k["normalized"] == x["normalized"]), kept).otherwise(F.concat(F.coalesce(kept, F.array().cast(ENTITY)), F.array(x))))


def _entities(*groups: Column) -> Column:
    return F.coalesce(_first_seen(F.concat(*[g.cast(ENTITY) for g in groups])), F.array().cast(ENTITY))


def _present(words: list[str], lowered: Column) -> Column:
    """The words a text holds between word borders, in alphabetical order; patterns are constants, compiled once."""
    found = [F.when(F.contains(lowered, F.lit(w)) & F.rlike(lowered, F.lit(rf"\b\Q{w}\E\b")), F.lit(w)) for w in sorted(words)]
    return F.array_compact(F.array(*found))


def people(text: Column, author: Column, domain: str = "company.com") -> Column:
    """Addresses, then mentions that name no team, then the author."""
    t = F.coalesce(text, F.lit(""))
    emails = F.transform(_all(t, EMAIL), lambda e: _item(e, F.lower(e), 1.0, "email"))
    mentions = F.transform(F.filter(_all(t, MENTION), lambda m: ~F.contains(F.lower(m), F.lit("team"))), lambda m: _item(F.concat(F.lit("@"), m), F.lower(F.concat(m, F.lit(f"@{domain}"))), 0.9, "mention"))
    writer = F.when(F.coalesce(author, F.lit("")) != "", F.array(_item(author, normalize_username(author, domain), 1.0, "author"))).otherwise(F.array().cast(ENTITY))
    return _entities(emails, mentions, writer)


def teams(text: Column, channel: Column) -> Column:
    """Team mentions, then teams a channel suggests, then departments named in the text.

    Departments are tried in alphabetical order. Where a channel names none of them, or one already found, the
    channel itself stands for a team.
    """
    t, lowered = F.coalesce(text, F.lit("")), F.lower(F.coalesce(text, F.lit("")))
    mentioned = F.transform(_all(t, TEAM_MENTION), lambda m: _item(F.concat(F.lit("@"), m), F.translate(F.lower(m), "_", "-"), 1.0, "mention"))
    name = F.lower(F.regexp_replace(F.coalesce(channel, F.lit("")), "^#+", ""))
    seen = F.transform(mentioned, lambda x: x["normalized"])
    named = F.filter(F.array(*[F.lit(d) for d in sorted(DEPARTMENTS)]), lambda d: F.contains(name, d))
    fresh = F.filter(named, lambda d: ~F.array_contains(seen, F.concat(d, F.lit("-team"))))
    whole = F.when(name.endswith("-team"), name).otherwise(F.concat(name, F.lit("-team")))
    inferred = F.when((name == "") | name.isin(GENERIC_CHANNELS), F.array().cast(ENTITY)).when(F.size(fresh) > 0, F.array(_item(channel, F.concat(fresh[0], F.lit("-team")), 0.7, "channel")).cast(ENTITY)).otherwise(F.array(_item(channel, whole, 0.6, "channel")).cast(ENTITY))
    spoken = F.transform(_present(DEPARTMENTS, lowered), lambda d: _item(d, F.concat(d, F.lit("-team")), 0.8, "keyword"))
    return _entities(mentioned, inferred, spoken)


def projects(text: Column) -> Column:
    """Project codes, then technical terms, then acronyms."""
    t = F.coalesce(text, F.lit(""))
    codes = F.transform(_all(t, PROJECT_CODE), lambda c: _item(c, F.lower(c), 1.0, "code"))
    terms = F.transform(_present(TERMS, F.lower(t)), lambda w: _item(w, w, 0.9, "keyword"))
    acronyms = F.transform(F.filter(_all(t, ACRONYM), lambda a: ~a.isin(NO_ACRONYMS)), lambda a: _item(a, F.lower(a), 0.6, "acronym"))
    return _entities(codes, terms, acronyms)


def topics(text: Column) -> Column:
    """Technical terms, then verbs of work."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    terms = F.transform(_present(TERMS, lowered), lambda w: _item(w, w, 0.7, "keyword"))
    verbs = F.transform(_present(VERBS, lowered), lambda w: _item(w, w, 0.6, "verb"))
    return _entities(terms, verbs)


def extract(text: Column, author: Column, channel: Column, *, with_people: bool = True, with_teams: bool = True, with_projects: bool = True, with_topics: bool = True) -> Column:
    """All entities of a message as one struct of arrays; kinds can be switched off."""
    none = F.array().cast(ENTITY)
    return F.struct(
        (people(text, author) if with_people else none).alias("people"),
        (teams(text, channel) if with_teams else none).alias("teams"),
        (projects(text) if with_projects else none).alias("projects"),
        (topics(text) if with_topics else none).alias("topics"),
    )


def normalize_entity(text: Column, kind: str) -> Column:
    """Canonical form of one entity of a kind: person, team, project or topic."""
    if kind == "person":
        return normalize_username(text)
    if kind == "team":
        return normalize_team_name(text)
    return F.lower(F.trim(text))


def entity_count(found: Column) -> Column:
    return F.size(found["people"]) + F.size(found["teams"]) + F.size(found["projects"]) + F.size(found["topics"])

"""Query parsing as columns: normal form, terms, intent, strategy and inline filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that begin a question, and what makes a boolean query.
QUESTIONS = ["who", "what", "when", "where", "why", "how", "which"]
BOOLEAN = [" and ", " or ", " not ", "+", "-"]

# Operators that may stand alone before a boolean query.
BARE = ("+", "-")

# Inline filters.
FILTERS = {"source": r"(?i)source:(\w+)", "channel": r"(?i)channel:(#?\w+)", "author": r"(?i)author:([\w@.]+)", "date": r"(?i)date:(\d{4}-\d{2}-\d{2})"}

STRATEGIES = ("semantic", "bm25", "hybrid_rrf", "hybrid_weighted", "auto")


def normalized(query: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(query, F.lit(""))), r"\s+", " "))


def terms(query: Column) -> Column:
    """Words of more than one character."""
    return F.filter(F.split(normalized(query), " "), lambda t: F.length(t) > 1)


def intent(query: Column) -> Column:
    lowered = F.lower(F.coalesce(query, F.lit("")))

    def any_of(tests: list[Column]) -> Column:
        out = tests[0]
        for t in tests[1:]:
            out = out | t
        return out

    return (
        F.when(normalized(query) == "", "empty")
        .when(any_of([F.startswith(lowered, F.lit(w)) for w in QUESTIONS]), "question")
        .when(any_of([F.contains(lowered, F.lit(q)) for q in ('"', "'")]), "exact_phrase")
        .when(any_of([F.contains(lowered, F.lit(o)) for o in BOOLEAN]), "boolean")
        .when(F.size(terms(query)) <= 2, "keyword")
        .otherwise("semantic")
    )


def strategy(query: Column, default: str = "hybrid_rrf") -> Column:
    kind = intent(query)
    return (
        F.when(kind.isin("question", "semantic"), "hybrid_rrf")
        .when((kind == "keyword") & (F.size(terms(query)) == 1), "bm25")
        .when(kind == "keyword", "hybrid_weighted")
        .when(kind.isin("exact_phrase", "boolean"), "bm25")
        .otherwise(default)
    )


def inline_filters(query: Column) -> Column:
    """Struct of the first source:, channel:, author: and date: filters; null where there is none."""
    q = F.coalesce(query, F.lit(""))
    return F.struct(*[F.nullif(F.regexp_extract(q, pattern, 1), F.lit("")).alias(name) for name, pattern in FILTERS.items()])


def without_filters(query: Column) -> Column:
    q = F.coalesce(query, F.lit(""))
    for pattern in FILTERS.values():
        q = F.regexp_replace(q, pattern, "")
    return F.trim(F.regexp_replace(q, r"\s+", " "))


def parse(query: Column, default: str = "hybrid_rrf") -> Column:
    return F.struct(query.alias("original"), normalized(query).alias("normalized"), terms(query).alias("terms"), intent(query).alias("intent"), strategy(query, default).alias("recommended_strategy"), inline_filters(query).alias("filters"))


def words_text(query: str) -> str:
    """The words of a parsed query for a keyword search: all but an operator that stands alone before them."""
    found = query.split()
    return " ".join(found[1:] if found[:1] and found[0] in BARE else found)


def parse_text(query: str) -> dict[str, object]:
    """The driver's own parse of one query, by the same rules, to choose a plan before there is one."""
    norm = " ".join(query.lower().split())
    words = [t for t in norm.split(" ") if len(t) > 1]
    lowered = query.lower()
    kind = "empty" if not norm else "question" if lowered.startswith(tuple(QUESTIONS)) else "exact_phrase" if '"' in query or "'" in query else "boolean" if any(o in lowered for o in BOOLEAN) else "keyword" if len(words) <= 2 else "semantic"
    chosen = "bm25" if kind in ("exact_phrase", "boolean") or kind == "keyword" and len(words) == 1 else "hybrid_weighted" if kind == "keyword" else "hybrid_rrf"
    return {"normalized": norm, "terms": words, "intent": kind, "recommended_strategy": chosen}

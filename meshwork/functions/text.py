"""Text functions as columns; only chunking runs in Python, over Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Fixed value: the pattern of a link.
URL = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"

#: What parts tokens.
SPACE = r"[ \t\n\r\f\x0B]+"

# Words that are never keywords.
STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "or", "that", "the", "to", "was", "will", "with", "we", "you", "i", "me", "my", "this", "these", "those"]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_text(text: Column | str) -> Column:
    """White space runs become one space; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"\s+", " "))


def remove_urls(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), URL, "")


def remove_mentions(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), r"(?U)@\w+", "")


def normalize_whitespace(text: Column | str) -> Column:
    """Runs of spaces become one, of line feeds at most two; ends are trimmed."""
    spaced = F.regexp_replace(_c(text), " +", " ")
    return F.regexp_replace(F.regexp_replace(spaced, r"\n\n+", "\n\n"), r"^\s+|\s+$", "")


def truncate_text(text: Column | str, length: int = 1000, suffix: str = "...") -> Column:
    t = _c(text)
    return F.when(F.length(t) <= length, t).otherwise(F.concat(F.substring(t, 1, length - len(suffix)), F.lit(suffix)))


def combine_fields(*fields: Column | str, separator: str = " ") -> Column:
    """Trimmed, non-empty fields joined."""
    trimmed = F.array(*[F.trim(F.coalesce(_c(f), F.lit(""))) for f in fields])
    return F.array_join(F.filter(trimmed, lambda x: x != ""), separator)


def normalize_username(name: Column | str, domain: str = "company.com") -> Column:
    bare = F.ltrim(_c(name), F.lit("@"))
    return F.lower(F.when(F.contains(bare, F.lit("@")), bare).otherwise(F.concat(bare, F.lit(f"@{domain}"))))


def normalize_team_name(team: Column | str) -> Column:
    name = F.translate(F.lower(F.regexp_replace(_c(team), "^[@#]+", "")), "_", "-")
    return F.when(name.endswith("-team"), name).otherwise(F.concat(name, F.lit("-team")))


def is_email(text: Column | str) -> Column:
    return F.rlike(_c(text), F.lit(r"^[a-zA-Z0-9._-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"))


def email_domain(email: Column | str) -> Column:
    """What follows the @, in lower case; empty without one."""
    return F.lower(F.split_part(_c(email), F.lit("@"), F.lit(2)))


def is_mention(text: Column | str) -> Column:
    return F.rlike(_c(text), F.lit("^@[a-zA-Z0-9_-]+$"))


def is_channel(text: Column | str) -> Column:
    return F.rlike(_c(text), F.lit("^#[a-zA-Z0-9_-]+$"))


def tokens(text: Column | str) -> Column:
    """Lower-cased tokens between white space."""
    return F.array_remove(F.split(F.lower(F.coalesce(_c(text), F.lit(""))), SPACE), "")


def token_count(text: Column | str) -> Column:
    """How many tokens there are, without making them."""
    return F.regexp_count(F.coalesce(_c(text), F.lit("")), F.lit(r"[^ \t\n\r\f\x0B]+"))


def term_count(text: Column | str, term: str) -> Column:
    """How often a lower-case token occurs: texts without it are told by a plain search, the rest by a pattern."""
    lowered = F.lower(F.coalesce(_c(text), F.lit("")))
    pattern = rf"(?<![^ \t\n\r\f\x0B])\Q{term}\E(?![^ \t\n\r\f\x0B])"
    return F.when(F.contains(lowered, F.lit(term)), F.regexp_count(lowered, F.lit(pattern))).otherwise(0)


def token_estimate(text: Column | str) -> Column:
    """Words and single marks: a proxy for a model's token count that needs no vocabulary."""
    return F.regexp_count(F.coalesce(_c(text), F.lit("")), F.lit(r"\w+|[^\w\s]"))


def message_tokens(count: Column, messages: int | Column = 1) -> Column:
    """Tokens of a request: 4 for each message and 3 for the request besides its texts."""
    return count + 4 * (F.lit(messages) if isinstance(messages, int) else messages) + 3


def _cuts(text: str, size: int, overlap: int, least: int) -> Iterator[str]:
    if len(text) <= size:
        if text:
            yield text
        return
    sentence, space = re.compile(r"[.!?]\s"), re.compile(r"\s")
    start = 0
    while start < len(text):
        end = start + size
        if end < len(text):
            tail = end - int(size * 0.2)
            if (m := sentence.search(text, max(tail, start), end)) or (m := space.search(text, max(end - 50, start), end)):
                end = m.end()
        if len(piece := text[start:end].strip()) >= least:
            yield piece
        start = end - overlap if end - overlap > start else start + max(1, size // 2)


def chunk_text(size: int = 500, overlap: int = 50, least: int = 100):  # noqa: ANN201
    """UDF to an array of overlapping chunks that end at a sentence or word where one ends near."""

    @F.pandas_udf("array<string>")
    def chunks(text: pd.Series) -> pd.Series:
        return text.fillna("").map(lambda t: list(_cuts(t, size, overlap, least)))

    return chunks


def keywords(df: DataFrame, key: str, text: str, top: int = 10) -> DataFrame:
    """(key, word, n, rank): the most frequent words of each row; ties go to the first to occur."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("([a-z0-9_]+)"), F.lit(1))
    good = df.select(F.col(key).alias("key"), F.posexplode(words).alias("pos", "word")).where((F.length("word") > 2) & ~F.col("word").isin(STOPWORDS))
    counted = good.groupBy("key", "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    order = W.partitionBy("key").orderBy(F.desc("n"), "first")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(F.col("key").alias(key), "word", "n", "rank")

"""Filters over result rows. Empty sets don't filter; different kinds of filters all have to hold."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.functions.timefn import parse_iso


@dataclass
class SearchFilter:
    sources: list[str] = field(default_factory=list)
    channels: list[str] = field(default_factory=list)
    authors: list[str] = field(default_factory=list)
    date_from: datetime | str | None = None
    date_to: datetime | str | None = None
    metadata: dict[str, str] = field(default_factory=dict)

    def is_empty(self) -> bool:
        return not (self.sources or self.channels or self.authors or self.date_from or self.date_to or self.metadata)

    def to_dict(self) -> dict:
        return {k: v for k, v in vars(self).items() if v}

    def conditions(self, metadata: str = "metadata", timestamp: str = "timestamp") -> list[Column]:
        out = [F.col(c).isin(v) for c, v in (("source", self.sources), ("channel", self.channels), ("author", self.authors)) if v]
        ts = F.col(timestamp)
        out += [ts >= F.lit(self.date_from).cast("timestamp")] if self.date_from else []
        out += [ts <= F.lit(self.date_to).cast("timestamp")] if self.date_to else []
        return out + [F.col(metadata)[k] == v for k, v in self.metadata.items()]

    def apply(self, df: DataFrame, **columns: str) -> DataFrame:
        for condition in self.conditions(**columns):
            df = df.where(condition)
        return df


def filter_results(df: DataFrame, sources: list[str] | None = None, channels: list[str] | None = None, authors: list[str] | None = None, date_from: datetime | None = None, date_to: datetime | None = None) -> DataFrame:
    return SearchFilter(sources or [], channels or [], authors or [], date_from, date_to).apply(df)


def within(df: DataFrame, start: Column, end: Column, timestamp: str = "timestamp") -> DataFrame:
    """Rows from start to end, both included; times that can't be read go."""
    return df.where(parse_iso(F.col(timestamp).cast("string")).between(start, end))


def recent(df: DataFrame, reference: Column, days: int, timestamp: str = "timestamp") -> DataFrame:
    """Rows of the last days before the reference time."""
    return df.where(F.col(timestamp) >= reference - F.make_dt_interval(F.lit(days)))


def semi(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def numeric_id(text: Column, prefix: str = "msg_") -> Column:
    """Number of an id such as msg_12; null for anything else."""
    return F.nullif(F.regexp_extract(text, rf"^{prefix}(\d+)$", 1), F.lit("")).try_cast("bigint")

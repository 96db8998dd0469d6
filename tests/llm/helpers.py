"""Small tables with awkward rows."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark: SparkSession, texts: list[str | None], extra: bool = False) -> DataFrame:
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    if extra:  # names that operators use inside
        for name in ("h", "n", "row", "key", "rep", "part", "bucket", "start", "node", "component", "words"):
            df = df.selectExpr("*", f"'x' as {name}")
    return df


def words(seed: int, n: int, vocabulary: int = 400) -> list[str]:
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


AWKWARD = [None, "", " ", "\n\t", "a", "ä", "日本語 テスト", "x" * 70_000, "word " * 20_000, "same text here", "same text here", "\x00\x01", "١٢٣", "<|im_end|>"]

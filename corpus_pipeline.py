"""A corpus pipeline of five stages, each written as Parquet and read again before the next.

The stages pass rows with the columns of ``documents``; the last returns where each document lies in the packed
sequences. Filters and redaction run where the rows are, without a shuffle; only near-dedup moves texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.llm import decontaminate, language_id, minhash_dedup, packing, secret_scan
from meshwork.llm.common import read
from meshwork.plans.sieve import bits_of, parted
from meshwork.plans.staging import stage

#: A document stays if one language has at least this share of its words.
MIN_SCORE = 0.35


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a leading language: texts without letters, and even mixtures of several, go."""
    found = language_id.identify(docs, language_id.train(docs), into="_found")
    return found.where((F.col("_found.lang_pred") != "und") & (F.col("_found.score") >= MIN_SCORE)).drop("_found")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of texts that share 0.8 of their five-word shingles; repeated rows once.

    Rows without an id take part under a number made from their text, above all usual ids: they go where a row with
    an id says the same, and stay otherwise.
    """
    number = F.lit(1 << 62) + F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1))
    rows = docs.withColumn("_row", F.coalesce(F.col("doc_id").cast("bigint"), number))
    found = minhash_dedup.near_duplicates(rows, shingle=5, percent=80, doc_id="_row").groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("n"), F.bool_or("kept").alias("kept"))
    special = stage(found.where("n > 1 or not kept"), "special", narrow=True)
    # Rows that go or are repeated are told apart by a bounded table first: only texts it holds are shuffled.
    maybe, rest = parted(rows, "_row", bits_of(special, "_id"))
    kept = maybe.join(special.where("not kept"), F.col("_row") == F.col("_id"), "left_anti").dropDuplicates(["_row", "text"])
    return rest.unionByName(kept).drop("_row")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold ten consecutive words of a benchmark item."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by marks of their kind; every document stays."""
    found = secret_scan.redact_secrets(docs, into="_clean")
    new = {"text": F.col("_clean.redacted"), "n_chars": F.col("_clean.n_chars")}
    return found.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place every document in training sequences of several permitted lengths."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack),
]

#: Language mixtures, signatures and packing are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs

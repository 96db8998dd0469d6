"""Files: judgments (JSON array), queries (JSON lines), results (JSON lines, CSV, text table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QRELS = "query_id string, document_id string, relevance int, query_text string, document_content string, metadata map<string,string>"
QUERIES = "query_id string, query_text string, category string, expected_topics array<string>"


def _check(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        raise FileNotFoundError(path)


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    _check(spark, path)
    return spark.read.option("multiLine", True).schema(QRELS).json(path)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    _check(spark, path)
    return spark.read.schema(QUERIES).json(path)


def write_queries(queries: DataFrame, path: str) -> None:
    queries.write.mode("overwrite").json(path)


def write_results(results: DataFrame, path: str, kind: str = "json") -> None:
    if kind not in ("json", "csv"):
        raise ValueError("format must be json or csv")
    out = results.write.mode("overwrite")
    out.json(path) if kind == "json" else out.option("header", True).csv(path)


#: Most rows that ``export`` brings to the driver.
EXPORTED = 100_000


def export(results: DataFrame, kind: str = "dict") -> list[dict] | str | DataFrame:
    """A small table of results as dicts, JSON text, CSV text or an aligned text table; larger ones are refused."""
    few = results.limit(EXPORTED + 1)
    if kind == "dict":
        out = [r.asDict(recursive=True) for r in few.collect()]
    elif kind == "json":
        out = [r[0] for r in few.select(F.to_json(F.struct("*"))).collect()]
    elif kind in ("csv", "table"):
        out = few.toPandas()
    else:
        raise ValueError("format must be dict, json, csv or table")
    if len(out) > EXPORTED:
        raise ValueError(f"more than {EXPORTED} rows: write them to files")
    if kind == "json":
        return "[" + ",".join(out) + "]"
    return out if kind == "dict" else out.to_csv(index=False) if kind == "csv" else out.to_string(index=False, float_format=lambda x: f"{x:.4f}")


# Invented queries by category, in the order they are tried.
TEMPLATES = {
    "keyword": ["oauth", "deployment", "database migration", "rate limits", "token cache"],
    "question": ["how do we rotate keys", "who owns the billing service", "why did the deploy fail", "when is the next release", "where are the runbooks"],
    "semantic": ["moving sign-in to a single provider", "making search results more relevant", "keeping staging and production alike", "lowering the cost of storage", "speeding up the nightly build"],
    "phrase": ['"single sign on"', '"error budget"', '"feature flag"', '"on call"'],
    "boolean": ["cache and database", "login or signup", "api + schema", "mobile - web"],
}


def test_queries(messages: DataFrame, count: int = 50, key: str = "id", text: str = "content") -> DataFrame:
    """(query_id, query_text, category): the templates, then the first five words of messages, cut to ``count``."""
    spark = messages.sparkSession
    fixed = [(f"q{i:04d}", q, c, i) for i, (c, q) in enumerate((c, q) for c, qs in TEMPLATES.items() for q in qs)]
    known = spark.createDataFrame(fixed, "query_id string, query_text string, category string, _n bigint")
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    own = messages.select(F.concat(F.lit("m"), F.col(key).cast("string")).alias("query_id"), F.array_join(F.slice(words, 1, 5), " ").alias("query_text"), F.lit("generated").alias("category"), (F.col(key) + 1_000_000).alias("_n")).where("query_text <> ''")
    return known.unionByName(own).orderBy("_n").limit(count).drop("_n")

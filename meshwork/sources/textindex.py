"""A stored text index: postings by term, written once and read for the terms of a query only.

Terms of half of the documents or more weigh nothing in BM25, so of these only the first ``HEAD`` documents are kept,
which fill up short results; all other postings lie in files sorted by term, so a query's terms are found by the
files' statistics. A row holds all that its score needs but the two numbers of the whole collection.
"""

from __future__ import annotations

import hashlib
import json
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from meshwork.functions.text import tokens
from meshwork.operators import bm25
from meshwork.plans.staging import shared_dir, spread

#: Documents kept of a term that weighs nothing; results may be this long less the number of a query's terms.
HEAD = 1000


class TextIndex:
    """An index at ``path``: ``postings`` and ``common`` (term, doc_id, tf, dl, df), ``stats`` (one row)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> TextIndex:
        """Write the index: one shuffle of counted terms; statistics come from the same texts."""
        spark, path = docs.sparkSession, path.rstrip("/")
        rows = spread(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")))
        bm25.postings(rows, "doc_id", "text").write.mode("overwrite").parquet(f"{path}/_all")
        bm25.collection_stats(rows, "text").coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
        counted = spark.read.parquet(f"{path}/_all")
        dfs = counted.groupBy(F.col("term").alias("_t")).agg(F.count("*").alias("df"))
        whole = counted.join(dfs, F.col("term") == F.col("_t")).drop("_t")
        n = spark.read.parquet(f"{path}/stats").first()["n_docs"]
        weighty = F.col("df") * 2 < n
        whole.where(weighty).repartition("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        place = F.row_number().over(W.partitionBy("term").orderBy("doc_id"))
        whole.where(~weighty).withColumn("_p", place).where(F.col("_p") <= HEAD).drop("_p").coalesce(1).write.mode("overwrite").parquet(f"{path}/common")
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_all")
        fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(fs_path, True)
        return cls(spark, path)

    @classmethod
    def of(cls, spark: SparkSession, files: str, doc_id: str = "doc_id", text: str = "text") -> TextIndex:
        """The index of Parquet files, built in the shared folder unless one of the same files, sizes and times is there."""
        docs = spark.read.parquet(files)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        state = []
        for file in sorted(docs.inputFiles()):
            path = jvm.org.apache.hadoop.fs.Path(file)
            status = path.getFileSystem(conf).getFileStatus(path)
            state.append((file, status.getLen(), status.getModificationTime()))
        name = hashlib.sha256(json.dumps([state, doc_id, text, HEAD]).encode()).hexdigest()[:24]
        where = f"{shared_dir(spark)}/meshwork/index-{name}"
        done = jvm.org.apache.hadoop.fs.Path(f"{where}/common/_SUCCESS")
        return cls(spark, where) if done.getFileSystem(conf).exists(done) else cls.build(docs, where, doc_id, text)

    @cached_property
    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    @cached_property
    def common(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/common")

    @cached_property
    def stats(self) -> dict:
        return self.spark.read.parquet(f"{self.path}/stats").first().asDict()

    def _weight(self, k1: float, b: float) -> Column:
        n, mean = F.lit(self.stats["n_docs"]), F.lit(self.stats["avgdl"])
        return bm25.term_score(bm25.idf(n, F.col("df")), F.col("tf"), bm25.length_norm(F.col("dl"), mean, b), k1)

    def score(self, query: str, k1: float = bm25.K1, b: float = bm25.B) -> DataFrame:
        """(doc_id, score) of documents that hold a term of some weight, and of the first that hold another; sums of the same terms may differ in the last digits."""
        asked = query.lower().split()
        times = {t: asked.count(t) for t in asked}
        held = F.col("term").isin(*times) if times else F.lit(False)
        repeated = [t for t, c in times.items() if c > 1]
        factor = F.coalesce(*[F.when(F.col("term") == t, times[t]) for t in repeated], F.lit(1))
        rows = self.postings.where(held).unionByName(self.common.where(held))
        return rows.groupBy("doc_id").agg(F.sum(self._weight(k1, b) * factor).alias("score"))

    def score_queries(self, queries: DataFrame, k: int = 10, k1: float = bm25.K1, b: float = bm25.B) -> DataFrame:
        """(query_id, doc_id, score, rank) for a table of queries (query_id, query): one plan for all of them."""
        asked = queries.select("query_id", F.explode(tokens("query")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
        found = asked.join(self.postings, "term").unionByName(asked.join(self.common, "term"))
        total = found.groupBy("query_id", "doc_id").agg(F.sum(self._weight(k1, b) * F.col("times")).alias("score"))
        order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
        return total.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

"""Retrieval metrics. Strategies and queries are rows: one plan evaluates all of them.

Run: strategy, query_id, doc_id, rank. Judgments: query_id, doc_id, relevance (0 to 3).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

GROUP = ["strategy", "query_id"]


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Run with relevance; what nobody judged is 0. Of repeated judgments the largest counts."""
    known = qrels.groupBy("query_id", "doc_id").agg(F.max("relevance").alias("relevance"))
    return run.join(known, ["query_id", "doc_id"], "left").withColumn("relevance", F.coalesce("relevance", F.lit(0)))


def gain(relevance: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), relevance) - 1) / F.log2(rank + 1.0)


def metrics(rows: DataFrame, ks: tuple[int, ...] = (5, 10), qrels: DataFrame | None = None) -> DataFrame:
    """Per strategy and query: rr, ap, dcg@k, ndcg@k, p@k, r@k, f1@k, num_results.

    The ideal order and the number of relevant documents are those of the list itself, or of all judgments if
    ``qrels`` is given.
    """
    w = W.partitionBy(*GROUP)
    ideal = F.row_number().over(w.orderBy(F.desc("relevance"), "rank"))
    hits = F.sum((F.col("relevance") > 0).cast("int")).over(w.orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    x = rows.withColumn("_ideal", ideal).withColumn("_hits", hits)
    rel = F.col("relevance") > 0
    total = F.sum(rel.cast("int"))
    columns = [F.count("*").alias("num_results"), total.alias("_relevant"), F.coalesce(1.0 / F.min(F.when(rel, F.col("rank"))), F.lit(0.0)).alias("rr")]
    columns.append(F.coalesce(F.try_divide(F.sum(F.when(rel, F.col("_hits") / F.col("rank"))), total), F.lit(0.0)).alias("ap"))
    for k in ks:
        within = F.col("rank") <= k
        columns.append(F.coalesce(F.sum(F.when(within, gain(F.col("relevance"), F.col("rank")))), F.lit(0.0)).alias(f"dcg_{k}"))
        columns.append(F.coalesce(F.sum(F.when(F.col("_ideal") <= k, gain(F.col("relevance"), F.col("_ideal")))), F.lit(0.0)).alias(f"_idcg_{k}"))
        columns.append(F.sum((within & rel).cast("int")).alias(f"_found_{k}"))
    per = x.groupBy(*GROUP).agg(*columns)
    if qrels is not None:
        order = W.partitionBy("query_id").orderBy(F.desc("relevance"), "doc_id")
        best = qrels.groupBy("query_id", "doc_id").agg(F.max("relevance").alias("relevance")).withColumn("i", F.row_number().over(order))
        best = best.groupBy("query_id").agg(F.sum((F.col("relevance") > 0).cast("int")).alias("_all"), *[F.coalesce(F.sum(F.when(F.col("i") <= k, gain(F.col("relevance"), F.col("i")))), F.lit(0.0)).alias(f"_best_{k}") for k in ks])
        per = per.join(best, "query_id", "left").withColumn("_relevant", F.coalesce("_all", F.lit(0))).withColumns({f"_idcg_{k}": F.coalesce(f"_best_{k}", F.lit(0.0)) for k in ks})
    out = per
    for k in ks:
        p, r = F.col(f"_found_{k}") / F.lit(k), F.coalesce(F.try_divide(F.col(f"_found_{k}"), F.col("_relevant")), F.lit(0.0))
        out = out.withColumn(f"ndcg_{k}", F.coalesce(F.try_divide(F.col(f"dcg_{k}"), F.col(f"_idcg_{k}")), F.lit(0.0)))
        out = out.withColumn(f"p_{k}", p).withColumn(f"r_{k}", r).withColumn(f"f1_{k}", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))
    return out.select(*GROUP, "num_results", "rr", "ap", *[f"{m}_{k}" for k in ks for m in ("dcg", "ndcg", "p", "r", "f1")])


def aggregate(per_query: DataFrame) -> DataFrame:
    """Mean of every metric by strategy (nulls don't count), queries and results."""
    names = [c for c in per_query.columns if c not in (*GROUP, "num_results")]
    renamed = {"rr": "mrr", "ap": "map"}
    return per_query.groupBy("strategy").agg(F.count("*").alias("queries"), F.sum("num_results").alias("results"), *[F.avg(n).alias(renamed.get(n, n)) for n in names])


def compare(per_strategy: DataFrame, baseline: str, by: str = "mrr") -> DataFrame:
    """Adds the gain over a baseline in percent and marks the best strategy (ties: the first by name)."""
    base = per_strategy.where(F.col("strategy") == baseline).select(F.col(by).alias("_base"))
    best = per_strategy.agg(F.max_by("strategy", F.struct(by, F.transform(F.split("strategy", ""), lambda c: -F.ascii(c)))).alias("_best"))
    rows = per_strategy.crossJoin(F.broadcast(best)).join(F.broadcast(base), F.lit(True), "left")
    return rows.withColumn("gain_percent", F.coalesce(F.try_divide((F.col(by) - F.col("_base")) * 100, F.col("_base")), F.lit(0.0))).withColumn("is_best", F.col("strategy") == F.col("_best")).drop("_base", "_best")


def check_judgments(qrels: DataFrame) -> DataFrame:
    """Raises on a relevance outside 0 to 3 when read."""
    ok = F.col("relevance").between(0, 3)
    return qrels.withColumn("relevance", F.when(ok, F.col("relevance")).otherwise(F.raise_error(F.lit("relevance must be 0 to 3")).cast("int")))


def judgment_counts(qrels: DataFrame) -> DataFrame:
    return qrels.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("judgments"))


def unknown_queries(run: DataFrame, qrels: DataFrame) -> DataFrame:
    return run.select("query_id").distinct().join(qrels, "query_id", "left_anti")


def paired_difference(per_query: DataFrame, a: str, b: str, metric: str = "rr") -> DataFrame:
    """One row: mean difference of two strategies over shared queries, and its t statistic."""
    one = lambda s, name: per_query.where(F.col("strategy") == s).select("query_id", F.col(metric).alias(name))
    d = one(a, "x").join(one(b, "y"), "query_id").select((F.col("x") - F.col("y")).alias("d"))
    return d.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.try_divide(F.avg("d"), F.stddev_samp("d") / F.sqrt(F.count("*"))).alias("t"))

"""Queries that evaluate retrieval, and general joins, aggregates and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.catalog.registry import MESSAGES, messages, query, read, sources, vectors
from meshwork.catalog.retrieval import BATCH, RRF, WEIGHTED, fused_run, keyword_run, semantic_run
from meshwork.operators import evaluation, filters
from meshwork.plans.staging import stage

_QRELS = "qrels AS (SELECT item_id AS query_id, doc_id, CAST(quality + 1 - toxic AS INTEGER) AS relevance FROM benchmark JOIN labels ON doc_id % 5 = item_id % 5)"
_RUNS = f"""{BATCH}, {RRF}, {WEIGHTED}, {_QRELS},
run AS (SELECT 'semantic' AS strategy, query_id, doc_id, rank FROM semantic UNION ALL SELECT 'bm25', query_id, doc_id, rank FROM keyword
  UNION ALL SELECT 'hybrid_rrf', query_id, doc_id, rank FROM rrf_run UNION ALL SELECT 'hybrid_weighted', query_id, doc_id, rank FROM weighted_run),
j AS (SELECT run.*, coalesce(relevance, 0) AS rel FROM run LEFT JOIN qrels USING (query_id, doc_id)),
w AS (SELECT *, row_number() OVER (PARTITION BY strategy, query_id ORDER BY rel DESC, rank) AS ideal, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY strategy, query_id ORDER BY rank) AS hits FROM j),
pq AS (SELECT strategy, query_id, count(*) AS num_results, coalesce(1.0 / min(rank) FILTER (rel > 0), 0)::DOUBLE AS rr, coalesce(sum(hits / rank) FILTER (rel > 0) / nullif(count(*) FILTER (rel > 0), 0), 0) AS ap,
  coalesce(sum((2 ** rel - 1) / log2(rank + 1)) FILTER (rank <= 5), 0) AS dcg_5, coalesce(sum((2 ** rel - 1) / log2(ideal + 1)) FILTER (ideal <= 5), 0) AS idcg_5, count(*) FILTER (rank <= 5 AND rel > 0) AS f5, count(*) FILTER (rel > 0) AS total FROM w GROUP BY 1, 2),
m AS (SELECT strategy, query_id, num_results, rr, ap, dcg_5, coalesce(dcg_5 / nullif(idcg_5, 0), 0) AS ndcg_5, f5 / 5.0::DOUBLE AS p_5, coalesce(f5 / nullif(total, 0), 0) AS r_5,
  coalesce(2 * (f5 / 5.0::DOUBLE) * (f5 / nullif(total, 0)) / nullif(f5 / 5.0::DOUBLE + f5 / nullif(total, 0), 0), 0) AS f1_5 FROM pq)"""


def qrels(spark: SparkSession, d: str) -> DataFrame:
    """Labels as judgments of the items whose number ends alike."""
    items = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 5).alias("k"))
    marked = read(spark, d, "labels").select("doc_id", (F.col("quality") + 1 - F.col("toxic")).cast("int").alias("relevance"), (F.col("doc_id") % 5).alias("k"))
    return items.join(marked, "k").select("query_id", "doc_id", "relevance")


def runs(spark: SparkSession, d: str) -> DataFrame:
    semantic, keyword = stage(semantic_run(spark, d), "semantic"), stage(keyword_run(spark, d), "keyword")
    parts = {"semantic": semantic, "bm25": keyword, "hybrid_rrf": fused_run(semantic, keyword, "rrf"), "hybrid_weighted": fused_run(semantic, keyword, "weighted")}
    out = None
    for name, run in parts.items():
        one = run.select(F.lit(name).alias("strategy"), "query_id", "doc_id", "rank")
        out = one if out is None else out.unionByName(one)
    return stage(out, "runs")


_METRICS = ("rr", "ap", "dcg_5", "ndcg_5", "p_5", "r_5", "f1_5")


@query(f"WITH {_RUNS} SELECT strategy, query_id, num_results, {', '.join(f'round({x}, 6) AS {x}' for x in _METRICS)} FROM m")
def ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    per = evaluation.metrics(evaluation.judged(runs(spark, d), qrels(spark, d)), (5,))
    return per.select("strategy", "query_id", "num_results", *[F.round(x, 6).alias(x) for x in _METRICS])


@query(f"""WITH {_RUNS}, s AS (SELECT strategy, count(*) AS queries, CAST(sum(num_results) AS BIGINT) AS results, avg(rr) AS mrr, avg(ap) AS map, avg(ndcg_5) AS ndcg_5, avg(p_5) AS p_5 FROM m GROUP BY 1)
SELECT strategy, queries, results, round(mrr, 6) AS mrr, round(map, 6) AS map, round(ndcg_5, 6) AS ndcg_5, round(p_5, 6) AS p_5,
  round((mrr - (SELECT mrr FROM s WHERE strategy = 'semantic')) * 100 / (SELECT mrr FROM s WHERE strategy = 'semantic'), 4) AS gain_percent, strategy = (SELECT strategy FROM s ORDER BY mrr DESC, strategy LIMIT 1) AS is_best FROM s""")
def strategy_compare(spark: SparkSession, d: str) -> DataFrame:
    per = evaluation.metrics(evaluation.judged(runs(spark, d), qrels(spark, d)), (5,))
    found = evaluation.compare(stage(evaluation.aggregate(per), "strategies"), "semantic")
    return found.select("strategy", "queries", "results", *[F.round(x, 6).alias(x) for x in ("mrr", "map", "ndcg_5", "p_5")], F.round("gain_percent", 4).alias("gain_percent"), "is_best")


@query(f"""WITH {_RUNS}, b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS i FROM qrels), best AS (SELECT query_id, sum((2 ** relevance - 1) / log2(i + 1)) FILTER (i <= 5) AS idcg, count(*) FILTER (relevance > 0) AS total FROM b GROUP BY 1)
SELECT strategy, query_id, round(coalesce(dcg_5 / nullif(idcg, 0), 0), 6) AS ndcg_5, round(coalesce(f5 / nullif(best.total, 0), 0), 6) AS r_5 FROM pq LEFT JOIN best USING (query_id)""")
def metrics_against_judgments(spark: SparkSession, d: str) -> DataFrame:
    q = qrels(spark, d)
    per = evaluation.metrics(evaluation.judged(runs(spark, d), q), (5,), q)
    return per.select("strategy", "query_id", F.round("ndcg_5", 6).alias("ndcg_5"), F.round("r_5", 6).alias("r_5"))


@query(f"WITH {_RUNS}, x AS (SELECT a.rr - b.rr AS d FROM m a JOIN m b USING (query_id) WHERE a.strategy = 'hybrid_rrf' AND b.strategy = 'bm25') SELECT count(*) AS n, round(avg(d), 6) AS mean, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 5) AS t FROM x")
def paired_difference(spark: SparkSession, d: str) -> DataFrame:
    per = evaluation.metrics(evaluation.judged(runs(spark, d), qrels(spark, d)), (5,))
    found = evaluation.paired_difference(per, "hybrid_rrf", "bm25")
    return found.select("n", F.round("mean", 6).alias("mean"), F.round("t", 5).alias("t"))


@query(f"WITH {_QRELS} SELECT count(DISTINCT query_id) AS queries, count(*) AS judgments FROM qrels")
def judgment_counts(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.judgment_counts(qrels(spark, d))


@query("SELECT DISTINCT conv_id AS query_id FROM conversations WHERE conv_id NOT IN (SELECT item_id FROM benchmark)")
def unknown_queries(spark: SparkSession, d: str) -> DataFrame:
    asked = read(spark, d, "conversations").select(F.col("conv_id").alias("query_id"))
    return evaluation.unknown_queries(asked, read(spark, d, "benchmark").select(F.col("item_id").alias("query_id")))


@query(f"WITH {MESSAGES} SELECT n_name AS source, channel, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars FROM messages JOIN nation ON source_id = n_nationkey GROUP BY 1, 2")
def messages_by_source(spark: SparkSession, d: str) -> DataFrame:
    m, s = messages(spark, d), sources(spark, d)
    both = m.join(s, m.source_id == s.id)
    return both.groupBy(F.col("type").alias("source"), "channel").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


@query("SELECT source AS channel, lang, count(*) AS n, count(*) FILTER (n_chars >= 2000) AS long_ FROM documents GROUP BY 1, 2")
def channel_counts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").groupBy(F.col("source").alias("channel"), "lang").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") >= 2000).alias("long_"))


@query("SELECT doc_id, vec_id IS NOT NULL AS has_vector, coalesce(label, -1) AS label FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def vectors_of_messages(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id")
    v = read(spark, d, "embeddings").select("vec_id", "label")
    return docs.join(v, docs.doc_id == v.vec_id, "left").select("doc_id", F.col("vec_id").isNotNull().alias("has_vector"), F.coalesce("label", F.lit(-1)).alias("label"))


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def semi_filter(spark: SparkSession, d: str) -> DataFrame:
    return filters.semi(read(spark, d, "documents").select("doc_id"), read(spark, d, "labels").where("toxic = 1"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels"), "doc_id", "left_anti")


@query(f"WITH {MESSAGES} SELECT id, author FROM messages ORDER BY timestamp DESC, id LIMIT 100")
def latest_messages(spark: SparkSession, d: str) -> DataFrame:
    from meshwork.sources.stores import latest

    return latest(messages(spark, d).select("id", "author", "timestamp"), 100).select("id", "author")


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, count(DISTINCT event_type) AS n FROM events GROUP BY user_id")
def distinct_sets(spark: SparkSession, d: str) -> DataFrame:
    sets = read(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("k"))
    return sets.select("user_id", F.array_join("k", ",").alias("kinds"), F.size("k").cast("bigint").alias("n"))


@query("SELECT doc_id FROM labels UNION SELECT vec_id FROM embeddings")
def union_ids(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "labels").select("doc_id").union(read(spark, d, "embeddings").select("vec_id")).distinct()


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{\"k\":' || json_extract_string(props, '$.k') || ',\"t\":\"' || event_type || '\"}' AS packed FROM events")
def parse_json(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").withColumn("p", F.from_json("props", "k bigint"))
    return rows.select("event_id", "p.k", F.to_json(F.struct("p.k", F.col("event_type").alias("t"))).alias("packed"))


@query("WITH k AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, CAST(sum(n) AS BIGINT) AS reactions, count(*) AS kinds FROM k GROUP BY 1")
def reaction_sums(spark: SparkSession, d: str) -> DataFrame:
    kinds = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return kinds.select("user_id", F.aggregate(F.map_values("m"), F.lit(0).cast("bigint"), lambda s, x: s + x).alias("reactions"), F.size("m").cast("bigint").alias("kinds"))


@query("""SELECT c_custkey, count(o_orderkey) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS spent FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def customer_orders(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("spent"))
    rows = read(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left")
    return rows.select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.round(F.coalesce("spent", F.lit(0.0)), 2).alias("spent"))


@query("""WITH x AS (SELECT vec_id, label FROM embeddings) SELECT a.label AS a, b.label AS b, count(*) AS n FROM x a JOIN x b ON a.vec_id % 50 = b.vec_id % 50 AND a.label < b.label GROUP BY 1, 2""")
def label_pairs(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d).select((F.col("id") % 50).alias("k"), F.col("label").cast("int").alias("l")).groupBy("k", "l").agg(F.count("*").alias("n"))
    both = v.alias("x").join(v.alias("y"), (F.col("x.k") == F.col("y.k")) & (F.col("x.l") < F.col("y.l")))
    return both.groupBy(F.col("x.l").alias("a"), F.col("y.l").alias("b")).agg(F.sum(F.col("x.n") * F.col("y.n")).alias("n"))

"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from meshwork.catalog.registry import MESSAGES, TOKENS, messages, query, read, sources, vectors
from meshwork.functions import vector
from meshwork.operators import bm25, filters, fusion, search
from meshwork.sources.textindex import TextIndex

_DOCS = f"d AS (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents), stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d)"
#: One query: the first five words of the first benchmark item.
_ONE = f"q AS (SELECT unnest(list_slice({TOKENS.format('text')}, 1, 5)) AS term FROM benchmark WHERE item_id = 0), asked AS (SELECT term, count(*) AS times FROM q GROUP BY term)"
SCORED = f"""{_DOCS}, {_ONE},
tf AS (SELECT doc_id, len(t) AS dl, term, times, len(list_filter(t, lambda x: x = term)) AS tf FROM d, asked),
df AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY term),
parts AS (SELECT doc_id, dl, term, times, tf, df, greatest(0, ln((n - df + 0.5) / (df + 0.5))) AS idf,
  greatest(0, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) * times AS score FROM tf JOIN df USING (term), stats),
scored AS (SELECT doc_id, sum(score) AS score FROM parts GROUP BY doc_id HAVING sum(tf) > 0)"""


#: Ranks as shown: 0 where a list misses a document.
_RANKS = ["coalesce(semantic_rank, 0) AS semantic_rank", "coalesce(keyword_rank, 0) AS keyword_rank"]


def first_words(spark: SparkSession, d: str, item: int = 0) -> str:
    row = read(spark, d, "benchmark").where(F.col("item_id") == item).select("text").first()
    return " ".join((row[0] if row else "").lower().split()[:5])


def index(spark: SparkSession, d: str) -> TextIndex:
    """The stored index of the documents."""
    return TextIndex.of(spark, f"{d}/documents.parquet")


def scored(spark: SparkSession, d: str, explain: bool = False) -> DataFrame:
    return bm25.score(read(spark, d, "documents"), first_words(spark, d), explain=explain)


@query(f"WITH {SCORED} SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY round(score, 9) DESC, doc_id LIMIT 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    top = index(spark, d).score(first_words(spark, d)).withColumn("exact", F.round("score", 9)).orderBy(F.desc("exact"), "doc_id").limit(10)
    return top.select("doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH {SCORED}, top AS (SELECT doc_id FROM scored ORDER BY round(score, 9) DESC, doc_id LIMIT 10)
SELECT doc_id, term, CAST(tf AS BIGINT) AS tf, CAST(coalesce(df, 0) AS BIGINT) AS df, round(idf, 6) AS idf, round(score, 6) AS score FROM parts JOIN top USING (doc_id)""")
def bm25_explain(spark: SparkSession, d: str) -> DataFrame:
    top = scored(spark, d, explain=True).orderBy(F.desc(F.round("score", 9)), "doc_id").limit(10)
    return top.select("doc_id", F.explode("terms").alias("x")).select("doc_id", "x.term", "x.tf", "x.df", F.round("x.idf", 6).alias("idf"), F.round("x.score", 6).alias("score"))


@query(f"WITH d AS (SELECT len({TOKENS.format('text')}) AS n FROM documents) SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens, round(avg(n), 6) AS avgdl FROM d")
def collection_stats(spark: SparkSession, d: str) -> DataFrame:
    return bm25.collection_stats(read(spark, d, "documents"), "text").withColumn("avgdl", F.round("avgdl", 6))


@query(f"WITH t AS (SELECT DISTINCT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents) SELECT term, count(*) AS df FROM t GROUP BY term")
def term_df(spark: SparkSession, d: str) -> DataFrame:
    return bm25.document_frequencies(read(spark, d, "documents"), "text")


@query(f"WITH t AS (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents) SELECT term, doc_id, count(*) AS tf FROM t GROUP BY term, doc_id")
def postings(spark: SparkSession, d: str) -> DataFrame:
    return bm25.postings(read(spark, d, "documents"), "doc_id", "text").select("term", "doc_id", "tf")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


BATCH = f"""{_DOCS},
q AS (SELECT item_id AS query_id, unnest({TOKENS.format('text')}) AS term FROM benchmark),
asked AS (SELECT query_id, term, count(*) AS times FROM q GROUP BY query_id, term),
flat AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM flat WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
kw AS (SELECT query_id, doc_id, sum(greatest(0, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) * times) AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term), stats GROUP BY query_id, doc_id),
keyword AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM kw QUALIFY rank <= 10),
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sims AS (SELECT p.vec_id AS query_id, q.vec_id AS doc_id, greatest(0, least(1, list_cosine_similarity(p.e, q.e))) AS score FROM v p, v q WHERE p.vec_id IN (SELECT item_id FROM benchmark)),
semantic AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sims QUALIFY rank <= 10)"""


def keyword_run(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).score_queries(_queries(spark, d))


def semantic_run(spark: SparkSession, d: str) -> DataFrame:
    items = read(spark, d, "benchmark").select(F.col("item_id").alias("vec_id"))
    v = read(spark, d, "embeddings").select("vec_id", "embedding")
    asked = v.join(items, "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return search.knn_queries(v, asked, 10)


@query(f"WITH {BATCH} SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM keyword")
def bm25_batch(spark: SparkSession, d: str) -> DataFrame:
    return keyword_run(spark, d).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {BATCH} SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM keyword")
def bm25_scan(spark: SparkSession, d: str) -> DataFrame:
    """The same without an index: one pass over the texts, for the terms asked."""
    return bm25.score_queries(read(spark, d, "documents"), _queries(spark, d)).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {BATCH} SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM semantic")
def knn_batch(spark: SparkSession, d: str) -> DataFrame:
    return semantic_run(spark, d).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT e FROM v WHERE vec_id = 0)
SELECT vec_id AS doc_id, round(list_cosine_similarity(v.e, q.e), 6) AS score FROM v, q WHERE label IN (1, 2, 3) ORDER BY round(list_cosine_similarity(v.e, q.e), 9) DESC, vec_id LIMIT 10""")
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in v.where("vec_id = 0").select("embedding").first()[0]])
    return search.knn(v, q, 10, "vec_id", where=F.col("label").isin(1, 2, 3)).select("doc_id", F.round("score", 6).alias("score"))


RRF = """rrf AS (SELECT coalesce(s.query_id, k.query_id) AS query_id, coalesce(s.doc_id, k.doc_id) AS doc_id,
  coalesce(1.0 / (60 + s.rank), 0) + coalesce(1.0 / (60 + k.rank), 0) AS score, s.rank AS sr, k.rank AS kr
  FROM semantic s FULL JOIN keyword k ON s.query_id = k.query_id AND s.doc_id = k.doc_id),
rrf_run AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, sr NULLS LAST, kr NULLS LAST, doc_id) AS rank FROM rrf QUALIFY rank <= 10)"""
WEIGHTED = """sn AS (SELECT *, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-10 THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm FROM semantic WINDOW w AS (PARTITION BY query_id)),
kn AS (SELECT *, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-10 THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm FROM keyword WINDOW w AS (PARTITION BY query_id)),
weighted AS (SELECT coalesce(s.query_id, k.query_id) AS query_id, coalesce(s.doc_id, k.doc_id) AS doc_id,
  0.7 * coalesce(s.norm, 0) + 0.3 * coalesce(k.norm, 0) AS score, s.rank AS sr, k.rank AS kr
  FROM sn s FULL JOIN kn k ON s.query_id = k.query_id AND s.doc_id = k.doc_id),
weighted_run AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, sr NULLS LAST, kr NULLS LAST, doc_id) AS rank FROM weighted QUALIFY rank <= 10)"""


def fused_run(semantic: DataFrame, keyword: DataFrame, kind: str) -> DataFrame:
    fuse = fusion.rrf if kind == "rrf" else fusion.weighted
    both = fuse(semantic, keyword, on=("query_id", "doc_id"))
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.asc_nulls_last("semantic_rank"), F.asc_nulls_last("keyword_rank"), "doc_id")
    return both.withColumn("rank", F.row_number().over(order)).where("rank <= 10")


@query(f"WITH {BATCH}, {RRF} SELECT query_id, doc_id, round(score, 6) AS score, CAST(coalesce(sr, 0) AS INTEGER) AS semantic_rank, CAST(coalesce(kr, 0) AS INTEGER) AS keyword_rank, CAST(rank AS INTEGER) AS rank FROM rrf_run")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return fused_run(semantic_run(spark, d), keyword_run(spark, d), "rrf").select("query_id", "doc_id", F.round("score", 6).alias("score"), *map(F.expr, _RANKS), "rank")


@query(f"WITH {BATCH}, {WEIGHTED} SELECT query_id, doc_id, round(score, 6) AS score, CAST(coalesce(sr, 0) AS INTEGER) AS semantic_rank, CAST(coalesce(kr, 0) AS INTEGER) AS keyword_rank, CAST(rank AS INTEGER) AS rank FROM weighted_run")
def weighted_fusion(spark: SparkSession, d: str) -> DataFrame:
    return fused_run(semantic_run(spark, d), keyword_run(spark, d), "weighted").select("query_id", "doc_id", F.round("score", 6).alias("score"), *map(F.expr, _RANKS), "rank")


@query("""SELECT user_id, max(value) AS value, arg_max(event_id, struct_pack(v := value, e := -event_id)) AS event_id FROM events GROUP BY user_id""")
def dedupe_keep_max(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").select("user_id", "value", "event_id", (-F.col("event_id")).alias("tie"))
    best = rows.groupBy("user_id").agg(F.max_by(F.struct("value", "event_id"), F.struct("value", "tie")).alias("x"))
    return best.select("user_id", "x.value", "x.event_id")


@query("SELECT event_id, value FROM events WHERE coalesce(value, 0) >= 100")
def threshold_filter(spark: SparkSession, d: str) -> DataFrame:
    return fusion.threshold(read(spark, d, "events"), 100.0, "value").select("event_id", "value")


@query(f"""WITH {SCORED}, {MESSAGES}, top AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored WHERE score > 0 QUALIFY rank <= 40)
SELECT id AS message_id, n_name AS source, channel, author, timestamp, round(score, 6) AS score, CAST(rank AS INTEGER) AS keyword_rank
FROM top JOIN messages ON id = doc_id JOIN nation ON source_id = n_nationkey
WHERE channel IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5') AND timestamp BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-28'
ORDER BY round(score, 9) DESC, rank LIMIT 20""")
def search_filtered(spark: SparkSession, d: str) -> DataFrame:
    wanted = filters.SearchFilter(channels=[f"src{i}" for i in range(6)], date_from="2024-01-03 00:00:00", date_to="2024-01-28 00:00:00")
    request = search.SearchRequest(first_words(spark, d), limit=20, ranking_strategy="bm25", filter=wanted)
    found = search.search(request, messages(spark, d), sources(spark, d), index=index(spark, d))
    return found.select("message_id", "source", "channel", "author", "timestamp", F.round("score", 6).alias("score"), "keyword_rank")


@query(f"""WITH {SCORED}, {MESSAGES}, kw AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored WHERE score > 0 QUALIFY rank <= 20),
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), qv AS (SELECT e FROM v WHERE vec_id = 0),
near AS (SELECT vec_id AS doc_id, list_cosine_similarity(v.e, qv.e) AS score FROM v, qv),
sem AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM near QUALIFY rank <= 20),
both_ AS (SELECT coalesce(s.doc_id, k.doc_id) AS doc_id, coalesce(1.0 / (60 + s.rank), 0) + coalesce(1.0 / (60 + k.rank), 0) AS score, s.rank AS sr, k.rank AS kr
  FROM (SELECT * FROM sem WHERE score >= 0.1) s FULL JOIN kw k ON s.doc_id = k.doc_id)
SELECT id AS message_id, n_name AS source, channel, round(score, 6) AS score, CAST(coalesce(sr, 0) AS INTEGER) AS semantic_rank, CAST(coalesce(kr, 0) AS INTEGER) AS keyword_rank
FROM both_ JOIN messages ON id = doc_id JOIN nation ON source_id = n_nationkey ORDER BY score DESC, sr NULLS LAST, kr NULLS LAST, id LIMIT 10""")
def search_hybrid(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    q = [float(x) for x in v.where("id = 0").select("embedding").first()[0]]
    request = search.SearchRequest(first_words(spark, d), q, threshold=0.1, ranking_strategy="hybrid_rrf")
    found = search.search(request, messages(spark, d), sources(spark, d), v, index(spark, d))
    return found.select("message_id", "source", "channel", F.round("score", 6).alias("score"), *map(F.expr, _RANKS))


@query("SELECT count(*) AS messages, (SELECT count(*) FROM embeddings) AS vectors FROM documents")
def search_health(spark: SparkSession, d: str) -> DataFrame:
    return search.health(read(spark, d, "documents"), read(spark, d, "embeddings"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT e FROM v WHERE vec_id = 1)
SELECT round(avg(greatest(0, list_cosine_similarity(v.e, q.e))), 6) AS avg_similarity FROM v, q""")
def average_similarity(spark: SparkSession, d: str) -> DataFrame:
    from meshwork.operators.cluster import average_similarity as mean

    v = read(spark, d, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in v.where("vec_id = 1").select("embedding").first()[0]])
    return mean(v, q).select(F.round("avg_similarity", 6).alias("avg_similarity"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT e FROM v WHERE vec_id = 1)
SELECT vec_id AS id, round(list_cosine_similarity(v.e, q.e), 6) AS max_similarity FROM v, q WHERE vec_id <> 1 ORDER BY list_cosine_similarity(v.e, q.e) DESC, vec_id LIMIT 1""")
def max_similarity(spark: SparkSession, d: str) -> DataFrame:
    from meshwork.operators.cluster import max_similarity as best

    v = read(spark, d, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in v.where("vec_id = 1").select("embedding").first()[0]])
    return best(v.where("vec_id <> 1"), q, "vec_id").select("id", F.round("max_similarity", 6).alias("max_similarity"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: (x * 2) * (x * 2)))), 5) AS norm FROM v""")
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    doubled = F.transform(vector.as_double("embedding"), lambda x: x * 2)
    return read(spark, d, "embeddings").select("vec_id", F.round(vector.norm(doubled), 5).alias("norm"))

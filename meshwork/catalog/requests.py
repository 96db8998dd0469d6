"""Queries on search requests, stores, rules and single functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.catalog.registry import MESSAGES, REFERENCE, messages, query, read, reference, sources, vectors
from meshwork.catalog.retrieval import SCORED, first_words, index
from meshwork.functions import features, timefn, vector
from meshwork.operators import filters, search
from meshwork.operators.validate import evidence_quality, validate, verification_quality
from meshwork.plans.staging import new_path
from meshwork.sources import stores

# --- search requests

_NEAR = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), qv AS (SELECT e FROM v WHERE vec_id = 0),
near AS (SELECT vec_id AS doc_id, greatest(0, list_cosine_similarity(v.e, qv.e)) AS score FROM v, qv),
sem AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM near QUALIFY rank <= 20)"""
_KEYWORD = "kw AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored WHERE score > 0 QUALIFY rank <= 20)"
_SHOWN = "id AS message_id, n_name AS source, channel, round(score, 6) AS score, CAST(coalesce(sr, 0) AS INTEGER) AS semantic_rank, CAST(coalesce(kr, 0) AS INTEGER) AS keyword_rank"
_JOINED = "JOIN messages ON id = doc_id JOIN nation ON source_id = n_nationkey ORDER BY round(score, 9) DESC, sr NULLS LAST, kr NULLS LAST, id LIMIT 10"


def _asked(spark: SparkSession, d: str, strategy: str, operator: str = "", **more: object) -> DataFrame:
    v = vectors(spark, d)
    q = [float(x) for x in v.where("id = 0").select("embedding").first()[0]]
    request = search.SearchRequest(f"{operator} {first_words(spark, d)}", q, ranking_strategy=strategy, **more)
    found = search.search(request, messages(spark, d), sources(spark, d), v, index(spark, d))
    blank = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return found.select("message_id", "source", "channel", F.round("score", 6).alias("score"), blank("semantic_rank"), blank("keyword_rank"))


@query(f"WITH {SCORED}, {MESSAGES}, {_KEYWORD}, alone AS (SELECT *, NULL AS sr, rank AS kr FROM kw) SELECT {_SHOWN} FROM alone {_JOINED}")
def search_auto(spark: SparkSession, d: str) -> DataFrame:
    """A request that begins with an operator, whatever its words: the parser takes it for a boolean one and recommends BM25."""
    return _asked(spark, d, "auto", operator="+")


@query(f"WITH {MESSAGES}, {_NEAR}, alone AS (SELECT *, rank AS sr, NULL AS kr FROM sem WHERE score >= 0.2) SELECT {_SHOWN} FROM alone {_JOINED}")
def search_semantic(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d, "semantic", threshold=0.2)


@query(f"""WITH {SCORED}, {MESSAGES}, {_KEYWORD}, {_NEAR},
s AS (SELECT *, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS norm FROM sem),
k AS (SELECT *, CASE WHEN max(score) OVER () - min(score) OVER () < 1e-10 THEN 1 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS norm FROM kw),
both_ AS (SELECT coalesce(s.doc_id, k.doc_id) AS doc_id, 0.6 * coalesce(s.norm, 0) + 0.4 * coalesce(k.norm, 0) AS score, s.rank AS sr, k.rank AS kr FROM s FULL JOIN k ON s.doc_id = k.doc_id)
SELECT {_SHOWN} FROM both_ {_JOINED}""")
def search_weighted(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d, "hybrid_weighted", semantic_weight=0.6, keyword_weight=0.4)


@query(f"""WITH {SCORED}, {MESSAGES}, top AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM scored JOIN messages ON id = doc_id WHERE score > 0
  AND channel IN ('src0', 'src1') AND timestamp BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-28' QUALIFY rank <= 40)
SELECT id AS message_id, n_name AS source, channel, round(score, 6) AS score, CAST(rank AS INTEGER) AS keyword_rank FROM top JOIN nation ON source_id = n_nationkey ORDER BY rank LIMIT 20""")
def search_prefiltered(spark: SparkSession, d: str) -> DataFrame:
    """Filtered before ranking; statistics still cover all messages."""
    wanted = filters.SearchFilter(channels=["src0", "src1"], date_from="2024-01-03 00:00:00", date_to="2024-01-28 00:00:00")
    request = search.SearchRequest(first_words(spark, d), limit=20, ranking_strategy="bm25", filter=wanted, prefilter=True)
    found = search.search(request, messages(spark, d), sources(spark, d))
    return found.select("message_id", "source", "channel", F.round("score", 6).alias("score"), "keyword_rank")


# --- stores


@query(f"""WITH {MESSAGES} SELECT id, source_id, CASE WHEN channel = 'src1' THEN 'moved' ELSE channel END AS channel, author FROM messages
WHERE channel <> 'src3' AND id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def store_messages(spark: SparkSession, d: str) -> DataFrame:
    """A message store made, appended to twice, upserted (the newest of two versions stays), and deleted from by condition and by ids."""
    table = stores.Table(spark, new_path(spark, "store"), stores.MESSAGES)
    rows = messages(spark, d).withColumn("thread_id", F.lit(None).cast("string"))
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    table.create()
    table.append(rows.where(english))
    table.append(rows.where(~english))
    old = rows.where("channel = 'src1'").withColumn("channel", F.lit("stale"))
    new = old.withColumns({"channel": F.lit("moved"), "timestamp": F.col("timestamp") + F.expr("interval 1 day")})
    table.upsert(old.unionByName(new).drop("lang"), "id", F.col("timestamp"))
    table.delete(F.col("channel") == "src3")
    table.delete_ids(read(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id")), "id")
    return table.read().select("id", "source_id", "channel", "author")


@query("SELECT doc_id AS message_id, text IS NULL OR trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' AS is_zero FROM documents")
def store_vectors(spark: SparkSession, d: str) -> DataFrame:
    """A vector store filled by the stand-in embedder: unit vectors, but for empty texts."""
    table = stores.Table(spark, new_path(spark, "vectors"), stores.VECTORS)
    stores.populate_vectors(messages(spark, d), table, stores.hashing_embedder(32))
    length = vector.norm(vector.as_double("embedding"))
    return table.read().select("message_id", (F.round(length, 5) != 1.0).alias("is_zero"))


# --- features and single functions

_REST = ["semantic_score", "bm25_score", "entity_overlap", "edit_freshness", "view_count", "team_influence"]


@query(f"""WITH p AS (SELECT *, TIMESTAMP '2024-01-01' + to_days(CAST(p_partkey % 30 AS INTEGER)) AS t FROM part),
x AS (SELECT *, CASE WHEN p_size % 2 = 1 THEN t + to_hours(p_size) ELSE t END AS edited FROM p)
SELECT p_partkey, round(p_size / 50.0, 6)::DOUBLE AS semantic_score, round(greatest(0, least(1, p_retailprice / 1500)), 6) AS bm25_score,
  round((CAST(split_part(p_name, ' ', 1) = 'small' AS INTEGER) + CAST(split_part(p_name, ' ', 2) = 'widget' AS INTEGER)) / 2.0, 6)::DOUBLE AS entity_overlap,
  round(least(1, pow(0.5, greatest(0, (epoch_us(TIMESTAMP '{REFERENCE}') - epoch_us(edited)) / 86400e6) / 7)), 6) AS edit_freshness,
  round(least(1, ln(1 + p_size) / ln(1001)), 6) AS view_count, CASE WHEN p_size % 3 = 0 THEN 0.5 ELSE round(p_size / 50.0, 6) END::DOUBLE AS team_influence FROM x""")
def features_rest(spark: SparkSession, d: str) -> DataFrame:
    size, at = F.col("p_size"), F.timestamp_add("DAY", (F.col("p_partkey") % 30).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    rows = read(spark, d, "part").select(
        "p_partkey",
        F.lit("Small Widget of any kind").alias("query"),
        F.initcap("p_name").alias("content"),
        at.alias("timestamp"),
        F.when(size % 2 == 1, F.timestamp_add("HOUR", size, at)).alias("edited_at"),
        (size / 50).alias("semantic_score_in"),
        (F.col("p_retailprice") / 1500).alias("bm25_score_in"),
        size.alias("view_count_in"),
        F.when(size % 3 != 0, size / 50).alias("team_influence_in"),
    )
    rows = rows.withColumnsRenamed({f"{c}_in": c for c in ("semantic_score", "bm25_score", "view_count", "team_influence")})
    return features.extract_features(rows, reference(), _REST).select("p_partkey", *[F.round(c, 6).alias(c) for c in _REST])


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT e FROM v WHERE vec_id = 0)
SELECT vec_id, 1.0::DOUBLE AS length, round(list_cosine_similarity(v.e, q.e), 6) AS similarity FROM v, q""")
def vector_units(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of any length made unit ones, and similarities from their distances."""
    v = read(spark, d, "embeddings").select("vec_id", vector.unit(F.transform(vector.as_double("embedding"), lambda x: x * 3)).alias("u"))
    q = F.array(*[F.lit(float(x)) for x in v.where("vec_id = 0").select("u").first()[0]])
    apart = vector.norm(F.zip_with("u", q, lambda a, b: a - b))
    return v.select("vec_id", F.round(vector.norm(F.col("u")), 6).alias("length"), F.round(vector.similarity_of_distance(apart), 6).alias("similarity"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE date_trunc('second', ts) - CASE WHEN event_type = 'click' THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END END AS at FROM events")
def parse_times(spark: SparkSession, d: str) -> DataFrame:
    """ISO times with Z, with an offset, and unreadable ones."""
    kind = F.col("event_type")
    plain = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(kind == "error", "tomorrow").when(kind == "click", F.concat(plain, F.lit("+02:00"))).otherwise(F.concat(plain, F.lit("Z")))
    return read(spark, d, "events").select("event_id", timefn.parse_iso(text).alias("at"))


# --- rules


@query("""WITH o AS (SELECT o_custkey, round(o_totalprice / 400000, 4) AS r, o_orderdate AS t FROM orders),
g AS (SELECT c_custkey, count(r) AS n, avg(r) AS mean, max(t) - min(t) AS spread FROM customer LEFT JOIN o ON o_custkey = c_custkey GROUP BY 1)
SELECT c_custkey, CASE WHEN n = 0 THEN 'no evidence' WHEN round(mean, 9) < 0.5 THEN 'low relevance' WHEN n > 1 AND spread < INTERVAL 1 MINUTE THEN 'evidence within a minute' ELSE '' END AS trouble FROM g""")
def evidence_rules(spark: SparkSession, d: str) -> DataFrame:
    share = F.floor(F.col("o_totalprice") / 400000 * 1e4 + 0.5) / 1e4  # half up in binary, as in SQL
    o = read(spark, d, "orders").select("o_custkey", F.struct(share.alias("relevance"), F.col("o_orderdate").alias("timestamp")).alias("e"))
    held = o.groupBy("o_custkey").agg(F.collect_list("e").alias("evidence"))
    rows = read(spark, d, "customer").select("c_custkey").join(held, F.col("c_custkey") == F.col("o_custkey"), "left")
    none = F.array().cast("array<struct<relevance:double,timestamp:timestamp>>")
    return rows.select("c_custkey", F.coalesce(evidence_quality(F.coalesce("evidence", none)), F.lit("")).alias("trouble"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'not duplicate work' WHEN o_orderkey % 11 < 7 THEN 'low confidence' WHEN o_orderkey % 41 < 20 THEN 'reasoning too short'
  WHEN o_orderkey % 2 = 0 THEN 'no supporting evidence' ELSE '' END AS trouble FROM orders""")
def verification_rules(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    v = F.struct(
        F.when(F.col("o_orderstatus") != "P", F.lit(True)).alias("is_duplicate"),
        ((k % 11) / 10).alias("confidence"),
        F.repeat(F.lit("x"), (k % 41).cast("int")).alias("reasoning"),
        F.when(k % 2 == 1, F.array(F.lit("e"))).otherwise(F.array().cast("array<string>")).alias("evidence"),
    )
    return read(spark, d, "orders").select("o_orderkey", F.coalesce(verification_quality(v), F.lit("")).alias("trouble"))


_SAID = {0: "we are working with them", 1: "a cross-team effort", 2: "nothing else"}


@query("""WITH e AS (SELECT o_custkey, o_orderpriority AS team, CASE o_orderkey % 97 WHEN 0 THEN 'we are working with them' WHEN 1 THEN 'a cross-team effort' ELSE 'nothing else' END AS said FROM orders),
g AS (SELECT c_custkey AS k, c_mktsegment AS seg, count(team) AS n, count(DISTINCT team) AS teams, coalesce(bool_or(said <> 'nothing else'), false) AS collab FROM customer LEFT JOIN e ON o_custkey = c_custkey GROUP BY 1, 2),
f AS (SELECT k, concat_ws(', ', CASE WHEN k % 20 < 14 THEN 'confidence too low' END, CASE WHEN teams < 2 THEN 'too few teams' END, CASE WHEN n < 3 THEN 'too little evidence' END,
  CASE WHEN k % 10 <> 0 AND k % 6 < 3 THEN 'overlap too short' END, CASE WHEN seg = 'BUILDING' THEN 'verification found no duplicate work' END, CASE WHEN collab THEN 'collaboration' END, CASE WHEN teams <= 1 THEN 'one team' END,
  CASE WHEN seg = 'MACHINERY' OR k % 15 = 0 THEN 'intentional redundancy' END, CASE WHEN k % 9 < 5 THEN 'overlap ratio too low' END, CASE WHEN k % 10 = 0 THEN 'no temporal overlap' END, CASE WHEN teams < 2 THEN 'duplicate work needs two teams' END) AS failures FROM g)
SELECT k, failures, failures = '' AS is_valid FROM f""")
def validation_rules(spark: SparkSession, d: str) -> DataFrame:
    """Every rule of a gap, fired by some customer: its orders are evidence, their priorities are teams."""
    o = read(spark, d, "orders")
    said = F.when(F.col("o_orderkey") % 97 == 0, _SAID[0]).when(F.col("o_orderkey") % 97 == 1, _SAID[1]).otherwise(_SAID[2])
    item = F.struct(F.col("o_orderpriority").alias("team"), said.alias("content"), F.col("o_orderdate").alias("timestamp"), F.lit(1.0).alias("relevance"))
    held = o.groupBy("o_custkey").agg(F.collect_list(item).alias("evidence"), F.sort_array(F.collect_set("o_orderpriority")).alias("teams_involved"))
    k, none = F.col("c_custkey"), "array<struct<team:string,content:string,timestamp:timestamp,relevance:double>>"
    rows = read(spark, d, "customer").join(held, F.col("c_custkey") == F.col("o_custkey"), "left")
    gaps = rows.select(
        k.alias("k"),
        ((k % 20) / 20).alias("confidence"),
        F.coalesce("evidence", F.array().cast(none)).alias("evidence"),
        F.coalesce("teams_involved", F.array().cast("array<string>")).alias("teams_involved"),
        F.when(k % 10 != 0, F.struct((k % 6).cast("int").alias("overlap_days"))).alias("temporal_overlap"),
        F.struct((F.col("c_mktsegment") != "BUILDING").alias("is_duplicate"), F.when(F.col("c_mktsegment") == "MACHINERY", "It is a Proof of Concept").otherwise("They do the same").alias("reasoning"), ((k % 9) / 10).alias("overlap_ratio")).alias("verification"),
        F.when(k % 15 == 0, "Two teams run an A/B test").otherwise("Two teams").alias("insight"),
    )
    return validate(gaps).select("k", F.array_join("failures", ", ").alias("failures"), "is_valid")

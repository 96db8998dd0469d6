"""Queries on similarity, clusters, detection, scoring and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.catalog.registry import MESSAGES, REFERENCE, messages, query, read, reference, vectors
from meshwork.functions import entities, prompts, scoring
from meshwork.operators import cluster, detect
from meshwork.plans.staging import stage

#: Vectors of the test tables are far apart; 0.40 gives clusters and no cosine is near it.
THRESHOLD = 0.40

_V = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
_PAIRS = f"{_V}, pairs AS (SELECT p.vec_id AS a, q.vec_id AS b, list_cosine_similarity(p.e, q.e) AS sim FROM v p JOIN v q ON p.vec_id < q.vec_id)"
_CLUSTERS = f"""{_PAIRS}, links AS (SELECT a, b FROM pairs WHERE sim >= {THRESHOLD}), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT vec_id AS id, vec_id AS other FROM v UNION SELECT r.id, e.b FROM reach r JOIN edges e ON r.other = e.a),
clusters AS (SELECT id, min(other) AS cluster_id FROM reach GROUP BY id)"""


@query(f"WITH {_PAIRS} SELECT a, b, round(greatest(0, sim), 6) AS sim FROM pairs")
def pairwise_similarity(spark: SparkSession, d: str) -> DataFrame:
    # Half up in binary, as in SQL: F.round goes through decimals, which took as long as all the rest.
    return cluster.pairwise(vectors(spark, d)).withColumn("sim", F.floor(F.col("sim") * 1e6 + 0.5) / 1e6)


@query(f"WITH {_PAIRS} SELECT a, b, round(sim, 6) AS sim FROM pairs WHERE sim >= {THRESHOLD}")
def similarity_join(spark: SparkSession, d: str) -> DataFrame:
    return cluster.similar_pairs(vectors(spark, d), THRESHOLD).withColumn("sim", F.round("sim", 6))


@query(f"WITH RECURSIVE {_CLUSTERS} SELECT id, cluster_id FROM clusters")
def clusters(spark: SparkSession, d: str) -> DataFrame:
    return cluster.cluster(vectors(spark, d), THRESHOLD)


@query(f"""WITH RECURSIVE {_PAIRS}, l0 AS (SELECT a, b FROM pairs WHERE sim >= 0.36), e0 AS (SELECT a, b FROM l0 UNION SELECT b, a FROM l0),
core AS (SELECT a AS id FROM e0 GROUP BY a HAVING count(*) + 1 >= 3), edges AS (SELECT a, b FROM e0 WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach AS (SELECT id, id AS other FROM core UNION SELECT r.id, e.b FROM reach r JOIN edges e ON r.other = e.a), c AS (SELECT id, min(other) AS cluster_id FROM reach GROUP BY id)
SELECT * FROM c UNION ALL SELECT e0.a, min(c.cluster_id) FROM e0 JOIN c ON e0.b = c.id WHERE e0.a NOT IN (SELECT id FROM core) GROUP BY e0.a""")
def dense_clusters(spark: SparkSession, d: str) -> DataFrame:
    return cluster.cluster(vectors(spark, d), 0.36, min_samples=3)


def members(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return messages(spark, d).join(v.select("id", "embedding"), "id").join(stage(cluster.cluster(v, THRESHOLD), "clusters"), "id")


_MEMBERS = f"{_CLUSTERS}, {MESSAGES}, m AS (SELECT * FROM messages JOIN clusters USING (id))"


@query(f"""WITH RECURSIVE {_MEMBERS}, coh AS (SELECT x.cluster_id, avg(greatest(0, sim)) AS s FROM pairs JOIN m x ON a = x.id JOIN m y ON b = y.id AND x.cluster_id = y.cluster_id GROUP BY 1),
g AS (SELECT cluster_id, count(*) AS size, min(timestamp) AS lo, max(timestamp) AS hi, count(DISTINCT nullif(author, '')) AS participant_count, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels, avg(length(content)) AS avg_length FROM m GROUP BY cluster_id)
SELECT cluster_id, size, participant_count, channels, round(avg_length, 6) AS avg_length, round((epoch_us(hi) - epoch_us(lo)) / 86400e6, 6) AS timespan_days,
  round(size / greatest((epoch_us(hi) - epoch_us(lo)) / 86400e6, 0.01), 6) AS messages_per_day, round(coalesce(s, 0), 6) AS avg_similarity FROM g LEFT JOIN coh USING (cluster_id)""")
def cluster_stats(spark: SparkSession, d: str) -> DataFrame:
    found = cluster.cluster_metadata(members(spark, d))
    return found.select("cluster_id", "size", "participant_count", F.array_join("channels", ",").alias("channels"), *[F.round(c, 6).alias(c) for c in ("avg_length", "timespan_days", "messages_per_day", "avg_similarity")])


_LABELS = "l AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS cluster_id FROM embeddings)"


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select("id", "embedding", F.col("label").cast("bigint").alias("cluster_id"))


@query(f"""WITH {_PAIRS}, {_LABELS} SELECT least(x.cluster_id, y.cluster_id) AS a, greatest(x.cluster_id, y.cluster_id) AS b, round(avg(1 - greatest(0, least(1, sim))), 6) AS distance
FROM pairs JOIN l x ON x.id = a JOIN l y ON y.id = b WHERE x.cluster_id <> y.cluster_id GROUP BY 1, 2""")
def cluster_separation(spark: SparkSession, d: str) -> DataFrame:
    return cluster.separation(labelled(spark, d)).withColumn("distance", F.round("distance", 6))


@query(f"""WITH {_PAIRS}, {_LABELS}, dist AS (SELECT a, b, 1 - sim AS d FROM pairs UNION ALL SELECT b, a, 1 - sim FROM pairs),
mean_ AS (SELECT a, x.cluster_id AS ca, y.cluster_id AS cb, avg(d) AS d FROM dist JOIN l x ON x.id = a JOIN l y ON y.id = b GROUP BY ALL),
p AS (SELECT a, min(d) FILTER (ca = cb) AS i, min(d) FILTER (ca <> cb) AS o FROM mean_ GROUP BY a)
SELECT round(avg(CASE WHEN i IS NULL OR o IS NULL THEN 0 ELSE (o - i) / greatest(i, o) END), 6) AS silhouette, (SELECT count(DISTINCT cluster_id) FROM l) AS clusters, (SELECT count(*) FROM l) AS points FROM p""")
def silhouette(spark: SparkSession, d: str) -> DataFrame:
    v = labelled(spark, d)
    return cluster.silhouette(v).withColumn("silhouette", F.round("silhouette", 6))


@query(f"WITH RECURSIVE {_CLUSTERS}, s AS (SELECT cluster_id, count(*) AS n FROM clusters GROUP BY 1 HAVING count(*) >= 2) SELECT count(*) AS clusters, round(avg(n), 6) AS avg_size, round(sum(n) / (SELECT count(*) FROM v), 6)::DOUBLE AS coverage FROM s")
def cluster_quality(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    c = stage(cluster.cluster(v, THRESHOLD), "clusters")
    big = c.join(c.groupBy("cluster_id").count().where("count >= 2").select("cluster_id"), "cluster_id", "left_semi")
    return cluster.quality(big, F.lit(float(max(1, v.count())))).withColumn("avg_size", F.round("avg_size", 6)).withColumn("coverage", F.round("coverage", 6))


@query(f"WITH RECURSIVE {_CLUSTERS} SELECT cluster_id, count(*) AS size FROM clusters GROUP BY 1 ORDER BY size DESC, cluster_id LIMIT 5")
def largest_clusters(spark: SparkSession, d: str) -> DataFrame:
    return cluster.largest(cluster.cluster(vectors(spark, d), THRESHOLD))


_TEAMS = f"""{_MEMBERS}, tm AS (SELECT *, channel || '-team' AS team FROM m), ts AS (SELECT cluster_id, list_sort(list(DISTINCT team)) AS teams FROM tm GROUP BY 1)"""


@query(f"WITH RECURSIVE {_TEAMS} SELECT cluster_id, array_to_string(teams, ',') AS teams FROM ts")
def cluster_teams(spark: SparkSession, d: str) -> DataFrame:
    found = detect.team_sets(detect.with_teams(members(spark, d)))
    return found.select("cluster_id", F.array_join("teams", ",").alias("teams"))


_LINES = "ln AS (SELECT cluster_id, team, min(timestamp) AS f, max(timestamp) AS l FROM tm GROUP BY 1, 2)"
_OVER = f"""{_LINES}, ov AS (SELECT x.cluster_id, x.team AS ta, y.team AS tb, greatest(x.f, y.f) AS s, least(x.l, y.l) AS e,
  greatest(0, date_diff('day', CAST(greatest(x.f, y.f) AS DATE), CAST(least(x.l, y.l) AS DATE))) AS days FROM ln x JOIN ln y ON x.cluster_id = y.cluster_id AND x.team < y.team WHERE greatest(x.f, y.f) <= least(x.l, y.l)),
best AS (SELECT * FROM ov QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY days DESC, ta, tb) = 1)"""


def labelled_members(spark: SparkSession, d: str) -> DataFrame:
    """Messages under the labels of their vectors: larger clusters than similarity gives."""
    return detect.with_teams(messages(spark, d).join(labelled(spark, d), "id"))


_LM = f"{_LABELS}, {MESSAGES}, m AS (SELECT * FROM messages JOIN l USING (id)), tm AS (SELECT *, channel || '-team' AS team FROM m), ts AS (SELECT cluster_id, list_sort(list(DISTINCT team)) AS teams FROM tm GROUP BY 1)"


@query(f"WITH {_LM}, {_OVER} SELECT cluster_id, ta AS team_a, tb AS team_b, CAST(days AS INTEGER) AS overlap_days FROM best")
def team_overlap(spark: SparkSession, d: str) -> DataFrame:
    return detect.team_overlap(detect.timelines(labelled_members(spark, d))).select("cluster_id", "team_a", "team_b", "overlap_days")


_EVID = "ev AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, team ORDER BY timestamp, id) AS rn FROM tm QUALIFY rn <= 3)"


@query(f"WITH {_LM}, {_EVID} SELECT cluster_id, team, id AS message_id, round(1.0 / rn, 6)::DOUBLE AS relevance, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY -1.0 / rn, team, timestamp, id) - 1 AS INTEGER) AS pos FROM ev")
def evidence_topk(spark: SparkSession, d: str) -> DataFrame:
    m = labelled_members(spark, d)
    found = detect.evidence(m, detect.team_sets(m)).select("cluster_id", F.posexplode("evidence").alias("pos", "e"))
    return found.select("cluster_id", "e.team", "e.message_id", F.round("e.relevance", 6).alias("relevance"), "pos")


_TERMS = ", ".join(f"'{x}'" for x in sorted(entities.TERMS))
_ACR = "list_filter(regexp_extract_all(regexp_replace(content, '[^\\x00-\\x7F]', 'a', 'g'), '\\b[A-Z]{2,6}\\b'), lambda a: a NOT IN ('I', 'A', 'AN', 'THE', 'OK', 'PR', 'MR'))"


@query(f"""WITH {_LM}, a AS (SELECT cluster_id, id, unnest(list_distinct(list_concat(list_filter([{_TERMS}], lambda t: regexp_matches(lower(regexp_replace(content, '[^\x00-\x7F]', 'a', 'g')), '(^|[^a-z0-9_])' || t || '($|[^a-z0-9_])')), list_transform({_ACR}, lambda x: lower(x))))) AS topic FROM m), c AS (SELECT cluster_id, topic, count(*) AS n FROM a GROUP BY 1, 2)
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, topic) = 1""")
def topic_mode(spark: SparkSession, d: str) -> DataFrame:
    plain = messages(spark, d).withColumn("content", F.regexp_replace("content", r"[^\x00-\x7F]", "a"))
    return detect.topic_mode(plain.join(labelled(spark, d), "id"))


_IMPACT = """i AS (SELECT o_orderkey AS k, o_orderkey % 6 + 1 AS teams, o_orderkey % 14 AS people, o_orderkey % 130 AS ev, o_orderkey % 9 AS commits, o_orderkey % 16 AS days, o_orderkey % 7 AS blocked, (o_orderkey % 11) / 10.0::DOUBLE AS ratio,
  CASE o_orderkey % 5 WHEN 0 THEN 0.9 WHEN 1 THEN 0.8 WHEN 2 THEN 0.3 WHEN 3 THEN 0.75 ELSE 0.5 END AS crit FROM orders),
h AS (SELECT *, (ev * 0.5 + commits * 2.0) * CASE WHEN days > 0 AND ev > 2 * days THEN 1.2::DOUBLE ELSE 1 END AS h FROM i),
s AS (SELECT *, CASE WHEN p >= 10 THEN 1.0 WHEN p >= 5 THEN 0.7 WHEN p >= 2 THEN 0.4 ELSE 0.2 END::DOUBLE AS team_size,
  round(CASE WHEN h >= 100 THEN 1.0 WHEN h >= 50 THEN 0.7 + (h - 50) / 50 * 0.3 WHEN h >= 20 THEN 0.5 + (h - 20) / 30 * 0.2 WHEN h >= 10 THEN 0.3 + (h - 10) / 10 * 0.2 ELSE least(0.3, h / 10 * 0.3) END::DECIMAL(18,9), 2)::DOUBLE AS time_investment,
  CASE WHEN blocked >= 5 THEN 1.0 WHEN blocked >= 3 THEN 0.7 + (blocked - 3) / 2 * 0.3 WHEN blocked >= 1 THEN 0.4 + (blocked - 1) / 2 * 0.3 ELSE 0.2 END::DOUBLE AS velocity
  FROM (SELECT *, CASE WHEN people > 0 THEN people ELSE teams * 5 END AS p FROM h)),
x AS (SELECT *, round(least(1, 0.0 + team_size * 0.25 + time_investment * 0.25 + crit::DOUBLE * 0.2 + velocity * 0.15 + ratio * 0.15)::DECIMAL(18,9), 2)::DOUBLE AS impact_score FROM s)"""


def impacts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    i = read(spark, d, "orders").select(k.alias("k"), (k % 6 + 1).alias("teams"), (k % 14).alias("people"), (k % 130).alias("ev"), (k % 9).alias("commits"), (k % 16).alias("days"), (k % 7).alias("blocked"), ((k % 11) / 10.0).alias("ratio"), F.when(k % 5 == 0, F.array(F.lit("Roadmap"), F.lit("internal"))).when(k % 5 == 1, F.array(F.lit("security"))).when(k % 5 == 2, F.array(F.lit("internal_tool"))).when(k % 5 == 3, F.array(F.lit("prod"), F.lit("x"))).otherwise(F.array(F.lit("none"))).alias("tags"))
    parts = scoring.impact_components(teams=F.col("teams"), participants=F.col("people"), evidence=F.col("ev"), commits=F.col("commits"), overlap_days=F.col("days"), tags=F.col("tags"), blocked=F.col("blocked"), overlap_ratio=F.col("ratio"))
    return i.withColumns(parts).withColumn("impact_score", scoring.impact({n: F.col(n) for n in parts}))


@query(f"WITH {_IMPACT} SELECT k, round(team_size, 6) AS team_size, time_investment, round(crit, 6)::DOUBLE AS criticality, round(velocity, 6) AS velocity, impact_score, CASE WHEN impact_score >= 0.8 THEN 'CRITICAL' WHEN impact_score >= 0.6 THEN 'HIGH' WHEN impact_score >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM x")
def impact_score(spark: SparkSession, d: str) -> DataFrame:
    return impacts(spark, d).select("k", F.round("team_size", 6).alias("team_size"), "time_investment", F.round("criticality", 6).alias("criticality"), F.round("velocity", 6).alias("velocity"), "impact_score", scoring.tier(F.col("impact_score")).alias("tier"))


@query(f"WITH {_IMPACT} SELECT count(*) AS total, count(*) FILTER (impact_score >= 0.8) AS critical, count(*) FILTER (impact_score >= 0.6 AND impact_score < 0.8) AS high, count(*) FILTER (impact_score >= 0.4 AND impact_score < 0.6) AS medium, count(*) FILTER (impact_score < 0.4) AS low FROM x")
def impact_tier_hist(spark: SparkSession, d: str) -> DataFrame:
    return detect.tier_histogram(impacts(spark, d).select(scoring.tier(F.col("impact_score")).alias("impact_tier")))


_COST = f"{_IMPACT}, c AS (SELECT *, greatest(5, 0.5 * ev + 2 * commits)::DOUBLE * CASE WHEN teams <= 1 THEN 1 ELSE least(CASE teams WHEN 2 THEN 1.8 WHEN 3 THEN 2.4 ELSE 2.4 + (teams - 3) * 0.4 END, teams * 0.85) END::DOUBLE * 1.15::DOUBLE AS hours FROM x)"


@query(f"WITH {_COST} SELECT k, round(hours, 4) AS hours, round((hours * 100)::DECIMAL(18,6), 2)::DOUBLE AS dollars, round((impact_score * ev * 1000)::DECIMAL(18,6), 2)::DOUBLE AS simple FROM c")
def cost_estimate(spark: SparkSession, d: str) -> DataFrame:
    x, c = impacts(spark, d), lambda n: F.col(n)
    hours = scoring.cost_hours(c("teams"), c("ev"), c("commits"))
    return x.select("k", F.round(hours, 4).alias("hours"), scoring.cost(c("teams"), c("ev"), c("commits"))["dollars"].alias("dollars"), scoring.simple_cost(c("impact_score"), c("ev")).alias("simple"))


@query(f"WITH {_COST} SELECT round(sum(round((hours * 100)::DECIMAL(18,6), 2)::DOUBLE), 1) AS cost, round(avg(impact_score), 6) AS avg_impact, round(avg(ratio), 6) AS avg_confidence, count(*) AS gaps, count(DISTINCT teams) AS teams FROM c")
def dashboard(spark: SparkSession, d: str) -> DataFrame:
    x = impacts(spark, d).withColumn("estimated_cost", scoring.cost(F.col("teams"), F.col("ev"), F.col("commits"))).withColumn("confidence", F.col("ratio")).withColumn("teams_involved", F.array("teams"))
    return detect.dashboard(x).select(F.round("cost", 1).alias("cost"), F.round("avg_impact", 6).alias("avg_impact"), F.round("avg_confidence", 6).alias("avg_confidence"), "gaps", "teams")


#: A whole detection over the labelled clusters: gates, evidence, verification, scores, rules.
_STEPS = f"""{_OVER}, {_EVID},
pr AS (SELECT x.cluster_id, avg(greatest(0, list_cosine_similarity(p.e, q.e))) AS sim FROM v p JOIN v q ON p.vec_id < q.vec_id JOIN m x ON x.id = p.vec_id JOIN m y ON y.id = q.vec_id AND x.cluster_id = y.cluster_id GROUP BY 1),
st AS (SELECT cluster_id, count(*) AS size, count(DISTINCT author) AS people, (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 86400e6 AS span FROM m GROUP BY 1),
en AS (SELECT cluster_id, count(*) AS n, arg_min(content, struct_pack(r := rn, t := team)) AS lead FROM ev GROUP BY 1),
g AS (SELECT st.*, len(teams) AS nt, array_to_string(teams, ',') AS teams, best.days, en.n, array_to_string(list_slice(list_filter(regexp_split_to_array(lead[1:500], '\\s+'), lambda w: w <> ''), 1, 5), ' ') AS topic, coalesce(pr.sim, 0) AS sim
  FROM st JOIN ts USING (cluster_id) JOIN best USING (cluster_id) JOIN en USING (cluster_id) LEFT JOIN pr USING (cluster_id) WHERE size >= 2 AND len(teams) >= 2 AND best.days >= 3),
h AS (SELECT *, n * 0.5 * CASE WHEN days > 0 AND n > 2 * days THEN 1.2::DOUBLE ELSE 1 END AS h, CASE WHEN people > 0 THEN people ELSE nt * 5 END AS p FROM g),
sc AS (SELECT *, round(least(1, (CASE WHEN p >= 10 THEN 1.0 WHEN p >= 5 THEN 0.7 WHEN p >= 2 THEN 0.4 ELSE 0.2 END)::DOUBLE * 0.25
  + round((CASE WHEN h >= 100 THEN 1.0 WHEN h >= 50 THEN 0.7 + (h - 50) / 50 * 0.3 WHEN h >= 20 THEN 0.5 + (h - 20) / 30 * 0.2 WHEN h >= 10 THEN 0.3 + (h - 10) / 10 * 0.2 ELSE least(0.3, h / 10 * 0.3) END)::DECIMAL(18,9), 2)::DOUBLE * 0.25 + 0.5 * 0.2 + 0.2 * 0.15 + 0.8 * 0.15)::DECIMAL(18,9), 2)::DOUBLE AS impact_score FROM h)"""
_GAPS = f"{_LM}, {_V}, {_STEPS}"
#: The same from messages alone: clusters of similar ones first.
_FOUND = f"{_MEMBERS}, tm AS (SELECT *, channel || '-team' AS team FROM m), ts AS (SELECT cluster_id, list_sort(list(DISTINCT team)) AS teams FROM tm GROUP BY 1), {_STEPS}"


def gaps(spark: SparkSession, d: str) -> DataFrame:
    m = stage(labelled_members(spark, d), "members")
    return detect.gaps_of(m, reference(), detect.DetectionConfig(min_confidence=0.5))


@query(f"""WITH {_GAPS} SELECT cluster_id, 'gap_' || sha256(CAST(cluster_id AS VARCHAR) || '|' || teams || '|{REFERENCE}')[1:12] AS gap_id, teams, topic, size AS messages, people, CAST(n AS INTEGER) AS evidence, CAST(days AS INTEGER) AS overlap_days,
  CAST(floor(span) AS INTEGER) AS timespan_days, round(0.7 * 0.75 + 0.3 * sim, 6) AS confidence, impact_score, CASE WHEN impact_score >= 0.8 THEN 'CRITICAL' WHEN impact_score >= 0.6 THEN 'HIGH' WHEN impact_score >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS tier,
  round((greatest(5, 0.5 * n)::DOUBLE * least(CASE nt WHEN 2 THEN 1.8 WHEN 3 THEN 2.4 ELSE 2.4 + (nt - 3) * 0.4 END, nt * 0.85)::DOUBLE * 1.15::DOUBLE * 100)::DECIMAL(18,6), 2)::DOUBLE AS dollars FROM sc""")
def gap_pipeline(spark: SparkSession, d: str) -> DataFrame:
    g = gaps(spark, d)
    return g.select("cluster_id", "gap_id", F.array_join("teams_involved", ",").alias("teams"), "topic", F.col("messages_analyzed").alias("messages"), F.col("people_affected").alias("people"), F.size("evidence").alias("evidence"), F.col("temporal_overlap.overlap_days").alias("overlap_days"), "timespan_days", F.round("confidence", 6).alias("confidence"), "impact_score", F.col("impact_tier").alias("tier"), F.col("estimated_cost.dollars").alias("dollars"))


@query(f"""WITH {_GAPS}, w AS (SELECT cluster_id, bool_or(contains(lower(content[1:500]), 'helping') OR contains(lower(content[1:500]), 'supporting')) AS collab FROM ev GROUP BY 1)
SELECT cluster_id, 0.7 * 0.75 + 0.3 * sim >= 0.5 AND n >= 3 AND NOT collab AS is_valid, concat_ws(',', CASE WHEN 0.7 * 0.75 + 0.3 * sim < 0.5 THEN 'confidence too low' END, CASE WHEN n < 3 THEN 'too little evidence' END, CASE WHEN collab THEN 'collaboration' END) AS failures FROM g JOIN w USING (cluster_id)""")
def validate_gaps(spark: SparkSession, d: str) -> DataFrame:
    return gaps(spark, d).select("cluster_id", "is_valid", F.array_join("failures", ",").alias("failures"))


@query(f"WITH {_GAPS}, p AS (SELECT cluster_id, unnest(string_split(teams, ',')) AS t FROM g) SELECT x.t AS team_a, y.t AS team_b, count(*) AS n FROM p x JOIN p y USING (cluster_id) GROUP BY 1, 2")
def team_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return detect.team_cooccurrence(gaps(spark, d))


@query(f"""WITH {_GAPS} SELECT cluster_id, impact_score, CAST((SELECT count(*) FROM sc) AS BIGINT) AS total, (SELECT count(*) FROM sc) > 4 AS has_more FROM sc
ORDER BY impact_score DESC, 'gap_' || sha256(CAST(cluster_id AS VARCHAR) || '|' || teams || '|{REFERENCE}')[1:12] LIMIT 4""")
def list_gaps(spark: SparkSession, d: str) -> DataFrame:
    return detect.page(stage(gaps(spark, d), "gaps"), 1, 4).select("cluster_id", "impact_score", "total", "has_more")


@query(f"""WITH RECURSIVE {_FOUND.replace('best.days >= 3', 'best.days >= 1').replace(f'sim >= {THRESHOLD}', 'sim >= 0.35')}, w AS (SELECT cluster_id, bool_or(contains(lower(content[1:500]), 'helping') OR contains(lower(content[1:500]), 'supporting')) AS collab FROM ev GROUP BY 1)
SELECT cluster_id, 'gap_' || sha256(CAST(cluster_id AS VARCHAR) || '|' || teams || '|{REFERENCE}')[1:12] AS gap_id, teams, CAST(size AS BIGINT) AS messages, CAST(n AS INTEGER) AS evidence, CAST(days AS INTEGER) AS overlap_days, round(0.7 * 0.75 + 0.3 * sim, 6) AS confidence, impact_score
FROM sc JOIN w USING (cluster_id) WHERE 0.7 * 0.75 + 0.3 * sim >= 0.5 AND n >= 2 AND NOT collab""")
def detect_gaps(spark: SparkSession, d: str) -> DataFrame:
    """The whole detector over all messages that have vectors, from similarity to valid gaps."""
    m = messages(spark, d)
    config = detect.DetectionConfig(similarity_threshold=0.35, min_confidence=0.5, min_evidence=2, min_overlap_days=1)
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("message_id"), "embedding")
    g = detect.detect(m, e, reference(), config)
    return g.select("cluster_id", "gap_id", F.array_join("teams_involved", ",").alias("teams"), F.col("messages_analyzed").alias("messages"), F.size("evidence").alias("evidence"), F.col("temporal_overlap.overlap_days").alias("overlap_days"), F.round("confidence", 6).alias("confidence"), "impact_score")


@query()
def detect_scenarios(spark: SparkSession, d: str) -> DataFrame:
    """The whole detector over invented messages with a stand-in embedder; tests pin what it finds."""
    from meshwork.sources import scenarios, stores

    m = scenarios.messages(spark)
    e = stores.embed(m.select(F.col("id").alias("message_id"), "content"), "content", stores.hashing_embedder(256))
    found = detect.detect(m, e, F.lit("2024-06-30 00:00:00").cast("timestamp"), detect.DetectionConfig(similarity_threshold=0.6, min_confidence=0.6))
    return found.select("gap_id", "title", F.array_join("teams_involved", ",").alias("teams"), "impact_score", "impact_tier", "messages_analyzed")


@query(f"""WITH {_LM}, {_EVID}, {_OVER} SELECT cluster_id, string_agg('- ' || team || ': ' || CASE WHEN length(content) > 200 THEN content[1:200] || '...' ELSE content END, chr(10) ORDER BY -1.0 / rn, team, timestamp, id) AS evidence,
  (SELECT array_to_string(teams, ', ') FROM ts WHERE ts.cluster_id = ev.cluster_id) AS teams, (SELECT strftime(s, '%Y-%m-%d') || ' to ' || strftime(e, '%Y-%m-%d') || ' (' || CAST(days AS VARCHAR) || ' days)' FROM best WHERE best.cluster_id = ev.cluster_id) AS timeframe FROM ev GROUP BY cluster_id""")
def prompt_parts(spark: SparkSession, d: str) -> DataFrame:
    m = stage(labelled_members(spark, d), "members")
    teams = detect.team_sets(m)
    rows = detect.evidence(m, teams).join(teams, "cluster_id").join(detect.team_overlap(detect.timelines(m)), "cluster_id")
    return rows.select("cluster_id", prompts.format_evidence(F.col("evidence")).alias("evidence"), prompts.format_teams(F.col("teams")).alias("teams"), prompts.format_timeframe(F.col("start"), F.col("end")).alias("timeframe"))


@query("""WITH a AS (SELECT event_id, event_id % 3 AS k, (event_id % 15) / 10.0::DOUBLE AS c FROM events) SELECT event_id, k < 2 AND c <= 1 AS known, CASE WHEN k < 2 AND c <= 1 THEN c ELSE -1 END::DOUBLE AS confidence FROM a""")
def parse_answers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    body = F.format_string('{"is_duplicate": true, "confidence": %s, "reasoning": "r", "evidence": ["e"], "overlap_ratio": 0.5}', ((k % 15) / 10).cast("string"))
    answer = F.when(k % 3 == 0, body).when(k % 3 == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))).otherwise("no idea")
    v = prompts.parse_verification(answer)
    return read(spark, d, "events").select("event_id", v.isNotNull().alias("known"), F.coalesce(v["confidence"], F.lit(-1.0)).alias("confidence"))


@query(f"WITH {_COST} SELECT teams, count(*) AS gaps, round(sum(round((impact_score * ev * 1000)::DECIMAL(18,6), 2)::DOUBLE), 1) AS total, round(avg(round((impact_score * ev * 1000)::DECIMAL(18,6), 2)::DOUBLE), 4) AS mean FROM c GROUP BY 1")
def gap_costs(spark: SparkSession, d: str) -> DataFrame:
    x = impacts(spark, d).select("teams", scoring.simple_cost(F.col("impact_score"), F.col("ev")).alias("cost"))
    return x.groupBy("teams").agg(F.count("*").alias("gaps"), F.round(F.sum("cost"), 1).alias("total"), F.round(F.avg("cost"), 4).alias("mean"))

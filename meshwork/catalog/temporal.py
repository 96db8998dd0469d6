"""Queries on time, filters, windows and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.catalog.registry import MESSAGES, REFERENCE, messages, query, read, reference
from meshwork.functions import features, timefn
from meshwork.operators import filters, usage
from meshwork.plans.staging import spread

_REF = f"TIMESTAMP '{REFERENCE}'"


@query(f"""SELECT event_id, round(least(1, exp(-ln(2) / 7 * (epoch_us({_REF}) - epoch_us(ts)) / 86400e6)), 6) AS recency,
  round(least(1, exp(-ln(2) / 7 * (epoch_us({_REF}) - epoch_us(ts + INTERVAL 36 HOUR)) / 86400e6)), 6) AS freshness FROM events""")
def recency(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts")
    return read(spark, d, "events").select("event_id", F.round(timefn.recency(ts, reference(), 7.0), 6).alias("recency"), F.round(timefn.edit_freshness(ts, ts + F.expr("INTERVAL 36 HOURS"), reference()), 6).alias("freshness"))


_TIMES = "t AS (SELECT user_id, list_sort(list(ts)) AS a FROM events GROUP BY user_id)"


def times(spark: SparkSession, d: str) -> DataFrame:
    """Event times of each user."""
    return read(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list("ts")).alias("a"))


@query(f"""WITH {_TIMES}, x AS (SELECT user_id, CAST(len(a) AS DOUBLE) AS n, len(list_filter(a, lambda v: v >= {_REF} - INTERVAL 48 HOUR)) AS r, (epoch_us({_REF}) - epoch_us(a[1])) / 3600e6 AS h FROM t),
y AS (SELECT *, CASE WHEN h > 48 THEN (n - r) / (h - 48) WHEN h > 0 THEN n / h ELSE 0 END AS past FROM x), z AS (SELECT *, r / 48.0 / nullif(past, 0) AS ratio FROM y)
SELECT user_id, round(CASE WHEN past = 0 THEN CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END WHEN ratio < 1 THEN 0.5 * ratio ELSE 0.5 + 0.5 * least(1, (ratio - 1) / 2) END, 6) AS burst FROM z""")
def burst(spark: SparkSession, d: str) -> DataFrame:
    return times(spark, d).select("user_id", F.round(timefn.activity_burst(F.col("a"), reference(), 48.0), 6).alias("burst"))


@query(f"""WITH {_TIMES}, x AS (SELECT user_id, len(a) AS n, (epoch_us(a[len(a)]) - epoch_us(a[1])) / 3600e6 AS h FROM t)
SELECT user_id, round(CASE WHEN n < 2 THEN 0.0 WHEN h = 0 THEN 1.0 ELSE least(1, (n - 1) / h / 10) END, 6) AS velocity FROM x""")
def velocity(spark: SparkSession, d: str) -> DataFrame:
    return times(spark, d).select("user_id", F.round(timefn.response_velocity(F.col("a")), 6).alias("velocity"))


@query("""WITH x AS (SELECT event_id, abs(epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 86400e6 AS g FROM events)
SELECT event_id, round(CASE WHEN g <= 5 THEN 1.0 WHEN g <= 10 THEN 1 - 0.5 * (g - 5) / 5 ELSE 0.5 * exp(-ln(2) / 10 * (g - 10)) END, 6) AS relevance FROM x""")
def temporal_relevance(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", F.round(timefn.temporal_relevance(F.col("ts"), reference(), 10.0), 6).alias("relevance"))


_SPANS = "s AS (SELECT user_id, event_type, min(ts) AS a, max(ts) AS b FROM events GROUP BY user_id, event_type)"


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """First and last event of each user and type, over all events."""
    return read(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))


@query(f"""WITH {_SPANS}, p AS (SELECT x.user_id AS u, y.user_id AS v, x.event_type AS kind, (epoch_us(least(x.b, y.b)) - epoch_us(greatest(x.a, y.a))) / 1e6 AS o,
  least(epoch_us(x.b) - epoch_us(x.a), epoch_us(y.b) - epoch_us(y.a)) / 1e6 AS s, greatest(0, date_diff('day', CAST(greatest(x.a, y.a) AS DATE), CAST(least(x.b, y.b) AS DATE))) AS days
  FROM s x JOIN s y ON y.user_id = x.user_id + 1 AND x.event_type = y.event_type)
SELECT u, v, kind, o > 0 AS overlaps, round(CASE WHEN o <= 0 THEN 0.0 WHEN s = 0 THEN 1.0 ELSE o / s END, 6) AS share, CAST(days AS INTEGER) AS days FROM p""")
def window_overlap(spark: SparkSession, d: str) -> DataFrame:
    x, y = _spans(spark, d).alias("x"), _spans(spark, d).alias("y")
    both = x.join(y, (F.col("y.user_id") == F.col("x.user_id") + 1) & (F.col("x.event_type") == F.col("y.event_type")))
    ends = [F.col(c) for c in ("x.a", "x.b", "y.a", "y.b")]
    has, share = timefn.window_overlap(*ends)
    return both.select(F.col("x.user_id").alias("u"), F.col("y.user_id").alias("v"), F.col("x.event_type").alias("kind"), has.alias("overlaps"), F.round(share, 6).alias("share"), timefn.overlap_days(*ends).alias("days"))


@query("SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12 12:00:00'")
def date_range_filter(spark: SparkSession, d: str) -> DataFrame:
    lo, hi = (F.lit(x).cast("timestamp") for x in ("2024-01-10 00:00:00", "2024-01-12 12:00:00"))
    return read(spark, d, "events").where(F.col("ts").between(lo, hi)).select("event_id", F.col("ts").cast("timestamp").alias("ts"))


@query(f"SELECT event_id FROM events WHERE ts >= {_REF} - INTERVAL 7 DAY")
def recent_window(spark: SparkSession, d: str) -> DataFrame:
    return filters.recent(read(spark, d, "events"), reference(), 7, "ts").select("event_id")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') = '7'")
def metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").withColumn("metadata", F.from_json("props", "map<string,string>"))
    return filters.SearchFilter(metadata={"k": "7"}).apply(rows).select("event_id", F.col("metadata")["k"].cast("bigint").alias("k"))


@query(f"WITH {MESSAGES} SELECT id, channel, author FROM messages WHERE channel IN ('src0', 'src3') AND author IN ('user_1', 'user_2', 'user_3', 'user_4') AND lang = 'en'")
def set_filter(spark: SparkSession, d: str) -> DataFrame:
    wanted = filters.SearchFilter(channels=["src0", "src3"], authors=[f"user_{i}" for i in range(1, 5)], metadata={"lang": "en"})
    return wanted.apply(messages(spark, d)).select("id", "channel", "author")


@query("SELECT user_id AS id, count(*) AS n FROM events GROUP BY user_id")
def numeric_ids(spark: SparkSession, d: str) -> DataFrame:
    named = read(spark, d, "events").select(F.explode(F.array(F.concat(F.lit("msg_"), F.col("user_id").cast("string")), F.lit("msg_x1"), F.lit("7"))).alias("t"))
    return named.select(filters.numeric_id(F.col("t")).alias("id")).where("id is not null").groupBy("id").agg(F.count("*").alias("n"))





@query(rf"""WITH {MESSAGES}, q AS (SELECT *, 'The On of' AS query, list_distinct(regexp_extract_all('the on of', '\w+')) AS terms FROM messages),
c AS (SELECT *, list_distinct(regexp_extract_all(query, '\b[A-Z][a-z]+\b')) AS asked, list_distinct(regexp_extract_all(regexp_replace(content, '[^\x00-\x7F]', 'a', 'g'), '\b[A-Z][a-z]+\b')) AS said FROM q)
SELECT id, CASE WHEN contains(lower(content), lower(query)) THEN 1.0::DOUBLE ELSE 0.0 END AS exact_match,
  round(len(list_filter(terms, lambda t: contains(lower(content), t))) / 3, 6) AS term_coverage, round(len(list_filter(terms, lambda t: contains(lower(channel), t))) / 3, 6) AS title_match,
  round(ln(1 + length(content)) / ln(1001), 6) AS message_length, CASE WHEN regexp_matches(content, '`| {{4}}') THEN 1.0::DOUBLE ELSE 0.0 END AS code_snippet_present,
  round(CASE WHEN len(regexp_extract_all(content, 'https?://\S+')) = 0 THEN 0 ELSE ln(1 + len(regexp_extract_all(content, 'https?://\S+'))) / ln(1001) END, 6) AS link_count,
  round(exp(-ln(2) / 30 * (epoch_us({_REF}) - epoch_us(timestamp)) / 86400e6), 6) AS recency FROM c""")
def features_text(spark: SparkSession, d: str) -> DataFrame:
    names = ["exact_match", "term_coverage", "title_match", "message_length", "code_snippet_present", "link_count", "recency"]
    made = features.extract_features(spread(messages(spark, d).select("id", "content", "channel", "timestamp")).withColumn("query", F.lit("The On of")), reference(), names)
    return made.select("id", *[F.round(n, 6).alias(n) for n in names])


_ENGAGED = """u AS (SELECT user_id, count(*) AS reply_count, list(DISTINCT event_type) AS teams, list(ts) AS a, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS clicks,
  count(DISTINCT CAST(ts AS DATE)) AS days, max(value) AS top FROM events GROUP BY user_id)"""


def engagement(spark: SparkSession, d: str) -> DataFrame:
    """Users as documents: their events as replies, reactions and teams."""
    e = read(spark, d, "events")
    base = e.groupBy("user_id").agg(F.count("*").alias("reply_count"), F.collect_set("event_type").alias("teams_involved"), F.collect_set(F.to_date("ts").cast("string")).alias("participants"), F.collect_list("ts").alias("thread_timestamps"), F.max("value").alias("top"))
    kinds = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("reactions"))
    rows = base.join(kinds, "user_id").withColumn("author_seniority", F.when(F.col("user_id") % 3 == 0, (F.col("user_id") % 10) / 10))
    return rows.withColumn("domain_expertise", F.create_map(F.lit("Clicks"), (F.col("user_id") % 7) / 7, F.lit("Views"), F.lit(0.9))).withColumn("query", F.lit("click rates"))


@query("""WITH u AS (SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds, count(DISTINCT CAST(ts AS DATE)) AS days, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3600e6 AS h FROM events GROUP BY user_id)
SELECT user_id, round(ln(1 + n) / ln(1001), 6) AS thread_depth, round(ln(1 + days) / ln(1001), 6) AS participant_count, round(ln(1 + n) / ln(1001), 6) AS reaction_count,
  CAST(least(1, kinds) AS DOUBLE) AS reaction_diversity, CAST(least(1, kinds) AS DOUBLE) AS cross_team_engagement, round(CASE WHEN user_id % 3 = 0 THEN (user_id % 10) / 10 ELSE 0.5 END, 6) AS author_seniority,
  0.5::DOUBLE AS channel_importance, round((user_id % 7) / 7, 6) AS domain_expertise, round(CASE WHEN n < 2 THEN 0.0 WHEN h = 0 THEN 1.0 ELSE least(1, (n - 1) / h / 10) END, 6) AS response_velocity FROM u""")
def features_engagement(spark: SparkSession, d: str) -> DataFrame:
    names = ["thread_depth", "participant_count", "reaction_count", "reaction_diversity", "cross_team_engagement", "author_seniority", "channel_importance", "domain_expertise", "response_velocity"]
    made = features.extract_features(engagement(spark, d), reference(), names)
    return made.select("user_id", *[F.round(n, 6).alias(n) for n in names])


@query("""SELECT 'value' AS feature, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(value) AS n FROM events
UNION ALL SELECT 'hour', min(hour(ts)), max(hour(ts)), round(avg(hour(ts)), 6), round(stddev_pop(hour(ts)), 6), count(*) FROM events""")
def feature_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").select("value", F.hour("ts").cast("double").alias("hour"))
    return features.feature_stats(rows, ["value", "hour"]).select("feature", *[F.round(c, 6).alias(c) for c in ("min", "max", "mean", "std")], "n")


@query("""WITH s AS (SELECT min(value) AS lo, max(value) AS hi, avg(value) AS mu, stddev_pop(value) AS sd FROM events)
SELECT event_id, round((value - lo) / (hi - lo), 6) AS minmax, round(CASE WHEN value <= 0 THEN 0 ELSE ln(1 + value) / ln(1001) END, 6) AS log, round((value - mu) / sd, 6) AS zscore, round(1 / (1 + exp(-value / 100)), 6) AS sigmoid FROM events, s""")
def normalizers(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    s = e.agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
    v = F.col("value")
    rows = e.crossJoin(F.broadcast(s))  # one row of statistics
    return rows.select("event_id", F.round(features.normalize(v, "minmax", F.col("lo"), F.col("hi")), 6).alias("minmax"), F.round(features.normalize(v, "log"), 6).alias("log"), F.round(features.normalize(v, "zscore", mean=F.col("mu"), std=F.col("sd")), 6).alias("zscore"), F.round(features.normalize(v / 100, "sigmoid"), 6).alias("sigmoid"))


_LEDGER = """l AS (SELECT event_id AS id, ts, CASE event_id % 4 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' WHEN 2 THEN 'large' ELSE 'other' END AS model, CAST(user_id * 10 + 5 AS BIGINT) AS i, CAST(event_id % 50 + 1 AS BIGINT) AS o FROM events),
p AS (SELECT *, i + o AS t, i / 1e6 * CASE model WHEN 'small' THEN 0.8 WHEN 'large' THEN 15 ELSE 3 END + o / 1e6 * CASE model WHEN 'small' THEN 4 WHEN 'large' THEN 75 ELSE 15 END AS c FROM l)"""


def ledger(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    model = F.when(k % 4 == 0, "small").when(k % 4 == 1, "medium").when(k % 4 == 2, "large").otherwise("other")
    return usage.priced(read(spark, d, "events").select(k.alias("id"), "ts", model.alias("model"), (F.col("user_id") * 10 + 5).cast("bigint").alias("input_tokens"), (k % 50 + 1).cast("bigint").alias("output_tokens")))


@query(f"WITH {_LEDGER} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS calls, CAST(sum(t) AS BIGINT) AS tokens, round(sum(c), 6) AS cost, sum(t) >= 200000 AS near_limit, sum(t) >= 250000 AS over_limit FROM p GROUP BY 1")
def usage_daily(spark: SparkSession, d: str) -> DataFrame:
    return usage.daily(ledger(spark, d), 250_000).withColumn("cost", F.round("cost", 6)).withColumn("day", F.col("day").cast("string"))


@query(f"WITH {_LEDGER} SELECT id, CAST(sum(t) OVER w AS BIGINT) AS used, sum(t) OVER w >= 200000 AS near_limit, sum(t) OVER w >= 250000 AS over_limit FROM p WINDOW w AS (PARTITION BY CAST(ts AS DATE) ORDER BY ts, id ROWS UNBOUNDED PRECEDING)")
def running_quota(spark: SparkSession, d: str) -> DataFrame:
    return usage.running_quota(ledger(spark, d), 250_000).select("id", "used", "near_limit", "over_limit")


@query(f"WITH {_LEDGER} SELECT count(*) AS calls, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, CAST(sum(t) AS BIGINT) AS total_tokens, round(sum(c), 5) AS total_cost, round(avg(t), 6) AS tokens_per_call FROM p WHERE ts >= TIMESTAMP '2024-01-20'")
def usage_summary(spark: SparkSession, d: str) -> DataFrame:
    found = usage.summary(ledger(spark, d), F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return found.withColumn("total_cost", F.round("total_cost", 5)).withColumn("tokens_per_call", F.round("tokens_per_call", 6))


@query("""SELECT CAST(CAST(g AS DATE) AS VARCHAR) AS day, count(e.event_id) AS n FROM generate_series(TIMESTAMP '2023-12-28', TIMESTAMP '2024-02-03', INTERVAL 1 DAY) AS c(g) LEFT JOIN events e ON CAST(e.ts AS DATE) = CAST(g AS DATE) GROUP BY 1""")
def daily_counts(spark: SparkSession, d: str) -> DataFrame:
    return usage.daily_counts(read(spark, d, "events"), "2023-12-28", "2024-02-03").select(F.col("day").cast("string").alias("day"), "n")

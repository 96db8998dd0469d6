"""Detection of duplicate work: cluster, gate, collect evidence, verify, score, validate.

Messages: id, content, timestamp, author, channel. Entities are extracted once per message and the cheap gates
run before the verifier, which sees one row per surviving cluster.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from meshwork.functions import entities, scoring, timefn
from meshwork.operators import cluster as clustering
from meshwork.operators.validate import validate
from meshwork.plans.staging import stage

VERIFICATION = "struct<is_duplicate:boolean,confidence:double,reasoning:string,evidence:array<string>,recommendation:string,overlap_ratio:double>"


@dataclass(frozen=True)
class DetectionConfig:
    similarity_threshold: float = 0.70
    min_cluster_size: int = 2
    time_window_days: int = 30
    min_teams: int = 2
    min_overlap_days: int = 3
    min_confidence: float = 0.7
    min_impact: float = 0.0
    min_evidence: int = 3
    min_overlap_ratio: float = 0.5
    max_gaps: int | None = None
    sources: list[str] = field(default_factory=list)
    channels: list[str] = field(default_factory=list)
    teams: list[str] = field(default_factory=list)
    include_evidence: bool = True
    #: Find similar messages by random projections: most pairs, with work that follows the candidates.
    approximate: bool = False

    def __post_init__(self) -> None:
        if not 0 <= self.similarity_threshold <= 1 or not 0 <= self.min_impact <= 1:
            raise ValueError("thresholds must be 0 to 1")
        if not 1 <= self.time_window_days <= 365:
            raise ValueError("time_window_days must be 1 to 365")
        if self.min_cluster_size < 1 or self.min_teams < 1:
            raise ValueError("minimum sizes must be at least 1")


def heuristic_verifier(gaps: DataFrame, strict: bool = False) -> DataFrame:
    """The default verifier: what the gates left is duplicate work; ``strict`` finds none."""
    fixed = F.struct(
        F.lit(not strict).alias("is_duplicate"),
        F.lit(0.0 if strict else 0.75).alias("confidence"),
        F.format_string("%d teams discuss the same topic in similar messages over the same days", F.size("teams")).alias("reasoning"),
        F.transform(F.slice("evidence", 1, 3), lambda e: e["content"]).alias("evidence"),
        F.lit("Bring the teams together and agree on one owner").alias("recommendation"),
        F.lit(0.0 if strict else 0.8).alias("overlap_ratio"),
    )
    return gaps.withColumn("verification", fixed.cast(VERIFICATION))


def with_teams(messages: DataFrame) -> DataFrame:
    """Adds the normalized team names of each message, in order of extraction."""
    return messages.withColumn("message_teams", F.transform(entities.teams(F.col("content"), F.col("channel")), lambda t: t["normalized"]))


def team_sets(members: DataFrame) -> DataFrame:
    """(cluster_id, teams): sorted distinct teams of each cluster."""
    return members.select("cluster_id", F.explode("message_teams").alias("team")).groupBy("cluster_id").agg(F.sort_array(F.collect_set("team")).alias("teams"))


def timelines(members: DataFrame) -> DataFrame:
    """(cluster_id, team, first, last)."""
    return members.select("cluster_id", "timestamp", F.explode(F.array_distinct("message_teams")).alias("team")).groupBy("cluster_id", "team").agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


def team_overlap(lines: DataFrame) -> DataFrame:
    """(cluster_id, team_a, team_b, start, end, overlap_days): the pair of teams whose times overlap longest.

    Ties go to the first pair in alphabetical order.
    """
    a, b = lines.alias("a"), lines.alias("b")
    start, end = F.greatest("a.first", "b.first"), F.least("a.last", "b.last")
    both = a.join(b, (F.col("a.cluster_id") == F.col("b.cluster_id")) & (F.col("a.team") < F.col("b.team")) & (start <= end))
    days = timefn.overlap_days(F.col("a.first"), F.col("a.last"), F.col("b.first"), F.col("b.last"))
    rows = both.select(F.col("a.cluster_id"), F.col("a.team").alias("team_a"), F.col("b.team").alias("team_b"), start.alias("start"), end.alias("end"), days.alias("overlap_days"))
    order = W.partitionBy("cluster_id").orderBy(F.desc("overlap_days"), "team_a", "team_b")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def evidence(members: DataFrame, teams: DataFrame, per_team: int = 3) -> DataFrame:
    """(cluster_id, evidence): the earliest messages of each team, relevance 1 / rank, most relevant first.

    A message counts for its first team; without one, for the first team whose name its channel holds.
    """
    named = members.join(teams, "cluster_id")
    own = F.get(F.filter("message_teams", lambda t: F.array_contains("teams", t)), F.lit(0))
    channel = F.get(F.filter("teams", lambda t: F.contains(F.lower(F.coalesce(F.col("channel"), F.lit(""))), F.lower(t))), F.lit(0))
    dealt = named.withColumn("team", F.coalesce(own, channel)).where("team is not null")
    order = W.partitionBy("cluster_id", "team").orderBy("timestamp", "id")
    top = dealt.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= per_team)
    item = F.struct((-1.0 / F.col("rn")).alias("_order"), F.col("team"), F.col("timestamp"), F.col("id").alias("message_id"), F.col("channel"), F.col("author"), F.substring("content", 1, 500).alias("content"), (1.0 / F.col("rn")).alias("relevance"))
    return top.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(item)), lambda e: e.dropFields("_order")).alias("evidence"))


def topic_of(found: Column) -> Column:
    """The first five words of the leading evidence."""
    words = F.filter(F.split(F.trim(F.get(found, F.lit(0))["content"]), r"\s+"), lambda w: w != "")
    return F.when(F.size(words) > 0, F.array_join(F.slice(words, 1, 5), " ")).otherwise("Unknown topic")


def topic_mode(members: DataFrame) -> DataFrame:
    """(cluster_id, topic): the most frequent project; ties go to the first in alphabetical order."""
    named = members.select("cluster_id", F.explode(F.transform(entities.projects(F.col("content")), lambda p: p["normalized"])).alias("topic"))
    counted = named.groupBy("cluster_id", "topic").agg(F.count("*").alias("n"))
    order = W.partitionBy("cluster_id").orderBy(F.desc("n"), "topic")
    return counted.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("cluster_id", "topic", "n")


def assemble(clusters: DataFrame, reference: Column) -> DataFrame:
    """Gap rows from (cluster_id, size, avg_similarity, participant_count, timespan_days, teams, overlap, evidence, verification)."""
    n_teams, n = F.size("teams"), F.size("evidence")
    parts = scoring.impact_components(teams=n_teams, participants=F.col("participant_count"), evidence=n, commits=F.lit(0), overlap_days=F.col("overlap.overlap_days"), tags=F.array().cast("array<string>"), blocked=F.lit(0), overlap_ratio=F.col("verification.overlap_ratio"))
    df = clusters.withColumn("topic", topic_of(F.col("evidence")))
    df = df.withColumn("impact_score", scoring.impact(parts)).withColumn("impact_breakdown", F.struct(*[c.alias(k) for k, c in parts.items()]))
    insight = F.format_string("%d teams (%s) are working on %s, in %d messages over %d days. %s", n_teams, F.array_join("teams", ", "), F.col("topic"), n, F.col("overlap.overlap_days"), F.col("verification.reasoning"))
    return df.select(
        F.concat(F.lit("gap_"), F.substring(F.sha2(F.concat_ws("|", F.col("cluster_id").cast("string"), F.array_join("teams", ","), reference.cast("string")), 256), 1, 12)).alias("gap_id"),
        F.lit("duplicate_work").alias("type"),
        F.concat(F.lit("Multiple teams working on "), F.col("topic")).alias("title"),
        "topic",
        F.col("teams").alias("teams_involved"),
        "impact_score",
        scoring.tier(F.col("impact_score")).alias("impact_tier"),
        (0.7 * F.col("verification.confidence") + 0.3 * F.col("avg_similarity")).alias("confidence"),
        "evidence",
        F.col("overlap").alias("temporal_overlap"),
        "verification",
        "impact_breakdown",
        scoring.cost(n_teams, n, F.lit(0)).alias("estimated_cost"),
        insight.alias("insight"),
        F.col("verification.recommendation").alias("recommendation"),
        reference.alias("detected_at"),
        "cluster_id",
        F.col("participant_count").alias("people_affected"),
        F.floor(F.coalesce("timespan_days", F.lit(0.0))).cast("int").alias("timespan_days"),
        F.col("size").alias("messages_analyzed"),
    )


def gaps_of(members: DataFrame, reference: Column, config: DetectionConfig, verifier: Callable[[DataFrame], DataFrame] = heuristic_verifier) -> DataFrame:
    """Gaps of clustered messages (with cluster_id and message_teams) that pass the gates, with the rules they break."""
    stats = clustering.cluster_metadata(members).where(F.col("size") >= config.min_cluster_size)
    teams = team_sets(members)
    overlap = team_overlap(timelines(members))
    gated = stats.join(teams.where(F.size("teams") >= config.min_teams), "cluster_id")
    gated = gated.where(F.arrays_overlap("teams", F.array(*[F.lit(t) for t in config.teams]))) if config.teams else gated
    gated = gated.join(overlap.where(F.col("overlap_days") >= config.min_overlap_days).select("cluster_id", F.struct("start", "end", "overlap_days", "team_a", "team_b").alias("overlap")), "cluster_id")
    full = gated.join(evidence(members, teams), "cluster_id")
    checked = stage(verifier(full), "verified")
    return validate(assemble(checked, reference), min_confidence=config.min_confidence, min_teams=config.min_teams, min_evidence=config.min_evidence, min_overlap_days=config.min_overlap_days, min_overlap_ratio=config.min_overlap_ratio)


def detect(messages: DataFrame, embeddings: DataFrame, reference: Column, config: DetectionConfig = DetectionConfig(), verifier: Callable[[DataFrame], DataFrame] = heuristic_verifier) -> DataFrame:
    """Valid gaps, by falling impact. ``embeddings`` has message_id and embedding."""
    start = reference - F.make_dt_interval(F.lit(config.time_window_days))
    scan = messages.where(F.col("timestamp").between(start, reference))
    for name, wanted in (("source", config.sources), ("channel", config.channels)):
        scan = scan.where(F.col(name).isin(wanted)) if wanted else scan
    rows = scan.join(embeddings.select(F.col("message_id").alias("id"), "embedding"), "id").where("embedding is not null")
    rows = stage(with_teams(rows), "messages")
    pairs = clustering.similar_pairs_lsh if config.approximate else clustering.similar_pairs
    members = stage(rows.join(clustering.cluster(rows, config.similarity_threshold, pairs=pairs), "id"), "members")
    gaps = gaps_of(members, reference, config, verifier)
    kept = gaps.where("is_valid").where(F.col("impact_score") >= config.min_impact).drop("is_valid", "failures")
    kept = kept if config.include_evidence else kept.withColumn("evidence", F.array().cast(kept.schema["evidence"].dataType))
    kept = kept.orderBy(F.desc("impact_score"), "gap_id")
    return kept.limit(config.max_gaps) if config.max_gaps else kept


def tier_histogram(gaps: DataFrame) -> DataFrame:
    return gaps.agg(F.count("*").alias("total"), *[F.count_if(F.col("impact_tier") == t).alias(t.lower()) for t in ("CRITICAL", "HIGH", "MEDIUM", "LOW")])


def dashboard(gaps: DataFrame) -> DataFrame:
    """One row of totals: gaps, cost, mean impact and confidence, distinct teams."""
    teams = gaps.select(F.explode("teams_involved").alias("t")).agg(F.count_distinct("t").alias("teams"))
    return gaps.agg(F.count("*").alias("gaps"), F.coalesce(F.sum("estimated_cost.dollars"), F.lit(0.0)).alias("cost"), F.avg("impact_score").alias("avg_impact"), F.avg("confidence").alias("avg_confidence")).crossJoin(teams)


def page(gaps: DataFrame, page_number: int = 1, limit: int = 20) -> DataFrame:
    """One page by falling impact, with ``total`` and ``has_more``; the total is a single broadcast row."""
    if page_number < 1 or not 1 <= limit <= 100:
        raise ValueError("page must be at least 1, limit 1 to 100")
    total = gaps.agg(F.count("*").alias("total"))
    rows = gaps.orderBy(F.desc("impact_score"), "gap_id").offset((page_number - 1) * limit).limit(limit)
    return rows.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > page_number * limit)


def gap_by_id(gaps: DataFrame, gap_id: str) -> DataFrame:
    return gaps.where(F.col("gap_id") == gap_id).limit(1)


def team_cooccurrence(gaps: DataFrame, teams: str = "teams_involved") -> DataFrame:
    """(team_a, team_b, n): gaps two teams share; a team with itself counts its gaps."""
    one = gaps.select(F.explode(F.array_distinct(teams)).alias("team_a"), F.col(teams).alias("all"))
    return one.select("team_a", F.explode(F.array_distinct("all")).alias("team_b")).groupBy("team_a", "team_b").agg(F.count("*").alias("n"))


def reasoning_chain(gaps: DataFrame, insights: Callable[[DataFrame], DataFrame], recommendations: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Later steps only where earlier ones are confident: insights from 0.6, recommendations from 0.7."""
    sure = F.col("verification.is_duplicate") & (F.col("verification.confidence") >= 0.6)
    strong = sure & (F.col("verification.confidence") >= 0.7)
    first = insights(gaps.where(sure & ~strong)).withColumn("recommendations", F.lit(None).cast("string"))
    return first.unionByName(recommendations(insights(gaps.where(strong)))).unionByName(gaps.where(F.coalesce(~sure, F.lit(True))).withColumn("insights", F.lit(None).cast("string")).withColumn("recommendations", F.lit(None).cast("string")))

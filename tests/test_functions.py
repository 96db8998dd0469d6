from __future__ import annotations

import math
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meshwork.functions import entities, features, query, scoring, text, timefn, vector

REF = datetime(2024, 1, 31)


def one(spark, *columns, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    row = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return row[0] if len(columns) == 1 else tuple(row)


def L(x):  # noqa: N802
    return F.lit(x)


def when(x):
    return F.lit(x).cast("timestamp")


# --- text


def test_cleaning(spark):
    assert one(spark, text.clean_text(L("  a \n\t b  "))) == "a b"
    assert one(spark, text.clean_text(L(None))) == ""
    assert one(spark, text.remove_urls(L("see https://x.example/a?b=1 now"))) == "see  now"
    assert one(spark, text.remove_mentions(L("hi @bob_1 and @zoë!"))) == "hi  and !"
    assert one(spark, text.normalize_whitespace(L("  a   b\n\n\n\nc "))) == "a b\n\nc"
    assert one(spark, text.truncate_text(L("abcdefghij"), 8)) == "abcde..."
    assert one(spark, text.truncate_text(L("abc"), 8)) == "abc"
    assert one(spark, text.combine_fields(L(" a "), L(""), L(None), L("b"))) == "a b"


def test_names(spark):
    assert one(spark, text.normalize_username(L("@Alice"))) == "alice@company.com"
    assert one(spark, text.normalize_username(L("Bob@X.com"))) == "bob@x.com"
    assert [one(spark, text.normalize_team_name(L(t))) for t in ("@platform-team", "#platform", "Data_Eng")] == ["platform-team", "platform-team", "data-eng-team"]
    assert [one(spark, text.is_email(L(t))) for t in ("a.b@c.de", "a@b", "@x")] == [True, False, False]
    assert [one(spark, text.email_domain(L(t))) for t in ("a@B.com", "nothing")] == ["b.com", ""]
    assert [one(spark, text.is_mention(L(t))) for t in ("@a-b", "@a b")] == [True, False]
    assert [one(spark, text.is_channel(L(t))) for t in ("#dev", "dev")] == [True, False]


def test_term_counts_are_token_counts(spark):
    t = "Oauth oauth, oauth\toauth-x oauth\nx.oauth OAUTH"
    assert one(spark, text.term_count(L(t), "oauth")) == t.lower().split().count("oauth")
    assert one(spark, text.token_count(L(t))) == len(t.split())
    assert one(spark, text.tokens(L(t))) == t.lower().split()
    assert one(spark, text.term_count(L("a.b a.b axb"), "a.b")) == 2


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abc.! \n", max_size=400), st.integers(10, 120), st.integers(0, 30))
def test_chunks_cover_the_text(body, size, overlap):
    pieces = list(text._cuts(body, size, overlap, 0))
    assert all(p in body and len(p) <= max(size, len(body) if len(body) <= size else 0) for p in pieces)
    if len(body) > size:
        whole = "".join("".join(text._cuts(body, size, 0, 0)).split())
        assert whole == "".join(body.split())  # without overlap nothing is lost or repeated


def test_chunks(spark):
    df = spark.createDataFrame([(0, "Short text."), (1, None), (2, "This is a sentence. " * 60)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", text.chunk_text(200, 20, 50)(F.col("t")).alias("c")).collect()}
    assert got[0] == ["Short text."] and got[1] == []
    assert len(got[2]) > 5 and all(50 <= len(c) <= 200 and c.endswith(".") for c in got[2][:-1])


def test_keywords(spark):
    df = spark.createDataFrame([(1, "the cache cache token is a token zebra of apple")], "id int, t string")
    assert [(r.word, r.n) for r in text.keywords(df, "id", "t", 3).orderBy("rank").collect()] == [("cache", 2), ("token", 2), ("zebra", 1)]


# --- time


def test_recency(spark):
    ref = when(REF)
    age = lambda d: when(REF - timedelta(days=d))
    assert one(spark, timefn.recency(age(14), ref, 7.0)) == pytest.approx(0.25)
    assert one(spark, timefn.recency(age(-3), ref, 7.0)) == 1.0
    assert one(spark, timefn.recency(F.lit(None).cast("timestamp"), ref)) == 0.0
    assert one(spark, timefn.edit_freshness(age(90), age(7), ref)) == pytest.approx(0.5)
    got = [one(spark, timefn.temporal_relevance(age(d), ref, 90.0)) for d in (45, 60, 90, 180)]
    assert got == pytest.approx([1.0, 0.8333333, 0.5, 0.25])
    assert one(spark, timefn.temporal_relevance(F.lit(None).cast("timestamp"), ref)) == 0.5


def test_bursts(spark):
    def burst(old: int, new: int, hours: int = 264) -> float:
        first = REF - timedelta(hours=hours)
        ts = [first] + [first + timedelta(hours=i % 200) for i in range(old - 1)] + [REF - timedelta(hours=1)] * new
        return one(spark, timefn.activity_burst(F.array(*[when(t) for t in ts]), when(REF)))

    assert burst(10, 3) == pytest.approx(1.0)
    assert burst(20, 4) == pytest.approx(0.75)
    assert burst(10, 0) == 0.0
    empty = F.array().cast("array<timestamp>")
    assert one(spark, timefn.activity_burst(empty, when(REF))) == 0.0


def test_velocity(spark):
    at = lambda *m: F.array(*[when(REF + timedelta(minutes=x)) for x in m])
    assert one(spark, timefn.response_velocity(at(0, 15, 30, 45))) == pytest.approx(0.4)
    assert one(spark, timefn.response_velocity(at(0, 0))) == 1.0
    assert one(spark, timefn.response_velocity(at(0))) == 0.0


def test_overlaps(spark):
    d = lambda n: when(datetime(2024, 1, n))
    has, share = one(spark, *timefn.window_overlap(d(1), d(10), d(5), d(15)))
    assert has and share == pytest.approx(5 / 9)
    assert one(spark, *timefn.window_overlap(d(1), d(5), d(5), d(9))) == (False, 0.0)
    assert one(spark, *timefn.window_overlap(d(1), d(9), d(5), d(5)))[0] is False
    assert [one(spark, timefn.overlap_days(*map(d, x))) for x in ((1, 10, 5, 15), (4, 4, 4, 4), (1, 2, 8, 9))] == [5, 0, 0]
    assert one(spark, timefn.parse_iso(L("2024-01-02T03:04:05Z"))) == datetime(2024, 1, 2, 3, 4, 5)
    assert one(spark, timefn.parse_iso(L("yesterday"))) is None


# --- vectors


def arr(*x):
    return F.array(*[F.lit(float(v)) for v in x])


def test_cosine(spark):
    assert one(spark, vector.cosine(arr(1, 0), arr(1, 1))) == pytest.approx(math.sqrt(0.5))
    assert one(spark, vector.cosine(arr(0, 0), arr(1, 1))) == 0.0
    assert one(spark, vector.cosine(arr(1, 0), arr(-1, 0))) == 0.0
    assert one(spark, vector.cosine_distance(arr(2, 0), arr(3, 0))) == 0.0
    assert one(spark, vector.unit(arr(3, 4))) == pytest.approx([0.6, 0.8])
    assert one(spark, vector.similarity_of_distance(L(1.0))) == 0.5
    with pytest.raises(Exception, match="positive length"):
        one(spark, vector.cosine(arr(1), arr(1, 2)))


# --- entities


def names(spark, column):
    return [x["normalized"] for x in one(spark, column)]


def test_people(spark):
    body = "Hi @alice, mail bob@x.com and @carol-team. thanks @dave"
    assert names(spark, entities.people(L(body), L("@Eve"))) == ["bob@x.com", "alice@company.com", "dave@company.com", "eve@company.com"]
    assert names(spark, entities.people(L("@alice @alice"), L("alice"))) == ["alice@company.com"]
    assert names(spark, entities.people(L(None), L(None))) == []


def test_teams(spark):
    t = lambda body, channel: names(spark, entities.teams(L(body), L(channel)))
    assert t("ask @Auth_Team now", "#general") == ["auth-team"]
    assert t("hello", "platform-infra") == ["platform-team"]
    assert t("hello", "checkout") == ["checkout-team"]
    assert t("hello", "auth-team") == ["auth-team"]
    assert t("the security folks", "random") == ["security-team"]
    assert t("@platform-team", "platform") == ["platform-team"]
    assert t("x", "backend-data") == ["backend-team"]


def test_projects_and_topics(spark):
    assert names(spark, entities.projects(L("PROJ-12 moves the API and CI/CD to SSO, OK"))) == ["proj-12", "api", "ci/cd", "sso", "proj", "ci", "cd"]
    assert names(spark, entities.topics(L("testing the database; api"))) == ["api", "database", "testing"]
    found = entities.extract(L("api @bob"), L("al"), L("dev"), with_teams=False)
    assert one(spark, entities.entity_count(found)) == 4
    assert one(spark, entities.normalize_entity(L(" OAuth "), "topic")) == "oauth"
    assert one(spark, entities.normalize_entity(L("#Data"), "team")) == "data-team"


# --- queries


@pytest.mark.parametrize(
    ("q", "intent", "strategy"),
    [
        ("oauth", "keyword", "bm25"),
        ("oauth token", "keyword", "hybrid_weighted"),
        ("oauth token refresh flow", "semantic", "hybrid_rrf"),
        ("how do we deploy", "question", "hybrid_rrf"),
        ('"exact text"', "exact_phrase", "bm25"),
        ("a and b", "boolean", "bm25"),
        ("cross-team", "boolean", "bm25"),
        ("however it goes", "question", "hybrid_rrf"),
        ("a", "keyword", "hybrid_weighted"),
        ("  ", "empty", "hybrid_rrf"),
    ],
)
def test_intents(spark, q, intent, strategy):
    assert one(spark, query.intent(L(q)), query.strategy(L(q))) == (intent, strategy)
    assert (query.parse_text(q)["intent"], query.parse_text(q)["recommended_strategy"]) == (intent, strategy)


def test_inline_filters(spark):
    q = "Source:slack channel:#dev author:a@b.c date:2024-01-02 login flow"
    assert one(spark, query.inline_filters(L(q))).asDict() == {"source": "slack", "channel": "#dev", "author": "a@b.c", "date": "2024-01-02"}
    assert one(spark, query.without_filters(L(q))) == "login flow"
    assert one(spark, query.terms(L("  A  bc  D ef "))) == ["bc", "ef"]


# --- features


def test_feature_table():
    assert len(features.FEATURES) == 24 and len(features.default_features()) == 23
    assert features.minimal_features() == ["semantic_score", "bm25_score", "exact_match", "term_coverage", "recency"]
    assert "view_count" not in features.category_features("engagement")


def test_normalizers(spark):
    n = lambda x, how, **k: one(spark, features.normalize(L(float(x)), how, **k))
    assert n(10, "log") == pytest.approx(0.347081, abs=1e-6)
    assert n(-1, "log") == 0.0
    assert n(1, "sigmoid") == pytest.approx(0.731059, abs=1e-6)
    assert n(7, "minmax") == 1.0
    assert n(7, "minmax", low=7, high=7) == 0.5
    assert n(5, "zscore", mean=3, std=2) == 1.0 and n(5, "zscore", mean=3, std=0) == 0.0
    with pytest.raises(ValueError, match="unknown"):
        features.normalize(L(1.0), "other")


def test_features(spark):
    df = spark.createDataFrame(
        [("Fix Oauth flow", "we fix the oauth Flow `x` http://a.b/c", "oauth-dev", REF - timedelta(days=30), {"a": 2, "b": 3}, ["x", "x", "y"], {"OAuth": 0.9, "db": 1.0})],
        "query string, content string, channel string, timestamp timestamp, reactions map<string,int>, participants array<string>, domain_expertise map<string,double>",
    )
    r = features.extract_features(df, when(REF), [f.name for f in features.FEATURES]).first()
    assert (r.exact_match, r.term_coverage, r.code_snippet_present) == (0.0, 1.0, 1.0)
    assert r.title_match == pytest.approx(1 / 3) and r.entity_overlap == 0.0
    assert r.recency == pytest.approx(0.5) and r.reaction_diversity == 1.0
    assert r.reaction_count == pytest.approx(math.log(6) / math.log(1001)) and r.participant_count == pytest.approx(math.log(3) / math.log(1001))
    assert (r.author_seniority, r.domain_expertise, r.semantic_score, r.temporal_relevance) == (0.5, 0.9, 0.0, 1.0)
    assert r.link_count == pytest.approx(math.log(2) / math.log(1001))
    listed = df.drop("reactions").withColumn("reaction_list", F.array(F.struct(F.lit("a").alias("emoji"), F.lit(5).alias("count"))))
    r = features.extract_features(listed, when(REF), ["reaction_count", "reaction_diversity"]).first()
    assert r.reaction_count == pytest.approx(math.log(2) / math.log(1001)) and r.reaction_diversity == 0.0


def test_feature_stats(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    assert [tuple(r) for r in features.feature_stats(df, ["x"]).collect()] == [("x", 1.0, 3.0, 2.0, 1.0, 2)]
    assert features.feature_stats(df.limit(1), ["x"]).first()["std"] == 0.0


# --- impact and cost


def impact(spark, **v):
    base = {"teams": 2, "participants": 0, "evidence": 6, "commits": 0, "overlap_days": 10, "tags": None, "blocked": 0, "overlap_ratio": 0.8} | v
    tags = F.array(*[F.lit(t) for t in base.pop("tags") or []]).cast("array<string>")
    parts = scoring.impact_components(tags=tags, **{k: F.lit(x) for k, x in base.items()})
    return one(spark, scoring.impact(parts), parts["time_investment"], scoring.tier(scoring.impact(parts)))


def test_impact(spark):
    assert impact(spark, participants=4) == (pytest.approx(0.37), pytest.approx(0.09), "LOW")
    assert impact(spark, participants=12, evidence=60, commits=10, overlap_days=14, tags=["Roadmap"], blocked=3, overlap_ratio=0.9) == (pytest.approx(0.86), pytest.approx(0.76), "CRITICAL")
    assert impact(spark, participants=6, overlap_days=2) == (pytest.approx(0.45), pytest.approx(0.11), "MEDIUM")
    assert [one(spark, scoring.tier(L(x))) for x in (0.8, 0.6, 0.4, 0.39)] == ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
    with pytest.raises(ValueError, match="sum to 1"):
        scoring.impact({k: F.lit(1.0) for k in scoring.WEIGHTS}, dict.fromkeys(scoring.WEIGHTS, 0.5))


def test_cost(spark):
    assert [one(spark, scoring.team_multiplier(L(n))) for n in (1, 2, 3, 5)] == pytest.approx([1.0, 1.7, 2.4, 3.2])
    c = one(spark, scoring.cost(L(2), L(6), L(0)))
    assert (c.hours, c.dollars) == (9.8, 977.5) and c.explanation.startswith("2 teams")
    hours = [one(spark, scoring.cost_hours(*map(L, x))) for x in ((3, 9, 0), (2, 30, 10), (5, 20, 0), (1, 2, 0))]
    assert hours == pytest.approx([13.8, 68.425, 36.8, 5.75])
    assert one(spark, scoring.simple_cost(L(0.5), L(4))) == 2000.0

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meshwork.operators import bm25, cluster, detect, evaluation, filters, fusion, search, usage
from meshwork.operators.validate import evidence_quality, validate, verification_quality
from meshwork.plans import components as plans
from meshwork.plans import sieve
from meshwork.plans.components import components
from meshwork.sources import files, scenarios, stores, textindex

REF = datetime(2024, 6, 30)


def ref():
    return F.lit("2024-06-30 00:00:00").cast("timestamp")


# --- BM25 and fusion

CORPUS = [(1, "oauth token refresh flow"), (2, "oauth oauth server design"), (3, "database schema migration plan for billing"), (4, "frontend layout bug"), (5, "token cache")]


@pytest.fixture
def corpus(spark):
    return spark.createDataFrame(CORPUS, "doc_id bigint, text string")


def test_bm25(corpus):
    got = {r.doc_id: r.score for r in bm25.score(corpus, "OAuth token").collect()}
    assert got == {1: pytest.approx(0.657375, abs=1e-6), 2: pytest.approx(0.472678, abs=1e-6), 5: pytest.approx(0.427624, abs=1e-6)}
    assert bm25.score(corpus, "  ").collect() == []
    twice = {r.doc_id: r.score for r in bm25.score(corpus, "token token").collect()}
    assert twice[5] == pytest.approx(2 * 0.427624, abs=1e-6)
    stats = bm25.collection_stats(corpus, "text").first()
    assert (stats.n_docs, stats.n_tokens, stats.avgdl) == (5, 19, 3.8)
    parts = bm25.score(corpus, "oauth", explain=True).where("doc_id = 2").first()
    assert (parts.terms[0].tf, parts.terms[0].df, parts.dl) == (2, 2, 4)
    assert parts.terms[0].idf == pytest.approx(0.336472, abs=1e-6)


def test_bm25_statistics_cover_the_corpus_of_a_filtered_search(corpus):
    part = bm25.score(corpus.where("doc_id = 5"), "oauth token", corpus=corpus).collect()
    assert [(r.doc_id, round(r.score, 6)) for r in part] == [(5, 0.427624)]


def test_bm25_floor_and_batch(spark, corpus):
    common = spark.createDataFrame([(i, "same words") for i in range(4)], "doc_id bigint, text string")
    assert {r.score for r in bm25.score(common, "same").collect()} == {0.0}
    queries = spark.createDataFrame([("a", "oauth token"), ("b", "bug"), ("c", "")], "query_id string, query string")
    got = {(r.query_id, r.doc_id): (round(r.score, 6), r["rank"]) for r in bm25.score_queries(corpus, queries, k=2).collect()}
    assert got[("a", 1)] == (0.657375, 1) and got[("a", 2)] == (0.472678, 2) and ("b", 4) in got and len(got) == 3


def hits(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, score double, rank int")


def test_rrf_and_weighted(spark):
    sem = hits(spark, [(1, 1.0, 1), (2, 0.6, 2), (3, 0.2, 3)])
    kw = hits(spark, [(2, 9.0, 1), (4, 3.0, 2)])
    got = [(r.doc_id, round(r.score, 6)) for r in fusion.rrf(sem, kw).orderBy(*fusion.fusion_order()).collect()]
    assert got == [(2, 0.032522), (1, 0.016393), (4, 0.016129), (3, 0.015873)]
    assert fusion.rrf(sem, kw).where("doc_id = 2").first().ranking_details.keyword_rank == 1
    alone = {r.doc_id: round(r.score, 6) for r in fusion.weighted(sem, kw.limit(0)).collect()}
    assert alone == {1: 0.7, 2: 0.35, 3: 0.0}
    assert {r.normalized for r in fusion.minmax(hits(spark, [(1, 2.0, 1), (2, 2.0, 2)])).collect()} == {1.0}
    with pytest.raises(ValueError, match="sum to 1"):
        fusion.weighted(sem, kw, 0.5, 0.3)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 9), unique=True, max_size=6), st.lists(st.integers(1, 9), unique=True, max_size=6))
def test_rrf_is_symmetric(spark, a, b):
    x, y = (hits(spark, [(d, 1.0 / (i + 1), i + 1) for i, d in enumerate(ids)]) for ids in (a, b))
    one = {r.doc_id: round(r.score, 12) for r in fusion.rrf(x, y).collect()}
    two = {r.doc_id: round(r.score, 12) for r in fusion.rrf(y, x).collect()}
    assert one == two and set(one) == set(a) | set(b) and all(0 < s <= 2 / 61 + 1e-9 for s in one.values())


def test_keep_best_and_threshold(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.9), (None, 0.5), (None, 0.1), (2, None)], "doc_id bigint, score double")
    assert sorted((r.doc_id or 0, r.score) for r in fusion.keep_best(df).where("score is not null").collect()) == [(0, 0.1), (0, 0.5), (1, 0.9)]
    assert fusion.threshold(df, 0.5).count() == 2 and fusion.threshold(df, 0.0).count() == 5


# --- filters and search


def test_filters(spark):
    df = spark.createDataFrame([("slack", "a", "u", datetime(2024, 1, 1), {"k": "1"}), ("git", "A", "v", datetime(2024, 1, 3), None), ("git", "b", "v", None, {"k": "1"})], "source string, channel string, author string, timestamp timestamp, metadata map<string,string>")
    assert filters.SearchFilter().is_empty() and filters.SearchFilter().apply(df).count() == 3
    assert filters.SearchFilter(channels=["a"]).apply(df).count() == 1
    assert filters.SearchFilter(sources=["git"], metadata={"k": "1"}).apply(df).count() == 1
    assert filters.filter_results(df, date_from=datetime(2024, 1, 1), date_to=datetime(2024, 1, 3)).count() == 2
    assert filters.SearchFilter(channels=["a"]).to_dict() == {"channels": ["a"]}
    assert filters.recent(df, F.lit("2024-01-04 00:00:00").cast("timestamp"), 1).count() == 1
    text = spark.createDataFrame([("2024-01-02",), ("now",), (None,)], "timestamp string")
    lo, hi = (F.lit(x).cast("timestamp") for x in ("2024-01-01", "2024-01-05"))
    assert filters.within(text, lo, hi).count() == 1
    ids = spark.createDataFrame([("msg_12",), ("msg_x",), ("12",), (None,), ("msg_99999999999999999999",)], "t string").select(filters.numeric_id(F.col("t")).alias("i"))
    assert [r.i for r in ids.collect()] == [12, None, None, None, None]


@pytest.fixture
def world(spark):
    now = datetime(2024, 1, 1)
    rows = [(i, 1 + i % 2, t, f"e{i}", "u", "dev" if i < 3 else "ops", None, now + timedelta(days=i), None) for i, t in CORPUS]
    messages = spark.createDataFrame(rows, stores.MESSAGES)
    sources = spark.createDataFrame([(1, "slack"), (2, "git")], "id bigint, type string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (9, [1.0, 0.0])], "message_id bigint, embedding array<double>")
    return messages, sources, vectors


def ids(df):
    return [r.message_id for r in df.collect()]


def test_strategies(world):
    ask = lambda s, **k: search.search(search.SearchRequest("oauth token", [1.0, 0.0], ranking_strategy=s, **k), *world)
    assert ids(ask("bm25")) == [1, 2, 5]
    assert ids(ask("semantic")) == [1, 2, 3]
    assert ids(ask("semantic", threshold=0.5)) == [1, 2]
    assert ids(ask("hybrid_rrf"))[:2] == [1, 2]
    assert ids(ask("hybrid_weighted"))[0] == 1
    assert ids(ask("auto"))[0] == 1
    assert search.strategy_of(search.SearchRequest("oauth")) == "bm25"
    first = ask("bm25").first()
    assert (first.source, first.channel, first.external_id) == ("git", "dev", "e1")


def test_an_operator_before_the_words_is_no_term(world):
    ask = lambda q, s: search.search(search.SearchRequest(q, [1.0, 0.0], ranking_strategy=s), *world)
    scores = lambda df: {r.message_id: (r.score, r.semantic_rank) for r in df.collect()}
    dashed = world[0].withColumn("content", F.when(F.col("id") == 4, "- frontend +").otherwise(F.col("content")))
    world = (dashed, *world[1:])
    assert scores(ask("+ oauth token", "auto")) == scores(ask("oauth token", "bm25")) != {}
    assert scores(ask("- who has oauth", "auto")) == scores(ask("who has oauth", "bm25")) != {}
    assert ids(ask("+ + layout", "auto")) == ids(ask("+", "bm25")) == [4] and ids(ask("+", "auto")) == []


def test_filters_after_and_before_ranking(world):
    ops = filters.SearchFilter(channels=["ops"])
    after = search.SearchRequest("oauth token", limit=1, ranking_strategy="bm25", filter=ops)
    before = search.SearchRequest("oauth token", limit=1, ranking_strategy="bm25", filter=ops, prefilter=True)
    assert ids(search.search(after, *world)) == [] and ids(search.search(before, *world)) == [5]


@pytest.mark.parametrize("bad", [{"query": "  "}, {"query": "x" * 1001}, {"limit": 0}, {"limit": 101}, {"threshold": 2.0}, {"ranking_strategy": "best"}, {"semantic_weight": -1.0}])
def test_requests_are_checked(bad):
    with pytest.raises(ValueError, match="must"):
        search.SearchRequest(**({"query": "q"} | bad))


def test_batched_neighbours_equal_single_ones(spark):


    x = np.random.default_rng(0).normal(size=(60, 5))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(99, [0.0] * 5)], "vec_id bigint, embedding array<double>").repartition(3)
    asked = v.where("vec_id < 4").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    got = sorted((r.query_id, r["rank"], r.doc_id) for r in search.knn_queries(v, asked, 6).collect())
    for q in range(4):
        one = search.knn(v, F.array(*[F.lit(float(c)) for c in x[q]]), 6, "vec_id").orderBy("rank").collect()
        assert [d for i, _, d in got if i == q] == [r.doc_id for r in one]
    assert search.knn_queries(v, asked.limit(0), 6).collect() == []


# --- clusters


@pytest.mark.parametrize("few", [0, 3, 1 << 18])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(plans, "FEW", few)
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (7, 7), (1, None), (20, 11), (20, 12), (20, 13), (5, 4)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(e, "a", "b").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, 11: 11, 12: 11, 13: 11, 20: 11}
    assert components(e.limit(0), "a", "b").collect() == []


@pytest.mark.parametrize("few", [0, 1 << 18])
@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(edges=st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components_are_a_partition(spark, few, edges):
    plans.FEW, before = few, plans.FEW
    up = list(range(26))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    try:
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    finally:
        plans.FEW = before
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


GROUPS = [(1, [1.0, 0.1, 0.0]), (2, [1.0, 0.0, 0.1]), (3, [0.9, 0.1, 0.1]), (4, [0.0, 1.0, 0.1]), (5, [0.1, 1.0, 0.0]), (6, [0.0, 0.1, 1.0]), (7, [0.1, 0.0, 1.0]), (8, [0.1, 0.1, 1.0]), (9, [0.6, 0.6, 0.6]), (10, None)]


@pytest.mark.parametrize("block", [2048, 2])
def test_clusters(spark, monkeypatch, block):
    monkeypatch.setattr(cluster, "BLOCK_ROWS", block)
    v = spark.createDataFrame(GROUPS, "id bigint, embedding array<double>")
    one = {r.id: r.cluster_id for r in cluster.cluster(v, 0.9).collect()}
    assert one == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 6, 9: 9}
    dense = {r.id: r.cluster_id for r in cluster.cluster(v, 0.9, min_samples=3).collect()}
    assert dense == {1: 1, 2: 1, 3: 1, 6: 6, 7: 6, 8: 6}
    assert cluster.pairwise(v).count() == 36


def test_pairs_send_each_vector_to_few_blocks(spark, monkeypatch):
    sent, blocked = [], cluster._blocked
    monkeypatch.setattr(cluster, "BLOCK_ROWS", 2)
    monkeypatch.setattr(cluster, "_blocked", lambda units, *a, **k: sent.append(units) or blocked(units, *a, **k))
    rng = np.random.default_rng(5)
    for x, size in ((rng.integers(-9, 9, (64, 4)) / 2, 4), (rng.normal(size=(64, 4)), 8)):
        v = spark.createDataFrame([(i * 3, r.tolist()) for i, r in enumerate(x)] + [(900, None)], "id bigint, embedding array<double>")
        got = {(r.a, r.b): r.sim for r in cluster.similar_pairs(v, -2.0).collect()}
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        assert got == {(i * 3, j * 3): pytest.approx(u[i] @ u[j]) for i in range(64) for j in range(i + 1, 64)}
        kind = dict(sent[-1].dtypes)["v"]
        assert sent[-1].agg(F.sum(F.length("v") if kind == "binary" else 8 * F.size("v"))).first()[0] == 8 * 64 * 4 * size


@pytest.mark.parametrize("least", [-2.0, -0.3, 0.2])
def test_pairs_by_bands_are_all_there_once(spark, monkeypatch, least):
    monkeypatch.setattr(cluster, "BLOCK_ROWS", 16)
    monkeypatch.setattr(cluster, "TILE", (5, 7))
    x = np.random.default_rng(6).normal(size=(70, 4))
    x[50:60], x[60:65], x[65] = x[:10] * 2, -x[:5], 0
    v = spark.createDataFrame([(997 * i % 70, r.tolist()) for i, r in enumerate(x)] + [(900, None)], "id bigint, embedding array<double>")
    got = sorted((r.a, r.b, r.sim) for r in cluster.similar_pairs(v, least, bands=3).collect())
    assert got == sorted((r.a, r.b, pytest.approx(r.sim)) for r in cluster.similar_pairs(v, least).collect())
    if least == -2.0:
        assert [(a, b) for a, b, _ in got] == [(a, b) for a in range(70) for b in range(a + 1, 70)]


def test_pairwise_result_is_small_on_disk(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(cluster, "BLOCK_ROWS", 4096)
    x = np.random.default_rng(7).normal(size=(2500, 64))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, embedding array<double>")
    cluster.pairwise(v).withColumn("sim", F.floor(F.col("sim") * 1e6 + 0.5) / 1e6).write.parquet(f"{tmp_path}/pairs")
    assert spark.read.parquet(f"{tmp_path}/pairs").count() == 2500 * 2499 // 2
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 4.4 * 2500 * 2499 // 2


def test_random_projections_find_most_pairs(spark):


    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    x = np.repeat(centres, 6, axis=0) + rng.normal(size=(240, 16)) * 0.35
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(900, [0.0] * 16), (901, None)], "id bigint, embedding array<double>")
    exact = {(r.a, r.b): r.sim for r in cluster.similar_pairs(v, 0.8).collect()}
    found = {(r.a, r.b): r.sim for r in cluster.similar_pairs_lsh(v, 0.8).collect()}
    assert set(found) <= set(exact) and len(found) >= 0.9 * len(exact) > 100
    assert all(found[p] == pytest.approx(exact[p]) for p in found)
    assert cluster.cluster(v.where("id < 240"), 0.8, pairs=cluster.similar_pairs_lsh).count() == 240


@pytest.mark.parametrize("block", [2048, 2])
def test_cluster_metadata(spark, monkeypatch, block):
    monkeypatch.setattr(cluster, "BLOCK_ROWS", block)
    rows = [(1, i, [1.0, 0.0] if i != 2 else [0.6, 0.8], "u" if i < 2 else "", "c", "abcd", datetime(2024, 1, 1 + i)) for i in range(3)] + [(9, 9, [1.0, 0.0], "v", None, "x", datetime(2024, 1, 1))]
    m = spark.createDataFrame(rows, "cluster_id bigint, id bigint, embedding array<double>, author string, channel string, content string, timestamp timestamp")
    got = {r.cluster_id: r for r in cluster.cluster_metadata(m).collect()}
    assert got[1].avg_similarity == pytest.approx((1 + 0.6 + 0.6) / 3) and got[9].avg_similarity == 0.0
    assert (got[1]["size"], got[1].timespan_days, got[1].participant_count, got[1].channels) == (3, 2.0, 1, ["c"])
    assert got[9].messages_per_day == pytest.approx(100.0)
    sep = cluster.separation(m).collect()
    assert [(r.a, r.b) for r in sep] == [(1, 9)] and sep[0].distance == pytest.approx((0 + 0 + 0.4) / 3)
    assert [r.cluster_id for r in cluster.largest(m, 1).collect()] == [1]
    assert "cluster 1: 3 messages" in cluster.summary(cluster.cluster_metadata(m))


def test_silhouette(spark):
    m = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [1.0, 0.0]), (3, 2, [0.0, 1.0])], "id bigint, cluster_id bigint, embedding array<double>")
    assert cluster.silhouette(m).first().silhouette == pytest.approx(2 / 3)
    alone = m.withColumn("cluster_id", F.col("id"))
    assert cluster.silhouette(alone).first().silhouette == 0.0


# --- evaluation


def run(spark, lists):
    rows = [("s", f"q{i}", f"d{j}", j + 1) for i, rel in enumerate(lists) for j in range(len(rel))]
    qrels = [(f"q{i}", f"d{j}", r) for i, rel in enumerate(lists) for j, r in enumerate(rel) if r]
    return evaluation.judged(spark.createDataFrame(rows, "strategy string, query_id string, doc_id string, rank int"), spark.createDataFrame(qrels, "query_id string, doc_id string, relevance int"))


def test_metrics(spark):
    got = {r.query_id: r for r in evaluation.metrics(run(spark, [[3, 2, 1], [0, 1, 2, 3], [1, 1, 0, 1, 0], [1, 0, 1, 0, 1], [0, 0, 0], [1, 0, 1, 0]]), (3, 10)).collect()}
    assert got["q0"].dcg_3 == pytest.approx(9.392789) and got["q0"].ndcg_3 == 1.0
    assert got["q1"].ndcg_10 == pytest.approx(0.547831, abs=1e-6)
    assert (got["q2"].p_3, got["q2"].r_3) == (pytest.approx(2 / 3), pytest.approx(2 / 3))
    assert got["q3"].ap == pytest.approx(0.755556, abs=1e-6)
    assert (got["q4"].rr, got["q4"].ap, got["q4"].ndcg_3, got["q4"].f1_3) == (0.0, 0.0, 0.0, 0.0)
    assert got["q5"].p_10 == pytest.approx(0.2)
    mrr = evaluation.aggregate(evaluation.metrics(run(spark, [[0, 1, 0], [1, 0, 0], [0, 0, 0]]), (3,))).first()
    assert (mrr.mrr, mrr.queries, mrr.results) == (pytest.approx(0.5), 3, 9)


def test_compare_and_checks(spark):
    s = spark.createDataFrame([("a", 0.5), ("b", 0.75), ("c", 0.75)], "strategy string, mrr double")
    got = {r.strategy: (round(r.gain_percent, 6), r.is_best) for r in evaluation.compare(s, "a").collect()}
    assert got == {"a": (0.0, False), "b": (50.0, True), "c": (50.0, False)}
    bad = spark.createDataFrame([("q", "d", 4)], "query_id string, doc_id string, relevance int")
    with pytest.raises(Exception, match="relevance"):
        evaluation.check_judgments(bad).collect()


# --- detection


def overlap(days):
    return F.struct(F.lit(days).alias("overlap_days"))


def gap(spark, **change):
    base = {"confidence": 0.8, "teams": ["a-team", "b-team"], "texts": [("a-team", "we build x"), ("a-team", "more"), ("b-team", "we build x too")], "days": 5, "dup": True, "ratio": 0.8, "insight": "two teams"} | change
    at = datetime(2024, 1, 1)
    evidence = [(t, at + timedelta(hours=i), 1.0 / (1 + i), c) for i, (t, c) in enumerate(base["texts"])]
    df = spark.createDataFrame([(base["confidence"], base["teams"], evidence, base["insight"])], "confidence double, teams_involved array<string>, evidence array<struct<team:string,timestamp:timestamp,relevance:double,content:string>>, insight string")
    v = F.struct(F.lit(base["dup"]).alias("is_duplicate"), F.lit(0.9).alias("confidence"), F.lit("a long enough reason for it").alias("reasoning"), F.array(F.lit("e")).alias("evidence"), F.lit(base["ratio"]).alias("overlap_ratio"))
    return df.withColumn("verification", v).withColumn("temporal_overlap", overlap(base["days"]) if base["days"] is not None else F.lit(None).cast("struct<overlap_days:int>"))


@pytest.mark.parametrize(
    ("change", "why"),
    [
        ({}, []),
        ({"confidence": 0.6}, ["confidence too low"]),
        ({"texts": [("a-team", "x"), ("b-team", "y")]}, ["too little evidence"]),
        ({"days": 2}, ["overlap too short"]),
        ({"days": None}, ["no temporal overlap"]),
        ({"dup": False}, ["verification found no duplicate work"]),
        ({"ratio": 0.4}, ["overlap ratio too low"]),
        ({"texts": [("a-team", "Helping out"), ("a-team", "x"), ("b-team", "y")]}, ["collaboration"]),
        ({"texts": [("a-team", "ask b-team"), ("a-team", "x"), ("b-team", "y")]}, ["collaboration"]),
        ({"texts": [("a-team", "ping @a-team"), ("a-team", "x"), ("b-team", "y")]}, ["collaboration"]),
        ({"texts": [("a-team", "x"), ("a-team", "y"), ("a-team", "z")]}, ["one team"]),
        ({"insight": "an A/B test on purpose"}, ["intentional redundancy"]),
        ({"teams": ["a-team"]}, ["too few teams", "duplicate work needs two teams"]),
    ],
)
def test_rules(spark, change, why):
    r = validate(gap(spark, **change)).first()
    assert (r.failures, r.is_valid) == (why, not why)


def test_quality_rules(spark):
    g = gap(spark)
    assert g.select(evidence_quality(F.col("evidence"))).first()[0] is None
    assert g.select(evidence_quality(F.col("evidence"), 0.9)).first()[0] == "low relevance"
    assert g.select(evidence_quality(F.slice("evidence", 1, 0))).first()[0] == "no evidence"
    close = F.transform("evidence", lambda e: e.withField("timestamp", F.lit(REF)))
    assert g.select(evidence_quality(close)).first()[0] == "evidence within a minute"
    assert g.select(verification_quality(F.col("verification"))).first()[0] is None
    assert g.select(verification_quality(F.col("verification"), 0.95)).first()[0] == "low confidence"
    assert gap(spark, dup=False).select(verification_quality(F.col("verification"))).first()[0] == "not duplicate work"


def team_vectors(spark, messages):
    """Stand-in embeddings that tell topics apart."""
    topics = ["oauth gateway", "graphql schema", "session migration", "cache headers", "login form", "login token", "billing events", "login provider", "message queue", "checkout outage", "export button"]
    v = F.array(*[F.when(F.contains("content", F.lit(t)), 1.0).otherwise(0.0).cast("float") for t in topics])
    return messages.select(F.col("id").alias("message_id"), v.alias("embedding"))


@pytest.mark.parametrize("name", list(scenarios.SCENARIOS))
def test_scenarios_are_detected_or_not(spark, name):
    m = scenarios.messages(spark, [name])
    found = detect.detect(m, team_vectors(spark, m), ref(), detect.DetectionConfig()).collect()
    assert bool(found) == scenarios.expected_detections()[name]
    for g in found:
        assert len(g.evidence) <= 3 * len(g.teams_involved) and g.impact_tier in ("LOW", "MEDIUM", "HIGH", "CRITICAL")
        assert g.confidence == pytest.approx(0.7 * 0.75 + 0.3, abs=1e-6) and g.gap_id.startswith("gap_") and len(g.gap_id) == 16


def test_detection_settings(spark):
    m = scenarios.messages(spark, ["login_twice", "api_twice"]).withColumn("source", F.lit("slack"))
    v = team_vectors(spark, m)
    go = lambda **k: detect.detect(m, v, ref(), detect.DetectionConfig(**k)).collect()
    assert len(go()) == len(go(approximate=True)) == 2 and len(go(max_gaps=1)) == 1 and go(min_impact=1.0) == []
    assert len(go(channels=["platform", "backend-eng"])) == 1 and go(sources=["git"]) == []
    assert len(go(teams=["auth-team"])) == 1 and go(include_evidence=False)[0].evidence == []
    assert detect.detect(m, v, ref(), verifier=lambda g: detect.heuristic_verifier(g, strict=True)).collect() == []
    assert detect.detect(m.limit(0), v, ref()).collect() == []
    again = go()
    assert [g.gap_id for g in again] == [g.gap_id for g in go()]
    gaps = detect.detect(m, v, ref())
    assert detect.gap_by_id(gaps, again[0].gap_id).count() == 1
    assert detect.tier_histogram(gaps).first().total == 2 and detect.dashboard(gaps).first().gaps == 2
    assert [(r.total, r.has_more) for r in detect.page(gaps, 1, 1).collect()] == [(2, True)]
    pairs = {(r.team_a, r.team_b): r.n for r in detect.team_cooccurrence(gaps).collect()}
    assert pairs[("platform-team", "platform-team")] == 2
    for bad in ({"time_window_days": 0}, {"similarity_threshold": 2.0}, {"min_teams": 0}):
        with pytest.raises(ValueError, match="must"):
            detect.DetectionConfig(**bad)


def test_reasoning_chain(spark):
    rows = spark.createDataFrame([(1, True, 0.9), (2, True, 0.65), (3, True, 0.5), (4, False, 0.9)], "id int, is_duplicate boolean, confidence double").select("id", F.struct("is_duplicate", "confidence").alias("verification"))
    out = detect.reasoning_chain(rows, lambda d: d.withColumn("insights", F.lit("i")), lambda d: d.withColumn("recommendations", F.lit("r")))
    assert {r.id: (r.insights, r.recommendations) for r in out.collect()} == {1: ("i", "r"), 2: ("i", None), 3: (None, None), 4: (None, None)}


# --- ledger


def test_usage(spark):
    rows = [(1, datetime(2024, 1, 1, 1), "medium", 1_000_000, 0), (2, datetime(2024, 1, 1, 2), "large", 0, 100_000), (3, datetime(2024, 1, 2), "unheard of", 1_000_000, 1_000_000)]
    ledger = usage.priced(spark.createDataFrame(rows, "id bigint, ts timestamp, model string, input_tokens bigint, output_tokens bigint"))
    assert [round(r.total_cost, 6) for r in ledger.orderBy("id").collect()] == [3.0, 7.5, 18.0]
    quota = {r.id: (r.used, r.near_limit, r.over_limit) for r in usage.running_quota(ledger, 1_100_000).collect()}
    assert quota == {1: (1_000_000, True, False), 2: (1_100_000, True, True), 3: (2_000_000, True, True)}
    assert usage.summary(ledger, F.lit("2024-01-02 00:00:00").cast("timestamp")).first().calls == 1
    assert usage.summary(ledger.limit(0), F.lit("2024-01-02 00:00:00").cast("timestamp")).first().total_tokens == 0
    days = usage.daily_counts(ledger, "2023-12-31", "2024-01-03").orderBy("day").collect()
    assert [r.n for r in days] == [0, 2, 1, 0]


# --- stores, files, streams


def test_stores(spark, tmp_path):
    t = stores.Table(spark, f"file://{tmp_path}/messages", stores.MESSAGES)
    assert t.count() == 0 and t.create() and not t.create()
    m = scenarios.messages(spark, ["outage"])
    t.append(m)
    t.append(m.where("id = 1").withColumn("id", F.lit(100).cast("bigint")))
    assert t.count() == 6 and stores.latest(t.read(), 2).count() == 2
    new = m.where("id <= 2").withColumn("content", F.lit("new"))
    t.upsert(new.union(new.withColumn("content", F.lit("older")).withColumn("timestamp", F.col("timestamp") - F.expr("INTERVAL 1 DAY"))), "id", F.col("timestamp"))
    assert t.count() == 6 and t.read().where("content = 'new'").count() == 2
    t.delete(F.col("channel") == "incidents")
    left = t.count()
    assert 0 < left < 6
    t.delete_ids(t.read().limit(1), "id")
    assert t.count() == left - 1
    t.clear()
    assert t.count() == 0 and t.drop() and not t.exists()


def test_vectors_and_index(spark, tmp_path):
    m = scenarios.messages(spark, ["outage"])
    t = stores.Table(spark, f"file://{tmp_path}/vectors", stores.VECTORS)
    assert stores.populate_vectors(m, t, stores.hashing_embedder(16)) == 5
    v = stores.vectors_of(m.select(F.col("id").alias("message_id")).union(spark.createDataFrame([(77,)], "message_id bigint")), t.read())
    assert v.where("embedding is null").count() == 1
    norm = v.where("embedding is not null").select(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)).alias("n")).collect()
    assert all(r.n == pytest.approx(1.0, abs=1e-5) for r in norm)
    stores.populate_text_index(m, f"{tmp_path}/index")
    assert spark.read.parquet(f"{tmp_path}/index/stats").first().n_docs == 5
    s = stores.Table(spark, f"file://{tmp_path}/sources", stores.SOURCES)
    assert stores.get_or_create_source(s, "slack", "main", ref()).first().id == 1
    assert stores.get_or_create_source(s, "slack", "main", ref()).first().id == 1
    assert stores.get_or_create_source(s, "git", "main", ref()).first().id == 2


def test_files(spark, tmp_path):
    (tmp_path / "j.json").write_text('[{"query_id":"q","document_id":"d","relevance":3},\n{"query_id":"q","document_id":"e","relevance":0}]')
    assert files.read_judgments(spark, f"{tmp_path}/j.json").count() == 2
    with pytest.raises(FileNotFoundError):
        files.read_judgments(spark, f"{tmp_path}/none.json")
    queries = files.test_queries(scenarios.messages(spark, ["outage"]), 26)
    assert queries.count() == 26 and queries.where("category = 'generated'").count() == 3
    files.write_queries(queries, f"{tmp_path}/q")
    assert files.read_queries(spark, f"{tmp_path}/q").count() == 26
    r = spark.createDataFrame([("a", 0.123456)], "strategy string, mrr double")
    assert files.export(r) == [{"strategy": "a", "mrr": 0.123456}] and "0.1235" in files.export(r, "table")
    assert files.export(r, "json") == '[{"strategy":"a","mrr":0.123456}]' and files.export(r, "csv").startswith("strategy,mrr")
    files.write_results(r, f"{tmp_path}/r", "csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/r").first().strategy == "a"
    for call in (lambda: files.export(r, "xml"), lambda: files.write_results(r, f"{tmp_path}/x", "xml")):
        with pytest.raises(ValueError, match="format"):
            call()


def test_scenarios(spark):
    m = scenarios.messages(spark)
    assert m.count() == sum(n for _, _, parts, *_ in scenarios.SCENARIOS.values() for *_, n in parts) == 91
    with pytest.raises(ValueError, match="unknown"):
        scenarios.messages(spark, ["x"])


def test_streams(spark, tmp_path, small):
    from meshwork.streaming import streams

    events = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    live = streams.read_files(spark, f"{tmp_path}/in", events.schema, 1)
    total = {}

    def keep(df, n):
        total[n] = df.count()

    streams.each_batch(streams.upserts(live, "event_id", "ts", "40 days"), keep, f"{tmp_path}/c1").awaitTermination()
    assert sum(total.values()) == events.count()
    streams.to_table(streams.activity(live, "event_type", delay="40 days"), f"{tmp_path}/out", f"{tmp_path}/c2").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").columns == ["start", "end", "event_type", "n"]
    sessions = streams.threads(live.withColumn("timestamp", F.col("ts")), "user_id")
    assert sessions.isStreaming and streams.daily_usage(live.withColumn("total_tokens", F.lit(1))).isStreaming


# --- catalog


def test_every_query_has_a_sound_name():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 60


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("head", [1000, 7])
def test_stored_index_ranks_like_counting_texts(spark, tmp_path, monkeypatch, head):
    monkeypatch.setattr(textindex, "HEAD", head)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.6, int(rng.integers(0, 40))) if x < 60) for _ in range(80)] + [None, "", "the THE the", "rare"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    index = textindex.TextIndex.build(docs, f"{tmp_path}/index")
    assert index.common.count() > 0 and index.postings.where("df * 2 >= 84").count() == 0
    asked = spark.createDataFrame([(1, "w1 w2 w2 w9"), (2, "rare the"), (3, "w1"), (4, "nothing"), (5, ""), (6, "w1 rare")], "query_id bigint, query string")
    plain = sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in bm25.score_queries(docs, asked, k=5).collect())
    assert sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in index.score_queries(asked, k=5).collect()) == plain
    for query in ("w1 w2 w2 w9", "rare the", "nothing", ""):
        full = {r.doc_id: round(r.score, 6) for r in bm25.score(docs, query).where("score > 0").collect()}
        assert {r.doc_id: round(r.score, 6) for r in index.score(query).where("score > 0").collect()} == full


def test_stored_index_follows_its_files(spark, tmp_path):
    write = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string").write.mode("overwrite").parquet(f"{tmp_path}/docs")
    write([(1, "a"), (2, "b"), (3, "c")])
    first = textindex.TextIndex.of(spark, f"{tmp_path}/docs")
    assert textindex.TextIndex.of(spark, f"{tmp_path}/docs").path == first.path
    write([(1, "a"), (2, "b"), (4, "d"), (5, "e")])
    second = textindex.TextIndex.of(spark, f"{tmp_path}/docs")
    assert second.path != first.path and [r.doc_id for r in second.score("d").collect()] == [4]


def test_a_table_of_bits_lets_all_wanted_ids_through(spark):
    rows = spark.createDataFrame([(i, "x") for i in range(-500, 500)] + [(None, "n")], "id bigint, _text string")
    wanted = spark.createDataFrame([(i,) for i in range(-100, 100, 7)], "w bigint")
    maybe, rest = sieve.parted(rows, "id", sieve.bits_of(wanted, "w"))
    assert maybe.columns == rest.columns == rows.columns
    some, others = {r.id for r in maybe.collect()}, {r.id for r in rest.collect()}
    assert set(range(-100, 100, 7)) <= some and len(some) < 40 and some | others == {*range(-500, 500), None} and not some & others
    none, every = sieve.parted(rows, "id", sieve.bits_of(wanted.limit(0), "w"))
    assert none.count() == 0 and every.count() == 1001

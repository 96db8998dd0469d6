from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from meshwork.engine import Engine
from meshwork.functions import prompts
from meshwork.operators import detect, search, usage, verifier
from meshwork.operators.validate import validate
from meshwork.sources import scenarios, stores
from tests.test_operators import gap, ref, team_vectors


@pytest.fixture
def engine(spark):
    m = scenarios.messages(spark, ["login_twice", "api_twice", "outage"])
    sources = spark.createDataFrame([(1, "slack")], "id bigint, type string")
    return Engine(m, sources, team_vectors(spark, m))


def test_search_and_health(engine):
    found = engine.search(search.SearchRequest("graphql", ranking_strategy="bm25", limit=5)).collect()
    assert len(found) == 5 and all("graphql" in r.content for r in found)
    assert engine.health().first().asDict() == {"messages": 48, "vectors": 48}


def test_detected_gaps_are_kept(engine):
    with pytest.raises(ValueError, match="nothing"):
        engine.list_gaps()
    found = engine.detect(ref()).collect()
    assert len(found) == 2
    assert [r.gap_id for r in engine.list_gaps(1, 1).collect()] == [found[0].gap_id]
    assert engine.get_gap(found[1].gap_id).first().title == found[1].title
    with pytest.raises(ValueError, match="page"):
        engine.list_gaps(0)


def test_comparison(spark, engine):
    with pytest.raises(ValueError, match="no judgments"):
        engine.statistics()
    good = engine.messages.where("content like '%graphql%'").select(F.lit(1).cast("bigint").alias("query_id"), F.col("id").alias("doc_id"), F.lit(2).alias("relevance"))
    engine.add_judgments(good)
    assert engine.statistics().first().judgments == 18
    vec = engine.vectors.join(engine.messages.where("content like '%graphql%'").select(F.col("id").alias("message_id")), "message_id").first().embedding
    queries = spark.createDataFrame([(1, "graphql schema", vec)], "query_id bigint, query string, query_vector array<float>")
    got = {r.strategy: r for r in engine.compare(queries).collect()}
    assert set(got) == {"semantic", "bm25", "hybrid_rrf", "hybrid_weighted"}
    assert all(r.mrr == 1.0 and r.ndcg_10 == pytest.approx(1.0) for r in got.values()) and got["bm25"].is_best
    with pytest.raises(ValueError, match="strategies"):
        engine.run(queries, ("best",))


def test_prompts(spark):
    g = gap(spark, texts=[("a-team", "x" * 300), ("b-team", "{teams} short")])
    text = prompts.prompt("insight", teams=prompts.format_teams(F.col("teams_involved")), evidence=prompts.format_evidence(F.col("evidence")))
    got = g.select(text).first()[0]
    assert "a-team, b-team do twice" in got and "- a-team: " + "x" * 200 + "..." in got and "{teams} short" in got
    assert set(prompts.TEMPLATES) >= {"verification", "recommendation"} and len(prompts.TEMPLATES) == 7
    bad = ['{"is_duplicate": true}', "no", None, '{"is_duplicate": true, "confidence": 7, "reasoning": "r"}']
    assert [r[0] for r in spark.createDataFrame([(b,) for b in bad], "t string").select(prompts.parse_verification(F.col("t"))).collect()] == [None] * 4


ANSWER = json.dumps({"is_duplicate": True, "confidence": 0.95, "reasoning": "they both build the same gateway", "evidence": ["e"], "recommendation": "meet", "overlap_ratio": 0.9})


def test_external_verifier(engine):
    def model(prompt: str) -> str:
        if "graphql" in prompt:
            raise RuntimeError("down")
        return f"Sure:\n```json\n{ANSWER}\n```"

    found = engine.detect(ref(), verifier=verifier.external_verifier(model, wait=0)).collect()
    assert sorted(r.verification.confidence for r in found) == [0.75, 0.95]


def test_metered_verifier_keeps_to_the_quota_and_writes_the_ledger(spark, engine, tmp_path):
    ledger = stores.Table(spark, f"file://{tmp_path}/ledger", stores.USAGE)
    ledger.create()
    model = lambda _: ANSWER
    found = engine.detect(ref(), verifier=verifier.metered_verifier(model, ledger, ref(), model="small")).collect()
    assert [r.verification.confidence for r in found] == [0.95, 0.95]
    rows = ledger.read().collect()
    assert len(rows) >= 2 and all(r.total_tokens == r.input_tokens + r.output_tokens > 0 and r.total_cost > 0 and r.model == "small" for r in rows)
    used = sum(r.total_tokens for r in rows)
    assert usage.used_today(ledger.read(), ref()).first().used == used
    again = engine.detect(ref(), verifier=verifier.metered_verifier(model, ledger, ref(), quota=used + 1)).collect()
    assert [r.verification.confidence for r in again] == [0.75, 0.75] and ledger.count() == len(rows)


def test_asking_again():
    calls = []

    def flaky(_: str) -> str:
        calls.append(1)
        if len(calls) < 3:
            raise verifier.Transient
        return "ok"

    assert verifier.ask(flaky, "p", wait=0) == "ok" and len(calls) == 3
    assert verifier.ask(lambda _: (_ for _ in ()).throw(verifier.Transient()), "p", wait=0) is None
    assert verifier.ask(lambda _: 1 / 0, "p") is None


def test_detectors_that_fail_are_skipped(engine):
    good = lambda: detect.detect(engine.messages, engine.vectors, ref())
    found, skipped = verifier.detect_gaps({"a": good, "b": lambda: 1 / 0}, ["a", "b", "missing"], max_gaps=1)
    assert found.count() == 1 and skipped == ["b", "missing"]
    assert verifier.detect_gaps({}, ["x"]) == (None, ["x"])


def test_validation_without_the_special_rules(spark):
    assert validate(gap(spark, days=None), duplicate_work=False).first().is_valid


def test_stores_hold_scenarios(spark, tmp_path):
    t = stores.Table(spark, f"file://{tmp_path}/m", stores.MESSAGES, ["channel"])
    t.append(scenarios.messages(spark, ["outage"]))
    assert t.read().where("channel = 'incidents'").count() == 4


def test_command_line(spark, tmp_path, capsys):
    from meshwork.__main__ import main

    root = f"file://{tmp_path}/tables"
    main(["generate", root, "--scenario", "api_twice", "--scenario", "outage", "--clear"])
    assert "23 messages" in capsys.readouterr().out
    main(["generate", root, "--scenario", "api_twice", "--scenario", "outage"])  # again: nothing doubles
    assert "23 messages" in capsys.readouterr().out
    main(["search", root, "rolled back", "--strategy", "bm25", "--limit", "3"])
    assert "Rolled back" in capsys.readouterr().out
    main(["detect", root, "--threshold", "0.5"])
    assert "gap_id" in capsys.readouterr().out
    main(["queries", root, f"{tmp_path}/q", "--count", "24"])
    (tmp_path / "queries.json").write_text('{"query_id":"a","query_text":"graphql schema"}\n{"query_id":"b","query_text":"checkout outage"}')
    (tmp_path / "judgments.json").write_text(json.dumps([{"query_id": "a", "document_id": str(i), "relevance": 2} for i in range(1, 19)]))
    main(["evaluate", root, f"{tmp_path}/queries.json", f"{tmp_path}/judgments.json", "--strategy", "bm25", "--format", "csv"])
    out = capsys.readouterr().out.splitlines()
    assert out[0].startswith("strategy,queries") and out[1].startswith("bm25,2,")

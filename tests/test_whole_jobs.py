"""Queries do their whole job: no row of their tables is left out."""

from __future__ import annotations

import os
from datetime import datetime, timedelta

import duckdb
import pytest

from meshwork import catalog


def test_window_overlap_spans_all_events(spark, small):
    spans: dict[tuple[int, str], tuple] = {}
    for r in spark.read.parquet(f"{small}/events.parquet").select("user_id", "event_type", "ts").collect():
        a, b = spans.get((r.user_id, r.event_type), (r.ts, r.ts))
        spans[r.user_id, r.event_type] = min(a, r.ts), max(b, r.ts)
    want = {}
    for (u, kind), (a, b) in spans.items():
        if (u + 1, kind) in spans:
            c, d = spans[u + 1, kind]
            o, s = (min(b, d) - max(a, c)).total_seconds(), min(b - a, d - c).total_seconds()
            share = 0.0 if o <= 0 else o / s if s else 1.0
            want[u, kind] = o > 0, round(share, 6), max(0, (min(b, d).date() - max(a, c).date()).days)
    got = {(r.u, r.kind): (r.overlaps, round(r.share, 6), r.days) for r in catalog.QUERIES["window_overlap"](spark, small).collect()}
    assert want and got == want


@pytest.mark.parametrize("words", ["Se que osllra nezll del does", "Which of erblest them hein ti", "That and onesen erblest it hein"])
def test_search_auto_ranks_by_keywords_whatever_the_words(spark, small, tmp_path, words):
    for t in ("documents", "embeddings", "nation"):
        os.symlink(f"{small}/{t}.parquet", tmp_path / f"{t}.parquet")
    spark.createDataFrame([(0, words)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sql = duckdb.connect()
    for t in ("documents", "embeddings", "nation", "benchmark"):
        sql.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet{'/*.parquet' if t == 'benchmark' else ''}'")
    want = sql.execute(catalog.ORACLES["search_auto"]).fetchall()
    assert want and [tuple(r) for r in catalog.QUERIES["search_auto"](spark, str(tmp_path)).collect()] == want


def test_store_vectors_finds_only_empty_texts_without_length(spark, tmp_path):
    texts = ["flow design", "Design FLOW", "beta retry beta retry", "one word", "", None, " \n\t ", "\u00a0", "\u2003\r", "\v", "\u2028 \x1c", "word " * 5000]
    rows = [(i, t, "en", "src0", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(sql.execute(catalog.ORACLES["store_vectors"]).fetchall())
    assert [i for i, zero in want if zero] == [4, 5, 6, 7, 8]
    assert sorted(tuple(r) for r in catalog.QUERIES["store_vectors"](spark, str(tmp_path)).collect()) == want


def test_evidence_rules_take_a_mean_of_just_a_half_in_any_order(spark, tmp_path):
    day = datetime(2024, 1, 1)
    prices = {1: [0.1, 0.7, 0.6, 0.6], 2: [0.6, 0.6, 0.7, 0.1], 3: [0.9, 0.3, 0.3], 4: [0.3, 0.3, 0.9], 5: [0.4999, 0.5, 0.5], 6: [0.5], 7: []}
    prices |= {10: [0.0353, 0.6819, 0.9117, 1.0524, 0.1639, 0.1548], 11: [0.9576, 0.2962, 0.1501, 0.9029, 0.4183, 0.0532, 1.1029, 0.1188], 12: [0.2655, 0.1894, 0.7388, 0.2743, 1.1156, 0.3956, 0.5208], 13: [0.8589, 0.1482, 0.4181, 0.5748]}
    prices |= {20: [0.39135, 0.60865], 21: [0.39135, 0.6086]}
    orders = [(100 * k + i, k, p * 400000, day + timedelta(days=i)) for k, ps in prices.items() for i, p in enumerate(ps)]
    spark.createDataFrame([(k,) for k in prices], "c_custkey bigint").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    sql = duckdb.connect()
    for t in ("customer", "orders"):
        sql.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(sql.execute(catalog.ORACLES["evidence_rules"]).fetchall())
    got = sorted(tuple(r) for r in catalog.QUERIES["evidence_rules"](spark, str(tmp_path)).collect())
    assert got == want and {k for k, why in got if why} == {5, 7, 21}

"""The registered queries over a whole small table, against plain versions."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from meshwork.llm import queries as q
from meshwork.llm import secret_scan
from tests.llm.test_text_operators import plain_base, plain_hits, sha, unigram  # noqa: F401


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def test_all_ten_are_registered_with_their_columns(spark, small):
    import __spark_entry__ as entry

    names = {
        1: "page_id url text n_chars",
        2: "doc_id n_tokens",
        3: "doc_id n_assign n_access n_hex base_sha256 spans",
        4: "doc_id part n_tokens bin_id bin_start bin_capacity",
        5: "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
        6: "doc_id n_shingles component_id kept",
        7: "vec_id n_links component_id kept",
        8: "doc_id n_words n_hit n_items items_sha256 contaminated",
        9: "doc_id held_out lang_pred score",
        10: "doc_id start n_tokens ids_crc32",
    }
    found = entry.queries()
    assert "pipeline" in found
    for n, columns in names.items():
        (name,) = [x for x in found if x.startswith(f"op{n}_")]
        df = found[name](spark, small)
        assert set(columns.split()) <= set(df.columns)
        counts = {"n_chars", "n_turns", "loss_chars", "formatted_chars", "n_shingles", "n_links", "n_words", "n_hit", "n_items", "start", "n_tokens", "ids_crc32", "n_assign", "n_access", "n_hex", "component_id"}
        assert {t for c, t in df.dtypes if c in counts} <= {"bigint"}


def test_counts_and_files(spark, small, texts, unigram):  # noqa: F811
    import public_tokenizers
    from tokenizers import Tokenizer

    counted = {r.doc_id: r.n_tokens for r in q.op2_token_counts(spark, small).collect()}
    assert counted == {i: len(unigram.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}
    library, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in q.op10_token_binary(spark, small).collect()}
    for i in sorted(texts):
        ids = [*library.encode(texts[i], add_special_tokens=False).ids, 2]
        assert got.pop(i) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert not got


def test_secrets_and_benchmark(spark, small, texts):
    for r in q.op3_secret_scans(spark, small).collect():
        base = plain_base(texts[r.doc_id])
        assert r.base_sha256 == sha(secret_scan.joined(base)) and (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in base) for k in range(3))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    for r in q.op8_decontamination(spark, small).collect():
        n, hit, found = plain_hits(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.items_sha256) == (n, hit, sha(",".join(found)))


def test_packing_holds_every_document(spark, small, texts):
    rows = q.op4_best_fit_packing(spark, small).collect()
    assert {r.doc_id for r in rows} == set(texts)
    bins: dict[int, list] = {}
    for r in rows:
        bins.setdefault(r.bin_id, []).append((r.bin_start, r.n_tokens, r.bin_capacity))
    for own in bins.values():
        assert sum(n for _, n, _ in own) <= own[0][2] and len({s for s, _, _ in own}) == len(own)

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwork.llm import minhash_dedup
from meshwork.llm.queries import op6_minhash_near_dedup
from meshwork.llm.words import SPACE_WORDS, batch_words, shingle_set
from meshwork.plans import staging
from tests.llm.helpers import AWKWARD, DOCS, docs, words


def plain_set(text: str | None, n: int) -> frozenset:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in low.replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if x]
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < n else frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def plain(texts: list[str | None], n: int, percent: int) -> dict[int, tuple[int, int]]:
    sets = [plain_set(t, n) for t in texts]
    up = list(range(len(sets)))

    def find(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def near_copies() -> list[str]:
    rng, out = random.Random(3), []
    for group in range(6):
        base = words(group, 60 + 20 * group)
        for copy in range(12):
            own = list(base)
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(len(own))] = f"new{rng.randrange(99)}"
            out.append(" ".join(own) if copy % 4 else " ".join(own).upper() + "\n")
    rng.shuffle(out)
    return out + [" ".join(words(90 + i, 50)) for i in range(20)]


@pytest.mark.parametrize(("shingle", "percent"), [(3, 85), (5, 80)])
def test_equals_comparing_all_pairs(spark, monkeypatch, shingle, percent):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 5)  # several blocks to a cluster
    monkeypatch.setattr(minhash_dedup, "PIVOTS", 2)
    texts = near_copies() + AWKWARD
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(docs(spark, texts), shingle, percent).collect()}
    assert found == plain(texts, shingle, percent)


def test_blocks_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK_BYTES", 2000)
    texts = near_copies()
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(docs(spark, texts), 3, 85).collect()}
    assert found == plain(texts, 3, 85)


@pytest.mark.parametrize("group", [0, 3, 256])
def test_candidates_connect_all_pairs_within_the_distance(spark, monkeypatch, group):
    monkeypatch.setattr(minhash_dedup, "GROUP", group)
    rng = np.random.default_rng(group)
    width = minhash_dedup.CHUNKS * minhash_dedup.WIDTH
    sig = rng.integers(0, 1 << 16, (120, width)).astype(np.uint16)
    for i in range(20, 120):  # near ones, and some that share a chunk with many but are far
        sig[i] = sig[i % 20]
        far = int(rng.integers(0, 35))
        sig[i, rng.choice(width, far, replace=False)] = rng.integers(0, 1 << 16, far)
    reps = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(sig)], "rep bigint, sig binary").repartition(3)
    edges = [(r.rep, r.lead) for r in minhash_dedup.candidates(reps).collect()]
    up = list(range(len(sig)))

    def find(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(find(a), find(b))] = min(find(a), find(b))
    for i in range(len(sig)):
        for j in range(i):
            assert (sig[i] != sig[j]).sum() > minhash_dedup.DISTANCE or find(i) == find(j)
    if group > 100:
        assert len(edges) < len(set(edges)) + 1 and any((sig[a] != sig[a % 20]).sum() > 25 and a not in {x for e in edges for x in e} for a in range(20, 120))
    short = minhash_dedup.sketches(sig)
    assert all(minhash_dedup.apart(short[i], short[j]) <= (sig[i] != sig[j]).sum() for i in range(30) for j in range(120))


def test_nothing_staged_is_left_behind(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "shared_dir", lambda _: f"file://{tmp_path}")
    assert minhash_dedup.near_duplicates(docs(spark, near_copies()), 3, 85).count() == 92
    assert {x.rsplit("-", 1)[0] for x in os.listdir(f"{tmp_path}/meshwork")} == {"near_duplicates"}


def test_repeated_rows_nulls_and_clashing_names(spark):
    rows = docs(spark, ["a b c d", "a b c d", "x y z", None], extra=True)
    more = rows.union(rows.where("doc_id = 1")).union(rows.where("doc_id = 2").withColumn("doc_id", F.lit(None).cast("bigint")))
    got = sorted((r.doc_id is None, r.doc_id, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(more, 3, 85).collect())
    assert [x[1:] for x in got] == [(0, 0, True), (1, 0, False), (1, 0, False), (2, 2, True), (3, 3, True), (None, 2, False)]


def test_empty_table(spark):
    assert minhash_dedup.near_duplicates(spark.createDataFrame([], DOCS), 3, 85).collect() == []


def test_signature_distance_is_guaranteed():
    """Every pair of signatures within the pigeonhole distance shares a key."""
    rng = np.random.default_rng(1)
    width = minhash_dedup.CHUNKS * minhash_dedup.WIDTH
    far = minhash_dedup.CHUNKS * (minhash_dedup.ERRORS + 1) - 1
    for _ in range(200):
        a = rng.integers(0, 1 << 16, width).astype(np.uint16)
        b = a.copy()
        b[rng.choice(width, far, replace=False)] ^= 1
        x, y = minhash_dedup.keys(np.stack([a, b]))
        assert set(x.tolist()) & set(y.tolist())


def test_shingles_equal_plain_ones():
    texts = [t for t in AWKWARD if t] + ["The cat. THE CAT\x0b sat", "É É é"]
    hashes, at = batch_words([t.encode() for t in texts], SPACE_WORDS)
    for n in (1, 3, 5):
        assert [len(shingle_set(hashes[a:b], n)) for a, b in zip(at, at[1:], strict=False)] == [len(plain_set(t, n)) for t in texts]


def test_query_covers_its_table(spark, small):
    found = op6_minhash_near_dedup(spark, small)
    assert found.columns[:4] == ["doc_id", "n_shingles", "component_id", "kept"]
    assert found.count() == spark.read.parquet(f"{small}/documents.parquet").count()

from __future__ import annotations

import numpy as np
import pytest

from meshwork.llm import embedding_dedup
from meshwork.llm.queries import op7_embedding_near_dedup


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, k string, row string")


def plain(rows: list[tuple], threshold: float) -> dict[int, tuple[int, int]]:
    ok = {i: np.array(v, float) for i, v, *_ in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = sorted(i for i, *_ in rows)
    up, links = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def find(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for i in ok:
        for j in ok:
            if i < j and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / np.linalg.norm(ok[i]) / np.linalg.norm(ok[j]) >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (links[i], find(i)) for i in ids}


def vectors(n: int, dim: int, seed: int) -> list[list[float]]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 8, dim))
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, dim)) * rng.uniform(0.05, 0.6, (n, 1))
    x[: n // 4] = centres[0] + rng.normal(size=(n // 4, dim)) * 0.1  # one large group
    return (x * rng.uniform(0.1, 9, (n, 1))).astype(np.float32).tolist()


@pytest.mark.parametrize(("dim", "cell"), [(16, 32), (5, 64), (64, 8192)])
def test_equals_comparing_all_pairs(spark, monkeypatch, dim, cell):
    monkeypatch.setattr(embedding_dedup, "CELL", cell)  # several cells, and several parts of a hot one
    monkeypatch.setattr(embedding_dedup, "UNIT", 3 * cell)
    rows = [(i, v, 0, "a", "b") for i, v in enumerate(vectors(300, dim, dim))]
    nan, inf = float("nan"), float("inf")
    rows += [(900, None, 0, "", ""), (901, [0.0] * dim, 0, "", ""), (902, [nan] + [1.0] * (dim - 1), 0, "", ""), (903, [inf] * dim, 0, "", ""), (904, [None] * dim, 0, "", ""), (905, [], 0, "", ""), (906, rows[0][1], 0, "", "")]
    found = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(table(spark, rows), 0.9).collect()}
    assert found == plain(rows, 0.9)


def test_repeated_ids_are_vectors_of_their_own(spark):
    got = embedding_dedup.near_vectors(table(spark, [(1, [1.0, 0.0], 0, "", ""), (1, [1.0, 0.0], 0, "", ""), (2, [0.0, 1.0], 0, "", "")]), 0.9).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]


def test_every_length_is_linked_with_its_own(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL", 32)
    rows = [(1, [1.0, 0.0], 0, "", ""), (2, [1.0, 0.0], 0, "", ""), (3, [1.0, 0.1], 0, "", "")]
    rows += [(10 + i, [0.0], 0, "", "") for i in range(50)] + [(70, [2.0], 0, "", ""), (71, [-2.0], 0, "", ""), (72, [3.0], 0, "", "")]
    rows += [(100 + i, v, 0, "", "") for i, v in enumerate(vectors(80, 6, 1))] + [(300 + i, v, 0, "", "") for i, v in enumerate(vectors(80, 9, 2))]
    found = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(table(spark, rows), 0.9).collect()}
    assert found == plain(rows, 0.9) and found[1] == (2, 1) and found[72] == (1, 70)


def test_only_unusable_rows(spark):
    got = embedding_dedup.near_vectors(table(spark, [(i, [0.0] if i % 2 else None, 0, "", "") for i in range(20)]), 0.9).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(i, 0, i, True) for i in range(20)]


def test_rows_without_an_id_take_part(spark):
    rows = [(None, [1.0, 0.0], 0, "", ""), (5, [1.0, 0.4], 0, "", ""), (3, [1.0, -0.4], 0, "", ""), (None, [0.0, 1.0], 0, "", "")]
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(table(spark, rows), 0.9).collect()}
    assert got == {(None, 2, 3, False), (5, 1, 3, False), (3, 1, 3, True), (None, 0, None, False)}


def test_many_copies_are_compared_once(spark, monkeypatch):
    joined = embedding_dedup.Task.join
    rows = [(i, [1.0, 0.0] if i < 400 else [1.0, 0.1], 0, "", "") for i in range(500)]
    found = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(table(spark, rows), 0.9).collect()}
    assert found == {i: (499, 0) for i in range(500)}
    counts, edges = joined(embedding_dedup.Task({}, 0.9), 0, np.array([0, 1]), np.array([400, 100]), embedding_dedup.unit_rows(np.array([[1.0, 0.0], [1.0, 0.1]])), np.array([True, True]), np.array([True, True]))
    assert counts.tolist() == [100, 400] and edges == [(1, 0)]


def test_empty_table(spark):
    assert embedding_dedup.near_vectors(table(spark, []), 0.9).collect() == []


def test_query(spark, small):
    found = op7_embedding_near_dedup(spark, small)
    rows = [(r.vec_id, list(r.embedding), 0, "", "") for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert {r.vec_id: (r.n_links, r.component_id) for r in found.collect()} == plain(rows, 0.9)

"""MinHash near-dedup by a multi-index Hamming join.

A text's set is its distinct word shingles, as 64-bit hashes. Its signature holds ``CHUNKS * WIDTH`` symbols of
16 bits, one minimum for each of as many hash functions. Two signatures that differ in at most
``CHUNKS * (ERRORS + 1) - 1`` symbols have, by pigeonhole, a chunk with at most ``ERRORS`` of them; every text is
filed under each chunk with each choice of ``ERRORS`` symbols left out, so such a pair always shares a key. At
similarity 0.85 a symbol differs with probability 0.15: with 9 chunks of 5 symbols and one error the distance
17 is exceeded for about one borderline pair in ten thousand.

1. Texts of equal sets (count and 128-bit digest) become one representative: the smallest id, by grouped minimum.
2. Under each key the texts that may be within the signature distance are connected: two bits of each symbol
   travel with a key, and a pair that differs in more of these than the distance allows differs in more symbols.
   Under a key of more than ``GROUP`` texts all point at the smallest one instead, first within a task, which sends
   on only that one with their number. Either way a key of n texts makes fewer than n edges, and the components of
   these edges hold every pair within the distance.
3. Components are cut into blocks of about ``BLOCK`` texts and ``BLOCK_BYTES`` by hash. Units of one or two blocks compare all full
   sets across them exactly and return a spanning forest of the links they find; see ``confirmed``.
4. Components of these links, joined back to all texts.

Null and empty texts have an empty set and link with nothing. Rows of one id are one node, whose texts all take part,
and take the component of that id; ids that are null get no component. Other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import map_arrow, pick, slices, text_bytes
from meshwork.llm.words import SPACE_WORDS, batch_words, combine, mix, shingle_set
from meshwork.plans.components import components
from meshwork.plans.sieve import bits_of, parted
from meshwork.plans.staging import drop, stage

CHUNKS, WIDTH, ERRORS = 9, 5, 1
DISTANCE = CHUNKS * (ERRORS + 1) - 1
GROUP = 256
BLOCK, BLOCK_BYTES, PIVOTS = 64, 16 << 20, 16
U = np.uint64
_A = mix(np.arange(1, CHUNKS * WIDTH + 1, dtype=U) * U(0xA24BAED4963EE407)) | U(1)
_B = mix(np.arange(1, CHUNKS * WIDTH + 1, dtype=U) * U(0x9FB21C651E98DF25))
_KEPT = [c for c in combinations(range(WIDTH), WIDTH - ERRORS)]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 16-bit symbols for each non-empty set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), CHUNKS * WIDTH), np.uint16)
    for k in range(CHUNKS * WIDTH):
        low = np.minimum.reduceat((flat * _A[k] + _B[k]) >> U(32), starts)
        out[:, k] = low.astype(np.uint16)
    return out


def keys(signature: np.ndarray) -> np.ndarray:
    """64-bit keys of each signature: every chunk with every choice of symbols left out."""
    n = len(signature)
    chunks = signature.reshape(n, CHUNKS, WIDTH).astype(U)
    out = []
    for c in range(CHUNKS):
        for k, kept in enumerate(_KEPT):
            key = np.full(n, c * len(_KEPT) + k + 1, U)
            for i in kept:
                key = mix(key * U(0xFF51AFD7ED558CCD) + chunks[:, c, i])
            out.append(key)
    return np.stack(out, axis=1)


def fingerprints(docs: DataFrame, shingle: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, bytes, set size, 128-bit digest of the set, signature (null for an empty set)."""

    def step(part: pa.RecordBatch) -> dict:
        raw = text_bytes(part.column(1))
        words, at = batch_words(raw, SPACE_WORDS)
        sets = [shingle_set(words[a:b], shingle) for a, b in zip(at[:-1], at[1:], strict=True)]
        full = [s for s in sets if len(s)]
        made = iter(signatures(full) if full else [])
        return {
            "doc_id": part.column(0),
            "size": pa.array([len(x) for x in raw], pa.int64()),
            "n": pa.array([len(s) for s in sets], pa.int64()),
            "d1": pa.array([int(mix(s).sum(dtype=U).view(np.int64)) for s in sets], pa.int64()),
            "d2": pa.array([int(np.bitwise_xor.reduce(mix(s ^ U(0x5851F42D4C957F2D))).view(np.int64)) if len(s) else 0 for s in sets], pa.int64()),
            "sig": pa.array([next(made).tobytes() if len(s) else None for s in sets], pa.binary()),
        }

    rows = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return map_arrow(rows, "doc_id bigint, size bigint, n bigint, d1 bigint, d2 bigint, sig binary", step)


def sketches(signature: np.ndarray) -> np.ndarray:
    """The lowest bit of every symbol, and the next one, as one 64-bit number each."""
    wide = signature.astype(U)
    place = np.arange(CHUNKS * WIDTH, dtype=U)
    return np.stack([(((wide >> U(bit)) & U(1)) << place).sum(axis=1, dtype=U) for bit in (0, 1)], axis=1)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many symbols sketches differ: never more than their signatures do."""
    differ = a ^ b
    return np.bitwise_count(differ[..., 0] | differ[..., 1])


def _starts(key: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))


def _filed(reps: DataFrame) -> DataFrame:
    """Rows (key, rep, s0, s1, n) of every key of every representative; rows without a number are edges (rep, s0 as lead)."""

    def step(part: pa.RecordBatch) -> dict:
        sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, CHUNKS * WIDTH)
        made, short = keys(sig).view(np.int64), sketches(sig).view(np.int64)
        times = made.shape[1]
        rows = np.stack([made.reshape(-1), *(np.repeat(c, times) for c in (part.column(0).to_numpy(), short[:, 0], short[:, 1]))])
        rows = rows[:, np.lexsort((rows[1], rows[0]))]
        first = _starts(rows[0])
        size = np.diff(np.append(first, rows.shape[1]))
        lead, many = np.repeat(rows[1, first], size), np.repeat(size > GROUP, size)
        head = np.zeros(rows.shape[1], bool)
        head[first] = True
        sent, number = rows[:, head | ~many], np.where(many, np.repeat(size, size), 1)[head | ~many]
        tied = many & (rows[1] != lead)
        edges = np.unique(np.stack([rows[1, tied], lead[tied]]), axis=1)
        blank = np.zeros(edges.shape[1], np.int64)
        both = np.concatenate((sent, np.stack([mix(edges[0].view(U)).view(np.int64), edges[0], edges[1], blank])), axis=1)
        return {**{c: pa.array(x) for c, x in zip(("key", "rep", "s0", "s1"), both, strict=True)}, "n": pa.array(np.concatenate((number, blank)).astype(np.int32))}

    return map_arrow(reps.select("rep", "sig"), "key bigint, rep bigint, s0 bigint, s1 bigint, n int", step, rows=1 << 13)


def near_in_group(reps: np.ndarray, short: np.ndarray) -> list[tuple[int, int]]:
    """Edges (rep, smallest rep) that connect the texts of one key that may be within the signature distance."""
    i, j = np.nonzero(np.triu(apart(short[:, None], short[None]) <= DISTANCE, 1))
    return forest(list(zip(i.tolist(), j.tolist(), strict=True)), reps.tolist())


def _edges_of(rows: np.ndarray) -> pa.RecordBatch:
    """Edges of whole groups; rows are (key, rep, s0, s1, n), ordered by key and rep."""
    first = _starts(rows[:, 0])
    size, short, total = np.diff(np.append(first, len(rows))), rows[:, 2:4].view(U), np.add.reduceat(rows[:, 4], first)
    small = total <= GROUP
    two = first[small & (size == 2)]  # most keys: many at a time
    two = two[apart(short[two], short[two + 1]) <= DISTANCE]
    star = np.repeat(~small, size)
    pairs = [np.stack([rows[two + 1, 1], rows[two, 1]]), np.stack([rows[star, 1], np.repeat(rows[first, 1], size)[star]])]
    for f, n in zip(first[small & (size > 2)].tolist(), size[small & (size > 2)].tolist(), strict=True):
        pairs.append(np.array(near_in_group(rows[f : f + n, 1], short[f : f + n]), np.int64).reshape(-1, 2).T)
    found = np.concatenate(pairs, axis=1)
    return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["rep", "lead"])


def _near_in_groups(grouped: DataFrame) -> DataFrame:
    """Edges of all keys; rows (key, rep, s0, s1, n) lie together by key, ordered by rep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((0, 5), np.int64)
        for part in slices(batches, rows=1 << 16, size=4 << 20):
            if part.num_rows:
                rows = np.stack([c.to_numpy().astype(np.int64) for c in part.columns], axis=1)
                tied = rows[rows[:, 4] == 0]
                yield pa.RecordBatch.from_arrays([pa.array(tied[:, 1]), pa.array(tied[:, 2])], ["rep", "lead"])
                rows = np.concatenate((rest, rows[rows[:, 4] > 0]))
                if not len(rows):
                    continue
                last = int((rows[:, 0] != rows[-1, 0]).nonzero()[0].max(initial=-1)) + 1  # where the last key begins
                rest = rows[last:]
                if last:
                    yield _edges_of(rows[:last])
                if len(rest) > GROUP:  # a star already: its first row stands for those so far
                    yield _edges_of(rest)
                    rest = np.concatenate((rest[:1, :4], [[rest[:, 4].sum()]]), axis=1)
        if len(rest):
            yield _edges_of(rest)

    return grouped.mapInArrow(run, "rep bigint, lead bigint")


def candidates(reps: DataFrame) -> DataFrame:
    """Edges (rep, lead) that connect all representatives within the signature distance of each other; staged."""
    grouped = _filed(reps).repartition("key").sortWithinPartitions("key", "rep")
    return stage(_near_in_groups(grouped).where("rep <> lead").distinct(), "candidates", narrow=True)


def links_across(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """All links (i, j) by exact set sizes: within ``left`` (i < j), or between ``left`` and ``right``."""
    sets = left + (right or [])
    n, size = len(sets), np.array([len(s) for s in sets], np.int64)
    token, doc = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(token, kind="stable")
    token, doc = token[order], doc[order]
    fresh = np.concatenate(([True], token[1:] != token[:-1]))
    code = np.cumsum(fresh) - 1
    shared = np.bincount(code)[code] > 1  # tokens of one text meet no other
    code, doc = code[shared], doc[shared]
    a, rows = len(left), slice(0, len(left))
    both = np.zeros((a, n), np.float32)
    if len(code):
        _, code = np.unique(code, return_inverse=True)
        cuts = np.searchsorted(code, np.arange(0, code[-1] + 1 + 4096, 4096))
        for k in range(len(cuts) - 1):
            if cuts[k] < cuts[k + 1]:
                dense = np.zeros((n, 4096), np.float32)
                dense[doc[cuts[k] : cuts[k + 1]], code[cuts[k] : cuts[k + 1]] - 4096 * k] = 1
                both += dense[rows] @ dense.T
    inter = both.astype(np.int64)
    union = size[:a, None] + size[None, :] - inter
    ok = 100 * inter >= percent * union
    if right is None:
        ok &= np.arange(n)[None, :] > np.arange(a)[:, None]
    else:
        ok[:, :a] = False
    i, j = np.nonzero(ok)
    return list(zip(i.tolist(), j.tolist(), strict=True))


def forest(pairs: list[tuple[int, int]], ids: list[int]) -> list[tuple[int, int]]:
    """Edges (id, smallest id) that connect what the pairs connect."""
    up = list(range(len(ids)))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for i, j in pairs:
        a, b = find(i), find(j)
        if a != b:
            if ids[a] < ids[b]:
                up[b] = a
            else:
                up[a] = b
    return [(ids[x], ids[find(x)]) for x in range(len(ids)) if find(x) != x]


def _compared(units: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Spanning edges (a, b) of the links in each unit: rows (cluster, i, j, side, rep, text).

    A unit with both sides compares one with the other, a unit with one side compares all of it.
    """
    dealt = units.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "side", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []

        def close() -> pa.RecordBatch:
            edges = []
            if len(held) > 1:
                words, at = batch_words([t for _, _, t in held], SPACE_WORDS)
                sets = [shingle_set(words[a:b], shingle) for a, b in zip(at[:-1], at[1:], strict=True)]
                left = sum(side == 0 for side, _, _ in held)
                edges = forest(links_across(sets[:left], sets[left:] or None, percent), [r for _, r, _ in held])
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in edges], pa.int64()), pa.array([y for _, y in edges], pa.int64())], ["a", "b"])

        for part in slices(batches):
            cols = [c.to_pylist() for c in part.columns[:5]]
            for c, i, j, side, rep, t in zip(*cols, text_bytes(part.column(5)), strict=True):
                if unit != (c, i, j):
                    yield close()
                    unit, held = (c, i, j), []
                held.append((side, rep, t))
        yield close()

    return dealt.mapInArrow(run, "a bigint, b bigint")


def _block(n: str, size: str, name: str) -> list[Column]:
    """How many blocks so many members of so many bytes make, and the block of a member."""
    blocks = F.ceil(F.greatest(F.col(n) / BLOCK, F.col(size) / BLOCK_BYTES)).cast("int")
    return [blocks.alias(f"{name}_blocks"), F.pmod(F.xxhash64("rep"), blocks).cast("int").alias(name)]


def confirmed(members: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Edges (a, b) that connect what all links within each cluster connect.

    Members are staged rows (rep, cluster, text, members and bytes of the cluster); they are dropped.

    A cluster of up to ``BLOCK`` members is one unit. A larger one is first compared block by block, each block
    together with the cluster's pivots (about ``PIVOTS`` of its members, by hash), which connects most of a
    group of near copies with each member read once. Members of one component need no further comparing, so
    afterwards those outside the cluster's largest component meet all members, block by block.
    """
    dealt = members.select("*", *_block("n", "size", "block"))
    pivot = F.pmod(F.xxhash64("rep", F.lit(7)), F.ceil(F.col("n") / PIVOTS)) == 0
    everywhere = F.when((F.col("block_blocks") > 1) & pivot, F.sequence(F.lit(0), F.col("block_blocks") - 1)).otherwise(F.array("block"))
    first = dealt.select("cluster", F.explode(everywhere).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "rep", "text")
    near = stage(_compared(first, shingle, percent), "near")

    large = members.where((F.col("n") > BLOCK) | (F.col("size") > BLOCK_BYTES))
    if large.isEmpty():
        drop(members)
        return near
    known = components(near, "a", "b")
    named = large.join(known, F.col("rep") == F.col("node"), "left").select("rep", "cluster", "text", "n", "size", F.coalesce("component", "rep").alias("own"))
    named = stage(named, "named")
    drop(members)
    parts = named.groupBy("cluster", "own").agg(F.count("*").alias("k"), F.sum(F.octet_length("text")).alias("bytes"))
    largest = F.max(F.struct("k", (-F.col("own")).alias("o"), "own", "bytes")).alias("main")
    main = stage(parts.groupBy(F.col("cluster").alias("_c")).agg(largest).select("_c", F.col("main.own").alias("main"), F.col("main.k").alias("inside"), F.col("main.bytes").alias("inside_size")), "mains", narrow=True)
    placed = named.join(main, F.col("cluster") == F.col("_c")).where(F.col("n") > F.col("inside"))
    placed = placed.withColumn("outside", F.col("n") - F.col("inside")).withColumn("outside_size", F.col("size") - F.col("inside_size"))
    blocks = placed.select("cluster", "rep", "text", (F.col("own") == F.col("main")).alias("is_main"), *_block("inside", "inside_size", "x"), *_block("outside", "outside_size", "y"))
    # Units (i, j): block i from outside the main component against its block j, or, as j = -1 - i', against block i'.
    up_to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    unit = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    of_main = F.transform(up_to("y_blocks"), lambda i: unit(i, F.col("x"), 1))
    with_main = F.transform(up_to("x_blocks"), lambda j: unit(F.col("y"), j, 0))
    others = F.filter(up_to("y_blocks"), lambda o: o != F.col("y"))
    with_others = F.transform(others, lambda o: F.when(F.col("y") < o, unit(F.col("y"), -1 - o, 0)).otherwise(unit(o, -1 - F.col("y"), 1)))
    own = F.array(unit(F.col("y"), -1 - F.col("y"), 0))
    exploded = blocks.withColumn("u", F.explode(F.when(F.col("is_main"), of_main).otherwise(F.concat(with_main, with_others, own))))
    far = _compared(exploded.select("cluster", "u.i", "u.j", "u.side", "rep", "text"), shingle, percent)
    both = stage(near.unionByName(far), "links")
    for done in (near, known, named, main):
        drop(done)
    return both


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable by links), kept.

    Texts link where 100 * shared shingles >= ``percent`` * all shingles of both.
    """
    prints = stage(fingerprints(docs, shingle, doc_id, text), "prints")
    full = prints.where("n > 0 and doc_id is not null")
    reps = stage(full.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig"), F.max("size").alias("size")), "reps")
    edges = candidates(reps)
    clusters = components(edges, "rep", "lead")
    drop(edges)
    wanted = reps.join(clusters, F.col("rep") == F.col("node")).groupBy("rep", F.col("component").alias("cluster")).agg(F.sum("size").alias("own"))
    whole = wanted.groupBy(F.col("cluster").alias("_c")).agg(F.count("*").alias("n"), F.sum("own").alias("size"))
    wanted = stage(wanted.join(whole, F.col("cluster") == F.col("_c")).select("rep", "cluster", "n", "size"), "wanted", narrow=True)
    source = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    source, _ = parted(source, "doc_id", bits_of(wanted, "rep"))  # only texts of clusters are shuffled
    members = stage(source.join(wanted, F.col("doc_id") == F.col("rep")).select("rep", "cluster", "text", "n", "size"), "members")
    drop(wanted)
    found = confirmed(members, shingle, percent)
    roots = components(found, "a", "b")
    drop(found)
    drop(clusters)
    named = reps.join(roots, F.col("rep") == F.col("node"), "left").select(F.col("n").alias("_n"), F.col("d1").alias("_1"), F.col("d2").alias("_2"), F.coalesce("component", "rep").alias("component"))
    named = stage(named, "named", narrow=True)
    drop(roots)
    drop(reps)
    same = (F.col("n") == F.col("_n")) & (F.col("d1") == F.col("_1")) & (F.col("d2") == F.col("_2"))
    out = prints.drop("sig").join(named, same, "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    out = stage(out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")), "near_duplicates", narrow=True)
    drop(prints)
    drop(named)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))

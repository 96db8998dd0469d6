"""Token ids in fixed-width packed files.

Every id takes the fewest bits that the vocabulary needs. A file is ``MAGIC``, blocks of ``BLOCK`` ids (each
begins at a byte), then its index: document ids, whether each is null, the first id of each document, the byte
offset of each block, and at the very end the sizes that locate the index. One document is read by its first
id, the blocks that hold it and one vectorised unpacking.

Documents are range-partitioned by id, so shard after shard holds them in ascending order; ties (repeated ids)
are ordered by text, null ids come first. A shard is written under a name of its own and then renamed, so a
repeated task leaves the same file. Shards lie in a folder that driver and executors share; the driver keeps
one manifest row a shard, with the ids before it.

Null and empty texts have the end id only; other columns are ignored; an empty table gives no documents.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import pick, slices, text_bytes
from meshwork.plans.staging import drop, new_path, stage

MAGIC = b"MESHTOK1"
BLOCK = 1 << 14
END_ID = 2
#: Pieces and bytes of a generation of known pieces; two generations are kept.
KEPT_WORDS, KEPT_BYTES = 400_000, 64 << 20
#: What the rules for pieces have to get right before they are used with a tokenizer.
PROBE = "Hello World, THE cat\nsat; don't  x9y I'M A.B. naïve ÉTÉ 12,000 (a) #b  Ünder-way\n\n end..."


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as big-endian fields of ``bits`` bits, filled up to whole bytes."""
    if bits == 16:
        return ids.astype(">u2").tobytes()
    wide = np.unpackbits(ids.astype(">u4").view(np.uint8)).reshape(-1, 32)
    return np.packbits(wide[:, 32 - bits :].reshape(-1)).tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, ">u2", n).astype(np.uint32)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, 32 - bits :] = np.unpackbits(np.frombuffer(data, np.uint8))[: n * bits].reshape(n, bits)
    return np.packbits(wide.reshape(-1)).view(">u4").astype(np.uint32)


_MARKS = b".,!?;:%&*$#|)"
#: A Latin-1 word and the marks behind it, in UTF-8.
_SPLIT = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,!?;:%&*$#|)]*)")


def _plain(text: bytes) -> bytes:
    """ASCII letters in lower case, where that can't change the ids.

    The tokenizer composes marks (U+0300 to U+036F) before it lowers letters, and knows special tokens by case:
    texts with either stay as they are.
    """
    return text if b"\xcc" in text or b"\xcd" in text or b"<|" in text else text.lower()


class Encoder:
    """The library's ids of whole texts, by pieces between spaces.

    No token spans a space or a line feed, so ids of pieces, which are kept for frequent ones, join to those of
    the text. A Latin-1 word followed by marks is looked up as word and marks, and the word in lower case, as
    the tokenizer's own rules would part and lower it. New words are encoded many at a time, in one text: every
    such word ends with the one token of it that carries the vocabulary's end-of-word suffix. A tokenizer for which
    these rules don't give the library's ids of ``PROBE`` is given whole texts instead.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        self.bits = max(1, max(vocabulary.values()).bit_length())
        self.kind = np.dtype("<u2" if self.bits <= 16 else "<u4")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.kept: dict[bytes, bytes] = {b"": b""}
        self.before: dict[bytes, bytes] = {}
        self.held, self.by_pieces = 0, True
        self.by_pieces = self.ids([PROBE.encode()]) == self._whole([PROBE.encode()])

    def _whole(self, parts: list[bytes]) -> list[bytes]:
        return [np.array(got.ids, self.kind).tobytes() for got in self.library.encode_batch_fast([p.decode() for p in parts], add_special_tokens=False)]

    def _encode(self, pieces: list[bytes]) -> None:
        for piece, got in zip(pieces, self.library.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False), strict=True):
            self.kept[piece] = np.array(got.ids, self.kind).tobytes()

    def _encode_words(self, words: list[bytes]) -> None:
        """Words of letters only, in one text."""
        ids = np.array(self.library.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, self.kind)
        size = self.kind.itemsize
        cuts = ((np.flatnonzero(self.ends[ids]) + 1) * size).tolist()
        if len(cuts) != len(words) or cuts[-1] != size * len(ids):
            self._encode(words)
            return
        data, at, kept = ids.tobytes(), 0, self.kept
        for word, cut in zip(words, cuts, strict=True):
            kept[word] = data[at:cut]
            at = cut

    def _learn(self, pieces: set[bytes]) -> None:
        kept, before = self.kept, self.before
        parts, words, whole = [], set(), set()
        for w in pieces:
            if (old := before.get(w)) is not None:
                kept[w] = old
                continue
            core = w.rstrip(_MARKS)
            if core.isalpha():
                core, tail = core.lower(), w[len(core) :]
            elif m := _SPLIT.fullmatch(w):
                core, tail = m[1].decode().lower().encode(), m[2]
            else:
                whole.add(w)
                continue
            if core != w:
                parts.append((w, core, tail))
            if core not in kept:
                words.add(core)
            if tail not in kept:
                whole.add(tail)
        if whole:
            self._encode(list(whole))
        if words:
            self._encode_words(list(words))
        for w, core, tail in parts:
            kept[w] = kept[core] + kept[tail]
        self.held += sum(len(w) + len(kept[w]) for w in pieces)

    def ids(self, parts: list[bytes], end: bytes = b"") -> list[bytes]:
        """Ids of each text, and ``end``, as bytes of ``kind``."""
        if not self.by_pieces:
            return [ids + end for ids in self._whole(parts)]
        split = [_plain(x).replace(b"\n", b" ").split(b" ") for x in parts]
        if len(self.kept) > KEPT_WORDS or self.held > KEPT_BYTES:
            self.before, self.kept, self.held = self.kept, {b"": b""}, 0
        fresh = set(chain.from_iterable(split)).difference(self.kept)
        if fresh:
            self._learn(fresh)
        get, join = self.kept.__getitem__, b"".join
        return [join(map(get, own)) + end for own in split]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Writer:
    def __init__(self, stream, bits: int) -> None:  # noqa: ANN001
        self.stream, self.bits = stream, bits
        self.stream.write(MAGIC)
        self.at, self.blocks, self.rest = len(MAGIC), [len(MAGIC)], np.zeros(0, np.uint32)
        self.docs: list[int] = []
        self.null: list[bool] = []
        self.first = [0]

    def add(self, doc_id: int | None, n: int) -> None:
        self.docs.append(0 if doc_id is None else doc_id)
        self.null.append(doc_id is None)
        self.first.append(self.first[-1] + n)

    def write(self, ids: np.ndarray) -> None:
        held = np.concatenate((self.rest, ids)) if len(self.rest) else ids
        whole = len(held) // BLOCK * BLOCK
        for i in range(0, whole, BLOCK):
            self._block(held[i : i + BLOCK])
        self.rest = held[whole:].copy()

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.stream.write(data)
        self.at += len(data)
        self.blocks.append(self.at)

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        self.stream.write(np.array(self.docs, "<i8").tobytes() + np.array(self.null, np.uint8).tobytes() + np.array(self.first, "<u8").tobytes() + np.array(self.blocks, "<u8").tobytes())
        self.stream.write(np.array([self.at, len(self.docs), len(self.blocks), self.bits], "<u8").tobytes() + MAGIC)
        self.stream.close()


class Reader:
    """Random access to one shard."""

    def __init__(self, uri: str) -> None:
        where, path = fs.FileSystem.from_uri(uri)
        self.file = where.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(40, size - 40)
        if tail[32:] != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        at, docs, blocks, self.bits = (int(x) for x in np.frombuffer(tail[:32], "<u8"))
        index = self.file.read_at(size - 40 - at, at)
        self.docs = np.frombuffer(index, "<i8", docs)
        self.null = np.frombuffer(index, np.uint8, docs, 8 * docs).astype(bool)
        self.first = np.frombuffer(index, "<u8", docs + 1, 9 * docs).astype(np.int64)
        self.blocks = np.frombuffer(index, "<u8", blocks, 17 * docs + 8).astype(np.int64)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start to end of the shard."""
        if start >= end:
            return np.zeros(0, np.uint32)
        a, b = start // BLOCK, (end - 1) // BLOCK
        data = self.file.read_at(int(self.blocks[b + 1] - self.blocks[a]), int(self.blocks[a]))
        out = []
        for k in range(a, b + 1):
            n = min(BLOCK, int(self.first[-1]) - k * BLOCK)
            at = int(self.blocks[k] - self.blocks[a])
            out.append(unpack(data[at : at + int(self.blocks[k + 1] - self.blocks[k])], n, self.bits))
        return np.concatenate(out)[start - a * BLOCK : end - a * BLOCK]

    def doc(self, i: int) -> np.ndarray:
        return self.ids(int(self.first[i]), int(self.first[i + 1]))


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and write all documents under ``folder`` (a URI all executors share); one manifest row a shard."""
    where = path or public_tokenizers.path("word_bpe_49k.json")
    rows = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        shard, made, writer = f"{base}/shard-{task.partitionId():06d}.tok", f"{base}/.{uuid.uuid4().hex}", None
        for part in slices(batches):
            if writer is None:
                store.create_dir(base, recursive=True)
                writer = Writer(store.open_output_stream(made), encoder(where).bits)
            own = encoder(where)
            ids = own.ids(text_bytes(part.column(1)), np.array([end_id], own.kind).tobytes())
            for d, x in zip(part.column(0).to_pylist(), ids, strict=True):
                writer.add(d, len(x) // own.kind.itemsize)
            writer.write(np.frombuffer(b"".join(ids), own.kind))
        if writer is not None:
            writer.close()
            store.move(made, shard)
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int64()), pa.array([f"{folder}/{os.path.basename(shard)}"]), pa.array([len(writer.docs)], pa.int64()), pa.array([writer.first[-1]], pa.int64())], ["part", "uri", "n_docs", "n_ids"])

    return ordered.mapInArrow(run, "part bigint, uri string, n_docs bigint, n_ids bigint")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32. The manifest is a row for each shard."""
    spark, base, shards = manifest.sparkSession, 0, []
    for r in sorted(manifest.select("part", "uri", "n_ids").collect()):
        shards.append((r.uri, base))
        base += r.n_ids
    rows = spark.createDataFrame(shards, "uri string, base bigint").repartition(max(1, len(shards)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Reader(uri)
                for i in range(0, len(shard.docs), 512):
                    j = min(i + 512, len(shard.docs))
                    at = shard.first[i : j + 1]
                    ids = shard.ids(int(at[0]), int(at[-1])).astype("<u4")
                    crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1] - at[0], at[1:] - at[0], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(shard.docs[i:j], pa.int64(), mask=shard.null[i:j]), pa.array(at[:-1] + first), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, path: str | None = None, **columns: str) -> DataFrame:
    """Write all documents to new files in the shared folder and read them back."""
    folder = new_path(docs.sparkSession, "tokens")
    manifest = stage(write_tokens(docs, folder, path, **columns), "manifest")
    out = read_tokens(manifest)
    drop(manifest)
    return out

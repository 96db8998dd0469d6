"""Vectorised words, word hashes and word shingles of UTF-8 text.

Word separators are single bytes below 0x80, so splitting UTF-8 bytes and splitting characters agree. A
word's hash is a polynomial over keyed byte values modulo 2**64, finished by a mixing function.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTES = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))


def lower_table(separators: bytes) -> bytes:
    """Translation that lower-cases A-Z and turns every separator into a space."""
    table = bytearray(range(256))
    for c in range(0x41, 0x5B):
        table[c] = c + 32
    for c in separators:
        table[c] = 0x20
    return bytes(table)


#: Separators of words made of anything but space and the controls 0x09-0x0D.
SPACE_WORDS = lower_table(bytes([0x20, *range(0x09, 0x0E)]))
#: Separators of words made of letters, digits and everything from 0x80 on (A-Z are lower-cased first).
ALNUM_WORDS = lower_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def table(base: int) -> np.ndarray:
        out = np.full(size, base & (2**64 - 1), dtype=U)
        out[0] = 1
        return np.multiply.accumulate(out)

    return table(_BASE), table(pow(_BASE, -1, 2**64))


def _hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of translated bytes."""
    arr = np.frombuffer(data, dtype=np.uint8)
    word = np.concatenate(([False], arr != 0x20, [False]))
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return start, np.zeros(0, U)
    size = 1 << max(21, int(len(arr) + 1).bit_length())
    power, back = _powers(size)
    total = np.zeros(len(arr) + 1, U)
    np.cumsum(_BYTES[arr] * power[: len(arr)], out=total[1:])
    return start, mix((total[end] - total[start]) * back[start] + (end - start).astype(U))


def batch_words(texts: list[bytes], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one text after the other, and each text's first position (and the end).

    Works on about a megabyte at a time, whatever the lengths of the texts.
    """
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(texts) + 1, np.int64)
    held: list[bytes] = []
    first, size = 0, 0

    def flush(upto: int) -> None:
        nonlocal held, first, size
        if held:
            joined = b" ".join(held)
            starts = np.cumsum([0] + [len(x) + 1 for x in held[:-1]])
            at, h = _hashes(joined)
            hashes.append(h)
            counts[first + 1 : upto + 1] += np.diff(np.append(np.searchsorted(at, starts), len(at)))
        held, first, size = [], upto, 0

    for i, text in enumerate(texts):
        data = text.translate(table)
        if len(data) > _PIECE:
            flush(i)
            at = 0
            while at < len(data):
                cut = len(data) if len(data) - at <= _PIECE else data.find(b" ", at + _PIECE)
                cut = len(data) if cut < 0 else cut
                h = _hashes(data[at:cut])[1]
                hashes.append(h)
                counts[i + 1] += len(h)
                at = cut
            first = i + 1
            continue
        held.append(data)
        size += len(data)
        if size > _PIECE:
            flush(i + 1)
    flush(len(texts))
    return (np.concatenate(hashes) if hashes else np.zeros(0, U)), np.cumsum(counts)


def combine(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive words."""
    count = max(len(words) - n + 1, 0)
    out = np.full(count, n, U)
    for k in range(n):
        out = mix(out * U(0xFF51AFD7ED558CCD) + words[k : k + count])
    return out


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct ``n``-word shingles; fewer words are one shingle, none are none."""
    if len(words) == 0:
        return words
    return np.unique(combine(words, min(n, len(words))))

"""Language ID by multilingual mixture inference.

Training counts byte trigrams (hashed to a fixed number of slots) of every labelled text, over all rows, by
language; the model is one smoothed log-probability table per language, of a size that does not depend on the
data. A document is a mixture: each of its words was written in one language of a set, with unknown
proportions. Expectation-maximisation estimates the proportions over all languages and then over nested sets of
the leading ones; a set grows while its likelihood, less ``penalty`` times half the log of the word count for
each language, gains. The language with the largest proportion is predicted; that proportion is the score.

Texts are read a piece at a time, words that cross pieces included, and equal words of a long text share one row
of likelihoods with their number, so memory beyond the text follows its different words.

Texts that are null or have no letter are ``und`` with score 0, as is everything under a model without
languages. Labels that are null teach nothing. Rows are independent, so repeated rows get equal results; a tie
goes to the language that is first in alphabetical order; other columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import finish, pick, slices, text_bytes
from meshwork.plans.staging import drop, stage

SLOTS = 1 << 16
#: Most languages of a model, whose table is then 256 MB; more are refused.
LANGUAGES = 1024
#: Digits, punctuation and controls part words and teach nothing; letters are lower-cased.
_TABLE = bytearray(b" " * 128 + bytes(range(128, 256)))
for _c in range(26):
    _TABLE[0x61 + _c] = _TABLE[0x41 + _c] = 0x61 + _c
_TABLE = bytes(_TABLE)
#: Numbers in the largest temporary table of a step.
_CELLS = 1 << 22


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Translated bytes of all texts, each closed by two spaces, and where each begins (and the end)."""
    data = b"".join([b" " + x.translate(_TABLE) + b"  " for x in parts])
    return np.frombuffer(data, np.uint8), np.cumsum([0] + [len(x) + 3 for x in parts])


def _trigrams(arr: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Where trigrams begin whose middle is inside a word, and their slots, ``size`` bytes at a time."""
    for i in range(0, len(arr) - 2, size):
        x = arr[i : i + size + 2].astype(np.uint32)
        at = np.flatnonzero(x[1:-1] != 0x20)
        code = (x[at] << 16) | (x[at + 1] << 8) | x[at + 2]
        yield at + i, ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # slots x languages, log-probabilities


def train(rows: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.05) -> Model:
    """Count all rows that have a label. The table has SLOTS rows and a column for each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for part in slices(batches):
            by: dict[str, list[bytes]] = {}
            for x, label in zip(text_bytes(part.column(0)), part.column(1).to_pylist(), strict=True):
                by.setdefault(label, []).append(x)
            for label, own in by.items():
                got = total.setdefault(label, np.zeros(SLOTS, np.int64))
                for _, slot in _trigrams(_joined(own)[0], _CELLS // 4):
                    got += np.bincount(slot, minlength=SLOTS)
        for label, got in total.items():
            some = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(some), pa.string()), pa.array(some), pa.array(got[some])], ["lang", "slot", "n"])

    picked = pick(rows, text=text, lang=lang).where("lang is not null and text is not null")
    sums = stage(picked.mapInArrow(run, "lang string, slot bigint, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n")), "trigrams")
    if (found := sums.select("lang").distinct().count()) > LANGUAGES:
        raise ValueError(f"{found} languages, more than {LANGUAGES}")
    counted = sums.toPandas()
    drop(sums)
    langs = sorted(counted.lang.unique())
    table = np.full((SLOTS, len(langs)), smoothing)
    for k, label in enumerate(langs):
        own = counted[counted.lang == label]
        table[own.slot.to_numpy(), k] += own.n.to_numpy()
    return Model(langs, np.log(table / table.sum(axis=0)).astype(np.float32))


@dataclass
class Words:
    """Words of some texts: text (ascending), likelihood in each language relative to the best, and number."""

    doc: np.ndarray
    like: np.ndarray
    number: np.ndarray

    def sums(self, docs: int, value) -> np.ndarray:  # noqa: ANN001
        """Sum over each text of what ``value`` makes of its words, given as rows by position."""
        out, step = None, max(1, _CELLS // self.like.shape[1])
        for i in range(0, len(self.doc), step):
            own = self.doc[i : i + step]
            made = value(slice(i, i + step))
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            out = np.zeros((docs, *made.shape[1:])) if out is None else out
            out[own[first]] += np.add.reduceat(made, first, axis=0)
        return out


def _same(words: Words) -> Words:
    """Equal words of a text as one."""
    rows = np.ascontiguousarray(np.hstack([words.doc.astype(np.float32)[:, None], words.like]))
    _, first, back = np.unique(rows.view([("", np.float32)] * rows.shape[1]).ravel(), return_index=True, return_inverse=True)
    order = np.argsort(words.doc[first], kind="stable")
    return Words(words.doc[first][order], words.like[first][order], np.bincount(back, words.number)[order])


def read_words(model: Model, parts: list[bytes]) -> Words:
    arr, at = _joined(parts)
    made: list[Words] = []
    kept, starts, last = np.zeros((0, len(model.langs))), np.zeros(0, np.int64), -2

    def close(rows: np.ndarray, where: np.ndarray) -> None:
        like = np.maximum(np.exp(rows - rows.max(axis=1, keepdims=True)), 1e-30).astype(np.float32)
        own = Words(np.searchsorted(at, where, side="right") - 1, like, np.ones(len(where)))
        made.append(_same(own) if len(parts) == 1 else own)

    for where, slot in _trigrams(arr, max(1 << 12, _CELLS // len(model.langs))):
        if not len(where):
            continue
        fresh = np.diff(where, prepend=last) > 1  # a gap ends a word
        first = np.flatnonzero(fresh | (np.arange(len(where)) == 0))
        rows = np.add.reduceat(model.table[slot].astype(np.float64), first, axis=0)
        if len(kept) and not fresh[0]:  # goes on with the word that is open
            rows[0] += kept[-1]
            where_first = np.concatenate((starts[-1:], where[first[1:]]))
        else:
            where_first = where[first]
            if len(kept):
                close(kept[-1:], starts[-1:])
        if len(rows) > 1:
            close(rows[:-1], where_first[:-1])
        kept, starts, last = rows[-1:], where_first[-1:], where[-1]
    if len(kept):
        close(kept, starts)
    if not made:
        return Words(np.zeros(0, np.int64), np.zeros((0, len(model.langs)), np.float32), np.zeros(0))
    out = Words(*(np.concatenate([getattr(w, x) for w in made]) for x in ("doc", "like", "number")))
    return _same(out) if len(parts) == 1 and len(made) > 1 else out


def _em(words: Words, count: np.ndarray, share: np.ndarray, rounds: int) -> np.ndarray:
    """Proportions (texts x languages) after so many rounds; zero proportions stay zero."""
    for _ in range(rounds):

        def expected(at: slice, share: np.ndarray = share) -> np.ndarray:
            resp = share[words.doc[at]] * words.like[at]
            return resp * (words.number[at] / resp.sum(axis=1))[:, None]

        share = words.sums(len(count), expected) / count[:, None]
    return share


def infer(model: Model, parts: list[bytes], penalty: float = 4.0) -> tuple[list[str], list[float], list[str]]:
    """Predicted language, its proportion, and the chosen set (by falling proportion) of every text."""
    n, names = len(parts), np.array(model.langs)
    lang, score, chosen = ["und"] * n, [0.0] * n, [""] * n
    words = read_words(model, parts) if len(names) else None
    if words is None or not len(words.doc):
        return lang, score, chosen
    docs, doc = np.unique(words.doc, return_inverse=True)
    words = Words(doc, words.like, words.number)
    count = np.bincount(doc, words.number)
    full = _em(words, count, np.full((len(docs), len(names)), 1 / len(names)), 12)
    order = np.argsort(-full, axis=1, kind="stable")
    best, best_share = np.full(len(docs), -np.inf), full
    growing = np.ones(len(docs), bool)  # a text's set grows until a language gains it nothing
    for k in range(1, len(names) + 1):
        mask = np.zeros_like(full)
        np.put_along_axis(mask, order[:, :k], 1.0, axis=1)
        share = full * mask + mask * 1e-9
        share = _em(words, count, share / share.sum(axis=1, keepdims=True), 6 if k > 1 else 0)

        def likelihood(at: slice, share: np.ndarray = share) -> np.ndarray:
            return words.number[at] * np.log(np.maximum((share[words.doc[at]] * words.like[at]).sum(axis=1), 1e-300))

        value = words.sums(len(docs), likelihood) - penalty * k * 0.5 * np.log(count + 1)
        growing &= value > best
        if not growing.any():
            break
        best = np.where(growing, value, best)
        best_share = np.where(growing[:, None], share, best_share)
    lead = best_share.argmax(axis=1)
    for i, d in enumerate(docs.tolist()):
        row = best_share[i]
        lang[d], score[d] = str(names[lead[i]]), float(min(1.0, row[lead[i]]))
        chosen[d] = ",".join(f"{names[j]}:{row[j]:.3f}" for j in np.argsort(-row, kind="stable") if row[j] > 1e-6)
    return lang, score, chosen


_LETTER = re.compile(rb"[A-Za-z]")


def _has_letter(text: bytes) -> bool:
    if _LETTER.search(text):
        return True
    decoder = codecs.getincrementaldecoder("utf-8")()
    return any(any(map(str.isalpha, decoder.decode(text[i : i + (1 << 16)]))) for i in range(0, len(text), 1 << 16))


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", into: str | None = None) -> DataFrame:
    """Per row: doc_id, lang_pred, score, and the chosen languages with their proportions."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def step(part: pa.RecordBatch) -> dict:
        raw = text_bytes(part.column(1))
        lang, score, chosen = infer(sent.value, raw)
        letters = [_has_letter(x) for x in raw]
        return {
            "doc_id": part.column(0),
            "lang_pred": [x if ok else "und" for x, ok in zip(lang, letters, strict=True)],
            "score": [x if ok else 0.0 for x, ok in zip(score, letters, strict=True)],
            "languages": [x if ok else "" for x, ok in zip(chosen, letters, strict=True)],
        }

    return finish(docs, "lang_pred string, score double, languages string", step, into, doc_id, text)


def held_out(doc_id: str = "doc_id"):  # noqa: ANN201
    """Rows that never teach: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))

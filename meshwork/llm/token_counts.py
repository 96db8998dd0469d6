"""Count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton of all pieces lists, at each end position, the pieces that end there, longest first.
Dynamic programming keeps the best score and the number of pieces for each position and no back pointers. The
tie rule is the tokenizer's: among equal scores the earliest start stays (a later candidate must be better by
strict comparison). A character that no piece of one character covers is unknown, at the lowest score less 10;
a run of unknown characters on the best path, and of the unknown piece's own name, is one unknown, counted as its
UTF-8 bytes where the vocabulary has byte pieces and the run is no piece itself.

Words begin at spaces, which become the mark U+2581 in front of them, and are counted by themselves; counts of
short words are kept, up to ``KEPT_WORDS`` of ``KEPT_CHARS`` characters. Texts are parted and long words scored a
window at a time, so memory beyond the text itself is bounded. The vocabulary file is a parameter: pieces in order of merge rank, whose score is
``-log(rank + 1)``.

Null and empty texts have no tokens. Rows are independent, so repeated rows get equal counts; other columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from functools import lru_cache

import ahocorasick
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from meshwork.llm.common import finish, texts

MARK = "▁"
PENALTY = 10.0
KEPT_WORDS, KEPT_CHARS = 300_000, 64
WINDOW = 1 << 16


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[tuple[str, float], ...]:
    """Pieces and scores in id order, from a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return tuple((model.id_to_piece(i), -math.log(i + 1)) for i in range(model.get_piece_size()))


class Counter:
    def __init__(self, pieces: tuple[tuple[str, float], ...], unknown: int = 0) -> None:
        """``unknown`` is the id of the unknown piece."""
        self.auto = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(pieces):
            self.auto.add_word(piece, (len(piece), score, i == unknown))
        self.auto.make_automaton()
        self.names = {p for p, _ in pieces}
        self.longest = max(map(len, self.names))
        self.unknown = min(s for _, s in pieces) - PENALTY
        self.bytes = all(f"<0x{b:02X}>" in self.names for b in range(256))
        self.kept: dict[str, tuple[int, float]] = {}

    def word(self, word: str) -> tuple[int, float]:
        """Piece count and score of the best path over one word.

        For each position: score and count of the best path, and, where it ends in an unknown run, where the run
        began, the count there and its bytes.
        """
        score, count, runs, base = [0.0], [0], [None], 0
        matches = self.auto.iter(word)
        ahead = next(matches, None)
        for e in range(1, len(word) + 1):
            best, back, single, run = -math.inf, 0, False, False
            while ahead is not None and ahead[0] == e - 1:  # longest first: the earliest start
                size, s, unknown = ahead[1]
                single |= size == 1
                if (value := score[e - size - base] + s) > best:
                    best, back, run = value, size, unknown
                ahead = next(matches, None)
            if not single and (value := score[e - 1 - base] + self.unknown) > best:
                best, back, run = value, 1, True
            at = e - back - base
            if run:
                start, before, size = runs[at] or (e - back, count[at], 0)
                size += len(word[e - back : e].encode())
                whole = e - start <= self.longest and word[start:e] in self.names
                runs.append((start, before, size))
                count.append(before + (1 if whole or not self.bytes else size))
            else:
                runs.append(None)
                count.append(count[at] + 1)
            score.append(best)
            if len(score) > WINDOW + self.longest:
                del score[:WINDOW], count[:WINDOW], runs[:WINDOW]
                base += WINDOW
        return count[-1], score[-1]

    def text(self, text: str) -> tuple[int, float]:
        total, score, at = 0, 0.0, 0
        while at < len(text):
            cut = text.find(" ", at + WINDOW)
            cut = len(text) if cut < 0 else cut
            words = text[at:cut].replace(" ", MARK).split(MARK)
            if words[0] == "" and len(words) > 1:
                del words[0]  # what begins with a space or a mark has its own mark
            at, kept = cut, self.kept
            for w in words:
                got = kept.get(w)
                if got is None:
                    got = self.word(MARK + w)
                    if len(w) <= KEPT_CHARS:
                        if len(kept) >= KEPT_WORDS:
                            kept.clear()
                        kept[w] = got
                total += got[0]
                score += got[1]
        return total, score


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def count_tokens(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, and the score of the best segmentation, rounded to 3 digits."""
    where = path or public_tokenizers.path("piece_bpe_32k.model")

    def step(part: pa.RecordBatch) -> dict:
        got = [counter(where).text(x) for x in texts(part.column(1))]
        return {"doc_id": part.column(0), "n_tokens": pa.array([n for n, _ in got], pa.int64()), "score": pa.array([round(s, 3) for _, s in got], pa.float64())}

    return finish(docs, "n_tokens bigint, score double", step, None, doc_id, text)

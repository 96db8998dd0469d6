"""Secret scans: keyword automaton, anchored patterns near its hits, then checks embedded in the token itself.

An Aho-Corasick automaton over lower-cased text finds the few places where a keyed secret can start; only
there a pattern is tried, anchored at the hit. Runs of lower-case hexadecimal digits have no keyword and are
found by one linear pattern. Kinds that carry their own check are reported only if it holds:

* ``github``, ``npm``: the last six characters are the CRC-32 of the 30 before them, in base 62;
* ``jwt``: the first part, from the first ``eyJ`` of a run of its characters on, is base64url of a JSON object with ``alg``;
* ``pem``: the body is base64 of one DER sequence whose stated length is that of the body.

A try that fails uses up the text that would make later tries in it fail as well, so time grows with the text.

Null and empty texts have no spans. Rows are independent, so repeated rows and ties give equal results;
other columns, whatever their names, are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import string
import zlib
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from meshwork.llm.common import finish, texts

KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]++)\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++")
JWT_RUN = re.compile(r"eyJ[A-Za-z0-9_-]*+")
PEM = re.compile(r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END \1PRIVATE KEY-----")

#: Lower-cased keyword to the kind that may start there.
KEYWORDS = {
    **dict.fromkeys(("password", "passwd", "secret", "token", "apikey", "api_key"), "assign"),
    "akia": "access",
    **dict.fromkeys(("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "github"),
    "npm_": "npm",
    "eyj": "jwt",
    "-----begin ": "pem",
}
_DIGITS = string.digits + string.ascii_uppercase + string.ascii_lowercase
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def crc_base62(body: str) -> str:
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = _DIGITS[d] + out
    return out


def _jwt_ok(head: str) -> bool:
    try:
        found = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, binascii.Error):
        return False
    return isinstance(found, dict) and "alg" in found


def _pem_ok(body: str) -> bool:
    try:
        der = base64.b64decode("".join(body.split()), validate=True)
    except (ValueError, binascii.Error):
        return False
    if len(der) < 2 or der[0] != 0x30:
        return False
    if der[1] < 0x80:
        return der[1] == len(der) - 2
    n = der[1] & 0x7F
    return 0 < n <= 4 and len(der) > 2 + n and int.from_bytes(der[2 : 2 + n]) == len(der) - 2 - n


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


#: Per kind: pattern, and whether a match counts. One that doesn't count still uses up its text, of a jwt its first part.
RULES = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= 6),
    "access": (ACCESS, lambda m: len(m[0]) >= 20),
    "github": (GITHUB, lambda m: crc_base62(m[1]) == m[2]),
    "npm": (NPM, lambda m: crc_base62(m[1]) == m[2]),
    "jwt": (JWT, lambda m: _jwt_ok(m[1])),
    "pem": (PEM, lambda m: _pem_ok(m[2])),
}


def scan(text: str) -> list[tuple[int, int, int]]:
    """All spans of one text as (start, index in KINDS, end), sorted; code points, end exclusive."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):  # a few letters change length
        low = text.translate(_LOWER)
    spans, free = [(m.start(), 2, m.end()) for m in HEX.finditer(text)], dict.fromkeys(RULES, 0)
    # Hits end in order; within a kind no keyword is the end of another, so they start in order as well.
    for end, (size, kind) in _automaton().iter(low):
        start = end + 1 - size
        pattern, counts = RULES[kind]
        if start < free[kind]:
            continue
        m = pattern.match(text, start)
        if m and counts(m):
            free[kind] = m.end()
            spans.append((start, KINDS.index(kind), m.end()))
        elif kind == "jwt":
            free[kind] = run.end() if (run := JWT_RUN.match(text, start)) else 0
        elif m:
            free[kind] = m.end()
    return sorted(spans)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end in spans)


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", into: str | None = None) -> DataFrame:
    """Per row: doc_id, counts by base kind, digest of the base spans, all spans, and counts of the checked kinds."""

    def step(part: pa.RecordBatch) -> dict:
        found = [scan(x) for x in texts(part.column(1))]
        base = [[s for s in spans if s[1] < 3] for spans in found]
        count = lambda k: pa.array([sum(s[1] == k for s in spans) for spans in found], pa.int64())
        return {
            "doc_id": part.column(0),
            "n_assign": count(0),
            "n_access": count(1),
            "n_hex": count(2),
            "base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b in base],
            "spans": [joined(spans) for spans in found],
            "n_checked": pa.array([sum(s[1] > 2 for s in spans) for spans in found], pa.int64()),
        }

    return finish(docs, "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_checked bigint", step, into, doc_id, text)


def redact(text: str) -> str:
    """The text with every secret replaced by a mark of its kind; overlapping spans become one mark."""
    out, at, spans = [], 0, scan(text)
    for i, (start, kind, end) in enumerate(spans):
        if start >= at:
            while i + 1 < len(spans) and spans[i + 1][0] < end:
                i, end = i + 1, max(end, spans[i + 1][2])
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
            at = end
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", into: str = "_clean") -> DataFrame:
    """``docs`` with a struct of the redacted text (null stays null) and its length."""

    def step(part: pa.RecordBatch) -> dict:
        made = [x if x is None else redact(x) for x in part.column(1).to_pylist()]
        return {"doc_id": part.column(0), "redacted": pa.array(made, pa.string()), "n_chars": pa.array([None if x is None else len(x) for x in made], pa.int64())}

    return finish(docs, "redacted string, n_chars bigint", step, into, doc_id, text)

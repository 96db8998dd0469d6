"""Chat formatting by schema fingerprint.

A record's fingerprint is a hash of its nested field paths with their kinds; it selects one of the declarative
mappings in ``LAYOUTS``, which say where turns, roles and texts lie. A fingerprint that is met for the first time
takes the first layout whose required paths it holds, whatever other fields it has, and keeps it. Records are
turned into canonical (role, text) turns and written with turn marks. Control strings inside texts are escaped by
one backslash between ``<`` and ``|`` (those that are there already get one more), which reading back removes.

One formatted row per turn keeps memory bounded however long a conversation is, and formatting needs no shuffle.
Turns of a conversation are read back as a stream in turn order, holding digests and not texts; a digest over all
turns is a chain, so the digest of one conversation is one task's work.

Null texts are empty, null roles are empty, a text that is a list of parts is the parts' texts, a line each; a
record with an empty list of turns has no turns; rows of equal turn number are ordered by role and text, so
repeated rows are repeated turns. Records that are no JSON or fit no layout give one row without a formatted text
that names the trouble in ``rejected``; reading back leaves these out. Other columns are ignored; an empty table
gives no turns.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import bound_batches, pick, slices

START, END = "<|im_start|>", "<|im_end|>\n"
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

#: Declarative layouts: required paths, and how turns are found. ``each`` walks a list ("" is the record itself);
#: ``turns`` lists (role, paths whose texts are joined by a blank line). ``system``, where there, comes first.
LAYOUTS = [
    {"name": "messages", "need": ["messages[].role", "messages[].content"], "each": "messages", "role": "role", "text": "content"},
    {"name": "shares", "need": ["conversations[].from", "conversations[].value"], "each": "conversations", "role": "from", "text": "value"},
    {"name": "list", "need": ["[].role", "[].content"], "each": "", "role": "role", "text": "content"},
    {"name": "turn", "need": ["role", "text"], "each": None, "role": "role", "text": "text"},
    {"name": "message", "need": ["role", "content"], "each": None, "role": "role", "text": "content"},
    {"name": "instruction", "need": ["instruction", "output"], "turns": [("user", ["instruction", "input"]), ("assistant", ["output"])]},
    {"name": "prompt", "need": ["prompt", "completion"], "turns": [("user", ["prompt"]), ("assistant", ["completion"])]},
    {"name": "response", "need": ["prompt", "response"], "turns": [("user", ["prompt"]), ("assistant", ["response"])]},
    {"name": "question", "need": ["question", "answer"], "turns": [("user", ["context", "question"]), ("assistant", ["answer"])]},
]
KEPT_SHAPES = 10_000
_HALF = re.compile("[\ud800-\udfff]")  # half a character, which JSON can name and UTF-8 cannot hold


def paths(record: object) -> set[tuple[str, str]]:
    """Nested field paths of a record with the kind of each leaf: s text or null, n number, b truth value, e empty."""
    found, todo = set(), [("", record)]
    while todo:
        at, value = todo.pop()
        if isinstance(value, dict) and value:
            todo += [(f"{at}.{k}" if at else k, v) for k, v in value.items()]
        elif isinstance(value, list) and value:
            todo += [(f"{at}[]", v) for v in value]
        else:
            found.add((f"{at}[]" if value == [] else at, "e" if value in ([], {}) else "b" if isinstance(value, bool) else "n" if isinstance(value, (int, float)) else "s"))
    return found


def fingerprint(found: set[tuple[str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{p}:{k}" for p, k in sorted(found)).encode("utf-8", "surrogatepass")).hexdigest()


def _holds(found: set[tuple[str, str]], path: str) -> bool:
    """Whether a path is there, as a leaf or a list of parts, or its list is empty."""
    head, in_list, _ = path.rpartition("[].")
    return any(p == path or p.startswith(path + "[]") for p, _ in found) or bool(in_list) and (head + "[]", "e") in found


def _text(value: object) -> str:
    """Text of a leaf or of a list of parts; parts without a text, such as images, say nothing."""
    if isinstance(value, list):
        said = [x.get("text") if isinstance(x, dict) else x for x in value]
        return "\n".join(_text(x) for x in said if x is not None)
    said = "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return said if said.isascii() else _HALF.sub("\ufffd", said)


class Mapper:
    """Selects the layout of each record by its fingerprint."""

    def __init__(self) -> None:
        self.layouts: dict[str, dict | None] = {}

    def layout(self, record: object) -> dict | None:
        found = paths(record)
        key = fingerprint(found)
        if key not in self.layouts:
            if len(self.layouts) >= KEPT_SHAPES:
                self.layouts.clear()
            self.layouts[key] = next((x for x in LAYOUTS if all(_holds(found, p) for p in x["need"])), None)
        return self.layouts[key]

    def turns(self, record: object) -> list[tuple[str, str]]:
        layout = self.layout(record)
        if layout is None:
            raise ValueError(f"no layout for a record with fields {sorted({p for p, _ in paths(record)})}")
        head = [("system", _text(record["system"]))] if isinstance(record, dict) and record.get("system") else []
        if "turns" in layout:
            made = [(role, "\n\n".join(_text(record[p]) for p in fields if record.get(p) not in (None, ""))) for role, fields in layout["turns"]]
        else:
            items = [record] if layout["each"] is None else record if layout["each"] == "" else record[layout["each"]]
            if not all(isinstance(x, dict) for x in items):
                raise ValueError("a turn that is no record")
            made = [(_text(x.get(layout["role"])), _text(x.get(layout["text"]))) for x in items]
        return head + [(ROLES.get(r, r), t) for r, t in made]

    def read(self, text: str | None) -> tuple[list[tuple[str, str]], str | None]:
        """Turns of a JSON record, or none and the reason."""
        try:
            return (self.turns(json.loads(text)) if text else []), None
        except (ValueError, RecursionError) as e:
            return [], str(e) or type(e).__name__


_INSIDE, _WRITTEN = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _INSIDE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _WRITTEN.sub(r"<\1|", text)


def _role(role: str) -> str:
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def _read_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """One marked turn, and the start and end of its loss mask in it (empty unless an assistant speaks)."""
    head, body = f"{START}{_role(role)}\n", escape(text)
    end = len(head) + len(body) if role == "assistant" else len(head)
    return head + body + END, len(head), end


def read_turn(segment: str) -> tuple[str, str]:
    role, _, text = segment[len(START) : -len(END)].partition("\n")
    return _read_role(role), unescape(text)


FORMATTED = "conv_id bigint, turn bigint, part bigint, role string, formatted string, loss_start bigint, loss_end bigint, rejected string"


def format_records(df: DataFrame, record: str, conv_id: str = "conv_id", turn: str | None = None) -> DataFrame:
    """Formatted turns of JSON records (``record``), each a whole conversation or one turn of it.

    Returns one row per turn: conv_id, turn (the record's), part (within the record), role, the formatted text and
    the loss mask within it. Ordered by turn, part, role and text they are the training text. A record that fits no
    layout is one row with ``rejected``.
    """
    bound_batches(df.sparkSession)
    rows = df.select(F.col(conv_id).cast("bigint").alias("conv_id"), (F.col(turn) if turn else F.lit(0)).cast("bigint").alias("turn"), F.col(record).alias("record"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapper = Mapper()
        for part in slices(batches):
            out: list[tuple] = []
            for conv, at, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                made, trouble = mapper.read(text)
                for i, (r, t) in enumerate(made):
                    out.append((conv, at, i, r, *format_turn(r, t), None))
                if trouble is not None:
                    out.append((conv, at, 0, None, None, None, None, trouble))
            names = [x.split(" ")[0] for x in FORMATTED.split(", ")]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return rows.mapInArrow(run, FORMATTED)


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Format a table of turns; each row is a record of the ``turn`` layout."""
    rows = pick(turns, conv_id=conv_id, turn=turn, role=role, text=text)
    both = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return format_records(rows.select("conv_id", "turn", F.to_json(both).alias("record")), "record", "conv_id", "turn")


DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of every conversation, parsed from its formatted turns and their loss masks, in turn order."""
    shown = F.expr(f"substring(formatted, loss_start + 1, length(formatted) - loss_start - {len(END)})")
    said = F.regexp_replace(shown, r"<\\(\\*)\|", "<$1|")
    kept = formatted.where("formatted is not null").select("conv_id", "turn", "part", "role", "formatted", "loss_start", "loss_end")
    ordered = kept.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "part", "role", said)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        out: list[tuple] = []

        def close() -> None:
            if held:
                conv, n, turns, chars, loss, total = held
                out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), total))

        def batch() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split(" ")[0] for x in DIGESTS.split(", ")])

        for part in slices(batches):
            for conv, _, _, _, segment, start, end in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if held is None or held[0] != conv:
                    close()
                    held = (conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0)
                _, n, turns, chars, loss, total = held
                role, text = read_turn(segment)
                turns.update(f"{role}\n{text}\n".encode())
                masked = unescape(segment[start:end])
                loss.update(masked.encode())
                held = (conv, n + 1, turns, chars + len(masked), loss, total + len(segment))
            if len(out) > 1000:
                yield batch()
                out.clear()
        close()
        yield batch()

    return ordered.mapInArrow(run, DIGESTS)

r"""Operator 7: chat formatting by a finite-state machine and a declarative template.

The machine checks the order of roles and the template turns each row into text segments with a
loss flag each. Control strings inside texts and roles are escaped by a backslash after their
first character (a backslash becomes two), so the output reads back exactly.

Scale: rows are dealt by conversation and sorted by turn, then streamed through the machine. A
conversation is never gathered: memory is one batch and a few scalars, however long it is.

Edge cases: null text is empty text; a null or unknown role is written as itself and makes the
conversation invalid from that turn on; a null conv_id is a conversation of its own; equal turns
are ordered by role, then text; repeated rows count twice; an empty table yields no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

NO_ROLE = "\\0"  # how a null role is written; escaping keeps any real role apart from it


@dataclass(frozen=True)
class Template:
    """What surrounds each text, which roles are trained on, and which turn orders are valid.

    ``moves`` maps a state to the roles it admits and the state each leads to.
    """

    turn_open: str = "<s>[INST]"
    role_close: str = "[/INST]"
    turn_close: str = "</s>"
    more_controls: tuple[str, ...] = ("<<SYS>>", "<</SYS>>")
    loss_roles: frozenset[str] = frozenset({"assistant"})
    start: str = "start"
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "instructed", "user": "asked"},
            "instructed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked", "tool": "asked"},
        }
    )

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.turn_open, self.role_close, self.turn_close, "<s>", "[INST]", *self.more_controls)


class Escaper:
    """Makes texts free of control strings, reversibly."""

    def __init__(self, controls: tuple[str, ...]) -> None:
        if any("\\" in c or len(c) < 2 for c in controls):
            raise ValueError("control strings need two characters and no backslash")
        starts = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in sorted(set(controls)))
        self._find = re.compile(f"\\\\|{starts}")
        self._undo = re.compile(r"\\(.)", re.DOTALL)

    def escape(self, text: str) -> str:
        return self._find.sub(lambda m: m[0] + "\\", text)

    def unescape(self, text: str) -> str:
        # a doubled backslash or one after a control's first character: the character stays
        out, i = [], 0
        while (j := text.find("\\", i)) >= 0:
            if text[j + 1 : j + 2] == "\\":
                out.append(text[i : j + 1])
                i = j + 2
            else:
                out.append(text[i:j])
                i = j + 1
        out.append(text[i:])
        return "".join(out)


SEGMENTS = "conv_id long, seq long, turn long, kind string, segment string, loss boolean, valid boolean"
_SEGMENTS = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("turn", pa.int64()), ("kind", pa.string()), ("segment", pa.string()), ("loss", pa.bool_()), ("valid", pa.bool_())])
OUT_ROWS = 4096  # segments of one batch


def _sorted(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def format_segments(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """Segments in order of ``seq`` within a conversation: ``open``, ``role``, ``sep``, ``text``, ``close`` per turn.

    The concatenation of a conversation's segments is its training text; ``loss`` marks what the
    loss counts (the whole text of a trained role, nothing around it); ``valid`` tells whether
    the turns so far follow the machine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        esc = Escaper(template.controls)
        at, state, seq, out = object(), None, 0, []
        for batch in batches:
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if conv != at:
                    at, state, seq = conv, template.start, 0
                state = template.moves.get(state, {}).get(role)
                loss = role in template.loss_roles
                shown = NO_ROLE if role is None else esc.escape(role)
                for kind, segment, counts in (("open", template.turn_open, False), ("role", shown, False), ("sep", template.role_close, False), ("text", esc.escape(text), loss), ("close", template.turn_close, False)):
                    out.append((conv, seq, turn, kind, segment, counts, state is not None))
                    seq += 1
                if len(out) >= OUT_ROWS:
                    yield _batch(out, _SEGMENTS)
                    out = []
        yield _batch(out, _SEGMENTS)

    return _sorted(conversations).mapInArrow(run, SEGMENTS)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])


class Reader:
    """Reads formatted text back, piece by piece, by its control strings alone."""

    def __init__(self, template: Template) -> None:
        self.template, self.esc = template, Escaper(template.controls)
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.valid, self.buffer, self.mask = True, [], []

    def feed(self, segment: str, loss: bool, valid: bool) -> None:
        self.chars += len(segment)
        self.valid &= valid
        self.buffer.append(segment)
        if loss:
            self.mask.append(segment)
        if segment == self.template.turn_close:
            self._turn("".join(self.buffer))
            self.buffer, self.mask = [], []

    def _turn(self, text: str) -> None:
        t = self.template
        if not text.startswith(t.turn_open) or not text.endswith(t.turn_close):
            raise ValueError("the text does not begin or end with a turn's marks")
        role, mark, body = text[len(t.turn_open) : -len(t.turn_close)].partition(t.role_close)
        if not mark or any(c in x for x in (role, body) for c in t.controls):
            raise ValueError("a control string stands inside a turn")
        role, body = "" if role == NO_ROLE else self.esc.unescape(role), self.esc.unescape(body)
        self.turns.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
        self.n_turns += 1
        trained = self.esc.unescape("".join(self.mask))
        self.loss_chars += len(trained)
        self.loss.update(trained.encode("utf-8", "surrogatepass"))

    def row(self, conv) -> tuple:
        if self.buffer:
            raise ValueError("the text ends inside a turn")
        return conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid


def read_back(segments: DataFrame, template: Template = Template(), ordered: bool = False) -> DataFrame:
    """One digest row per conversation, from the formatted segments only.

    ``ordered`` says that each partition already holds whole conversations in order of ``seq``,
    as :func:`format_segments` leaves them; otherwise they are dealt and sorted first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, reader = None, None
        for batch in batches:
            out = []
            for conv, segment, loss, valid in zip(*(c.to_pylist() for c in batch.columns)):
                if reader is None or conv != at:
                    if reader:
                        out.append(reader.row(at))
                    at, reader = conv, Reader(template)
                reader.feed(segment, loss, valid)
            yield _batch(out, _DIGEST)
        if reader:
            yield _batch([reader.row(at)], _DIGEST)

    if not ordered:
        segments = segments.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return segments.select("conv_id", "segment", "loss", "valid").mapInArrow(run, DIGEST)


SAID = "</s>[INST] ok [/INST]"  # what the planted conversation says


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every conversation's formatted text, with a planted one that says control strings."""
    planted = spark.createDataFrame([(-1, 0, "user", SAID), (-1, 1, "assistant", SAID)], "conv_id long, turn long, role string, text string")
    every = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return read_back(format_segments(every), ordered=True)


def sql(template: Template = Template()) -> str:
    """The digests in DuckDB, from the conversations alone: every control string in a text costs one backslash."""
    text = lambda v: "'" + v.replace("'", "''") + "'"
    cost = lambda c: " + ".join([f"length({c})", f"length({c}) - length(replace({c}, '\\', ''))", *[f"(length({c}) - length(replace({c}, {text(x)}, ''))) // {len(x)}" for x in sorted(set(template.controls) - {template.turn_open})]])
    marks = len(template.turn_open) + len(template.role_close) + len(template.turn_close)
    # controls may follow each other but never share a place, but for the turn's opening, which is two of them
    return f"""WITH C AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', {text(SAID)} UNION ALL SELECT -1, 1, 'assistant', {text(SAID)}),
G AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 (sum({cost('text')} + CASE WHEN role IS NULL THEN 2 ELSE {cost('role')} END) + {marks} * count(*))::BIGINT AS formatted_chars,
 string_agg(CASE role WHEN 'system' THEN 'S' WHEN 'user' THEN 'U' WHEN 'assistant' THEN 'A' WHEN 'tool' THEN 'T' ELSE '?' END, '' ORDER BY turn, role, text) AS path FROM C GROUP BY conv_id)
SELECT * EXCLUDE (path), regexp_full_match(path, 'S?(U(A[UT])*A?)?') AS valid FROM G"""

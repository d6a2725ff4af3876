"""Content streams of pages: lexing, replaying and byte-exact splicing.

A stream is read once by a regular expression whose alternatives are the token kinds; strings with
brackets inside, whose nesting needs a counter, and inline images are read apart. Nothing raises on bad input: what
had to be skipped or mended is noted as a problem (offset, code), and a stray closer becomes a
one-byte operator, so reading always advances.

The interpreter looks each operator up in a table of handlers. It reports text runs, referenced
XObjects and operators without a handler as events in order of the stream.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

Problem = tuple[int, str]

_TOKEN = re.compile(
    rb"[\0\t\n\f\r ]*+(?:(?P<string>\([^()\\]*+(?:\\[\0-\xff][^()\\]*+)*+\))|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?=[\0\t\n\f\r ()<>\[\]{}/%]|$))|(?P<operator>[^\0\t\n\f\r ()<>\[\]{}/%]+)"
    rb"|(?P<name>/[^\0\t\n\f\r ()<>\[\]{}/%]*)|(?P<dict_open><<)|(?P<hex><[^>]*>?)|(?P<array_open>\[)|(?P<array_close>\])|(?P<comment>%[^\r\n]*)|(?P<dict_close>>>)|(?P<nested>\()|(?P<stray>[)>{}]))"
)
_KINDS = {i: kind for kind, i in _TOKEN.groupindex.items()}
_PLAIN = rb"(\([^()\\]*+(?:\\[\0-\xff][^()\\]*+)*+\)|<[0-9A-Fa-f]*+>)[\0\t\n\f\r ]*+Tj"
#: The commonest forms, which are read at once: a string that is shown, a text object of one line, and what keeps, restores and colours.
_SHOWN = re.compile(rb"[\0\t\n\f\r ]*+" + _PLAIN + rb"(?=[\0\t\n\f\r ()<>\[\]{}/%]|$)")
_LINE = re.compile(rb"_*+BT_*+/([^\0\t\n\f\r ()<>\[\]{}/%#]*+)_++(N)_++Tf_++(N)_++(N)_++Td_*+".replace(b"_", rb"[\0\t\n\f\r ]").replace(b"N", rb"[+-]?(?:\d++\.?+\d*+|\.\d++)") + _PLAIN + rb"[\0\t\n\f\r ]++ET(?=[\0\t\n\f\r ()<>\[\]{}/%]|$)")
_GRAPHICS = re.compile(rb"_*+(?:(q)|(Q)|(N)_++(N)_++(N)_++rg)(?=[\0\t\n\f\r ()<>\[\]{}/%]|$)".replace(b"_", rb"[\0\t\n\f\r ]").replace(b"N", rb"[+-]?(?:\d++\.?+\d*+|\.\d++)"))
#: A word that stands by itself: kept state, colour, one shown string and the state restored, in one match.
_WORD = re.compile(rb"_*+q_++(N)_++(N)_++(N)_++rg_++BT_++/([^\0\t\n\f\r ()<>\[\]{}/%#]*+)_++(N)_++Tf_++(N)_++(N)_++Td_*+".replace(b"_", rb"[\0\t\n\f\r ]").replace(b"N", rb"[+-]?(?:\d++\.?+\d*+|\.\d++)") + _PLAIN + rb"_++ET_++Q(?=[\0\t\n\f\r ()<>\[\]{}/%]|$)".replace(b"_", rb"[\0\t\n\f\r ]"))
_PAREN = re.compile(rb"\\.|[()]", re.DOTALL)
_ESCAPE = re.compile(rb"(\\(?:[0-7]{1,3}|\r\n|.)|\r\n|\r)", re.DOTALL)
_BACKSLASH = re.compile(rb"(\\(?:[0-7]{1,3}|.))", re.DOTALL)  # the same without line ends, found by its first byte
_MEANT = {b"\\" + bytes([c]): bytes([c]) for c in range(256)} | {b"\\n": b"\n", b"\\r": b"\r", b"\\t": b"\t", b"\\b": b"\b", b"\\f": b"\f", b"\r\n": b"\n", b"\r": b"\n"}
_MEANT |= {b"\\\r\n": b"", b"\\\r": b"", b"\\\n": b""} | {b"\\%0*o" % (n, v): bytes([v & 255]) for n in (1, 2, 3) for v in range(8**n)}
_IMAGE_DATA = re.compile(rb"[\0\t\n\f\r ]ID[\0\t\n\f\r ]")
_IMAGE_END = re.compile(rb"[\0\t\n\f\r ]EI(?=[\0\t\n\f\r ()<>\[\]{}/%]|$)")
_NAME_ESCAPE = re.compile(rb"#([0-9A-Fa-f]{2})?")
_NOT_HEX = re.compile(rb"[^0-9A-Fa-f\0\t\n\f\r ]")
_NO_DIGITS = bytes(c for c in range(256) if chr(c) not in "0123456789ABCDEFabcdef")


class Token(NamedTuple):
    kind: str
    start: int
    end: int
    value: object = None


def literal_bytes(body: bytes) -> bytes:
    """Bytes of a literal string's inside."""
    if b"\\" not in body and b"\r" not in body:
        return body
    parts = (_ESCAPE if b"\r" in body else _BACKSLASH).split(body)
    parts[1::2] = map(_MEANT.__getitem__, parts[1::2])
    return b"".join(parts)


def hex_bytes(body: bytes) -> bytes:
    digits = body[1:-1].decode("latin-1")
    if len(digits) % 2 == 0 and digits.isalnum() and digits.isascii() and body[:1] == b"<" and body[-1:] == b">":
        try:
            return bytes.fromhex(digits)
        except ValueError:  # letters that are no digits are left out
            pass
    digits = body.translate(None, _NO_DIGITS).decode()
    return bytes.fromhex(digits + "0" if len(digits) % 2 else digits)


def _name(body: bytes, at: int, problems: list[Problem]) -> str:
    def one(m: re.Match) -> bytes:
        if m[1]:
            return bytes([int(m[1], 16)])
        problems.append((at + m.start(), "invalid-name-escape"))
        return b"#"

    return _NAME_ESCAPE.sub(one, body).decode("latin-1")


def tokens(data: bytes, problems: list[Problem] | None = None, at: int = 0) -> Iterator[Token]:
    """Tokens with half-open byte ranges from a place on; only white space lies between them. Problems are appended to the list."""
    problems = [] if problems is None else problems
    n, match = len(data), _TOKEN.match
    while m := match(data, at):
        group = m.lastindex
        kind = _KINDS[group]
        begin, at = m.span(group)
        if kind == "string":
            yield Token(kind, begin, at, literal_bytes(data[begin + 1 : at - 1]))
        elif kind == "number":
            yield Token(kind, begin, at, float(m[group]))
        elif kind == "operator":
            if m[group] == b"BI":
                inside = _IMAGE_DATA.search(data, at)
                stop = _IMAGE_END.search(data, inside.end() - 1 if inside else n)
                at = stop.end() if stop else n
                if not stop:
                    problems.append((begin, "unterminated-inline-image"))
                yield Token("inline-image", begin, at)
            else:
                yield Token(kind, begin, at, m[group].decode("latin-1"))
        elif kind == "name":
            body = m[group][1:]
            yield Token(kind, begin, at, _name(body, begin + 1, problems) if b"#" in body else body.decode("latin-1"))
        elif kind == "hex":
            text = m[group]
            problems += [(begin + x.start(), "invalid-hex-pair") for x in _NOT_HEX.finditer(text, 1, len(text) - text.endswith(b">"))]
            if not text.endswith(b">"):
                problems.append((begin, "unterminated-hexstring"))
            yield Token("hexstring", begin, at, hex_bytes(text))
        elif kind == "nested":
            depth, at = 1, n
            for p in _PAREN.finditer(data, begin + 1):
                depth += {b"(": 1, b")": -1}.get(p[0], 0)
                if not depth:
                    at = p.end()
                    break
            if depth:
                problems.append((begin, "unterminated-string"))
            yield Token("string", begin, at, literal_bytes(data[begin + 1 : at - (not depth)]))
        elif kind == "comment":
            yield Token(kind, begin, at, m[group][1:].decode("latin-1"))
        else:
            if kind == "stray":
                problems.append((begin, "unbalanced-paren"))
            yield Token("operator" if kind == "stray" else kind.replace("_", "-"), begin, at, m[group].decode("latin-1"))


def uncovered(data: bytes) -> int:
    """Bytes other than white space that no token holds, plus bytes that two tokens hold; always 0."""
    at = wrong = 0
    for t in tokens(data):
        wrong += len(data[at : t.start].strip(b"\0\t\n\f\r ")) + max(0, at - t.start)
        at = t.end
    return wrong + len(data[at:].strip(b"\0\t\n\f\r "))


Matrix = tuple[float, float, float, float, float, float]
UNIT: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
Colour = tuple[float, float, float]


def multiply(a: Matrix, b: Matrix) -> Matrix:
    """Row vectors: ``a`` first, then ``b``."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def translation(x: float, y: float) -> Matrix:
    return (1.0, 0.0, 0.0, 1.0, x, y)


def transformed(m: Matrix, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def nearly_equal(a: Matrix, b: Matrix, within: float = 1e-6) -> bool:
    return all(abs(x - y) <= within for x, y in zip(a, b))


class Graphics(NamedTuple):
    ctm: Matrix = UNIT
    fill: Colour = (0.0, 0.0, 0.0)
    stroke: Colour = (0.0, 0.0, 0.0)


class TextState(NamedTuple):
    font: str = ""
    size: float = 0.0
    char_spacing: float = 0.0
    word_spacing: float = 0.0
    scale: float = 100.0
    leading: float = 0.0
    rise: float = 0.0
    mode: float = 0.0
    matrix: Matrix = UNIT
    line: Matrix = UNIT


@dataclass(slots=True)
class Run:
    """A text-showing operation: its text, place, state and the byte ranges of its strings."""

    text: str
    operator: str
    x: float
    y: float
    font: str
    size: float
    operands: list[tuple[int, int, bool]]
    kerns: list[float]
    fill: Colour
    stroke: Colour = (0.0, 0.0, 0.0)
    state: TextState = TextState()
    start: int = 0
    end: int = 0
    in_xobject: bool = False


@dataclass(slots=True)
class Event:
    """``text-run``, ``do-xobject`` (``value`` names it) or ``unsupported-op`` (``value`` is the operator)."""

    kind: str
    start: int
    end: int
    value: str
    run: Run | None = None


@dataclass
class Page:
    events: list[Event] = field(default_factory=list)
    problems: list[Problem] = field(default_factory=list)

    @property
    def runs(self) -> list[Run]:
        return [e.run for e in self.events if e.run is not None]


def latin1(font: str, raw: bytes) -> str:
    return raw.decode("latin-1")


class Interpreter:
    """Replays one page. Operands go after each operator; a dictionary is one opaque operand."""

    def __init__(self, decode: Callable[[str, bytes], str] = latin1, in_xobject: bool = False) -> None:
        self.decode, self.page, self.in_xobject = decode, Page(), in_xobject
        self.graphics, self.stack, self.inside, self.text = Graphics(), [], False, TextState()

    def run(self, data: bytes) -> Page:
        operands: list = []
        nested: list[tuple[str, list]] = []
        rest = tokens(data, self.page.problems, self._ahead(data, 0))
        while (t := next(rest, None)) is not None:
            kind = t.kind
            if kind == "operator" and not nested:
                self._apply(t, operands)
                operands = []
                if (at := self._ahead(data, t.end)) > t.end:
                    rest = tokens(data, self.page.problems, at)
            elif kind in ("array-open", "dict-open"):
                nested.append((kind[:-5], []))
            elif kind in ("array-close", "dict-close"):
                if nested and nested[-1][0] == kind[:-6]:
                    kind, done = nested.pop()
                    (nested[-1][1] if nested else operands).append(done if kind == "array" else {"dict": done})
                else:
                    self.page.problems.append((t.start, "unknown-operator"))
            elif kind not in ("comment", "inline-image"):
                (nested[-1][1] if nested else operands).append(t)
        self.page.problems += [(len(data), "unknown-operator")] * len(nested)
        return self.page

    def _ahead(self, data: bytes, at: int) -> int:
        """Replay what follows of the commonest forms, between operators; the place of what is left to be read by tokens."""
        show, decode, hidden, inside = self.page.events.append, self.decode, self.in_xobject, self.inside
        numbers: dict[bytes, float] = {}  # a page's words share sizes, colours and heights

        def number(digits: bytes) -> float:
            if (n := numbers.get(digits)) is None:
                n = numbers[digits] = float(digits)
            return n

        while m := _SHOWN.match(data, at) if inside else _WORD.match(data, at) or _LINE.match(data, at) or _GRAPHICS.match(data, at):
            g = self.graphics
            if m.re is _GRAPHICS:
                if m[1]:
                    self.stack.append(g)
                elif m[3]:
                    self.graphics = Graphics(g.ctm, (float(m[3]), float(m[4]), float(m[5])), g.stroke)
                elif self.stack:
                    self.graphics = self.stack.pop()
                else:
                    break
                at = m.end()
                continue
            (start, end), at, fill = m.span(m.lastindex), m.end(), g.fill
            stop = at
            if not inside:
                *colour, name, size, x, y, shown = m.groups()
                if colour:
                    fill = (number(colour[0]), number(colour[1]), number(colour[2]))
                x, y = number(x), number(y)
                matrix = (1.0, 0.0, 0.0, 1.0, x * 1.0 + y * 0.0 + 0.0, x * 0.0 + y * 1.0 + 0.0)  # as multiply gives it
                self.text = TextState(name.decode("latin-1"), number(size), 0.0, 0.0, 100.0, 0.0, 0.0, 0.0, matrix, matrix)
                stop = data.index(b"Tj", end) + 2
            else:
                shown = m[1]
            s, as_hex = self.text, data[start] == 0x3C
            raw = hex_bytes(shown) if as_hex else literal_bytes(shown[1:-1])
            x, y = transformed(g.ctm, s.matrix[4], s.matrix[5])
            show(Event("text-run", start, stop, "Tj", Run(decode(s.font, raw), "Tj", x, y, s.font, s.size, [(start, end, as_hex)], [], fill, g.stroke, s, start, stop, hidden)))
        return at

    def _apply(self, t: Token, operands: list) -> None:
        op = t.value
        if op in _IN_TEXT and not self.inside:
            self.page.problems.append((t.start, "text-op-outside-bt-et"))
            return
        needed, handler = _HANDLERS.get(op, (0, None))
        if handler is None:
            self.page.events.append(Event("unsupported-op", t.start, t.end, op))
            return
        numbers = () if op == "Tj" else [x.value for x in operands if isinstance(x, Token) and x.kind == "number"]
        if len(numbers) < needed:
            if op not in _QUIET:
                self.page.problems.append((t.start, "missing-operand"))
        else:
            handler(self, t, numbers, operands)

    # ---- handlers: (token, its numbers, all operands) ----

    def _save(self, t, n, operands) -> None:
        self.stack.append(self.graphics)

    def _restore(self, t, n, operands) -> None:
        if self.stack:
            self.graphics = self.stack.pop()
        else:
            self.page.problems.append((t.start, "graphics-state-underflow"))

    def _concat(self, t, n, operands) -> None:
        self.graphics = self.graphics._replace(ctm=multiply(tuple(n[-6:]), self.graphics.ctm))

    def _colour(self, t, n, operands) -> None:
        where = "fill" if str(t.value).islower() else "stroke"
        self.graphics = self.graphics._replace(**{where: _rgb(n[-_HANDLERS[t.value][0] :])})

    def _begin(self, t, n, operands) -> None:
        self.inside, self.text = True, TextState()

    def _finish(self, t, n, operands) -> None:
        self.inside = False

    def _set(self, t, n, operands) -> None:
        name, default = _STATE[t.value]
        self.text = self.text._replace(**{name: n[-1] if n else default})

    def _font(self, t, n, operands) -> None:
        names = [x.value for x in operands if isinstance(x, Token) and x.kind == "name"]
        if names:
            self.text = self.text._replace(font=names[-1], size=n[-1])
        else:
            self.page.problems.append((t.start, "missing-operand"))

    def _move(self, x: float, y: float) -> None:
        at = multiply(translation(x, y), self.text.line)
        self.text = self.text._replace(matrix=at, line=at)

    def _next(self, t, n, operands) -> None:
        if t.value == "TD":
            self.text = self.text._replace(leading=-n[-1])
        self._move(*(n[-2:] if t.value in ("Td", "TD") else (0.0, -self.text.leading)))

    def _place(self, t, n, operands) -> None:
        self.text = self.text._replace(matrix=tuple(n[-6:]), line=tuple(n[-6:]))

    def _show(self, t, n, operands) -> None:
        op = t.value
        items = next((x for x in operands if isinstance(x, list)), []) if op == "TJ" else operands
        strings = [x for x in items if isinstance(x, Token) and x.kind in ("string", "hexstring")]
        if op != "TJ":
            strings = strings[-1:]
            if op == '"' and len(n) >= 2:
                self.text = self.text._replace(word_spacing=n[-2], char_spacing=n[-1])
            if op != "Tj":
                self._next(t, n, operands)
        if not strings and op != "TJ":
            self.page.problems.append((t.start, "missing-operand"))
            return
        s, g = self.text, self.graphics
        x, y = transformed(g.ctm, s.matrix[4], s.matrix[5])
        kerns = [x.value for x in items if isinstance(x, Token) and x.kind == "number"] if op == "TJ" else []
        text = "".join([self.decode(s.font, x.value) for x in strings])
        start = strings[0].start if strings else t.start
        run = Run(text, op, x, y, s.font, s.size, [(x.start, x.end, x.kind == "hexstring") for x in strings], kerns, g.fill, g.stroke, s, start, t.end, self.in_xobject)
        self.page.events.append(Event("text-run", start, t.end, op, run))

    def _xobject(self, t, n, operands) -> None:
        names = [x.value for x in operands if isinstance(x, Token) and x.kind == "name"]
        if names:
            self.page.events.append(Event("do-xobject", t.start, t.end, names[-1]))
        else:
            self.page.problems.append((t.start, "missing-operand"))


def _rgb(v: list[float]) -> Colour:
    if len(v) == 4:
        return tuple((1 - c) * (1 - v[3]) for c in v[:3])
    return tuple(v) if len(v) == 3 else (v[0],) * 3


_IN_TEXT = {"Td", "TD", "Tm", "T*", "Tj", "TJ", "'", '"'}
_QUIET = {"G", "RG", "K"}
_STATE = {"Tc": ("char_spacing", 0.0), "Tw": ("word_spacing", 0.0), "Tz": ("scale", 100.0), "TL": ("leading", 0.0), "Tr": ("mode", 0.0), "Ts": ("rise", 0.0)}
#: Operator -> (numbers it needs, handler); any other operator is reported as unsupported.
_HANDLERS = (
    {"q": (0, Interpreter._save), "Q": (0, Interpreter._restore), "cm": (6, Interpreter._concat), "BT": (0, Interpreter._begin), "ET": (0, Interpreter._finish), "Tf": (1, Interpreter._font), "Do": (0, Interpreter._xobject)}
    | {op: (k, Interpreter._colour) for op, k in (("g", 1), ("rg", 3), ("k", 4), ("G", 1), ("RG", 3), ("K", 4))}
    | {op: (0, Interpreter._set) for op in _STATE}
    | {"Td": (2, Interpreter._next), "TD": (2, Interpreter._next), "T*": (0, Interpreter._next), "Tm": (6, Interpreter._place)}
    | {op: (0, Interpreter._show) for op in ("Tj", "TJ", "'", '"')}
)

_ORDINARY = bytes(c for c in range(32, 127) if chr(c) not in "\\()")
_WRITTEN = {bytes([c]): b"\\%03o" % c for c in range(256)} | {b"\n": b"\\n", b"\r": b"\\r", b"\t": b"\\t", b"\b": b"\\b", b"\f": b"\\f", b"\\": b"\\\\", b"(": b"\\(", b")": b"\\)"}


def literal(raw: bytes) -> bytes:
    """A literal string: backslash and parentheses escaped, other bytes by name or in octal where not printable."""
    special = raw.translate(None, _ORDINARY)
    if not special:
        return b"(%b)" % raw
    for c in sorted(set(special), key=b"\\".__contains__, reverse=True):  # the backslash first, as the others are written with it
        one = bytes((c,))
        raw = raw.replace(one, _WRITTEN[one])
    return b"(%b)" % raw


def serialize(raw: bytes, as_hex: bool | None = False) -> bytes:
    """A string in hex or literal form; None takes the shorter, literal if they are equal."""
    if as_hex is None:
        return min(literal(raw), serialize(raw, True), key=len)
    return b"<" + raw.hex().upper().encode() + b">" if as_hex else literal(raw)


Change = tuple[int, int, bool, bytes]


def splice(data: bytes, changes: list[Change]) -> bytes:
    """Replace operand ranges (start, end, hex form, new bytes); ranges must not overlap."""
    out, at = [], 0
    for start, end, as_hex, raw in sorted(changes):
        if not 0 <= start < end <= len(data) or start < at:
            raise ValueError("replacements overlap or lie outside the stream")
        out += [data[at:start], serialize(raw, as_hex)]
        at = end
    return b"".join([*out, data[at:]])


def spliced_length(data: bytes, changes: list[Change]) -> int:
    """Length of the spliced stream, from the ranges alone."""
    return len(data) + sum(len(serialize(raw, as_hex)) - (end - start) for start, end, as_hex, raw in changes)


def joined(parts: list[bytes]) -> bytes | None:
    """A page's content of several streams, a space between them; none give None."""
    return b" ".join(parts) if parts else None

"""Fonts of content streams: glyph names, encodings, character maps, and text to bytes and back.

Tables come from rules where there is one: Python's codecs for the Windows and Macintosh sets, and
Unicode's own character names for letters with accents. What no rule gives stands under a comment
that marks it as fixed values.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from dataclasses import dataclass, field

LOST = "\ufffd"
MAX_RANGE = 65_536  # codes of one range in a character map; what lies beyond is a problem

# Names of the ASCII punctuation and digits, in order of their codes.
_ASCII = (
    "space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash "
    "zero one two three four five six seven eight nine colon semicolon less equal greater question at "
    + " ".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ") + " bracketleft backslash bracketright asciicircum underscore grave "
    + " ".join("abcdefghijklmnopqrstuvwxyz") + " braceleft bar braceright asciitilde"
).split()

# Glyph names of other signs.
_SIGNS = {
    "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "quotesinglbase": "‚", "quotedblbase": "„", "guilsinglleft": "‹", "guilsinglright": "›",
    "guillemotleft": "«", "guillemotright": "»", "endash": "–", "emdash": "—", "bullet": "•", "ellipsis": "…", "dagger": "†", "daggerdbl": "‡", "perthousand": "‰", "trademark": "™",
    "Euro": "€", "florin": "ƒ", "fraction": "⁄", "minute": "′", "second": "″", "nbspace": "\u00a0", "nonbreakingspace": "\u00a0", "hyphennb": "-", "exclamdown": "¡", "cent": "¢",
    "sterling": "£", "currency": "¤", "yen": "¥", "brokenbar": "¦", "section": "§", "dieresis": "¨", "copyright": "©", "ordfeminine": "ª", "logicalnot": "¬", "registered": "®",
    "macron": "¯", "degree": "°", "plusminus": "±", "onesuperior": "¹", "twosuperior": "²", "threesuperior": "³", "acute": "´", "mu": "µ", "paragraph": "¶", "periodcentered": "·",
    "cedilla": "¸", "ordmasculine": "º", "onequarter": "¼", "onehalf": "½", "threequarters": "¾", "questiondown": "¿", "multiply": "×", "divide": "÷", "AE": "Æ", "ae": "æ",
    "OE": "Œ", "oe": "œ", "Oslash": "Ø", "oslash": "ø", "Eth": "Ð", "eth": "ð", "Thorn": "Þ", "thorn": "þ", "germandbls": "ß", "Lslash": "Ł", "lslash": "ł", "IJ": "Ĳ", "ij": "ĳ",
    "circumflex": "ˆ", "tilde": "˜", "ff": "ﬀ", "fi": "ﬁ", "fl": "ﬂ", "ffi": "ﬃ", "ffl": "ﬄ", "enspace": "\u2002", "emspace": "\u2003", "thinspace": "\u2009",
    "hairspace": "\u200a", "zerowidthspace": "\u200b", "minus": "−", "partialdiff": "∂", "infinity": "∞", "approxequal": "≈", "notequal": "≠", "lessequal": "≤", "greaterequal": "≥",
    "arrowleft": "←", "arrowup": "↑", "arrowright": "→", "arrowdown": "↓", ".notdef": "\0",
}
#: Names that encodings use though some readers do not know them; ``parity`` leaves them out.
_RARE = {"product": "∏", "pi": "π", "integral": "∫", "Omega": "Ω", "radical": "√", "ring": "˚", "hungarumlaut": "˝", "ogonek": "˛", "caron": "ˇ", "dotlessi": "ı"}
_ACCENTS = {"grave": "GRAVE", "acute": "ACUTE", "circumflex": "CIRCUMFLEX", "tilde": "TILDE", "dieresis": "DIAERESIS", "ring": "RING ABOVE", "cedilla": "CEDILLA", "caron": "CARON", "ogonek": "OGONEK", "dotaccent": "DOT ABOVE"}


@functools.cache
def glyphs(parity: bool = False) -> dict[str, str]:
    """Glyph name -> character."""
    out = {name: chr(0x20 + k) for k, name in enumerate(_ASCII)} | _SIGNS
    for letter in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz":
        size = "CAPITAL" if letter.isupper() else "SMALL"
        for accent, said in _ACCENTS.items():
            try:
                out[letter + accent] = unicodedata.lookup(f"LATIN {size} LETTER {letter.upper()} WITH {said}")
            except KeyError:
                continue
    return out if parity else out | _RARE


def character(name: str, parity: bool = False) -> str | None:
    """Character of a glyph name: by table, then ``uniXXXX`` and ``uXXXX`` to ``uXXXXXX``."""
    found = glyphs(parity).get(name)
    if found is None and (m := re.fullmatch(r"uni([0-9A-Fa-f]{4})|u([0-9A-Fa-f]{4,6})", name)):
        code = int(m[1] or m[2], 16)
        found = chr(code) if code < 0x110000 else None
    return found


def glyph_name(char: str) -> str | None:
    """First name of a character."""
    return next((name for name, c in glyphs().items() if c == char), None)


# The upper half of the standard set, by code.
_STANDARD = {0xA1: "¡¢£⁄¥ƒ§¤'“«‹›ﬁﬂ", 0xB1: "–†‡·", 0xB6: "¶•‚„”»…‰", 0xBF: "¿", 0xC1: "`´ˆ˜¯", 0xC8: "¨", 0xCA: "˚¸", 0xCD: "˝˛ˇ", 0xE1: "Æ", 0xE3: "ª", 0xE8: "ŁØŒº", 0xF1: "æ", 0xF5: "ı", 0xF8: "łøœß"}
_MAC_GAPS = {0xB7, 0xC6, 0xD7, 0xF0, *range(0xF5, 0x100)}
ENCODINGS = ("WinAnsiEncoding", "MacRomanEncoding", "StandardEncoding", "MacExpertEncoding")


@functools.cache
def encoding(name: str, parity: bool = False) -> dict[int, str]:
    """Code -> character of a named encoding; the expert set has its ASCII part only."""
    out = {c: chr(c) for c in range(0x20, 0x7F)}
    if name == "WinAnsiEncoding":  # no-break space and soft hyphen stand for the plain ones
        high = {c: bytes([c]).decode("cp1252", "ignore") for c in range(0x80, 0x100)} | {0xA0: " ", 0xAD: "-"}
    elif name == "MacRomanEncoding":
        high = {c: bytes([c]).decode("mac_roman") for c in range(0x80, 0x100) if c not in _MAC_GAPS} | {0xBD: "Ω", 0xCA: " ", 0xDB: "¤"}
    elif name == "StandardEncoding":
        high = {first + k: c for first, chars in _STANDARD.items() for k, c in enumerate(chars)}
    elif name == "MacExpertEncoding":
        high = {}
    else:
        raise KeyError(name)
    rare = set(_RARE.values()) if parity else set()
    return out | {c: x for c, x in high.items() if x and x not in rare}


SUBSET = re.compile(r"^[A-Z]{6}\+")
_DEFAULT = {"TrueType": "WinAnsiEncoding", "Type1": "StandardEncoding", "MMType1": "StandardEncoding"}
_KINDS = {"WinAnsiEncoding": "simple-winansi", "MacRomanEncoding": "simple-macroman", "StandardEncoding": "simple-standard", "MacExpertEncoding": "simple-macexpert"}


def base_encoding(subtype: str | None, named: str | None) -> str | None:
    """The named encoding if it is known, else what the subtype stands for."""
    return named if named in ENCODINGS else _DEFAULT.get(subtype)


def differences(entries: list) -> dict[int, str]:
    """Code -> glyph name; a number sets the position, a name takes it and moves on."""
    out, at = {}, 0
    for x in entries:
        if isinstance(x, str):
            out[at] = x
            at += 1
        else:
            at = int(x)
    return out


@dataclass
class Font:
    """A resolved font: codes and texts both ways, and what kept it from being resolved."""

    base_font: str
    kind: str
    bytes_per_code: int = 1
    to_text: dict[int, str] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    @functools.cached_property
    def to_code(self) -> dict[str, int]:
        """Single characters only; of several codes the least, or of a character map the one that stands first."""
        known = sorted(self.to_text.items()) if self.bytes_per_code == 1 else list(self.to_text.items())
        return {text: code for code, text in reversed(known) if len(text) == 1}

    @functools.cached_property
    def _texts(self) -> dict[int, str]:
        return {c: self.to_text.get(c, LOST) for c in range(256)}

    @functools.cached_property
    def _codes(self) -> dict[int, int]:
        return {ord(c): code for c, code in self.to_code.items()}

    @functools.cached_property
    def _codable(self) -> frozenset[str]:
        top = 0xFF if self.bytes_per_code == 1 else 0xFFFF
        return frozenset(c for c, code in self.to_code.items() if 0 <= code <= top)

    @property
    def encodable(self) -> bool:
        return bool(self.to_text)

    @property
    def is_subset(self) -> bool:
        return bool(SUBSET.match(self.base_font))

    @property
    def real_name(self) -> str:
        return SUBSET.sub("", self.base_font)

    def decode(self, raw: bytes) -> str:
        """Text of a string; without any table byte for byte, an odd last byte of two-byte codes is left out."""
        if not self.to_text:
            return raw.decode("latin-1")
        if self.bytes_per_code == 1:
            return raw.decode("latin-1").translate(self._texts)
        return "".join(self.to_text.get(raw[k] << 8 | raw[k + 1], LOST) for k in range(0, len(raw) - 1, 2))

    def missing(self, text: str) -> list[str]:
        """Characters without a code, in order of their first place."""
        if self._codable.issuperset(text):
            return []
        return [c for c in dict.fromkeys(text) if c not in self._codable]

    def encode(self, text: str) -> tuple[bytes | None, str | None]:
        """(bytes, None) or (None, why not)."""
        if not self.to_code:
            return None, f"encoding {self.kind} is not encodable"
        if lost := self.missing(text):
            return None, f"cannot encode {len(lost)} character(s) for {self.base_font}: {' '.join(lost)}"
        if self.bytes_per_code == 1:
            return text.translate(self._codes).encode("latin-1"), None
        return b"".join(self.to_code[c].to_bytes(2, "big") for c in text), None


def resolve(base_font: str = "", subtype: str = "", named: str | None = None, entries: list | None = None, to_unicode: str | bytes | None = None, parity: bool = False) -> Font:
    """A font from its dictionary: the encoding's or base encoding's name, differences, and a character map."""
    if subtype == "Type0":
        kind = {"Identity-H": "identity-h", "Identity-V": "identity-v", None: "unknown"}.get(named, "cmap")
        found = parse_cmap(to_unicode).to_text if to_unicode else {}
        return Font(base_font, kind, 2, found, [] if found else [f"no usable character map for {kind}"])
    base = base_encoding(subtype, named)
    table = dict(encoding(base, parity)) if base else {}
    for code, name in differences(entries or []).items():
        table.pop(code, None)
        if (c := character(name, parity)) is not None:
            table[code] = c
    return Font(base_font, _KINDS.get(base, "simple-custom"), 1, table)


# ---- character maps ----------------------------------------------------------------------------


@dataclass
class CMap:
    to_text: dict[int, str] = field(default_factory=dict)
    bytes_per_code: int = 2
    problems: list[str] = field(default_factory=list)


_CMAP_TOKEN = re.compile(r"%[^\r\n]*|\((?:\\.|[^\\()])*\)|<([0-9A-Fa-f\s]*)>|([\[\]])|([^\s<>\[\]%(]+)", re.DOTALL)
_SECTION = {"begincodespacerange": "endcodespacerange", "beginbfchar": "endbfchar", "beginbfrange": "endbfrange"}


def utf16(digits: str) -> str | None:
    """Text of hex digits in UTF-16, big end first; one byte is its character; odd lengths give None."""
    if not digits or len(digits) % 2 or len(digits) > 2 and len(digits) % 4:
        return None
    return chr(int(digits, 16)) if len(digits) == 2 else bytes.fromhex(digits).decode("utf-16-be", "surrogatepass")


def parse_cmap(source: str | bytes) -> CMap:
    """Codes of a character map's ``bfchar`` and ``bfrange`` sections, and its code width."""
    text = source.decode("latin-1") if isinstance(source, bytes) else source
    out, section, body, array = CMap(), None, [], None
    for m in _CMAP_TOKEN.finditer(text):
        digits, bracket, word = m.groups()
        if section is None:
            if word in _SECTION and re.search(rf"\b{_SECTION[word]}\b", text[m.end() :]):
                section, body, array = word, [], None
        elif word == _SECTION[section]:
            _SECTIONS[section](out, body)
            section = None
        elif bracket == "[":
            array = []
        elif bracket == "]":
            if array is not None:
                body.append(array)
            array = None
        elif digits is not None:
            (body if array is None else array).append("".join(digits.split()))
    return out


def _codespace(out: CMap, body: list) -> None:
    width = len(body[0]) // 2 if body and isinstance(body[0], str) else 0
    if width in (1, 2, 4):
        out.bytes_per_code = width


def _chars(out: CMap, body: list) -> None:
    plain = [x for x in body if isinstance(x, str)]
    for code, value in zip(plain[::2], plain[1::2]):
        if code and (text := utf16(value)) is not None:
            out.to_text[int(code, 16)] = text


def _ranges(out: CMap, body: list) -> None:
    k = 0
    while k + 2 < len(body):
        low, high, third = body[k : k + 3]
        if isinstance(low, list) or isinstance(high, list) or not low or not high:
            k += 1
            continue
        k += 3
        first, last = int(low, 16), int(high, 16)
        if last - first >= MAX_RANGE:
            out.problems.append(f"range of {last - first + 1} codes cut to {MAX_RANGE}")
            last = first + MAX_RANGE - 1
        if isinstance(third, list):
            values = [v for v in map(utf16, third) if v is not None]
            out.to_text |= {first + i: v for i, v in enumerate(values) if first + i <= last}
        elif base := utf16(third):
            end = ord(base[-1])
            out.to_text |= {c: base[:-1] + chr(min(end + c - first, 0x10FFFF)) for c in range(first, last + 1)}


_SECTIONS = {"begincodespacerange": _codespace, "beginbfchar": _chars, "beginbfrange": _ranges}

"""A small reader and writer of the document container: objects, page trees, streams, information.

The reader finds objects by their marks rather than by the cross-reference table, so it reads
damaged files too; streams are plain or deflated, and object streams are opened. Encrypted files
raise. The writer makes a file of pages with content streams and standard fonts.
"""

from __future__ import annotations

import functools
import re
import zlib
from dataclasses import dataclass, field

from . import engine

_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+\Z")
_MARK, _TRAILER = re.compile(rb"obj\b"), re.compile(rb"trailer\b")  # found by their first letters
_STREAM = re.compile(rb"\s*stream\r?\n?")


class Ref(int):
    """Number of another object."""


@dataclass
class Stream:
    info: dict
    raw: bytes

    def data(self) -> bytes:
        filters = self.info.get("Filter") or []
        out = self.raw
        for f in filters if isinstance(filters, list) else [filters]:
            if f != "FlateDecode":
                raise ValueError(f"filter {f} is not supported")
            out = zlib.decompressobj().decompress(out)
            parms = self.info.get("DecodeParms") or {}
            if isinstance(parms, dict) and parms.get("Predictor", 1) >= 10:
                out = _unpredicted(out, int(parms.get("Columns", 1)))
        return out


def _unpredicted(data: bytes, columns: int) -> bytes:
    above, out = bytearray(columns), bytearray()
    for at in range(0, len(data), columns + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + columns])
        for i in range(len(row)):
            left = row[i - 1] if i else 0
            add = {0: 0, 1: left, 2: above[i], 3: (left + above[i]) // 2}.get(kind, 0)
            row[i] = (row[i] + add) & 255
        out += row
        above = row
    return bytes(out)


def _value(tokens: list, at: int):
    """(value, next place) of the object whose first token stands at a place."""
    t = tokens[at]
    if t.kind == "dict-open":
        out, at = {}, at + 1
        while at < len(tokens) and tokens[at].kind != "dict-close":
            key = tokens[at].value
            out[key], at = _value(tokens, at + 1)
        return out, at + 1
    if t.kind == "array-open":
        out, at = [], at + 1
        while at < len(tokens) and tokens[at].kind != "array-close":
            v, at = _value(tokens, at)
            out.append(v)
        return out, at + 1
    if t.kind == "number":
        if at + 2 < len(tokens) and tokens[at + 1].kind == "number" and tokens[at + 2].value == "R":
            return Ref(int(t.value)), at + 3
        return t.value, at + 1
    if t.kind == "operator":
        return {"true": True, "false": False}.get(t.value), at + 1
    return t.value, at + 1


def _objects(data: bytes) -> list[tuple[int, int, int]]:
    """Numbers, starts and ends of all marks ``1 0 obj``."""
    out, last = [], 0
    for m in _MARK.finditer(data):
        size = 32
        while not (before := data[max(last, m.start() - size) : m.start()]).strip(b"0123456789 \t\n\r\x0b\x0c") and m.start() - size > last:
            size *= 2  # the numbers may begin further before
        if found := _OBJECT.search(before):
            out.append((int(found[1]), m.start() - len(found[0]), m.end()))
            last = m.end()
    return out


MOST_KEPT = 1000  # bytes


@functools.lru_cache(maxsize=1024)
def _kept(part: bytes):
    tokens = [t for t in engine.tokens(part) if t.kind != "comment"]
    return _value(tokens, 0)[0] if tokens else None


def _parsed(part: bytes):
    """The object that bytes say. Short ones, which files of one writer share, are kept and never changed by a reader."""
    return _kept(part) if len(part) <= MOST_KEPT else _kept.__wrapped__(part)


class Document:
    """Objects of one file."""

    def __init__(self, data: bytes) -> None:
        if not data.lstrip()[:5].startswith(b"%PDF"):
            raise ValueError("not a document of this format")
        self.objects: dict[int, object] = {}
        marks = _objects(data)
        for (number, _, at), (_, end, _) in zip(marks, [*marks[1:], (0, len(data), 0)]):
            self.objects[number] = self._read(data[at:end])
        for o in [o for o in self.objects.values() if isinstance(o, Stream) and o.info.get("Type") == "ObjStm"]:
            self._open(o)
        trailers = [self._dict(data[m.end() :]) for m in _TRAILER.finditer(data) if not re.match(rb"\w", data[max(0, m.start() - 1) : m.start()])]
        trailers += [o.info for o in self.objects.values() if isinstance(o, Stream) and o.info.get("Type") == "XRef"]
        self.trailer = {k: v for t in trailers for k, v in t.items()}
        if "Encrypt" in self.trailer:
            raise ValueError("the document is encrypted")

    def _dict(self, part: bytes) -> dict:
        part = part.split(b"startxref")[0]
        return _parsed(part) if part.lstrip(b"\0\t\n\f\r ").startswith(b"<<") else {}

    def _read(self, part: bytes):
        head, mark = part, re.search(rb">>\s*stream\r?\n", part)
        if mark:
            head = part[: mark.start() + 2]
        value = _parsed(head if mark else head.rsplit(b"endobj", 1)[0])
        if not mark or not isinstance(value, dict):
            return value
        end = part.rfind(b"endstream")
        raw = part[mark.end() : end if end >= 0 else len(part)]
        n = value.get("Length")
        return Stream(value, raw[: int(n)] if isinstance(n, float) and n <= len(raw) else raw.rstrip(b"\r\n"))

    def _open(self, stream: Stream) -> None:
        data, first, n = stream.data(), int(stream.info["First"]), int(stream.info["N"])
        numbers = [int(t.value) for t in engine.tokens(data[:first])]
        places = [*numbers[1 : 2 * n : 2], len(data) - first]
        for k in range(n):
            self.objects.setdefault(numbers[2 * k], self._read(data[first + places[k] : first + places[k + 1]]))

    def get(self, value):
        """What a reference stands for, followed to its end."""
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            value = self.objects.get(int(value))
        return None

    def text(self, value) -> str:
        raw = self.get(value)
        if not isinstance(raw, bytes):
            return ""
        return raw[2:].decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.decode("latin-1")

    def pages(self) -> list[dict]:
        """Dictionaries of the pages in order, with what they inherit."""
        root = self.get(self.trailer.get("Root")) or next((o for o in self.objects.values() if isinstance(o, dict) and o.get("Type") == "Catalog"), {})
        out: list[dict] = []

        def visit(node, inherited: dict, seen: frozenset) -> None:
            d = self.get(node)
            if not isinstance(d, dict) or node in seen:
                return
            held = inherited | {k: d[k] for k in ("Resources", "MediaBox", "Rotate") if k in d}
            if d.get("Type") == "Pages" or "Kids" in d:
                for kid in self.get(d.get("Kids")) or []:
                    visit(kid, held, seen | {node} if isinstance(node, Ref) else seen)
            else:
                out.append(held | d)

        visit(root.get("Pages"), {}, frozenset())
        return out

    def info(self) -> dict:
        d = self.get(self.trailer.get("Info")) or {}
        return {"page_count": len(self.pages()), **{k.lower(): self.text(d.get(k)) for k in ("Title", "Author", "Subject")}}

    def contents(self, page: dict) -> list[bytes]:
        """Decoded parts of a page's content."""
        found = self.get(page.get("Contents"))
        parts = found if isinstance(found, list) else [page.get("Contents")]
        return [s.data() for s in map(self.get, parts) if isinstance(s, Stream)]

    def size(self, page: dict) -> tuple[float, float, int]:
        box = [self.get(x) for x in self.get(page.get("MediaBox")) or (0, 0, 612, 792)]
        return box[2] - box[0], box[3] - box[1], int(self.get(page.get("Rotate")) or 0)

    def fonts(self, page: dict) -> list[dict]:
        """Font rows of a page: name, base_font, subtype, encoding, entries, to_unicode. A broken font is left out."""
        out = []
        for name, ref in (self.get((self.get(page.get("Resources")) or {}).get("Font")) or {}).items():
            d = self.get(ref)
            if not isinstance(d, dict):
                continue
            e, entries, cmap = self.get(d.get("Encoding")), [], self.get(d.get("ToUnicode"))
            if isinstance(e, dict):
                entries = [{"code": int(x), "glyph": None} if isinstance(x, float) else {"code": None, "glyph": x} for x in map(self.get, self.get(e.get("Differences")) or [])]
                e = self.get(e.get("BaseEncoding"))
            try:
                source = cmap.data().decode("latin-1") if isinstance(cmap, Stream) else None
            except (ValueError, zlib.error):
                continue
            out.append({"name": name, "base_font": self.get(d.get("BaseFont")) or "", "subtype": self.get(d.get("Subtype")) or "", "encoding": e, "entries": entries, "to_unicode": source})
        return out


@dataclass
class PageToWrite:
    contents: bytes
    width: float = 612.0
    height: float = 792.0
    rotation: int = 0
    images: dict[str, tuple[bytes, int, int]] = field(default_factory=dict)  # JPEG bytes, width, height


def write(pages: list[PageToWrite], info: dict[str, str] | None = None, standard: tuple[str, ...] = ("Helvetica",)) -> bytes:
    """A file of the pages, with standard fonts as F1, F2 and so on."""
    body: list[bytes] = []

    def add(x: bytes) -> int:
        body.append(x)
        return len(body)

    def stream(data: bytes, more: str = "") -> int:
        packed = zlib.compress(data) if not more else data
        kind = "/Filter /FlateDecode" if not more else more
        return add(f"<< /Length {len(packed)} {kind} >>\nstream\n".encode() + packed + b"\nendstream")

    add(b"")
    add(b"")
    held = " ".join(f"/F{k + 1} {add(f'<< /Type /Font /Subtype /Type1 /BaseFont /{name} /Encoding /WinAnsiEncoding >>'.encode())} 0 R" for k, name in enumerate(standard))
    kids = []
    for p in pages:
        pictures = " ".join(f"/{n} {stream(raw, f'/Type /XObject /Subtype /Image /Width {w} /Height {h} /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /DCTDecode')} 0 R" for n, (raw, w, h) in p.images.items())
        at = stream(p.contents)
        kids.append(add(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {p.width:g} {p.height:g}] /Rotate {p.rotation} /Contents {at} 0 R /Resources << /Font << {held} >> /XObject << {pictures} >> >> >>".encode()))
    said = b" ".join(f"/{k} ".encode() + engine.literal(b"\xfe\xff" + v.encode("utf-16-be")) for k, v in (info or {}).items())
    about = add(b"<< " + said + b" >>")
    body[0] = b"<< /Type /Catalog /Pages 2 0 R >>"
    body[1] = f"<< /Type /Pages /Count {len(kids)} /Kids [{' '.join(f'{k} 0 R' for k in kids)}] >>".encode()
    out, places = bytearray(b"%PDF-1.7\n"), []
    for k, x in enumerate(body):
        places.append(len(out))
        out += f"{k + 1} 0 obj\n".encode() + x + b"\nendobj\n"
    start = len(out)
    out += f"xref\n0 {len(body) + 1}\n0000000000 65535 f \n".encode() + b"".join(b"%010d 00000 n \n" % p for p in places)
    out += f"trailer\n<< /Size {len(body) + 1} /Root 1 0 R /Info {about} 0 R >>\nstartxref\n{start}\n%%EOF\n".encode()
    return bytes(out)


def draw(ops: list[dict], page_height: float = 792.0) -> bytes:
    """Content of drawing operations (rows of the draw operators) for a page written here."""
    out = [b"q"]
    for o in ops:
        v = {k: o.get(k) for k in ("x", "y", "x2", "y2", "w", "h", "size", "thickness", "rotate")}
        rgb = " ".join(f"{o.get(c) or 0:g}" for c in "rgb")
        if o["op"] == "text":
            raw = (o.get("text") or "").encode("cp1252", "replace")
            at = f"1 0 0 1 {v['x']:g} {v['y']:g} Tm"
            if v["rotate"]:
                import math

                c, s = math.cos(math.radians(v["rotate"])), math.sin(math.radians(v["rotate"]))
                at = f"{c:.6f} {s:.6f} {-s:.6f} {c:.6f} {v['x']:g} {v['y']:g} Tm"
            out.append(f"BT {rgb} rg /F1 {v['size'] or 12:g} Tf {at} ".encode() + engine.literal(raw) + b" Tj ET")
        elif o["op"] == "line":
            out.append(f"{rgb} RG {v['thickness'] or 1:g} w {v['x']:g} {v['y']:g} m {v['x2']:g} {v['y2']:g} l S".encode())
        elif o["op"] in ("fill", "box"):
            out.append(f"{rgb} rg {v['x']:g} {v['y']:g} {v['w']:g} {v['h']:g} re f".encode())
        elif o["op"] == "stroke":
            out.append(f"{rgb} RG {v['thickness'] or 1:g} w {v['x']:g} {v['y']:g} {v['w']:g} {v['h']:g} re S".encode())
        elif o["op"] == "ellipse":
            k, x, y, w, h = 0.5522847498, v["x"], v["y"], v["w"], v["h"]
            curves = [(x + w, y + k * h, x + k * w, y + h, x, y + h), (x - k * w, y + h, x - w, y + k * h, x - w, y), (x - w, y - k * h, x - k * w, y - h, x, y - h), (x + k * w, y - h, x + w, y - k * h, x + w, y)]
            out.append(f"{rgb} RG {v['thickness'] or 1:g} w {x + w:g} {y:g} m ".encode() + b" ".join(" ".join(f"{p:g}" for p in c).encode() + b" c" for c in curves) + b" S")
    return b"\n".join([*out, b"Q"])

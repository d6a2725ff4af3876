"""Content streams, fonts and editing of pages, against what the format's rules say."""

import random
import time

import pytest

from folioframe.content import container, engine, fonts, surgery

SPACE = b"\0\t\n\f\r "
SIGNS = b"()<>[]{}/% \n\\ABITDEj0.1#-+\x00\xff"


def read(data):
    problems = []
    return list(engine.tokens(data, problems)), [c for _, c in problems]


def test_random_bytes_are_covered_and_end():
    rng = random.Random(1)
    began = time.time()
    for _ in range(600):
        data = bytes(rng.choice(SIGNS) for _ in range(rng.randrange(80)))
        found, _ = read(data)
        assert engine.uncovered(data) == 0
        assert all(t.end > t.start for t in found)
        engine.Interpreter().run(data)
    assert time.time() - began < 20


@pytest.mark.parametrize("kind", ["number", "name", "string", "hexstring", "operator"])
def test_generated_tokens_read_back(kind):
    rng = random.Random(kind)
    for _ in range(100):
        if kind == "number":
            want = rng.randrange(-9999, 9999) / 2 ** rng.randrange(4)
            text = rng.choice(["", "+"]) + f"{want:.4f}" if want >= 0 else f"{want:.4f}"
        elif kind == "name":
            want = "".join(chr(rng.randrange(1, 256)) for _ in range(rng.randrange(1, 9)))
            text = "/" + "".join(c if c.isascii() and c.isalnum() else f"#{ord(c):02X}" for c in want)
        elif kind == "operator":
            want = text = rng.choice("abcdefgqQTBx") + rng.choice(["", "*", "j", "'"])
        else:
            want = rng.randbytes(rng.randrange(20))
            text = engine.serialize(want, kind == "hexstring").decode("latin-1")
        found, problems = read(b"  " + text.encode("latin-1") + b"\n")
        assert [(t.kind, t.value) for t in found] == [(kind, want)] and not problems


@pytest.mark.parametrize(
    "data, code",
    [(b"(open", "unterminated-string"), (b"<41", "unterminated-hexstring"), (b"/x#4", "invalid-name-escape"), (b"<4G>", "invalid-hex-pair"), (b"7 )", "unbalanced-paren"), (b"BI ID x", "unterminated-inline-image"), (b"]", "unknown-operator"), (b"[ 1", "unknown-operator"), (b"0 g 1 rg", "missing-operand"), (b"Do", "missing-operand"), (b"q Q Q", "graphics-state-underflow"), (b"1 2 Td", "text-op-outside-bt-et")],
)
def test_damage_is_noted(data, code):
    assert [c for _, c in engine.Interpreter().run(data).problems] == [code]


def test_strings_by_rule():
    assert read(rb"(p\(q\)\\ \r\t\b\f\n \7\07\007x\q)")[0][0].value == b"p(q)\\ \r\t\b\f\n \7\7\7xq"
    assert read(b"(a\\\r\nb\rc\r\nd(e(f)g))")[0][0].value == b"ab\nc\nd(e(f)g)"
    assert read(b"<4 1\n4>")[0][0].value == b"A@"


def test_inline_images_are_one_token():
    found, _ = read(b"q BI /W 1 /H 1 ID (raw ) EIx \xff\x00 EI Q")
    assert [t.kind for t in found] == ["operator", "inline-image", "operator"]


def show(run):
    return run.text, round(run.x, 6), round(run.y, 6)


def test_text_state():
    page = engine.Interpreter().run(b"""
        q 2 0 0 3 10 20 cm BT /A 9 Tf 1 Tc 2 Tw 80 Tz 12 TL 1 Tr 3 Ts 5 7 Td (one) Tj T* (two) ' 4 6 (three) " 1 2 TD (four) Tj 1 0 0 1 50 60 Tm [(fi) -20 <7665> 3] TJ ET Q
        BT (bare) Tj ET""")
    assert [show(r) for r in page.runs] == [("one", 20, 41), ("two", 20, 41 - 72), ("three", 20, 41 - 108), ("four", 22, 41 - 102), ("five", 110, 200), ("bare", 0, 0)]
    one, three, four, five, bare = (page.runs[k] for k in (0, 2, 3, 4, 5))
    s = one.state
    assert (s.font, s.size, s.char_spacing, s.word_spacing, s.scale, s.leading, s.mode, s.rise) == ("A", 9, 1, 2, 80, 12, 1, 3)
    assert (three.state.word_spacing, three.state.char_spacing, four.state.leading) == (4, 6, -2)
    assert five.kerns == [-20, 3] and [h for *_, h in five.operands] == [False, True]
    assert bare.state == engine.TextState()


def test_colours_and_events():
    page = engine.Interpreter().run(b"0.5 g 0 1 0 RG q 0.1 0.2 0.3 0.5 k BT (a) Tj ET Q 1 0 0 rg 0 0 0 1 K BT (b) Tj ET /P cs 3 scn /Im Do 1 w [1 [2] 3] 0 d")
    a, b = page.runs
    assert a.fill == pytest.approx((0.45, 0.4, 0.35)) and a.stroke == (0, 1, 0)
    assert b.fill == (1, 0, 0) and b.stroke == (0, 0, 0)
    assert [(e.kind, e.value) for e in page.events if e.kind != "text-run"] == [("unsupported-op", "cs"), ("unsupported-op", "scn"), ("do-xobject", "Im"), ("unsupported-op", "w"), ("unsupported-op", "d")]


def test_dictionaries_are_opaque():
    page = engine.Interpreter().run(b"BT << /W 7 /K << /N [1 2] >> >> 5 6 Td (x) Tj ET /Span << /M 3 >> BDC")
    assert show(page.runs[0]) == ("x", 5, 6) and page.problems == []


def test_matrices():
    m, k = (2, 1, 0, 3, 5, 7), (1, 4, 2, 0, 3, 1)
    x, y = engine.transformed(m, 1, 1)
    assert engine.transformed(engine.multiply(m, k), 1, 1) == engine.transformed(k, x, y)
    assert engine.nearly_equal(engine.multiply(m, engine.UNIT), m) and not engine.nearly_equal(m, k)


def test_serialised_forms():
    every = bytes(range(256))
    for as_hex in (True, False, None):
        assert read(engine.serialize(every, as_hex))[0][0].value == every
    assert engine.serialize(b"ab", None) == b"(ab)" and engine.serialize(b"\x80\x81", None) == b"<8081>"
    assert engine.literal(b"\n(\x7f\\") == rb"(\n\(\177\\)"


def test_splice_and_its_length():
    rng = random.Random(3)
    for _ in range(50):
        texts = [rng.randbytes(rng.randrange(6)) for _ in range(5)]
        data = b" ".join(b"BT " + engine.serialize(t, rng.random() < 0.5) + b" Tj ET" for t in texts)
        strings = [t for t in engine.tokens(data) if t.kind in ("string", "hexstring")]
        new = {k: rng.randbytes(3) for k in rng.sample(range(5), 3)}
        changes = [(strings[k].start, strings[k].end, strings[k].kind == "hexstring", v) for k, v in new.items()]
        out = engine.splice(data, changes)
        assert len(out) == engine.spliced_length(data, changes)
        again = [t for t in engine.tokens(out) if t.kind in ("string", "hexstring")]
        assert [t.value for t in again] == [new.get(k, t) for k, t in enumerate(texts)]
        assert [t.kind for t in again] == [t.kind for t in strings]
    for bad in ([(0, 4, False, b""), (3, 5, False, b"")], [(0, len(data) + 1, False, b"")], [(4, 4, False, b"")], [(-1, 2, False, b"")]):
        with pytest.raises(ValueError):
            engine.splice(data, bad)
    assert engine.joined([b"a", b"b"]) == b"a b" and engine.joined([]) is None


# ---- fonts -------------------------------------------------------------------------------------


def test_encodings_by_their_codecs():
    win = fonts.encoding("WinAnsiEncoding")
    assert all(win[c] == bytes([c]).decode("cp1252") for c in win if c not in (0xA0, 0xAD))
    assert (win[0xA0], win[0xAD]) == (" ", "-") and 0x81 not in win
    mac = fonts.encoding("MacRomanEncoding")
    assert all(mac[c] == bytes([c]).decode("mac_roman") for c in mac if c not in (0xBD, 0xCA, 0xDB))
    assert len(fonts.encoding("StandardEncoding")) == 95 + 51 and len(fonts.encoding("MacExpertEncoding")) == 95
    assert len(fonts.encoding("StandardEncoding", True)) == 95 + 46


def test_glyph_names():
    for name, want in {"eacute": "é", "Scaron": "Š", "zero": "0", "Euro": "€", "uni0416": "Ж", "u1F600": "😀", "fi": "ﬁ", "Aogonek": "Ą"}.items():
        assert fonts.character(name) == want
    assert fonts.character("uni04") is None and fonts.character("") is None and fonts.character("radical", True) is None
    assert fonts.character("u110000") is None and fonts.glyph_name("é") == "eacute" and fonts.glyph_name("ж") is None


def test_fonts_resolve():
    for subtype, named, kind in [("TrueType", None, "simple-winansi"), ("Type1", None, "simple-standard"), ("MMType1", "Custom", "simple-standard"), ("Type1", "MacRomanEncoding", "simple-macroman"), ("Type3", None, "simple-custom"), ("Type0", "Identity-V", "identity-v"), ("Type0", "Some-CMap", "cmap"), ("Type0", None, "unknown")]:
        f = fonts.resolve("Any", subtype, named)
        assert f.kind == kind and f.encodable == (kind.startswith("simple") and subtype != "Type3")
    f = fonts.resolve("QWERTY+Real", "Type3", None, ["a", 200, "eacute", "nosuch", "Omega"])
    assert f.to_text == {0: "a", 200: "é", 202: "Ω"} and f.is_subset and f.real_name == "Real"
    over = fonts.resolve("X", "TrueType", "WinAnsiEncoding", [65, "nosuch", "A"])
    assert 65 not in over.to_text and over.to_code["A"] == 66 and over.to_text[0xE9] == "é"


def test_simple_encoding_and_missing():
    f = fonts.resolve("X", "Type1", "WinAnsiEncoding")
    text = "".join(f.to_text.values())
    assert f.decode(f.encode(text)[0]) == text
    raw, why = f.encode("aЖbΩЖ")
    assert raw is None and why.startswith("cannot encode 2") and f.missing("aЖbΩЖ") == ["Ж", "Ω"]
    assert f.encode(" ")[0] is None and f.to_code[" "] == 32
    assert fonts.resolve("X", "Type3").encode("a") == (None, "encoding simple-custom is not encodable")
    assert fonts.resolve("X", "Type3").decode(b"\xe9") == "é"


def test_two_byte_encoding():
    f = fonts.resolve("X", "Type0", "Identity-H", to_unicode="beginbfchar <0102> <0041> <0304> <00660069> <FFFF> <0042> endbfchar beginbfchar <0005> <0041> endbfchar")
    assert f.encode("AB") == (b"\1\2\xff\xff", None) and f.decode(b"\1\2\3\4\x09") == "Afi"
    assert f.missing("fiA") == ["f", "i"] and f.decode(b"\x7f\x7f") == fonts.LOST
    assert fonts.resolve("X", "Type0", "Identity-H").warnings


@pytest.mark.parametrize(
    "body, want",
    [
        ("beginbfrange <20> <22> <0041> endbfrange", {32: "A", 33: "B", 34: "C"}),
        ("beginbfrange <0001> <0003> [<0041> <00420043>] endbfrange", {1: "A", 2: "BC"}),
        ("beginbfrange <0009> <0001> <0041> <0002> <0002> <D83DDE00> endbfrange", {2: "😀"}),
        ("beginbfchar <01> <41> <02> <414> <> <0041> <03> <0042> endbfchar", {1: "A", 3: "B"}),
        ("% beginbfchar <01> <0041> endbfchar\n(beginbfchar \\) ) beginbfchar <0 2> <00 42> endbfchar", {2: "B"}),
        ("beginbfchar <01> <0041>", {}),
        ("", {}),
    ],
)
def test_character_maps(body, want):
    assert fonts.parse_cmap(body).to_text == want


def test_map_widths_and_huge_ranges():
    for digits, n in (("00", 1), ("0000", 2), ("00000000", 4), ("000000", 2)):
        assert fonts.parse_cmap(f"begincodespacerange <{digits}> <{digits.replace('0', 'F')}> endcodespacerange").bytes_per_code == n
    huge = fonts.parse_cmap("beginbfrange <00000000> <FFFFFFFF> <0000> endbfrange")
    assert len(huge.to_text) == fonts.MAX_RANGE and huge.problems
    assert fonts.parse_cmap(b"beginbfchar <01> <0041> endbfchar").to_text == {1: "A"}


# ---- locating and editing ----------------------------------------------------------------------

TABLE = {"F": fonts.resolve("Plain", "Type1", "WinAnsiEncoding"), "G": fonts.resolve("Bold", "Type1", "WinAnsiEncoding"), "W": fonts.resolve("Wide", "Type0", "Identity-H", to_unicode="beginbfrange <0020> <007E> <0020> endbfrange")}


def box(x, baseline, size=12.0, w=200.0):
    return surgery.Box(x, 792 - baseline - 0.75 * size, w, 1.1 * size)


def stream(*lines):
    return b"\n".join(b"BT /%s 12 Tf 1 0 0 1 %d %d Tm " % (f, x, y) + s + b" ET" for f, x, y, s in lines)


def runs(data):
    return engine.Interpreter(surgery.decoder(TABLE)).run(data).runs


def test_edit_distance_against_the_table():
    rng = random.Random(5)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            above, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        return row[-1]

    for _ in range(300):
        a, b = ("".join(rng.choice("abé") for _ in range(rng.randrange(12))) for _ in range(2))
        assert surgery.distance(a, b) == plain(a, b)


def test_cascade():
    page = runs(stream((b"F", 72, 700, b"(Same text) Tj"), (b"F", 72, 600, b"(Same  text) Tj"), (b"F", 72, 500, b"(Sa) Tj (me) Tj ( ) Tj (words here) Tj"), (b"F", 72, 400, b"(Quite another line of text) Tj")))
    cases = [
        ("Same text", box(72, 700), [0], 1.0), (" Same text ", box(72, 600), [1], 1.0), ("Same words here", box(72, 500), [2, 3, 4, 5], 0.95),
        ("Quite another line of texts", box(72, 400), [6], 1 - 1 / 27), ("Same text", box(3000, 40), [0], 0.85), ("Same words here", None, [2, 3, 4, 5], 0.8),
        ("Quite another line of texts", None, [6], 0.85 - 1 / 27), ("", box(72, 700), [], 0.0), ("Nothing like it at all", box(72, 700), [], 0.0),
    ]
    for text, where, want, sure in cases:
        f = surgery.locate(page, text, where)
        assert (f.runs, f.confidence) == (want, pytest.approx(sure)), text


def test_box_limits_are_inclusive():
    page = runs(stream((b"F", 100, 700, b"(x) Tj")))
    b = surgery.Box(118, 792 - 700 + 7.2, 10, 0)
    assert surgery.near(page[0], b, 12) and not surgery.near(page[0], surgery.Box(118.1, b.y, 10, 0), 12)
    assert not surgery.near(page[0], surgery.Box(118, b.y + 0.1, 10, 0), 12) and surgery.tolerances(1) == (8, 4)


def apply(data, *wanted, table=TABLE):
    new, out = surgery.edit_page(data, [surgery.Edit(*w) for w in wanted], table)
    return new, [o.status for o in out]


def test_every_operator_is_edited():
    data = stream((b"F", 72, 700, b"(old) Tj"), (b"F", 72, 680, b"[(o) -5 <6C> 3 (d)] TJ"), (b"F", 72, 660, b"<6F6C64> Tj"), (b"W", 72, 640, b"<006F006C0064> Tj"), (b"F", 72, 620, b"0 TL (old) '"))
    new, out = apply(data, *[("old", "new", box(72, y)) for y in (700, 680, 660, 640, 620)])
    assert out == [surgery.APPLIED] * 5
    assert [r.text for r in runs(new)] == ["new"] * 5
    assert b"[(new) -5 <> 3 ()] TJ" in new and b"<6E6577> Tj" in new and b"<006E00650077> Tj" in new


def test_groups_of_runs():
    data = stream((b"F", 72, 700, b"( ) Tj (ab) Tj (cd) Tj"))
    for text, want in (("wxyz", [" ", "wx", "yz"]), ("longer", [" ", "longer", ""]), (" led", [" ", " l", "ed"])):
        new, out = apply(data, ("abcd", text, box(72, 700)))
        assert out == [surgery.APPLIED] and [r.text for r in runs(new)] == want
    mixed = b"BT /F 12 Tf 1 0 0 1 72 700 Tm (ab) Tj /G 12 Tf (cd) Tj ET"
    assert apply(mixed, ("abcd", "x", box(72, 700)))[1] == [surgery.FALLBACK]
    assert apply(b"BT /F 12 Tf 1 0 0 1 72 700 Tm (ab) Tj [(cd)] TJ ET", ("abcd", "x", box(72, 700)))[1] == [surgery.FALLBACK]


def test_refusals():
    data = stream((b"F", 72, 700, b"(text) Tj"), (b"Z", 72, 600, b"(other) Tj"))
    where = box(72, 700)
    assert apply(data, ("text", "Ж", where))[1] == [surgery.MISSING]
    assert apply(data, ("other", "new", box(72, 600)))[1] == [surgery.NOT_SIMPLE]
    assert apply(data, ("absent", "new", where))[1] == [surgery.UNSURE] and apply(data, ("text", "new", None))[1] == [surgery.UNSURE]
    assert apply(None, ("text", "new", where)) == (None, [surgery.NO_STREAM])
    new, out = apply(data, ("text", "one", where), ("text", "two", where))
    assert out == [surgery.APPLIED, surgery.FALLBACK] and b"(one)" in new
    inside = engine.Interpreter(in_xobject=True).run(data).runs
    assert surgery.locate(inside, "text", where).runs == []


# ---- files -------------------------------------------------------------------------------------


def test_files_read_back():
    pages = [container.PageToWrite(b"BT /F1 12 Tf (one) Tj ET", 300, 400, 90), container.PageToWrite(b"BT (two) Tj ET")]
    d = container.Document(container.write(pages, {"Title": "Ein Titel – ж", "Author": "A (b)"}))
    assert d.info() == {"page_count": 2, "title": "Ein Titel – ж", "author": "A (b)", "subject": ""}
    first, second = d.pages()
    assert d.size(first) == (300, 400, 90) and d.contents(first) == [pages[0].contents] and d.size(second) == (612, 792, 0)
    assert d.fonts(first) == [{"name": "F1", "base_font": "Helvetica", "subtype": "Type1", "encoding": "WinAnsiEncoding", "entries": [], "to_unicode": None}]


def test_other_shapes_of_files():
    import zlib

    data = (
        b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 3 0 R >> endobj 3 0 obj << /Kids [4 0 R 5 0 R 3 0 R] /MediaBox [0 0 100 200] /Resources << /Font << /A 8 0 R /B 99 0 R >> >> >> endobj "
        b"4 0 obj << /Type /Page /Contents [6 0 R 7 0 R] >> endobj 5 0 obj << /Type /Page /Rotate 90 >> endobj 6 0 obj << /Length 1 >> stream\na\nendstream endobj 7 0 obj << /Filter /FlateDecode >> stream\n"
        + zlib.compress(b"b") + b"\nendstream endobj 8 0 obj << /BaseFont /ABCDEF+X /Subtype /Type1 /Encoding << /Differences [65 /a /b] >> >> endobj trailer << /Root 1 0 R >>"
    )
    d = container.Document(data)
    one, two = d.pages()
    assert engine.joined(d.contents(one)) == b"a b" and d.contents(two) == [] and d.size(two) == (100, 200, 90)
    assert [f["entries"] for f in d.fonts(one)] == [[{"code": 65, "glyph": None}, {"code": None, "glyph": "a"}, {"code": None, "glyph": "b"}]]
    for bad in (b"", b"plain", b"%PDF-1 trailer << /Encrypt 1 0 R >>"):
        with pytest.raises(ValueError):
            container.Document(bad)

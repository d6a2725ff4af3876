"""Column functions of the document operators, all built from Spark's own expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(s: Column) -> Column:
    """Runs of (any) white space as one space, trimmed; case and punctuation stay."""
    return F.trim(F.regexp_replace(s, r"(?U)\s{2,}|[^\S ]", " "))  # single spaces stay as they are, so most texts are only read


def truncate(s: Column, n: int, keep_all: bool = False) -> Column:
    """At most ``n`` characters, the last of a cut text an ellipsis; ``keep_all`` puts it after the n-th."""
    return F.when(F.length(s) > n, F.concat(F.left(s, F.lit(n if keep_all else n - 1)), F.lit("…"))).otherwise(s)


def escape_regexp(text: str) -> str:
    """The pattern that matches the text itself."""
    return re.sub(r"[.*+?^${}()|\[\]\\]", r"\\\g<0>", text)


def matches(s: Column, pattern: str) -> Column:
    """Array of (start, text) of a regular expression's non-empty matches, ignoring case.

    The pattern runs as it is, so its own groups and references keep their numbers. Starts are
    running sums of lengths, folded once over the parts beside the matches.
    """
    flagged = f"(?iu){pattern}"
    parts, found = F.split(s, flagged, -1), F.regexp_extract_all(s, F.lit(flagged), F.lit(0))
    sizes = F.transform(found, lambda m, i: F.struct(F.length(F.get(parts, i)).alias("before"), m.alias("text")))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    folded = F.aggregate(sizes, state, lambda a, x: F.struct((a["at"] + x["before"] + F.length(x["text"])).alias("at"), F.array_append(a["starts"], a["at"] + x["before"]).alias("starts")))
    hits = F.zip_with(folded["starts"], found, lambda a, m: F.struct(a.alias("start"), m.alias("text")))
    return F.filter(hits, lambda m: F.length(m["text"]) > 0)


def snippet(s: Column, start: Column, size: Column, around: int = 40) -> Column:
    """What stands around a match, with an ellipsis where it was cut."""
    low, high = F.greatest(start - around, F.lit(0)), F.least(start + size + around, F.length(s))
    body = F.trim(F.regexp_replace(F.substring(s, low + 1, high - low), r"(?U)\s+", " "))
    return F.concat(F.when(low > 0, "…").otherwise(""), body, F.when(high < F.length(s), "…").otherwise(""))


def hex_to_rgb(c: Column) -> list[Column]:
    """r, g, b in 0..1 of ``#rrggbb``; anything else is black."""
    ok = c.rlike("^#[0-9a-fA-F]{6}$")
    return [F.when(ok, F.conv(F.substring(c, at, 2), 16, 10).cast("double") / 255).otherwise(0.0) for at in (2, 4, 6)]


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    byte = lambda v: F.lpad(F.lower(F.hex(F.round(v * 255).cast("long"))), 2, "0")
    return F.concat(F.lit("#"), byte(r), byte(g), byte(b))


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> list[Column]:
    return [(1 - v) * (1 - k) for v in (c, m, y)]


def packed_rgb(n: Column) -> list[Column]:
    """r, g, b in 0..1 of a number 0xRRGGBB."""
    return [F.shiftright(n, by).bitwiseAND(255) / 255.0 for by in (16, 8, 0)]


def chosen_colour(line: Column, span: Column, char: Column) -> Column:
    """``#rrggbb`` of a line's number, else its first span's, else its first character's; 0 and null fall through to black."""
    n = F.coalesce(F.nullif(line, F.lit(0)), F.nullif(span, F.lit(0)), F.nullif(char, F.lit(0)), F.lit(0))
    return rgb_to_hex(*packed_rgb(n))


def with_font_defaults(name: Column, family: Column, weight: Column, style: Column, size: Column) -> list[Column]:
    """What a line's font is where the extractor does not say."""
    given = ((name, "Helvetica", "name"), (family, "sans-serif", "family"), (weight, "normal", "weight"), (style, "normal", "style"), (size, 12.0, "size"))
    return [F.coalesce(c, F.lit(d)).alias(n) for c, d, n in given]


# Parts of font names that tell their class.
_MONO = "mono|courier|consolas|menlo|inconsolata"
_SERIF = "times|roman|georgia|garamond|palatino|cambria|caslon|baskerville|charter|minion"
_SANS = "helvetica|arial|verdana|tahoma|calibri|segoe|trebuchet|lato|roboto|ubuntu"


def standard_font(family: Column, weight: Column, style: Column, name: Column) -> Column:
    """The one of twelve standard fonts that is nearest: fixed pitch, else serif unless plainly sans, else sans."""
    family, name = (F.lower(F.coalesce(c, F.lit(""))) for c in (family, name))
    weight, style = F.coalesce(weight, F.lit("")), F.coalesce(style, F.lit(""))
    bold = (weight == "bold") | name.rlike("bold|black|heavy") | weight.rlike(r"^[6789]\d{2}$")
    slant = style.isin("italic", "oblique") | name.rlike("italic|oblique")
    mono = name.rlike(_MONO) | family.rlike("mono|courier")
    serif = (name.rlike(_SERIF) | family.rlike("(^|[^a-z])serif([^a-z]|$)")) & ~(name.rlike(_SANS) | family.contains("sans"))
    cut = lambda plain, b, i, both: F.when(bold & slant, both).when(bold, b).when(slant, i).otherwise(plain)
    return (
        F.when(mono, cut("Courier", "Courier-Bold", "Courier-Oblique", "Courier-BoldOblique"))
        .when(serif, cut("Times-Roman", "Times-Bold", "Times-Italic", "Times-BoldItalic"))
        .otherwise(cut("Helvetica", "Helvetica-Bold", "Helvetica-Oblique", "Helvetica-BoldOblique"))
    )


def file_size(n: Column) -> Column:
    """Bytes in units of 1024 with at most two decimals; beyond GB it stays in GB."""
    unit = F.when(n < 1, 0).otherwise(F.least(F.floor(F.log(n.cast("double")) / F.log(F.lit(1024.0)) + 1e-12), F.lit(3)))
    value = F.round(n / F.pow(F.lit(1024.0), unit), 2)
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", value), r"0+$", ""), r"\.$", "")
    return F.when(n == 0, "0 Bytes").otherwise(F.concat(text, F.lit(" "), F.element_at(F.array(*map(F.lit, ("Bytes", "KB", "MB", "GB"))), (unit + 1).cast("int"))))


def relative_time(at: Column, now: Column) -> Column:
    """How long before or after ``now`` a moment is, in words."""
    return relative_words((F.unix_micros(at.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / 1000)


def relative_words(ms: Column) -> Column:
    """A distance in milliseconds (negative: before), parts of one included, in words: seconds below a minute, then minutes, hours, days."""
    away = F.floor(F.abs(ms) / 1000 + 0.5)
    minutes, hours = F.floor(away / 60 + 0.5), F.floor(F.floor(away / 60 + 0.5) / 60 + 0.5)
    # halves round up, towards later
    count = lambda unit: F.floor(ms / unit + 0.5).cast("long")
    said = lambda n, unit: F.when(n < 0, F.concat(-n, F.lit(f" {unit}"), F.when(n == -1, "").otherwise("s"), F.lit(" ago"))).otherwise(F.concat(F.lit("in "), n, F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s")))
    s, m, h, d = count(1000), count(60_000), count(3_600_000), count(86_400_000)
    day = F.when(d == 0, "today").when(d == -1, "yesterday").when(d == 1, "tomorrow").otherwise(said(d, "day"))
    return F.when(away < 60, F.when(s == 0, "now").otherwise(said(s, "second"))).when(minutes < 60, F.when(m == 0, "this minute").otherwise(said(m, "minute"))).when(hours < 24, F.when(h == 0, "this hour").otherwise(said(h, "hour"))).otherwise(day)


def page_ranges(spec: Column, last: int) -> Column:
    """'1-3, 5' as sorted distinct pages within 1..last; reversed ranges, junk and numbers out of range give nothing."""
    none = F.array().cast("array<int>")

    def number(digits: Column) -> Column:  # beyond nine digits it lies past any page
        return F.when(F.length(F.regexp_replace(digits, "^0+", "")) > 9, 999_999_999).otherwise(digits.try_cast("int"))

    def one(part: Column) -> Column:
        ends = F.split(part, "-")
        two = part.rlike(r"^\s*\d+\s*-\s*\d+\s*$")
        low, high = F.greatest(number(F.trim(F.get(ends, F.lit(0)))), F.lit(1)), F.least(number(F.trim(F.get(ends, F.lit(1)))), F.lit(last))
        single = F.when(part.rlike(r"^\s*\d+\s*$"), number(F.trim(part)))
        return F.when(two & (low <= high), F.sequence(low, F.greatest(high, low))).when(single.between(1, last), F.array(single)).otherwise(none)

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(spec, ","), one))))


def sidecar_path(path: Column, ending: str) -> Column:
    """Path of a document's companion file, such as ``.ocr.json``."""
    return F.regexp_replace(path, r"(?i)\.pdf$", ending)


def image_size(width: Column, height: Column, shown: float = 200.0) -> list[Column]:
    """Width and height at which an image is put in, its shape kept."""
    return [F.lit(shown).alias("w"), F.floor(F.lit(shown) / (width / height) + 0.5).cast("double").alias("h")]


def font_size(transform: Column) -> Column:
    """Size of text whose matrix is the array a..f."""
    c, d = F.get(transform, F.lit(2)), F.get(transform, F.lit(3))
    return F.sqrt(c * c + d * d)


def item_box(text: Column, transform: Column, width: Column, height: Column, page_height: float) -> Column:
    """Box of a text item, y from the top; without a width half the size a character, without a height the size."""
    size = font_size(transform)
    h = F.coalesce(F.nullif(height, F.lit(0.0)), size)
    w = F.coalesce(F.nullif(width, F.lit(0.0)), F.length(text) * size * 0.5)
    return F.struct(F.get(transform, F.lit(4)).alias("x"), (page_height - F.get(transform, F.lit(5)) - h).alias("y"), w.alias("w"), h.alias("h"))


def matrix_multiply(a: Column, b: Column) -> Column:
    """Product of two matrices a..f as arrays, ``a`` applied first."""
    x, y = (lambda k: F.get(a, F.lit(k))), (lambda k: F.get(b, F.lit(k)))
    row = lambda i: [x(i) * y(0) + x(i + 1) * y(2), x(i) * y(1) + x(i + 1) * y(3)]
    e, f = row(4)
    return F.array(*row(0), *row(2), e + y(4), f + y(5))


def matrix_apply(m: Column, x: Column, y: Column) -> Column:
    k = lambda i: F.get(m, F.lit(i))
    return F.struct((k(0) * x + k(2) * y + k(4)).alias("x"), (k(1) * x + k(3) * y + k(5)).alias("y"))


def utf16_text(digits: Column) -> Column:
    """Text of hex digits in UTF-16, big end first; one byte is its character; odd lengths give null."""
    n = F.length(digits)
    return F.when(n == 2, F.decode(F.unhex(digits), "ISO-8859-1")).when((n > 0) & (n % 4 == 0), F.decode(F.unhex(digits), "UTF-16BE"))


def hex_number(digits: Column) -> Column:
    return F.when(F.length(digits) > 0, F.conv(digits, 16, 10).cast("long"))

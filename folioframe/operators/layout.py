"""Laying text out on pages: greedy wrapping by measured width and page breaks."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._arrow import map_rows

WIDTH, HEIGHT, MARGIN, SIZE, LEADING = 595.0, 842.0, 50.0, 11.0, 1.4

# Widths of Helvetica's ASCII characters from the space on, in thousandths of the size.
_HELVETICA = [
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
]


def width(text: str, size: float, fixed: float | None = None) -> float:
    """Width in Helvetica without kerning (an accented letter is as wide as its base), or at ``fixed`` thousandths a character."""
    if fixed is not None:
        return len(text) * fixed * size / 1000
    total = 0
    for c in text:
        base = unicodedata.normalize("NFD", c)[0]
        total += _HELVETICA[ord(base) - 32] if " " <= base <= "~" else 556
    return total * size / 1000


def wrap(text: str, size: float, most: float, fixed: float | None = None) -> list[str]:
    """Lines no wider than ``most``, broken at spaces; a single wider word stays whole."""
    out = []
    for line in text.split("\n"):
        held, wide, space = [], 0.0, width(" ", size, fixed)
        for word in line.split(" "):
            w = width(word, size, fixed)
            current = " ".join(held)
            if current and wide + space + w > most:
                out.append(current)
                held, wide = [word], w
            elif current:
                held.append(word)
                wide += space + w
            else:
                held, wide = [word], w
        out.append(" ".join(held))
    return out


def wrapped(texts: DataFrame, size: float = SIZE, most: float = WIDTH - 2 * MARGIN, fixed: float | None = None) -> DataFrame:
    """Lines (doc_id, ord, line) of texts (doc_id, text)."""
    return map_rows(texts.select("doc_id", "text"), lambda doc, text: [(doc, k, line) for k, line in enumerate(wrap(text or "", size, most, fixed))], "doc_id long, ord long, line string")


def lines_per_page(height: float = HEIGHT, margin: float = MARGIN, size: float = SIZE) -> int:
    """Lines from the top margin down to the last that does not lie below the bottom one."""
    return int((height - 2 * margin) // (size * LEADING)) + 1


def placed(lines: DataFrame, height: float = HEIGHT, margin: float = MARGIN, size: float = SIZE) -> DataFrame:
    """Page and baseline of every line (doc_id, ord, line)."""
    n = lines_per_page(height, margin, size)
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1
    row = F.pmod(at, F.lit(n))
    return lines.select("doc_id", "ord", "line", (F.floor(at / n) + 1).cast("long").alias("page_number"), F.lit(margin).alias("x"), (height - margin - row * (size * LEADING)).alias("y"))

"""Overlays and annotations as drawing operations, ordered within a page; the page's y axis points up.

An operation is one row: ``op`` is fill, stroke, ellipse, line, box, text or image; a line runs
from (x, y) to (x2, y2). Operations of a page are ordered by layer (text, images, annotations),
then ``ord``, then ``part``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import hex_to_rgb

PAGE_HEIGHT = 792.0
ARROW_HEAD, ARROW_ANGLE = 10.0, 30.0
COLUMNS = ["part", "op", "x", "y", "x2", "y2", "w", "h", "text", "size", "opacity", "thickness", "rotate", "r", "g", "b"]
TEXT, IMAGE, ANNOTATION = 0, 1, 2
DRAWN = ("highlight", "rectangle", "circle", "underline", "strikethrough", "line", "arrow", "freehand", "note", "stamp")


def _op(part: int | Column, op: str, **given) -> Column:
    kinds = {"text": "string", "op": "string"}
    values = {"part": part, "op": op, "opacity": 1.0} | given
    out = []
    for name in COLUMNS:
        v = values.get(name)
        c = v if isinstance(v, Column) else F.lit(v)
        out.append(c.cast("int" if name == "part" else kinds.get(name, "double")).alias(name))
    return F.struct(*out)


def _line(part: int | Column, x: Column, y: Column, x2: Column, y2: Column) -> Column:
    return _op(part, "line", x=x, y=y, x2=x2, y2=y2, thickness=2.0)


def _ops(page_height: float) -> Column:
    """Array of operations of an annotation row with type, x, y, w, h, end_x, end_y, points, text, stamp."""
    x, y, w, h = (F.col(c) for c in "xywh")
    top, bottom, middle = page_height - y, page_height - y - h, page_height - y - h / 2
    end_x, end_y = F.coalesce("end_x", x + w), page_height - F.coalesce("end_y", y + h)
    angle = F.atan2(end_y - top, end_x - x)
    head = lambda part, by: _line(part, end_x, end_y, end_x - ARROW_HEAD * F.cos(angle + by), end_y - ARROW_HEAD * F.sin(angle + by))
    spread = F.radians(F.lit(ARROW_ANGLE))
    points = F.coalesce("points", F.array().cast("array<struct<x:double,y:double>>"))
    segments = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.transform(F.slice(points, 2, F.greatest(F.size(points), F.lit(1))), lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda a, b: _line(b["i"], a["x"], page_height - a["y"], b["p"]["x"], page_height - b["p"]["y"]))
    label = F.upper(F.coalesce("stamp", F.lit("stamp")))
    box = lambda part, op, **more: _op(part, op, x=x, y=bottom, w=w, h=h, **more)
    note = F.array(box(0, "box", opacity=0.9, thickness=1.0, r=0.99, g=0.82, b=0.30))
    kinds = {
        "highlight": F.array(box(0, "fill", opacity=0.3)),
        "rectangle": F.array(box(0, "stroke", thickness=2.0)),
        "circle": F.array(_op(0, "ellipse", x=x + w / 2, y=middle, w=w / 2, h=h / 2, thickness=2.0)),
        "underline": F.array(_line(0, x, bottom, x + w, bottom)),
        "strikethrough": F.array(_line(0, x, middle, x + w, middle)),
        "line": F.array(_line(0, x, top, x + w, bottom)),
        "arrow": F.array(_line(0, x, top, end_x, end_y), head(1, -spread), head(2, spread)),
        "freehand": segments,
        "note": F.when(F.coalesce("text", F.lit("")) != "", F.concat(note, F.array(_op(1, "text", x=x + 5, y=top - 15, text="Note", size=10.0, r=0.2, g=0.2, b=0.2)))).otherwise(note),
        "stamp": F.array(box(0, "stroke", thickness=3.0), _op(1, "text", x=x + w / 2 - F.length(label) * 3, y=middle - 5, text=label, size=12.0, rotate=-15.0)),
    }
    out = F.when(F.lit(False), kinds["highlight"])
    for kind in DRAWN:
        out = out.when(F.col("type") == kind, kinds[kind])
    return out


OPTIONAL = {"end_x": "double", "end_y": "double", "points": "array<struct<x:double,y:double>>", "text": "string", "stamp": "string", "color": "string"}


def draw_ops(annotations: DataFrame, page_height: float = PAGE_HEIGHT) -> DataFrame:
    """Operations of annotations (doc_id, page_number, id, type, x, y, w, h and the optional columns).

    Types without a drawing give none. ``r``, ``g``, ``b`` are the annotation's colour, or the
    operation's own.
    """
    more = {c: F.lit(None).cast(kind) for c, kind in OPTIONAL.items() if c not in annotations.columns}
    drawn = annotations.withColumns(more).select("doc_id", "page_number", "id", "color", F.inline(_ops(page_height)))
    own = dict(zip("rgb", hex_to_rgb(F.coalesce("color", F.lit("#000000")))))
    return drawn.withColumns({c: F.coalesce(c, v) for c, v in own.items()} | {"layer": F.lit(ANNOTATION)}).drop("color")


def text_ops(elements: DataFrame, page_height: float = PAGE_HEIGHT) -> DataFrame:
    """Added texts (doc_id, page_number, id, x, y, text, size, color): size 12 and black unless given."""
    size = F.coalesce(F.nullif("size", F.lit(0.0)), F.lit(12.0))
    r, g, b = hex_to_rgb(F.coalesce("color", F.lit("#000000")))
    return elements.select("doc_id", "page_number", "id", F.lit("text").alias("op"), "x", (page_height - F.col("y") - size).alias("y"), "text", size.alias("size"), r.alias("r"), g.alias("g"), b.alias("b"), F.lit(TEXT).alias("layer"))


def images(elements: DataFrame, bad: str = "skip") -> DataFrame:
    """Images of data URIs (``data``): ``format`` png or jpeg and ``bytes``; others are null, or raise with ``bad='error'``."""
    head = F.substring_index("data", ",", 1)
    kind = F.when(head.startswith("data:image/png"), "png").when(head.rlike("^data:image/jpe?g"), "jpeg")
    if bad == "error":
        kind = F.when(kind.isNull(), F.raise_error(F.lit("only PNG and JPEG images can be added")).cast("string")).otherwise(kind)
    return elements.withColumns({"format": kind, "bytes": F.when(kind.isNotNull(), F.unbase64(F.substring_index("data", ",", -1)))})


def image_ops(elements: DataFrame, page_height: float = PAGE_HEIGHT) -> DataFrame:
    """Added images (doc_id, page_number, id, x, y, w, h, data) of a known format."""
    return images(elements).filter("format is not null").select("doc_id", "page_number", "id", F.lit("image").alias("op"), "x", (page_height - F.col("y") - F.col("h")).alias("y"), "w", "h", F.lit(IMAGE).alias("layer"), "format", "bytes")


def first_entry(overlays: DataFrame) -> DataFrame:
    """Of several overlay lists of a page (doc_id, page_number, entry, ...) only the first counts."""
    first = F.dense_rank().over(Window.partitionBy("doc_id", "page_number").orderBy("entry"))
    return overlays.withColumn("_r", first).filter("_r = 1").drop("_r")


def modifications(pages: DataFrame, texts: DataFrame, pictures: DataFrame, annotations: DataFrame, page_height: float = PAGE_HEIGHT) -> DataFrame:
    """All operations of the documents' pages, numbered in the order in which they are drawn."""
    every = text_ops(texts, page_height).unionByName(image_ops(pictures, page_height), allowMissingColumns=True).unionByName(draw_ops(annotations, page_height), allowMissingColumns=True)
    held = pages.select("doc_id", "page_number").join(every, ["doc_id", "page_number"])
    at = Window.partitionBy("doc_id", "page_number").orderBy("layer", "id", "part")
    return held.withColumn("position", F.row_number().over(at))


def drag_box(x1: Column, y1: Column, x2: Column, y2: Column, scale: Column) -> list[Column]:
    """Box of a drag between two corners on a page shown at a scale."""
    return [(F.least(x1, x2) / scale).alias("x"), (F.least(y1, y2) / scale).alias("y"), (F.abs(x2 - x1) / scale).alias("w"), (F.abs(y2 - y1) / scale).alias("h")]


def drawable(shapes: DataFrame) -> DataFrame:
    """Shapes large enough to keep: over 5 each way; lines by hand need over two points."""
    return shapes.filter(F.when(F.col("type") == "freehand", F.size("points") > 2).otherwise((F.col("w") > 5) & (F.col("h") > 5)))


# The colour in which each tool draws.
TOOL_COLOURS = {"highlight": "#FFFF00", "underline": "#FF0000", "strikethrough": "#FF0000", "rectangle": "#3B82F6", "circle": "#10B981", "arrow": "#EF4444", "line": "#8B5CF6", "freehand": "#000000", "note": "#FCD34D", "stamp": "#DC2626"}


def tool_colour(tool: Column) -> Column:
    spec = F.create_map(*[F.lit(x) for kv in TOOL_COLOURS.items() for x in kv])
    return F.coalesce(F.try_element_at(spec, tool), F.lit("#6B7280"))

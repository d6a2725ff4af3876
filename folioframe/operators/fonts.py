"""Font tables as DataFrames: encodings by joins, character maps parsed once each, encoding of texts.

A font is a row (font_key, base_font, subtype, encoding, entries, to_unicode); ``entries`` are the
encoding's differences, structs of a position or a glyph name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..content import fonts
from ..plans.shared import written
from ._arrow import map_rows

FONT = "base_font", "subtype", "encoding", "entries", "to_unicode"


def is_subset(base_font: Column) -> Column:
    return base_font.rlike(fonts.SUBSET.pattern)


def real_name(base_font: Column) -> Column:
    return F.regexp_replace(base_font, fonts.SUBSET.pattern, "")


def base_tables(spark: SparkSession, parity: bool = False) -> DataFrame:
    """(encoding, code, unicode) of the named encodings, about 700 rows."""
    rows = [(name, code, c) for name in fonts.ENCODINGS for code, c in fonts.encoding(name, parity).items()]
    return spark.createDataFrame(rows, "encoding string, code int, unicode string")


def glyph_table(spark: SparkSession, parity: bool = False) -> DataFrame:
    return spark.createDataFrame(list(fonts.glyphs(parity).items()), "glyph string, unicode string")


def differences(table: DataFrame) -> DataFrame:
    """(font_key, code, glyph): each name takes the code after the last position or name; a later one of a code wins."""
    each = table.select("font_key", F.posexplode("entries").alias("at", "e")).select("font_key", "at", "e.code", "e.glyph")
    font = Window.partitionBy("font_key").orderBy("at")
    start = F.last(F.when(F.col("code").isNotNull(), F.col("at")), ignorenulls=True).over(font)
    base = F.coalesce(F.last("code", ignorenulls=True).over(font), F.lit(0))
    placed = each.withColumn("_base", base).withColumn("_at", F.coalesce(start + 1, F.lit(0))).filter("glyph is not null")
    placed = placed.select("font_key", (F.col("_base") + F.col("at") - F.col("_at")).cast("int").alias("code"), "glyph", "at")
    last = F.row_number().over(Window.partitionBy("font_key", "code").orderBy(F.desc("at")))
    return placed.withColumn("_r", last).filter("_r = 1").select("font_key", "code", "glyph")


def code_table(table: DataFrame, parity: bool = False) -> DataFrame:
    """(font_key, code, unicode) of simple fonts: the base encoding, overlaid by the differences.

    A glyph name without a character leaves its code unmapped. All joins but one are against
    tables of a few hundred rows.
    """
    spark = table.sparkSession
    simple = table.filter("subtype is null or subtype <> 'Type0'")
    default = F.when(F.col("subtype") == "TrueType", "WinAnsiEncoding").when(F.col("subtype").isin("Type1", "MMType1"), "StandardEncoding")
    base = F.when(F.col("encoding").isin(*fonts.ENCODINGS), F.col("encoding")).otherwise(default)
    plain = simple.select("font_key", base.alias("encoding")).join(F.broadcast(base_tables(spark, parity)), "encoding").select("font_key", "code", "unicode")
    named = differences(simple.select("font_key", "entries")).join(F.broadcast(glyph_table(spark, parity)), "glyph", "left")
    digits = F.regexp_extract("glyph", r"^(?:uni([0-9A-Fa-f]{4})|u([0-9A-Fa-f]{4,6}))$", 1)
    more = F.regexp_extract("glyph", r"^(?:uni([0-9A-Fa-f]{4})|u([0-9A-Fa-f]{4,6}))$", 2)
    number = F.conv(F.concat(digits, more), 16, 10).cast("long")
    by_rule = F.when(F.length(F.concat(digits, more)) > 0, utf8_of(number))
    over = named.select("font_key", "code", F.coalesce("unicode", by_rule).alias("_over"), F.lit(True).alias("_named"))
    both = plain.join(over, ["font_key", "code"], "full_outer")
    return both.select("font_key", "code", F.when(F.col("_named"), F.col("_over")).otherwise(F.col("unicode")).alias("unicode")).filter("unicode is not null")


def utf8_of(code: Column) -> Column:
    """Character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def reverse_table(codes: DataFrame) -> DataFrame:
    """(font_key, unicode, code) of single characters; of several codes the least."""
    return codes.filter(F.length("unicode") == 1).groupBy("font_key", "unicode").agg(F.min("code").alias("code"))


def decoded(raw: Column, encoding: str, parity: bool = False) -> Column:
    """Text of bytes (as Latin-1 text) in a named encoding: each code looked up, those without a character lost.

    A lookup in the map that an expression carries, where a join would need a row a byte.
    """
    table = fonts.encoding(encoding, parity)
    return F.translate(raw, "".join(map(chr, range(1, 256))), "".join(table.get(c, fonts.LOST) for c in range(1, 256)))


def cmap_codes(table: DataFrame) -> DataFrame:
    """(font_key, code, unicode) of character maps, each distinct map parsed once."""
    maps = table.filter("to_unicode is not null")

    def each(source):
        yield source, [{"code": c, "unicode": t} for c, t in fonts.parse_cmap(source).to_text.items()]

    parsed = map_rows(maps.select("to_unicode").distinct(), each, "to_unicode string, codes array<struct<code:int,unicode:string>>")
    return maps.select("font_key", "to_unicode").join(parsed, "to_unicode").select("font_key", F.inline("codes"))


def of_row(row: dict) -> fonts.Font:
    """Font of a struct with the columns of a font row."""
    entries = [e["glyph"] if e["code"] is None else e["code"] for e in row["entries"] or ()]
    return fonts.resolve(row["base_font"] or "", row["subtype"] or "", row["encoding"], entries, row["to_unicode"])


PACKED = "chars string, codes string, code_chars string, texts string, multi array<struct<mark:string,text:string>>, width int, kind string"
#: Codes stand in strings as characters of plane 15, each code one character, whatever it is; texts of several characters as marks of plane 16.
CODE, MARK = 0xF0000, 0x100000


def packed(table: DataFrame) -> DataFrame:
    """One row a font (font_key and its columns) with its tables as strings, for the expressions below.

    ``chars`` and ``codes`` pair each encodable character with its code, ``code_chars`` and ``texts`` each
    code with its text, ``multi`` the marks that stand for texts of several characters. Each distinct font is resolved once.
    """
    spec = F.struct(*FONT)
    distinct = table.select(spec.alias("font")).distinct()

    def each(font):
        f = of_row(font)
        top = 0xFF if f.bytes_per_code == 1 else 0xFFFF
        pairs = [(c, code) for c, code in f.to_code.items() if 0 <= code <= top]
        texts = [(code, t) for code, t in f.to_text.items() if 0 <= code <= top]
        if f.to_text and f.bytes_per_code == 1:
            texts += [(code, fonts.LOST) for code in range(256) if code not in f.to_text]
        long = {t: chr(MARK + k) for k, t in enumerate(sorted({t for _, t in texts if len(t) != 1}))}
        yield (
            font, "".join(c for c, _ in pairs), "".join(chr(CODE + code) for _, code in pairs), "".join(chr(CODE + code) for code, _ in texts), "".join(long.get(t, t) for _, t in texts),
            [{"mark": m, "text": t} for t, m in long.items()], f.bytes_per_code, f.kind,
        )

    found = map_rows(distinct, each, f"font {distinct.schema['font'].dataType.simpleString()}, {PACKED}")
    return table.withColumn("_font", spec).join(found, F.col("_font").eqNullSafe(F.col("font"))).drop("_font", "font")


def _bytes_of(coded: Column, width: Column) -> Column:
    """Bytes of a string of code characters: the last one or two of each in UTF-32."""
    digits = F.hex(F.encode(coded, "UTF-32"))
    return F.unhex(F.when(width == 1, F.regexp_replace(digits, ".{6}(..)", "$1")).otherwise(F.regexp_replace(digits, ".{4}(.{4})", "$1")))


def _coded(raw: Column, width: Column) -> Column:
    """Bytes as a string of code characters; an odd last byte of two-byte codes is left out."""
    digits = F.hex(raw)
    wide = F.when(width == 1, F.regexp_replace(digits, "(..)", "000F00$1")).otherwise(F.regexp_replace(F.regexp_replace(digits, "^((?:.{4})*)..$", "$1"), "(.{4})", "000F$1"))
    return F.decode(F.unhex(wide), "UTF-32")


def text_of(raw: Column) -> Column:
    """Text of bytes in the row's packed font; what it does not map is U+FFFD, and without any table (or font) each byte is its character."""
    plain = F.decode(raw, "ISO-8859-1")
    read = F.call_function("translate", _coded(raw, F.col("width")), F.col("code_chars"), F.col("texts"))
    read = F.regexp_replace(read, "[\\x{F0000}-\\x{FFFFF}]", fonts.LOST)
    whole = F.when(F.size("multi") > 0, F.aggregate("multi", read, lambda t, m: F.replace(t, m["mark"], m["text"]))).otherwise(read)
    return F.when(F.coalesce(F.length("texts"), F.lit(0)) == 0, plain).otherwise(whole)


def decoded_by_font(rows: DataFrame, page_fonts: DataFrame, table: DataFrame, raw: str = "raw") -> DataFrame:
    """Rows (doc_id, page_number, font, raw) with the ``text`` of their bytes, each by its own page's font.

    ``page_fonts`` (doc_id, page_number, name, font_key) says which font a name is on a page; names it does not know
    are read byte for byte. Joins only, and a character lookup inside the row: no row a byte, no Python on the rows.
    Fonts are joined without a hint, so that they are broadcast only where their size, measured at run time, is small.
    """
    named = page_fonts.select("doc_id", "page_number", F.col("name").alias("font"), "font_key").dropDuplicates(["doc_id", "page_number", "font"])
    keyed = rows.join(named, ["doc_id", "page_number", "font"], "left").join(packed(table).drop(*FONT), "font_key", "left")
    return keyed.withColumn("text", text_of(F.col(raw))).select(*rows.columns, "text")


def encoded(texts: DataFrame) -> DataFrame:
    """Texts (id, text, and a font's columns) as bytes of their font, or what is missing and why, and read back.

    Each distinct font is resolved once and packed; the texts themselves are encoded by expressions.
    """
    spec = texts.select(*FONT).distinct().withColumn("font_key", F.monotonically_increasing_id())
    font = F.struct(*FONT)
    rows = texts.select("id", F.coalesce("text", F.lit("")).alias("text"), font.alias("_own"))
    p = packed(spec).select(font.alias("_font"), "base_font", *[c.split()[0] for c in PACKED.split(", ")])
    rows = rows.join(p, F.col("_own").eqNullSafe(F.col("_font")))
    left = F.call_function("translate", F.col("text"), F.col("chars"), F.lit(""))
    known = F.length("chars") > 0
    missing = F.when(known & (left != ""), F.array_distinct(F.split(left, ""))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("missing", F.filter(missing, lambda c: c != ""))
    why = F.when(~known, F.concat(F.lit("encoding "), "kind", F.lit(" is not encodable")))
    why = why.when(F.size("missing") > 0, F.concat(F.lit("cannot encode "), F.size("missing").cast("string"), F.lit(" character(s) for "), F.coalesce("base_font", F.lit("")), F.lit(": "), F.array_join("missing", " ")))
    raw = F.when(known & (F.size("missing") == 0), _bytes_of(F.call_function("translate", F.col("text"), F.col("chars"), F.col("codes")), F.col("width")))
    name = F.coalesce("base_font", F.lit(""))
    return rows.withColumn("bytes", raw).select("id", "bytes", "missing", why.alias("reason"), is_subset(name).alias("is_subset"), real_name(name).alias("real_name"), text_of(F.col("bytes")).alias("back"))


def nearest_with(nodes: DataFrame, holders: DataFrame, depth: int = 64) -> DataFrame:
    """(doc_id, node, holder, refused): the nearest of a node and its ancestors that is among ``holders`` (doc_id, node), or null.

    ``nodes`` (doc_id, node, parent) is the tree; parents may be null or unknown. Pointers are doubled:
    after k rounds a node knows of 2^k - 1 ancestors, so ``depth`` of them take about log2(depth) joins. A chain that has not ended
    by then is a cycle or too deep, and ``refused``.

    Scale: a shuffle join by (doc_id, node) a round, each round written to the shared folder, so that
    plans do not double along with the pointers; nodes whose search has ended are not joined again.
    """
    own = holders.select("doc_id", "node").distinct().withColumn("_holds", F.lit(True))
    at = nodes.select("doc_id", "node", "parent").dropDuplicates(["doc_id", "node"]).join(own, ["doc_id", "node"], "left")
    at = at.select("doc_id", "node", F.when(F.col("_holds"), F.col("node")).alias("holder"), F.when(F.col("_holds").isNull(), F.col("parent")).alias("jump"))
    at = written(at, "ancestors")
    for _ in range(depth.bit_length()):
        further = at.select("doc_id", F.col("node").alias("jump"), F.col("holder").alias("_holder"), F.col("jump").alias("_jump"))
        going = at.filter("jump is not null").drop("holder").join(further, ["doc_id", "jump"], "left")
        going = going.select("doc_id", "node", F.col("_holder").alias("holder"), F.col("_jump").alias("jump"))
        more = written(at.filter("jump is null").select("doc_id", "node", "holder", "jump").unionByName(going), "ancestors")
        at, done = more, more.filter("jump is not null").isEmpty()
        if done:
            break
    return at.select("doc_id", "node", "holder", F.col("jump").isNotNull().alias("refused"))


def with_inherited(pages: DataFrame, own: DataFrame, parents: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """Font table of each page: its own resources, or those of the nearest ancestor that has some.

    Without a ``tree`` (doc_id, node, parent, and for pages page_number) the document is each page's parent,
    and ``parents`` its resources by doc_id; with one they are by (doc_id, node). Pages whose ancestors go round in a circle have none.
    """
    has = own.select("doc_id", "page_number").distinct()
    bare = pages.join(has, ["doc_id", "page_number"], "left_anti")
    if tree is None:
        return own.unionByName(bare.join(parents, "doc_id").select(*own.columns))
    found = nearest_with(tree, parents).filter("holder is not null").join(tree.filter("page_number is not null").select("doc_id", "node", "page_number"), ["doc_id", "node"])
    given = bare.select("doc_id", "page_number").join(found.select("doc_id", "page_number", "holder"), ["doc_id", "page_number"])
    return own.unionByName(given.join(parents.withColumnRenamed("node", "holder"), ["doc_id", "holder"]).select(*own.columns))

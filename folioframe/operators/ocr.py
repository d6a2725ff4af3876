"""Shaping of recognised text: page results, transcripts, Markdown, sidecars, and the text-layer test."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import normalize

ENOUGH = 200  # characters of a text layer that make recognition needless
SIDECAR = "version int, generated_at string, engine string, results array<struct<page_number:bigint,text:string,confidence:double,words:array<struct<text:string,confidence:double,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>>>"
RESULT = ["doc_id", "page_number", "text", "confidence", "words"]


def quad_box(box: Column) -> Column:
    """Box x0, y0, x1, y1 around a quadrilateral of points [x, y]; zeros if it has under four."""
    xs, ys = F.transform(box, lambda p: F.get(p, F.lit(0))), F.transform(box, lambda p: F.get(p, F.lit(1)))
    real = F.coalesce(F.size(box) >= 4, F.lit(False))
    each = {"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys)}
    return F.struct(*[F.when(real, v).otherwise(0.0).alias(n) for n, v in each.items()])


def words(ocr: DataFrame) -> DataFrame:
    """Recognised lines with their quadrilateral ``box`` as words: text, confidence, bbox."""
    return ocr.withColumn("word", F.struct(F.col("line").alias("text"), F.coalesce("mean", F.lit(0.0)).alias("confidence"), quad_box(F.col("box")).alias("bbox")))


def page_results(ocr: DataFrame) -> DataFrame:
    """Text of a page's lines in order, and their mean confidence (a null mean counts as 0)."""
    ordered = F.array_sort(F.collect_list(F.struct("line_idx", "line")))
    return ocr.groupBy("doc_id", "page_number").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"), F.coalesce(F.avg(F.coalesce("mean", F.lit(0.0))), F.lit(0.0)).alias("confidence"))


def results_with_words(ocr: DataFrame) -> DataFrame:
    """Page results with their words in order."""
    ordered = F.array_sort(F.collect_list(F.struct("line_idx", "word")))
    each = words(ocr).groupBy("doc_id", "page_number").agg(ordered.alias("o"))
    inside = F.transform("o", lambda x: x["word"])
    return each.select("doc_id", "page_number", F.array_join(F.transform(inside, lambda w: w["text"]), "\n").alias("text"), F.aggregate(inside, F.lit(0.0), lambda a, w: a + w["confidence"], lambda a: a / F.size(inside)).alias("confidence"), inside.alias("words"))


def recognised(layer: DataFrame, recognise: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results of pages (doc_id, page_number, text): the text layer where it suffices, with confidence 1 and no words.

    ``recognise`` gets the other pages only and returns their lines (line_idx, line, mean, box).
    """
    flat = normalize(F.col("text"))
    own = layer.withColumn("_ok", F.coalesce(F.length(flat) >= ENOUGH, F.lit(False)))
    none = F.array().cast("array<struct<text:string,confidence:double,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>")
    text = own.filter("_ok").select("doc_id", "page_number", flat.alias("text"), F.lit(1.0).alias("confidence"), none.alias("words"))
    read = results_with_words(recognise(own.filter("not _ok").drop("_ok"))).select(*RESULT)
    return text.unionByName(read)


def page_layer(items: DataFrame) -> DataFrame:
    """Text layer of pages from their items (ord, text), joined by spaces, empty ones left out."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return items.filter("text <> ''").groupBy("doc_id", "page_number").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"))


def progress(pages: DataFrame) -> DataFrame:
    """Share of a document's pages that are done with each page, in whole per cent."""
    doc = Window.partitionBy("doc_id")
    done = F.row_number().over(doc.orderBy("page_number"))
    return pages.select("doc_id", "page_number", F.floor(100 * done / F.count(F.lit(1)).over(doc) + 0.5).cast("int").alias("progress"))


def transcript(results: DataFrame) -> DataFrame:
    """Pages of a document under their headings; a blank page says so."""
    body = F.when(F.col("text") == "", "[no text]").otherwise(F.col("text"))
    part = F.concat(F.lit("\n--- Page "), "page_number", F.lit(" ---\n"), body, F.lit("\n"))
    ordered = F.array_sort(F.collect_list(F.struct("page_number", part.alias("part"))))
    return results.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "").alias("transcript"))


def markdown(transcript: F.Column) -> F.Column:
    return F.regexp_replace(transcript, r"--- Page (\d+) ---", "\n## Page $1\n")


def text_layer(docs: DataFrame) -> DataFrame:
    """Documents whose own text suffices, with its normalised length."""
    n = F.length(normalize(F.col("text")))
    return docs.select("doc_id", n.cast("long").alias("n"), (n >= ENOUGH).alias("sufficient"))


def to_sidecar(results: DataFrame, engine: str, at: str, pretty: bool = False) -> DataFrame:
    """One JSON text per document: version, moment, engine, and its pages' results in order."""
    each = F.array_sort(F.collect_list(F.struct("page_number", "text", "confidence", "words")))
    return results.groupBy("doc_id").agg(F.to_json(F.struct(F.lit(1).alias("version"), F.lit(at).alias("generated_at"), F.lit(engine).alias("engine"), each.alias("results")), {"pretty": str(pretty).lower()}).alias("json"))


def from_sidecar(sidecars: DataFrame) -> DataFrame:
    """Results of sidecars; a null or unreadable one has none."""
    return sidecars.select("doc_id", F.inline(F.from_json("json", SIDECAR)["results"]))

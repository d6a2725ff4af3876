"""Full-text search over lines and recognised lines, with offsets, snippets and stepping."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import escape_regexp, matches, snippet


def checked(spark: SparkSession, pattern: str) -> str:
    """The pattern, or ValueError at once if it is empty or no regular expression."""
    if not pattern:
        raise ValueError("an empty pattern matches nothing")
    try:
        spark.sql("SELECT regexp_like('', :p)", {"p": f"(?iu){pattern}"}).first()
    except PySparkException as e:
        raise ValueError(f"not a regular expression: {pattern!r}") from e
    return pattern


def find(lines: DataFrame, pattern: str, source: str = "text") -> DataFrame:
    """One row per match: place, page-wide ``match_index`` and ``snippet``. Map-only but for the index."""
    checked(lines.sparkSession, pattern)
    hit = lines.filter(F.col("line").rlike(f"(?iu){pattern}")).select("doc_id", "page_number", "line_idx", "line", F.explode(matches(F.col("line"), pattern)).alias("m"))
    hits = hit.select("doc_id", "page_number", "line_idx", F.col("m.start").cast("long").alias("start"), F.col("m.text").alias("text"), snippet(F.col("line"), F.col("m.start"), F.length("m.text")).alias("snippet"), F.lit(source).alias("source"))
    at = Window.partitionBy("doc_id", "page_number").orderBy("line_idx", "start")
    return hits.withColumn("match_index", (F.row_number().over(at) - 1).cast("long"))


def find_with_ocr(lines: DataFrame, ocr: DataFrame, pattern: str) -> DataFrame:
    """Text hits of the expression, and recognised hits of its plain text on pages without a text hit."""
    text = find(lines, pattern)
    more = find(ocr, escape_regexp(pattern), "ocr").join(text.select("doc_id", "page_number").distinct(), ["doc_id", "page_number"], "left_anti")
    return text.unionByName(more)


def ordered(hits: DataFrame) -> DataFrame:
    """Hits as a list of results shows them."""
    return hits.orderBy("doc_id", "page_number", "match_index", "source")


def step(hits: DataFrame, by: int) -> DataFrame:
    """Add ``target``: the hit of the document that stepping leads to, wrapping around."""
    doc = Window.partitionBy("doc_id")
    at = F.row_number().over(doc.orderBy("page_number", "match_index", "source")) - 1
    return hits.withColumn("position", at.cast("long")).withColumn("target", F.pmod(F.col("position") + by, F.count(F.lit(1)).over(doc)).cast("long"))

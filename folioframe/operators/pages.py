"""Page algebra: every operation keeps pages as rows and renumbers them.

Lists of pages become a map from page to positions, applied row by row, so pages are read once and
no join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(pages: DataFrame, order: str) -> DataFrame:
    """Documents one after another within ``group``, in order of ``order``, pages renumbered."""
    at = Window.partitionBy("group").orderBy(order, "page_number")
    return pages.withColumn("new_page", F.row_number().over(at).cast("long"))


def places(wanted: list[int]) -> Column:
    """Array of the positions (from 0) of a row's page in the list, none if it is not there."""
    at: dict[int, list[int]] = {}
    for k, p in enumerate(wanted):
        at.setdefault(p, []).append(k)
    none = F.array().cast("array<int>")
    if not at:
        return none
    spec = F.create_map(*[x for p, ks in at.items() for x in (F.lit(p), F.array(*map(F.lit, ks)))])
    return F.coalesce(F.try_element_at(spec, F.col("page_number").cast("int")), none)


def select_pages(pages: DataFrame, wanted: list[int]) -> DataFrame:
    """Pages in the given order, duplicates allowed; pages a document lacks are skipped."""
    kept = pages.withColumn("_at", F.explode(places(wanted)))
    return kept.withColumn("new_page", F.row_number().over(Window.partitionBy("doc_id").orderBy("_at")).cast("long")).drop("_at")


def split(pages: DataFrame, parts: list[list[int]]) -> DataFrame:
    """Parts of explicit 0-based page lists, numbered from 1; every row is its part's page of the list."""
    spots: dict[int, list[tuple[int, int]]] = {}
    for k, part in enumerate(parts):
        for i, p in enumerate(part):
            spots.setdefault(p + 1, []).append((k + 1, i + 1))
    spec = F.create_map(*[x for p, ks in spots.items() for x in (F.lit(p), F.array(*[F.struct(F.lit(a).alias("part"), F.lit(b).alias("new_page")) for a, b in ks]))])
    return pages.select("*", F.inline(F.try_element_at(spec, F.col("page_number").cast("int"))))


def delete(pages: DataFrame, page: int) -> DataFrame:
    left = pages.filter(F.col("page_number") != page)
    return left.withColumn("new_page", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number")).cast("long"))


def rotate(pages: DataFrame, page: int, angle: int) -> DataFrame:
    return pages.withColumn("rotation", F.when(F.col("page_number") == page, angle).otherwise(F.col("rotation")))


def drag(pages: DataFrame, page: int, target: int) -> DataFrame:
    """One page taken out and put in at the place that ``target`` had."""
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    p = F.col("page_number")
    passed = F.when((p > page) & (p <= target), p - 1).when((p < page) & (p >= target), p + 1).otherwise(p)
    real = (F.lit(page) <= n) & (F.lit(target) <= n)
    return pages.withColumn("new_page", F.when(real, F.when(p == page, F.lit(target)).otherwise(passed)).otherwise(p).cast("long"))


def remap(rows: DataFrame, selection: list[int]) -> DataFrame:
    """Rows of selected pages under the number that their page gets, once for each time it is listed."""
    return rows.withColumn("page_number", F.explode(F.transform(places(selection), lambda k: (k + 1).cast("long"))))


def turn(current: Column, by: int, pages: Column, spread: bool = False) -> Column:
    """Page that stepping leads to, two at a time in a spread, within the document."""
    return F.least(F.greatest(current + by * (2 if spread else 1), F.lit(1)), pages)


def dims(pages: DataFrame, scale: float = 1.0) -> DataFrame:
    """Width and height of every page (width, height) at a scale."""
    return pages.select("doc_id", "page_number", (F.col("width") * scale).alias("width"), (F.col("height") * scale).alias("height"))


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_count"))


def previews(pages: DataFrame, most: int = 20) -> DataFrame:
    """Pages that get a preview: the first of each document."""
    return pages.filter(F.col("page_number") <= most)

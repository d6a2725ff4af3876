"""One place for what a user of documents does: open, search, edit, annotate, recognise, save.

A :class:`Library` holds the tables of many documents; every method returns a DataFrame over all
of them, or those of ``doc_id`` alone where it is given. Arguments are checked at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import draw, edits, layout, locate, ocr, pages, search, search_index, stores, streams
from .operators import lines as shown
from .sources import files
from .streaming import events


def check_page(page) -> int:
    if not isinstance(page, int) or isinstance(page, bool) or page < 1:
        raise ValueError(f"a page number is an integer from 1 on, not {page!r}")
    return page


def check_columns(df: DataFrame, needed: list[str], what: str) -> DataFrame:
    if lost := [c for c in needed if c not in df.columns]:
        raise ValueError(f"{what} lack {', '.join(lost)}")
    return df


@dataclass
class Library:
    """Tables: pages, lines and streams of documents, with their annotations and recognised lines."""

    spark: SparkSession
    pages: DataFrame
    lines: DataFrame
    streams: DataFrame
    annotations: DataFrame | None = None
    recognised: DataFrame | None = None
    mode: str = "auto"

    def _of(self, df: DataFrame, doc_id: int | None) -> DataFrame:
        return df if doc_id is None else df.filter(F.col("doc_id") == doc_id)

    # documents and pages
    def info(self, folder: str) -> DataFrame:
        return files.document_info(files.read_bytes(self.spark, folder))

    def list(self, folder: str) -> DataFrame:
        return files.library(self.spark, folder)

    def page_text(self, page: int, doc_id: int | None = None) -> DataFrame:
        return self._of(self.lines, doc_id).filter(F.col("page_number") == check_page(page))

    def page_counts(self) -> DataFrame:
        return pages.page_counts(self.pages)

    def page_dims(self, scale: float = 1.0) -> DataFrame:
        return pages.dims(self.pages, scale)

    def extract_pages(self, wanted: list[int]) -> DataFrame:
        return pages.select_pages(self.pages, [check_page(p) for p in wanted])

    reorder_pages = extract_pages

    def split(self, parts: list[list[int]] | None = None, ranges: list[tuple[int, int]] | None = None) -> DataFrame:
        """By lists of 0-based pages, or by ranges of pages from 1 on, both ends included."""
        return pages.split(self.pages, parts if parts is not None else [list(range(a - 1, b)) for a, b in ranges or []])

    def merge(self, group: str, order: str = "doc_id") -> DataFrame:
        return pages.merge(self.pages.withColumn("group", F.expr(group)), order)

    def delete_page(self, page: int) -> DataFrame:
        return pages.delete(self.pages, check_page(page))

    def rotate_page(self, page: int, angle: int) -> DataFrame:
        if angle % 90:
            raise ValueError("an angle is a multiple of 90")
        return pages.rotate(self.pages, check_page(page), angle)

    # search
    def search(self, pattern: str, doc_id: int | None = None) -> DataFrame:
        lines = self._of(self.lines, doc_id)
        if self.recognised is None:
            return search.find(lines, pattern)
        return search.find_with_ocr(lines, self._of(self.recognised, doc_id), pattern)

    def build_index(self, path: str) -> None:
        search_index.build(self.lines, path)

    def search_index(self, path: str, pattern: str, doc_id: int | None = None) -> DataFrame:
        return self._of(search_index.find(self.spark, path, pattern), doc_id)

    def shown_lines(self) -> DataFrame:
        """Lines put together from the runs that the pages' streams show, with their boxes, fonts and colours."""
        return shown.grouped(streams.runs(self.streams))

    # edits
    def locate(self, targets: DataFrame) -> DataFrame:
        return locate.locate_on_pages(check_columns(targets, ["doc_id", "page_number", "id", "text"], "targets"), self.streams, decode=lambda font, raw: raw.decode("latin-1"))

    def bake(self, wanted: DataFrame, mode: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(edited pages, outcome of every changed edit)."""
        check_columns(wanted, ["doc_id", "page_number", *edits.EDIT], "edits")
        done = edits.apply(self.streams, edits.changed(wanted))
        return done.select("doc_id", "page_number", "contents"), edits.bake(edits.outcomes(done), mode or self.mode)

    # annotations and overlays
    def save_annotations(self) -> DataFrame:
        return stores.to_sidecar(self.annotations, pretty=True)

    def apply_modifications(self, texts: DataFrame, images: DataFrame, annotations: DataFrame | None = None) -> DataFrame:
        return draw.modifications(self.pages, texts, images, self.annotations if annotations is None else annotations)

    # recognised text
    def ocr_results(self) -> DataFrame:
        return ocr.page_results(self.recognised)

    def transcript(self) -> DataFrame:
        return ocr.transcript(self.ocr_results())

    def layout(self, texts: DataFrame) -> DataFrame:
        return layout.placed(layout.wrapped(texts))

    # generated text
    def generate(self, prompts: DataFrame, provider) -> DataFrame:
        return events.generate(check_columns(prompts, ["prompt"], "prompts"), provider)

    def tokens(self) -> DataFrame:
        return streams.tokens(self.streams)

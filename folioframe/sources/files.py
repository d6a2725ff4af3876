"""Files of documents and their companions: listing, reading, writing one file a row.

Reading goes through Spark's own readers, so any store that Spark opens works. Writing goes
through Spark's Hadoop file systems on the driver for single small files, and through a data
source with one file a row for many; the latter writes to a mounted folder or to a store's URI (file, s3, gs, hdfs, abfs).
"""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..content import container
from ..functions.scalar import sidecar_path
from ..operators import layout, ocr, stores
from ..operators._arrow import Made, made, map_rows

ANNOTATIONS, RECOGNISED = ".annotations.json", ".ocr.json"


def binary(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, length, modificationTime, content of files; content is read only where it is used. Spark leaves empty files out."""
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def file_info(spark: SparkSession, path: str) -> DataFrame:
    """path, name, size, modified of files; a missing path raises FileNotFoundError."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return described(binary(spark, path))


def described(files: DataFrame) -> DataFrame:
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    return binary(spark, path).select("path", "content")


def library(spark: SparkSession, folder: str) -> DataFrame:
    """Documents directly in a folder, the last changed first."""
    return listed(described(binary(spark, folder)))


def listed(files: DataFrame) -> DataFrame:
    """Files (path, name, size, modified) that are documents by their ending, the last changed first."""
    return files.filter(F.lower("name").endswith(".pdf")).orderBy(F.desc("modified"), "path")


# ---- documents ---------------------------------------------------------------------------------

_INFO = "path string, page_count int, title string, author string, subject string, error string"
_PAGES = "path string, page_number long, width double, height double, rotation int, parts array<binary>, fonts array<struct<name:string,base_font:string,subtype:string,encoding:string,entries:array<struct<code:int,glyph:string>>,to_unicode:string>>"


def document_info(files: DataFrame | Made, reader: Callable = container.Document) -> DataFrame:
    """Page count, title, author and subject of document files (path, content); what cannot be read says why.

    ``reader`` opens a file's bytes; another one may be given. Files that are not written yet (:func:`unwritten`) are written in the same pass.
    """
    rows, columns, make = made(files, "content")

    def each(path, *held):
        content = make(*held)
        try:
            i = reader(content).info()
            yield path, i["page_count"], i["title"], i["author"], i["subject"], None
        except Exception as e:  # any damage of one file must not stop the others
            yield path, None, None, None, None, f"{type(e).__name__}: {e}"

    return map_rows(rows.select("path", *columns), each, _INFO)


def document_pages(files: DataFrame, reader: Callable = container.Document) -> DataFrame:
    """Pages of document files: size, rotation, decoded content parts (see ``streams.join_parts``) and fonts."""

    def each(path, content):
        try:
            doc = reader(content)
            for k, page in enumerate(doc.pages()):
                yield path, k + 1, *doc.size(page), doc.contents(page), doc.fonts(page)
        except Exception:  # reported by document_info
            return

    return map_rows(files.select("path", "content"), each, _PAGES)


def to_files(pages: DataFrame | Made) -> DataFrame:
    """Document files (path, content) of pages (path, page_number, contents, width, height)."""
    rows, columns, make = unwritten(pages)
    return map_rows(rows.select("path", *columns), lambda path, *held: [(path, make(*held))], "path string, content binary")


def unwritten(pages: DataFrame | Made) -> Made:
    """The files of :func:`to_files`, written in the pass that reads them."""
    rows, columns, make = made(pages)
    ordered = F.array_sort(F.collect_list(F.struct("page_number", *columns, "width", "height")))

    def write(rows):
        return container.write([container.PageToWrite(make(*[r[c] for c in columns]), r["width"], r["height"]) for r in rows])

    return Made(rows.groupBy("path").agg(ordered.alias("rows")), ("rows",), write)


def drawn_pages(ops: DataFrame, page_height: float = 792.0, page_width: float = 612.0) -> DataFrame:
    """Pages (path, page_number, contents, width, height) of drawing operations with ``path`` and ``position``."""
    rows, columns, make = _undrawn(ops, page_height, page_width)
    return map_rows(rows.select("path", "page_number", *columns), lambda path, page, *held: [(path, page, make(*held), page_width, page_height)], "path string, page_number long, contents binary, width double, height double")


def _undrawn(ops: DataFrame, page_height: float, page_width: float) -> Made:
    columns = [c for c in ops.columns if c not in ("path", "page_number", "position")]
    rows = ops.groupBy("path", "page_number").agg(F.sort_array(F.collect_list(F.struct("position", F.struct(*columns).alias("o")))).alias("drawn"))
    return Made(rows.withColumns({"width": F.lit(page_width), "height": F.lit(page_height)}), ("drawn",), lambda drawn: container.draw([r["o"] for r in drawn], page_height))


def with_drawings(streams: DataFrame, ops: DataFrame, page_height: float = 792.0) -> DataFrame:
    """Pages (doc_id, page_number, contents) with drawing operations (and ``position``) after what they show.

    What a page leaves set does not reach the drawings.
    """
    columns = [c for c in ops.columns if c not in ("doc_id", "page_number", "position")]
    rows = ops.groupBy("doc_id", "page_number").agg(F.sort_array(F.collect_list(F.struct("position", F.struct(*columns).alias("o")))).alias("rows"))

    def each(doc, page, contents, rows):
        if not rows:
            yield doc, page, contents
        else:
            yield doc, page, b"q\n" + (contents or b"") + b"\nQ\n" + container.draw([r["o"] for r in rows], page_height)

    both = streams.select("doc_id", "page_number", "contents").join(rows, ["doc_id", "page_number"], "left")
    return map_rows(both, each, "doc_id long, page_number long, contents binary")


def text_files(texts: DataFrame, fixed: float | None = None) -> DataFrame:
    """Document files (path, content) of plain texts (doc_id, text): wrapped, broken into pages, in Helvetica."""
    return to_files(_text_pages(texts, fixed))


def unwritten_text_files(texts: DataFrame, fixed: float | None = None) -> Made:
    """The files of :func:`text_files`, drawn and written in the pass that reads them."""
    return unwritten(_text_pages(texts, fixed))


def _text_pages(texts: DataFrame, fixed: float | None) -> Made:
    at = layout.placed(layout.wrapped(texts, fixed=fixed))
    ops = at.select(F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), "page_number", F.col("ord").alias("position"), F.lit("text").alias("op"), "x", "y", F.col("line").alias("text"), F.lit(layout.SIZE).alias("size"))
    return _undrawn(ops, layout.HEIGHT, layout.WIDTH)


def cached(spark: SparkSession, path: str) -> DataFrame:
    """A folder's files, kept after the first reading until ``unpersist`` is called, such as after a save."""
    return read_bytes(spark, path).cache()


BY_LIST = 10_000  # changed files that are read by their names

_HELD = "path string, length long, modified long, held long"


def _manifest(spark: SparkSession, at: str) -> tuple[DataFrame, int]:
    """What a cache held after its last refresh, and the number of that refresh (0 if there was none)."""
    if not exists(spark, f"{at}/manifest"):
        return spark.createDataFrame([], _HELD), 0
    every = spark.read.schema(f"{_HELD}, version long").parquet(f"{at}/manifest")
    last = every.agg(F.max("version")).first()[0] or 0
    return every.filter(F.col("version") == last).drop("version"), last


def refresh_cache(spark: SparkSession, folder: str, at: str) -> int:
    """Bring a cache of a folder's files up to date, and return how many files were read for it.

    Only files are read whose path, length and time of change are not those of the last refresh, found by an
    anti join with its manifest; what is gone from the folder is gone from the next manifest. Contents are written
    before the manifest that names them, so a refresh that fails leaves the cache as it was, and readers see one state or the next.
    Up to ``BY_LIST`` changed files are read by name; of more, the folder is read once.
    """
    key = ["path", "length", "modified"]
    listing = binary(spark, folder).select("path", "length", F.unix_micros("modificationTime").alias("modified"))
    before, last = _manifest(spark, at)
    fresh = listing.join(before, key, "left_anti").select(*key)
    changed = [r["path"] for r in fresh.select("path").limit(BY_LIST + 1).collect()]
    kept = before.join(listing, key, "left_semi")
    if last and not changed and kept.count() == before.count():
        return 0
    new = last + 1
    if changed:
        some = spark.read.format("binaryFile").load(changed) if len(changed) <= BY_LIST else binary(spark, folder)
        read = some.withColumn("modified", F.unix_micros("modificationTime")).join(before, key, "left_anti")
        read.select(*key, "content").write.mode("overwrite").parquet(f"{at}/data/version={new}")
        held = spark.read.parquet(f"{at}/data/version={new}").select(*key, F.lit(new).cast("long").alias("held"))
        kept = kept.select(*key, "held").unionByName(held)
    else:
        held = None
    kept.select(*key, "held").write.mode("overwrite").parquet(f"{at}/manifest/version={new}")
    return held.count() if held is not None else 0


def cached_files(spark: SparkSession, at: str) -> DataFrame:
    """path, length, content of the files of a cache as of its last refresh."""
    now, last = _manifest(spark, at)
    if not last or not exists(spark, f"{at}/data"):
        return spark.createDataFrame([], "path string, length long, content binary")
    data = spark.read.schema("path string, length long, modified long, content binary, version long").parquet(f"{at}/data")
    return data.join(now.select("path", F.col("held").alias("version")), ["path", "version"]).select("path", "length", "content")


# ---- companions --------------------------------------------------------------------------------


def companions(files: DataFrame, folder: DataFrame, ending: str) -> DataFrame:
    """Documents (path) with the text of their companion file, null where it is missing."""
    held = folder.select(F.col("path").alias("_at"), F.decode("content", "UTF-8").alias("json"))
    return files.select("path").join(held, F.col("_at") == sidecar_path(F.col("path"), ending), "left").drop("_at")


def load_annotations(files: DataFrame, folder: DataFrame) -> DataFrame:
    """Annotations of documents from their companion files."""
    return stores.from_sidecar(companions(files, folder, ANNOTATIONS).withColumnRenamed("path", "doc_id"))


def load_recognised(files: DataFrame, folder: DataFrame) -> DataFrame:
    """Recognised pages of documents from their companion files; a missing or unreadable one has none."""
    return ocr.from_sidecar(companions(files, folder, RECOGNISED).withColumnRenamed("path", "doc_id"))


# ---- sinks -------------------------------------------------------------------------------------


@dataclass
class _Written(WriterCommitMessage):
    names: list


def _store(folder: str):
    """The file system of a folder, and the folder's path in it; a path without a scheme is that of a mounted folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), os.path.abspath(folder))


class _OneFileARow(DataSourceWriter):
    """Tasks write to a staging folder beside the files; the commit moves what they wrote into place, an abort deletes the folder."""

    def __init__(self, options: dict) -> None:
        self.folder, self.staging = options["path"], f"_staging-{uuid.uuid4().hex}"

    def _place(self, root: str, name: str) -> str:
        at = posixpath.normpath(posixpath.join(root, name))
        if posixpath.commonpath([at, posixpath.normpath(root)]) != posixpath.normpath(root):
            raise ValueError(f"{name} lies outside the folder")
        return at

    def write(self, rows: Iterator) -> _Written:
        store, root = _store(self.folder)
        at = posixpath.join(root, self.staging)
        store.create_dir(at, recursive=True)
        names = []
        for row in rows:
            place, part = self._place(root, row["name"]), posixpath.join(at, uuid.uuid4().hex)
            with store.open_output_stream(part) as f:
                f.write(row["content"] or b"")
            names.append((part, place))
        return _Written(names)

    def commit(self, messages: list) -> None:
        store, root = _store(self.folder)
        for m in messages:
            for part, place in m.names if m else ():
                store.create_dir(posixpath.dirname(place), recursive=True)
                store.move(part, place)
        self._clear(store, root)

    def abort(self, messages: list) -> None:
        self._clear(*_store(self.folder))

    def _clear(self, store, root: str) -> None:
        from pyarrow import fs

        at = posixpath.join(root, self.staging)
        if store.get_file_info(at).type != fs.FileType.NotFound:
            store.delete_dir(at)


class FilesSource(DataSource):
    """``df.write.format("folio-files")``: rows (name, content) as files of a folder in any store that Arrow opens by its URI, all or none."""

    @classmethod
    def name(cls) -> str:
        return "folio-files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _OneFileARow(dict(self.options))


def write_files(files: DataFrame, folder: str) -> None:
    """Write (name, content) rows as files; each appears whole, once all are written."""
    spark = files.sparkSession
    spark.dataSource.register(FilesSource)
    files.select("name", "content").write.format("folio-files").mode("append").save(folder)


def write_text(texts: DataFrame, folder: str) -> None:
    """Write (name, text) rows as UTF-8 files."""
    write_files(texts.select("name", F.encode("text", "UTF-8").alias("content")), folder)


def write_lines(lines: DataFrame, path: str) -> None:
    """Write a column of lines as text files, one a partition."""
    lines.select("line").write.mode("overwrite").text(path)


def load_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A companion table, or None if there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None

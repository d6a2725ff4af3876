"""The cache of a folder's files: what a refresh reads, what readers see; the sink of files: all or none."""

import os

import pytest
from pyspark.sql import functions as F

from folioframe.sources import files


def names(df):
    return {os.path.basename(r.path): bytes(r.content) for r in df.collect()}


def put(folder, name, content, when):
    (folder / name).write_bytes(content)
    os.utime(folder / name, (when, when))


def test_a_refresh_reads_only_what_changed(spark, tmp_path, monkeypatch):
    folder, at = tmp_path / "files", f"{tmp_path}/cache"
    folder.mkdir()
    assert names(files.cached_files(spark, at)) == {}
    for k, name in enumerate("abc"):
        put(folder, name, name.encode(), 1000 + k)
    assert files.refresh_cache(spark, str(folder), at) == 3
    assert names(files.cached_files(spark, at)) == {"a": b"a", "b": b"b", "c": b"c"}
    assert files.refresh_cache(spark, str(folder), at) == 0
    put(folder, "b", b"B", 2000)  # saved again, of the same length
    assert names(files.cached_files(spark, at))["b"] == b"b"  # readers see the last refresh
    assert files.refresh_cache(spark, str(folder), at) == 1
    assert names(files.cached_files(spark, at)) == {"a": b"a", "b": b"B", "c": b"c"}
    os.remove(folder / "a")
    put(folder, "d", b"d", 5)  # older than all others
    put(folder, "c", b"longer", 1002)  # changed without a new time
    assert files.refresh_cache(spark, str(folder), at) == 2
    assert names(files.cached_files(spark, at)) == {"b": b"B", "c": b"longer", "d": b"d"}
    os.remove(folder / "d")
    assert files.refresh_cache(spark, str(folder), at) == 0
    assert names(files.cached_files(spark, at)) == {"b": b"B", "c": b"longer"}
    monkeypatch.setattr(files, "BY_LIST", 1)  # more changed files than are read by name
    for name in "xyz":
        put(folder, name, name.encode(), 3000)
    assert files.refresh_cache(spark, str(folder), at) == 3
    assert set(names(files.cached_files(spark, at))) == set("bcxyz")


def test_a_refresh_that_fails_leaves_the_cache(spark, tmp_path, monkeypatch):
    folder, at = tmp_path / "files", f"{tmp_path}/cache"
    folder.mkdir()
    put(folder, "a", b"a", 1000)
    files.refresh_cache(spark, str(folder), at)
    put(folder, "a", b"A", 2000)
    whole, calls = type(spark.range(1).write).parquet, []

    def parquet(self, path, *args, **kwargs):
        calls.append(path)
        if "manifest" in path:
            raise OSError("lost")
        return whole(self, path, *args, **kwargs)

    monkeypatch.setattr(type(spark.range(1).write), "parquet", parquet)
    with pytest.raises(OSError):
        files.refresh_cache(spark, str(folder), at)
    monkeypatch.undo()
    assert len(calls) == 2 and names(files.cached_files(spark, at)) == {"a": b"a"}
    assert files.refresh_cache(spark, str(folder), at) == 1 and names(files.cached_files(spark, at)) == {"a": b"A"}


def test_a_sink_writes_all_files_or_none(spark, tmp_path):
    folder = tmp_path / "a folder"
    rows = [(f"{k % 3}/{k}.bin", bytes([k, 0, 255])) for k in range(20)] + [("empty", None)]
    frame = spark.createDataFrame(rows, "name string, content binary").repartition(4)
    for place in (str(folder), f"file://{tmp_path}/by-uri"):
        files.write_files(frame, place)
        root = place.removeprefix("file://")
        found = {os.path.relpath(os.path.join(d, n), root): open(os.path.join(d, n), "rb").read() for d, _, names in os.walk(root) for n in names}
        assert {k: v for k, v in found.items() if not os.path.basename(k).startswith(".")} == {n: c or b"" for n, c in rows}
        assert not [d for d in os.listdir(root) if d.startswith("_staging")]
    bad = frame.withColumn("name", F.when(F.col("name") == "empty", F.raise_error(F.lit("lost")).cast("string")).otherwise(F.concat(F.lit("new/"), "name")))
    with pytest.raises(Exception, match="lost"):
        files.write_files(bad, str(folder))
    assert not (folder / "new").exists() and not [d for d in os.listdir(folder) if d.startswith("_staging")]
    with pytest.raises(Exception, match="outside"):
        files.write_files(spark.createDataFrame([("../out", b"x"), ("in", b"y")], "name string, content binary"), str(folder))
    assert not (tmp_path / "out").exists() and not (folder / "in").exists()

"""Operators on small tables made for them: files, sinks, streams of events, argument checks, awkward rows."""

import math
import os

import pytest
from pyspark.sql import functions as F

from folioframe import api
from folioframe.content import container
from folioframe.functions import scalar
from folioframe.operators import draw, edits, layout, locate, ocr, pages, search, stores, streams
from folioframe.plans import views
from folioframe.sources import files
from folioframe.streaming import events


def lines_of(spark, texts, doc=1):
    rows = [(doc, 1, k, k, t, 72.0, 752.0 - 18 * k) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, page_number long, line_idx long, row long, line string, x double, y double")


# ---- search ------------------------------------------------------------------------------------


@pytest.mark.parametrize("pattern", ["an", "a*", r"(a)\1", r"(?:b|c)+", "É", r"\.", "x$", r"(b)(c)?"])
def test_matches_equal_a_scan(spark, pattern):
    import re

    texts = ["banana", "xaaya", "bcbc é É.", "", "a.b.X", "tail x", "aa"]
    got = {(r.t, m.start, m.text) for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", scalar.matches(F.col("t"), pattern).alias("m")).collect() for m in r.m}
    assert got == {(t, m.start(), m[0]) for t in texts for m in re.finditer(f"(?i){pattern}", t) if m[0]}


def test_search_rejects_what_it_cannot_run(spark):
    lines = lines_of(spark, ["x"])
    for bad in ("", "(", "[a"):
        with pytest.raises(ValueError):
            search.find(lines, bad)


def test_recognised_text_is_searched_literally(spark):
    text, read = lines_of(spark, ["a.c", "abc"]), lines_of(spark, ["abc a.c"], doc=2)
    got = [(r.doc_id, r.source, r.text) for r in search.ordered(search.find_with_ocr(text, read, "a.c")).collect()]
    assert got == [(1, "text", "a.c"), (1, "text", "abc"), (2, "ocr", "a.c")]
    assert scalar.escape_regexp("a.c(d)*[e]") == r"a\.c\(d\)\*\[e\]"


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    assert value(scalar.truncate(F.lit("abcdef"), 4)) == "abc…" and value(scalar.truncate(F.lit("abcdef"), 4, True)) == "abcd…" and value(scalar.truncate(F.lit("abcd"), 4)) == "abcd"
    assert value(F.array_join(scalar.page_ranges(F.lit("99999999999, 2-99999999999,-3, 00004"), 5), ",")) == "2,3,4,5"
    assert value(scalar.file_size(F.lit(0).cast("long"))) == "0 Bytes" and value(scalar.file_size(F.lit(1536).cast("long"))) == "1.5 KB"
    assert value(scalar.hex_to_rgb(F.lit("red"))[0]) == 0 and value(scalar.normalize(F.lit(" a \t b "))) == "a b"


# ---- streams -----------------------------------------------------------------------------------


def test_every_character_survives(spark):
    texts = ["plain (x) \\", "é ÿ 100%", "Ж 漢字 – “q”", "😀 smile", ""]
    got = streams.runs(streams.page_streams(lines_of(spark, texts))).orderBy("ord").collect()
    assert [r.text for r in got] == texts and {r.font for r in got} == {"F1", "F2"}


def test_null_ids_and_streams(spark):
    s = spark.createDataFrame([(None, 1, b"BT (a) Tj ET"), (2**60 + 1, 1, None), (2**60 + 1, 2, b"BT (b) Tj ET")], "doc_id long, page_number long, contents binary")
    assert {(r.doc_id, r.text) for r in streams.runs(s).collect()} == {(None, "a"), (2**60 + 1, "b")}
    assert streams.eligible(streams.runs(s)).count() == 2 and streams.coverage(s).count() == 3
    upper = streams.runs(s, decode=lambda font, raw: raw.decode().upper())
    assert {r.text for r in upper.collect()} == {"A", "B"}
    kinds = {r.kind: r.str_value for r in streams.tokens(s.filter("page_number = 2")).collect()}
    assert set(kinds) == {"operator", "string"}


def test_edits_of_awkward_rows(spark):
    lines = views.boxed(lines_of(spark, ["first line", "second (line)", "third"]))
    e = lines.select("doc_id", "page_number", F.concat(F.lit("l"), "row").alias("id"), "line_idx", F.col("line").alias("original_text"), F.lit("new").alias("new_text"), "bx", "by", "bw", "bh", "size")
    lost = e.limit(1).withColumns({"page_number": F.lit(9).cast("long"), "id": F.lit("lost")})
    nothing = e.filter("row = 2").withColumns({"original_text": F.lit(None).cast("string"), "id": F.lit("null")}) if "row" in e.columns else e.filter("line_idx = 2").withColumns({"original_text": F.lit(None).cast("string"), "id": F.lit("null")})
    done = edits.apply(streams.page_streams(lines), e.filter("line_idx < 2").unionByName(lost).unionByName(nothing))
    found = {r.id: r.status for r in edits.outcomes(done).collect()}
    assert found == {"l0": "tj-surgery", "l1": "tj-surgery", "lost": "refused-no-content-stream", "null": "refused-locator-low-confidence"}
    assert [r.text for r in streams.runs(done.filter("contents is not null")).orderBy("ord").collect()] == ["new", "new", "third"]
    strict = {r.id: (r.path, r.why) for r in edits.bake(edits.outcomes(done), "strict").collect()}
    assert strict["lost"] == ("refused", "refused-no-content-stream: the page has no readable stream")
    blank = edits.bake(edits.outcomes(done), "legacy-only", F.col("id") == "l0")
    assert {r.id: r.path for r in blank.collect()}["l0"] == "refused"
    with pytest.raises(ValueError):
        edits.bake(done, "other")
    assert edits.apply(streams.page_streams(lines), e.limit(0)).count() == 0


def test_relational_and_paged_location_agree(spark):
    sf = "/root/testdata/sf0.001"
    s, e = streams.page_streams(views.lines(spark, sf)), views.edits(spark, sf)
    wanted = e.select("doc_id", "page_number", "id", F.expr("concat('x', substr(original_text, 2))").alias("text"), "bx", "by", "bw", "bh")
    near = {(r.doc_id, r.page_number, r.id): (r.ord, round(r.confidence, 9)) for r in locate.locate(wanted, streams.runs(s)).collect()}
    whole = {(r.doc_id, r.page_number, r.id): (r.runs[0] if r.runs else None, round(r.confidence, 9)) for r in locate.locate_on_pages(wanted, s).collect()}
    assert near == whole and len(near) > 900


def test_redraw_skips_blank_texts(spark):
    rows = spark.createDataFrame([(1, 1, "a", "  ", 0.0, 0.0, 1.0, 1.0, 10.0, None), (1, 1, "b", "t", 10.0, 100.0, 50.0, 12.0, 10.0, "#ff0000")], "doc_id long, page_number long, id string, new_text string, bx double, by double, bw double, bh double, size double, color string")
    got = edits.redraw(rows.withColumn("font", F.lit("Courier"))).collect()
    assert [(r.id, r.op, r.x, r.y, r.r) for r in got] == [("b", "box", 9.0, 679.0, 1.0), ("b", "text", 10.0, 682.0, 1.0)]


# ---- drawing and pages -------------------------------------------------------------------------


def test_drawings(spark):
    rows = [(1, 1, 1, "arrow", 10.0, 20.0, 30.0, 0.0, "#010203"), (1, 1, 2, "comment", 0.0, 0.0, 1.0, 1.0, None), (1, 1, 3, "freehand", 0.0, 0.0, 1.0, 1.0, None), (1, 1, 4, "stamp", 0.0, 0.0, 100.0, 20.0, "bad")]
    got = draw.draw_ops(spark.createDataFrame(rows, "doc_id long, page_number long, id long, type string, x double, y double, w double, h double, color string")).orderBy("id", "part").collect()
    assert [(r.id, r.op) for r in got] == [(1, "line")] * 3 + [(4, "stroke"), (4, "text")]
    assert got[0].x2 == 40 and got[0].y2 == 772 and got[1].x2 == pytest.approx(40 - 10 * math.cos(math.pi / 6)) and got[0].b == pytest.approx(3 / 255)
    assert got[4].text == "STAMP" and got[4].rotate == -15 and got[4].x == 35


def test_images_raise_or_skip(spark):
    rows = spark.createDataFrame([("data:image/png;base64,QUI=",), ("data:image/gif;base64,QUI=",), (None,)], "data string")
    assert [(r.format, r.bytes) for r in draw.images(rows).collect()] == [("png", b"AB"), (None, None), (None, None)]
    with pytest.raises(Exception, match="PNG and JPEG"):
        draw.images(rows, "error").collect()


def test_page_lists(spark):
    p = spark.range(1, 5).select(F.lit(7).cast("long").alias("doc_id"), F.col("id").alias("page_number"))
    listed = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    assert listed(pages.select_pages(p, [4, 1, 4, 9]), "new_page", "page_number") == [(1, 4), (2, 1), (3, 4)]
    assert listed(pages.select_pages(p, []), "new_page") == []
    assert listed(pages.split(p, [[3, 0], [], [9, 1]]), "part", "new_page", "page_number") == [(1, 1, 4), (1, 2, 1), (3, 2, 2)]
    for a in range(1, 5):
        for b in range(1, 5):
            want = [1, 2, 3, 4]
            want.remove(a)
            want.insert(b - 1, a)
            assert [x for _, x in listed(pages.drag(p, a, b), "new_page", "page_number")] == want


# ---- stores ------------------------------------------------------------------------------------


def test_stores(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (None, "n", 0.0)], "id long, type string, x double")
    patch = spark.createDataFrame([(1, "p", None, 1), (1, "q", 5.0, 2), (1, None, None, 3), (9, "z", 1.0, 1)], "id long, type string, x double, seq long")
    assert sorted((r.id or 0, r.type, r.x) for r in stores.update(rows, patch, ["id"], ["type", "x"]).collect()) == [(0, "n", 0.0), (1, "q", 5.0), (2, "b", 2.0)]
    changes = spark.createDataFrame([(2, "u", 0.0, 5), (2, "t", 9.0, 5), (3, "new", 1.0, 1)], "id long, type string, x double, seq long")
    assert sorted((r.id or 0, r.type) for r in stores.upsert(rows, changes, ["id"]).collect()) == [(0, "n"), (1, "a"), (2, "u"), (3, "new")]
    bad = spark.createDataFrame([(1, "no json"), (2, None)], "doc_id long, json string")
    assert stores.from_sidecar(bad).count() == 0 and ocr.from_sidecar(bad).count() == 0


# ---- events ------------------------------------------------------------------------------------


def locked(rows, window, limit, lock):
    state, out = {}, {}
    for key, i, t in sorted(rows, key=lambda r: (r[2], r[1])):
        recent, until = state.get(key, ([], -1e18))
        if t < until:
            out[i] = (False, False)
            continue
        recent = [x for x in recent if t - x < window] + [t]
        full = len(recent) >= limit
        state[key] = (recent, t + lock if full else until)
        out[i] = (True, full)
    return out


def test_lockout_of_null_keys(spark):
    import random

    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 2**60 + 1]), i, rng.randrange(2000)) for i in range(300)]
    df = spark.createDataFrame([(k, i, float(t)) for k, i, t in rows], "key long, id long, s double").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: (r.recorded, r.locked) for r in events.lockout(df, "key", "ts", 60, 5, 30).collect()}
    assert got == locked(rows, 60, 5, 30) and any(x for _, x in got.values())


def streamed(spark, folder, batches, schema):
    """A stream of one file a batch, in order, whose column s gives the moment ts."""
    for k, part in enumerate(batches):
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.parquet(f"{folder}/{k}")
        os.utime(next(p for p in (folder / str(k)).glob("*.parquet")), (1000 + k, 1000 + k))
    return spark.readStream.schema(f"{schema}, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def ran(df, folder, name="out"):
    query = df.writeStream.format("parquet").option("checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True).start(f"{folder}/{name}")
    query.awaitTermination(180)
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}").collect()


KEYED = "key long, id long, s double"


def test_lockout_as_a_stream(spark, tmp_path):
    import random

    rng = random.Random(4)
    rows = sorted([(rng.choice([None, 0, 1, 2]), i, float(rng.randrange(3000))) for i in range(200)], key=lambda r: (r[2], r[1]))
    rows.append((7, 900, 90_000.0))  # long after: the locks and windows of all others have ended
    source = streamed(spark, tmp_path / "in", [rows[:70], rows[70:71], rows[71:200], rows[200:]], KEYED)
    got = {r.id: (r.recorded, r.locked) for r in ran(events.lockout_stream(source, "key", "ts", 60, 5, 30), tmp_path)}
    assert got == locked(rows, 60, 5, 30) and any(x for _, x in got.values())
    held = spark.read.format("statestore").option("stateVarName", "held").load(f"{tmp_path}/out-state").collect()
    assert [r["key"]["key"] for r in held] == [7]


def test_late_failures_are_dropped_by_the_watermark(spark, tmp_path):
    source = streamed(spark, tmp_path / "in", [[(1, 1, 1000.0)], [(1, 2, 5000.0)], [(1, 3, 6000.0)], [(1, 4, 1001.0), (1, 5, 4990.0)]], KEYED)
    assert {r.id for r in ran(events.lockout_stream(source, "key", "ts", 60, 5, 30, "30 seconds"), tmp_path)} == {1, 2, 3, 5}


def test_latest_as_a_stream(spark, tmp_path):
    rows = [(1, 1, 10.0), (1, 2, 20.0), (2, 3, 15.0), (1, 4, 18.0), (None, 5, 20.0), (None, 6, 20.0), (1, 7, 30.0), (0, 8, 30.0), (2, 9, 31.0)]
    source = streamed(spark, tmp_path / "in", [rows[:3], rows[3:4], rows[4:7], rows[7:]], KEYED)
    got = [tuple(r) for r in ran(events.latest_stream(source, "key", "ts", "id"), tmp_path)]
    batch = spark.createDataFrame(rows, KEYED).withColumn("ts", F.timestamp_seconds("s"))
    want = {(r.key, r.id): r.state for r in events.latest(batch, "key", "ts", "id").collect()}
    cancelled = {(k, i) for k, i, state, _ in got if state == "cancelled"}
    assert {(k, i) for k, i, state, _ in got if state == "current"} == set(want)
    assert cancelled == {k for k, state in want.items() if state == "cancelled"}
    assert {(i, by) for _, i, state, by in got if state == "cancelled"} == {(1, 2), (4, 2), (2, 7), (5, 6), (3, 9)}


def test_requests_and_answers(spark, tmp_path):
    requests = [(1, 0.0), (2, 10.0), (3, 20.0), (4, 30.0), (5, 40.0), (None, 50.0)]
    answers = [(1, 5.0, "result"), (1, 6.0, "error"), (2, 75.0, "result"), (3, 21.0, "error"), (9, 22.0, "result"), (5, 39.0, "result"), (None, 51.0, "result")]
    ask = lambda df: df.select("id", F.col("ts").alias("at"))
    say = lambda df: df.select("id", F.col("ts").alias("answered_at"), "kind", F.lit("text").alias("payload"), F.lit(None).cast("string").alias("error"))
    moment = F.timestamp_seconds("s")
    requests, answers = [(i, s + 1000) for i, s in requests], [(i, s + 1000, k) for i, s, k in answers]
    a, b = spark.createDataFrame(requests, "id long, s double").withColumn("ts", moment), spark.createDataFrame(answers, "id long, s double, kind string").withColumn("ts", moment)
    want = {(1, "resolved", "text", None), (2, "rejected", None, "no answer in time"), (3, "rejected", None, "failed"), (4, "rejected", None, "no answer in time"), (5, "rejected", None, "no answer in time"), (None, "rejected", None, "no answer in time")}
    pick = lambda rows: {(r.id, r.state, r.payload, r.error) for r in rows}
    assert pick(events.answered(ask(a), say(b), "60 seconds").collect()) == want
    # over streams the same, once time has passed; a request behind the watermark is dropped
    left = streamed(spark, tmp_path / "q", [[requests[0], requests[2]], [requests[1], *requests[3:]], [(90, 5000.0)], [(91, 100.0), (92, 9000.0)], [(93, 20000.0)]], "id long, s double")
    right = streamed(spark, tmp_path / "a", [answers[:3], answers[3:], [(90, 5001.0, "result")], [(92, 9001.0, "error")], [(93, 20001.0, "result")]], "id long, s double, kind string")
    df = events.answered(ask(left.withWatermark("ts", "60 seconds")), say(right.withWatermark("ts", "60 seconds")), "60 seconds")
    got = pick(ran(df, tmp_path))
    assert got - {(93, "resolved", "text", None)} == want | {(90, "resolved", "text", None), (92, "rejected", None, "failed")}


def test_running_totals_survive_a_replay(spark, tmp_path):
    bakes = [[(1, "tj-surgery"), (1, "legacy"), (2, "refused")], [(1, "tj-surgery"), (1, "tj-surgery")]]
    at = str(tmp_path / "totals")
    for k, rows in enumerate(bakes):
        events.add_totals(spark.createDataFrame(rows, "doc_id long, path string"), k, at)
    want = {(1, 3, 1, 0), (2, 0, 0, 1)}
    assert {tuple(r) for r in events.running_totals(spark, at).collect()} == want
    events.add_totals(spark.createDataFrame(bakes[1], "doc_id long, path string"), 1, at)
    assert {tuple(r) for r in events.running_totals(spark, at).collect()} == want
    assert tuple(events.running_totals(spark, at, ()).first()) == (3, 1, 1)


def test_debounce_as_a_stream(spark, tmp_path):
    rows = [(1, 0.0, 1), (1, 5.0, 2), (1, 100.0, 3), (2, 3.0, 4), (9, 9999.0, 5)]
    df = spark.createDataFrame(rows, "key long, s double, value long").withColumn("ts", F.timestamp_seconds("s"))
    df.write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in").withWatermark("ts", "1 second")
    query = events.debounce(source, "key", "ts", "10 seconds", "value").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination(120)
    assert {(r.key, r.n, r.value) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {(1, 2, 2), (1, 1, 3), (2, 1, 4)}


def test_chunks_keep_empty_and_null_texts(spark):
    rows = [(1, "a  b c "), (2, ""), (3, None), (4, " ")]
    df = spark.createDataFrame(rows, "id long, text string")
    assert sorted(tuple(r) for r in events.reassembled(events.chunks(df, "text"), ["id"]).collect()) == rows


def test_generated_texts(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "id long, prompt string")

    def provider(prompts):
        return prompts.map(lambda p: None if p is None else p[::-1])

    import pandas as pd

    provider.__annotations__ = {"prompts": pd.Series, "return": pd.Series}
    assert {r.id: r.text for r in events.generate(df, provider).collect()} == {1: "cba", 2: None}


# ---- recognised text and layout ----------------------------------------------------------------


def test_only_poor_pages_are_recognised(spark):
    layer = spark.createDataFrame([(1, 1, "x" * 200), (1, 2, "short"), (1, 3, None)], "doc_id long, page_number long, text string")
    asked = []

    def recognise(rest):
        asked.extend(sorted(r.page_number for r in rest.collect()))
        return rest.select("doc_id", "page_number", F.lit(0).cast("long").alias("line_idx"), F.lit("read").alias("line"), F.lit(None).cast("double").alias("mean"), F.lit(None).cast("array<array<double>>").alias("box"))

    got = {r.page_number: (r.text[:4], r.confidence, len(r.words)) for r in ocr.recognised(layer, recognise).collect()}
    assert asked == [2, 3] and got == {1: ("xxxx", 1.0, 0), 2: ("read", 0.0, 1), 3: ("read", 0.0, 1)}


def test_wrapping():
    assert layout.width("iW é", 1000) == 222 + 944 + 278 + 556
    assert layout.wrap("aa bb cc\n\nd", 10, 30, fixed=600) == ["aa bb", "cc", "", "d"]
    assert layout.wrap("toolongword x", 10, 12, fixed=600) == ["toolongword", "x"] and layout.wrap("", 10, 10) == [""]
    assert layout.lines_per_page() == 49
    rows = layout.wrap("word " * 500, layout.SIZE, layout.WIDTH - 2 * layout.MARGIN)
    assert all(layout.width(r, layout.SIZE) <= layout.WIDTH - 2 * layout.MARGIN for r in rows) and " ".join(rows).split() == ["word"] * 500


# ---- files -------------------------------------------------------------------------------------


def test_a_folder_of_documents(spark, tmp_path):
    folder = tmp_path / "lib"
    (folder / "sub").mkdir(parents=True)
    for name, at in (("old.pdf", 1000), ("new.PDF", 2000), ("note.txt", 3000), ("broken.pdf", 1500)):
        body = b"junk" if name != "old.pdf" else container.write([container.PageToWrite(b"BT /F1 12 Tf 72 700 Td (the line) Tj ET"), container.PageToWrite(b"")], {"Title": "T"})
        (folder / name).write_bytes(body)
        os.utime(folder / name, (at, at))
    (folder / "sub" / "deep.pdf").write_bytes(b"x")
    assert [r.name for r in files.library(spark, str(folder)).collect()] == ["new.PDF", "broken.pdf", "old.pdf"]
    assert files.file_info(spark, f"{folder}/note.txt").first().size == 4
    with pytest.raises(FileNotFoundError):
        files.file_info(spark, f"{folder}/absent")
    every = files.read_bytes(spark, str(folder))
    info = {os.path.basename(r.path): (r.page_count, r.title, r.error is None) for r in files.document_info(every).collect()}
    assert info["old.pdf"] == (2, "T", True) and info["broken.pdf"][2] is False
    read = files.document_pages(every).select("path", "page_number", F.posexplode("parts").alias("part", "contents")).withColumn("doc_id", F.lit(1).cast("long"))
    assert [r.text for r in streams.runs(streams.join_parts(read)).collect()] == ["the line"]


def test_companions_and_sinks(spark, tmp_path):
    folder = f"{tmp_path}/lib"
    notes = spark.createDataFrame([("a", 1, 1, "note", 1.0, 2.0, 3.0, 4.0)], "doc_id string, page_number long, id long, type string, x double, y double, w double, h double")
    side = stores.to_sidecar(notes, pretty=True)
    files.write_files(side.select(F.concat("doc_id", F.lit(".annotations.json")).alias("name"), F.encode("json", "UTF-8").alias("content")), folder)
    files.write_text(spark.createDataFrame([("a.pdf", "x"), ("b.pdf", "y"), ("c.ocr.json", "no json"), ("c.pdf", "z")], "name string, text string"), folder)
    assert "\n" in open(f"{folder}/a.annotations.json").read() and open(f"{folder}/b.pdf").read() == "y"
    held = files.read_bytes(spark, folder)
    docs = held.filter(F.col("path").endswith(".pdf"))
    assert files.companions(docs, held, files.ANNOTATIONS).filter("json is null").count() == 2
    got = files.load_annotations(docs, held).collect()
    assert len(got) == 1 and got[0].id == 1 and got[0].doc_id.endswith("a.pdf") and files.load_recognised(docs, held).count() == 0
    with pytest.raises(Exception, match="outside"):
        files.write_text(spark.createDataFrame([("../out.txt", "x")], "name string, text string"), folder)
    files.write_lines(spark.createDataFrame([("a",), ("b",)], "line string"), f"{tmp_path}/lines")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/lines").collect()) == ["a", "b"]


def test_drawings_become_files(spark):
    ops = draw.draw_ops(spark.createDataFrame([(1, 1, 1, "highlight", 1.0, 2.0, 3.0, 4.0), (1, 1, 2, "circle", 1.0, 2.0, 3.0, 4.0), (1, 1, 3, "stamp", 1.0, 2.0, 3.0, 4.0)], "doc_id long, page_number long, id long, type string, x double, y double, w double, h double"))
    content = files.to_files(files.drawn_pages(ops.withColumns({"path": F.lit("x.pdf"), "position": F.col("id") * 10 + F.col("part")}))).first().content
    d = container.Document(content)
    said = d.contents(d.pages()[0])[0]
    assert b"re f" in said and said.count(b" c") == 4 and b"(STAMP) Tj" in said and d.info()["page_count"] == 1


# ---- the library -------------------------------------------------------------------------------


def test_library(spark):
    sf = "/root/testdata/sf0.001"
    lines = views.lines(spark, sf)
    lib = api.Library(spark, views.pages(spark, sf), lines, streams.page_streams(lines), views.annotations(spark, sf), views.ocr_lines(spark, sf))
    assert lib.search("the", doc_id=3).count() > 0 and lib.page_text(1, 3).count() > 0
    assert lib.extract_pages([1, 1]).count() == 2 * lib.page_counts().count() and lib.split(ranges=[(1, 2)]).count() >= 200
    changed, found = lib.bake(views.edits(spark, sf).filter("doc_id < 20"), "strict")
    assert found.filter("path = 'tj-surgery'").count() > 0 and changed.count() > 0
    for wrong in (lambda: lib.page_text(0), lambda: lib.page_text("1"), lambda: lib.rotate_page(1, 45), lambda: lib.bake(lines), lambda: lib.generate(lines, None), lambda: lib.delete_page(True)):
        with pytest.raises(ValueError):
            wrong()
    assert lib.transcript().count() == lib.ocr_results().select("doc_id").distinct().count()


def test_empty_tables(spark):
    lines = lines_of(spark, ["x"]).limit(0)
    s = streams.page_streams(lines)
    for df in (search.find(lines, "x"), s, streams.runs(s), streams.events(s), streams.problems(s), streams.token_kinds(s), streams.coverage(s)):
        assert df.count() == 0

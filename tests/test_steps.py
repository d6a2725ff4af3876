"""Work and memory of the shared steps: what grows with a page, a batch or a table, and what must not."""

import random
import re

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from folioframe import catalog
from folioframe.content import container, engine, surgery
from folioframe.functions import scalar
from folioframe.operators import _arrow, locate, streams
from folioframe.plans import views
from folioframe.sources import files


def page(lines, words):
    shown = lambda k: b" ".join(b"(w%d_%d ) Tj" % (k, j) for j in range(words))
    return b"\n".join(b"BT /F1 12 Tf 72 %d Td " % (752 - 18 * k) + shown(k) + b" ET" for k in range(lines))


def test_common_forms_are_replayed_without_tokens(monkeypatch):
    made, plain = [], engine.tokens
    monkeypatch.setattr(engine, "tokens", lambda *a: (made.append(t) or t for t in plain(*a)))
    runs = engine.Interpreter().run(page(3, 500)).runs
    assert len(runs) == 1500 and len(made) < 3 * 12
    made.clear()
    assert len(engine.Interpreter().run(page(40, 1)).runs) == 40 and not made


def test_common_forms_are_replayed_as_by_tokens(monkeypatch):
    texts = [rb"BT /F1 12 Tf -3 .5 Td (a\)\n\101) Tj ET q 2 0 0 2 1 1 cm BT /F2 9 Tf 1 2 Td <4142>Tj ET Q", b"BT /F 1 Tf (a(b) c) Tj (d)Tj(e) Tjx <4Z> Tj <4> Tj ET", b"BT /F#31 1 Tf 0 0 Td (x) Tj ET (y) Tj", b"[BT /F 1 Tf 0 0 Td (x) Tj ET] TJ 5 (x) Tj", page(3, 4)]
    ahead = [engine.Interpreter().run(t) for t in texts]
    monkeypatch.setattr(engine.Interpreter, "_ahead", lambda self, data, at: at)
    assert [engine.Interpreter().run(t) for t in texts] == ahead


def test_a_target_is_held_against_the_runs_of_its_height(monkeypatch):
    asked, near = [], surgery.near
    monkeypatch.setattr(surgery, "near", lambda run, *a: asked.append(run) or near(run, *a))
    text = lambda k, new="": "".join(f"{new}w{k}_{j} " for j in range(50))
    edits = [surgery.Edit(text(k), text(k, "n"), surgery.Box(72.0, 31.0 + 18 * k, 100.0, 13.2), 12.0) for k in range(40)]
    table = {"F1": surgery.fonts.resolve("Helvetica", "Type1", "WinAnsiEncoding")}
    done, said = surgery.edit_page(page(40, 50), edits, table)
    assert {o.status for o in said} == {surgery.APPLIED} and done.count(b"nw") == 2000
    assert len(asked) <= 40 * 2 * 50  # 80,000 before


def test_texts_that_share_too_few_parts_are_not_compared(monkeypatch):
    asked, distance = [], surgery.distance
    monkeypatch.setattr(surgery, "distance", lambda *a: asked.append(a) or distance(*a))
    rng = random.Random(4)
    said = ["".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(40)]
    runs = surgery.Shown([engine.Run(t, "Tj", 72.0, 752.0 - 18 * k, "F1", 12.0, [(0, 1, False)], [], (0.0, 0.0, 0.0)) for k, t in enumerate(said)])
    found = [surgery.locate(runs, t[:100] + t[110:], None).runs for t in said]
    assert found == [[k] for k in range(40)] and len(asked) <= 50  # 1,600 before


def test_texts_within_an_edit_distance_share_parts():
    rng = random.Random(3)
    for _ in range(3000):
        a = "".join(rng.choice("ab c") for _ in range(rng.randrange(40)))
        b = list(a)
        for _ in range(rng.randrange(9)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "a", "b", " ", "cc"])
        far = surgery.distance(a, "".join(b))
        assert surgery.may_be_within(a, "".join(b), far) and surgery.may_be_within(a, "".join(b), far + 2)
    assert not surgery.may_be_within("abc" * 50, "abd" * 50, 20)


def test_confidence_halfway_between_two_steps_is_rounded_up(spark, tmp_path):
    text = "In the " + "w" * 3196
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    row = catalog.Q["locate_unplaced"](spark, str(tmp_path)).collect()
    assert [(r["ord"], r["confidence"]) for r in row] == [(0, 0.849063)]  # 0.849062 before


def test_pages_are_cut_before_the_shuffle_and_say_what_their_lines_say(spark, tmp_path):
    long_ = "\n".join(f"line {k} Ж" if k % 7 == 0 else f"line {k} (a)" for k in range(95))
    rows = [(1, long_), (2, ""), (3, None), (4, "a\n"), (5, "\n" * 80), (6, "later\nb"), (6, "early\n\nd"), (7, "\n".join("x" * 40))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    lines = views.lines(spark, str(tmp_path))
    for apart in (False, True):
        whole = streams.text_streams(views.page_texts(spark, str(tmp_path)), apart)
        assert sorted(whole.collect()) == sorted(streams.page_streams(lines, apart).collect())
    counted = lines.groupBy("doc_id", "page_number").agg(F.count(F.lit(1)).alias("n_lines")).withColumn("rotation", F.lit(0))
    assert sorted(views.pages(spark, str(tmp_path)).collect()) == sorted(counted.collect()) and counted.count() == 10
    for name in ("stream_problems", "documents_modified"):  # lines of streams and fonts went through the shuffle one by one before
        plan = catalog.Q[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("posexplode") == (name == "documents_modified")  # its edits are lines


def test_a_batch_is_taken_apart_by_and_by(spark):
    class Rows:
        def mapInArrow(self, run, schema):
            return run

    seen = []
    run = _arrow.map_rows(Rows(), lambda n: seen.append(n) or [(n, b"x" * 1000)], "n long, held binary")
    parts = run(iter([pa.record_batch({"n": list(range(3000))})]))
    next(parts)
    assert len(seen) <= _arrow.IN_ROWS
    assert sum(p.num_rows for p in parts) + len(seen[: _arrow.IN_ROWS]) == 3000 and seen == list(range(3000))


def test_words_by_themselves_are_replayed_without_tokens(monkeypatch):
    data = b"\n".join(b"q %d 0 0 rg BT /F2 12 Tf %d 700 Td <00410042> Tj ET Q" % (k % 2, k) for k in range(500))
    made, plain = [], engine.tokens
    monkeypatch.setattr(engine, "tokens", lambda *a: (made.append(t) or t for t in plain(*a)))
    runs = engine.Interpreter().run(data + b" Q q 1 2 3 rg").runs
    assert [r.fill[0] for r in runs] == [0.0, 1.0] * 250 and [t.value for t in made] == ["Q"]


def test_a_page_of_words_needs_one_shuffle_of_lines(spark):
    rows = [(1, n, t, 1, n, 72.0, 752.0 - 18 * n) for n, t in enumerate(["a  b\tcé dd", "", " 😀 x ", "one", "  y"])]
    lines = spark.createDataFrame(rows, "doc_id long, line_idx long, line string, page_number long, row long, x double, y double")
    made = views.word_streams(lines)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = streams.runs(made).collect()
    want = views.placed_words(lines).orderBy(F.desc("line_idx"), F.desc("pos")).collect()
    assert [(r.text, r.x, r.y, r.fill.r, r.fill.g) for r in got] == [(w.text, w.x, w.y, w.fill.r, w.fill.g) for w in want]


def test_strings_are_written_and_read_by_their_distinct_characters():
    every = bytes(range(256)) + b"\\\\((\\)\n\\053"
    assert engine.literal_bytes(engine.literal(every)[1:-1]) == every
    assert engine.literal(b"a\\(b)\n\x00\xe4") == b"(a\\\\\\(b\\)\\n\\000\\344)"
    assert not hasattr(engine, "_SPECIAL")  # a pattern that stopped at every character before


def test_streams_are_built_in_the_pass_that_locates(spark, tmp_path):
    rows = [(1, "\n".join(f"the line {k % 30}" for k in range(95))), (2, "the end"), (2, "on the way\nthe end"), (3, None), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    texts = views.page_texts(spark, str(tmp_path))
    e = views.edits(spark, str(tmp_path)).select("doc_id", "page_number", "id", F.col("original_text").alias("text"), *[F.lit(None).cast("double").alias(c) for c in ("bx", "by", "bw", "bh")])
    wanted = e.unionByName(e.filter("doc_id = 2").withColumn("page_number", F.lit(9).cast("long")))
    later, built = (sorted(locate.locate_on_pages(wanted, s).collect()) for s in (streams.unbuilt(texts), streams.text_streams(texts)))
    assert later == built and len(later) == 95 + 2 * 3 and sum(r.stream_size == 0 for r in later) == 3
    assert sorted(streams.runs(streams.unbuilt(texts)).collect()) == sorted(streams.runs(streams.text_streams(texts)).collect())
    plan = catalog.Q["locate_anywhere"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1  # 2 before, with whole streams through a second shuffle


def test_files_are_written_in_the_pass_that_reads_them(spark, tmp_path):
    rows = [(k, "\n".join(f"line {j} of {k} obj" for j in range(k * 7))) for k in range(12)] + [(3, "obj")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    pages = streams.text_streams(views.page_texts(spark, str(tmp_path))).select(F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), "page_number", "contents", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))
    q = catalog.Q["document_files"](spark, str(tmp_path))
    assert sorted(q.collect()) == sorted(files.document_info(files.to_files(pages)).select("path", "page_count", "title").collect())
    assert q._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # 3 before


def test_objects_are_found_by_their_marks():
    data = b"1 0 obj a endobj x1 obj 2\n" + b" " * 90 + b"0  obj b 33 44 55 obj 6 7 objx 12345678901234567890123456789012345678 0 obj"
    old = re.compile(rb"(\d+)\s+(\d+)\s+obj\b")
    assert container._objects(data) == [(int(m[1]), m.start(), m.end()) for m in old.finditer(data)]
    file = container.write([container.PageToWrite(b"q Q")])
    container._kept.cache_clear()
    assert [container.Document(file).info()["page_count"] for _ in range(3)] == [1, 1, 1]
    assert container._kept.cache_info().misses <= 8  # every object of every file was read anew before


def test_outcomes_alone_need_no_new_bytes(spark, tmp_path, monkeypatch):
    rows = [(k, "\n".join(f"the line {j} of {k}" for j in range(50))) for k in range(1, 12)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = catalog.Q["documents_modified"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "contents" not in plan  # 2 before, with whole streams through a second shuffle and out of the last pass
    e = surgery.Edit("abc", "abd", surgery.Box(72.0, 31.0, 100.0, 13.2), 12.0)
    table, data = {"F1": surgery.fonts.resolve("Helvetica", "Type1", "WinAnsiEncoding")}, b"BT /F1 12 Tf 72 752 Td (abc) Tj ET"
    (new, said), (none, alike) = surgery.edit_page(data, [e], table), surgery.edit_page(data, [e], table, splice=False)
    assert b"(abd)" in new and none is None and said == alike and said[0].status == surgery.APPLIED
    assert table["F1"].missing("aΩbЖΩ") == ["Ω", "Ж"] and table["F1"].missing("ab ") == []


def test_nested_values_of_a_batch_are_taken_by_columns():
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.list_(pa.struct([("c", pa.binary())])))]))
    given = [None, [], [None, {"a": None, "b": None}, {"a": 3, "b": [{"c": b"x"}, None, {"c": None}]}], [{"a": 4, "b": []}]] * 3
    column = pa.array(given, kind)
    assert [_arrow.values(column.slice(k)) for k in range(12)] == [given[k:] for k in range(12)]


def test_a_run_stands_once_and_any_box_is_reached(spark):
    edge = (-1e300, -5.0, 0.0, 191.9, 192.0, 700.0, 1e5, 1e300)
    boxes = [(1, 1, f"{a}{b}", a, b, c, d) for a in edge for b in edge for c, d in ((-1e300, 1e300), (71.0, 73.0), (1e4, 1e5))]
    dots = [(1, 1, k, x, y) for k, (x, y) in enumerate((x, y) for x in edge for y in (-9.0, 72.0, 2e4))]
    t = spark.createDataFrame(boxes, "doc_id long, page_number long, id string, low_x double, high_x double, low_y double, high_y double")
    found = locate.in_reach(t, spark.createDataFrame(dots, "doc_id long, page_number long, ord long, x double, y double"))
    got = sorted((r.id, r.ord) for r in found.collect())  # numbers of cells overflowed before
    assert got == sorted((i, k) for _, _, i, a, b, c, d in boxes for _, _, k, x, y in dots if a <= x <= b and c <= y <= d)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("explode") == 2  # of targets alone; of runs too before


def test_distances_of_one_line_are_all_taken_by_bit_vectors(spark, tmp_path):
    rows = [(1, "the  end\n  the\tcat sat \nthe cat sat on the mat\nthe\n \nthe" + " x" * 300), (2, "a thing"), (3, "in the open")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    con.execute("CREATE TABLE events (event_id BIGINT, user_id BIGINT, event_type VARCHAR, ts TIMESTAMP, props VARCHAR)")
    for name in ("locate_exact", "locate_fuzzy"):
        df = catalog.Q[name](spark, str(tmp_path))
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "levenshtein" not in plan and "Window" not in plan and plan.count("MapInArrow") == 1  # texts went through the window's shuffle before
        assert sorted(map(tuple, df.collect()), key=repr) == sorted(con.execute(catalog.SQL[name]).fetchall(), key=repr)


def test_white_space_is_evened_out_as_before(spark):
    texts = ["", " ", "a b", "a  b", "\ta  b ", "a \n b c", "\u0085x\u001cy", " a b ", "a\tb"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    both = df.select(scalar.normalize(F.col("s")), F.trim(F.regexp_replace("s", r"(?U)\s+", " "))).collect()
    assert all(a == b for a, b in both)
    assert [surgery.distance_within("the end", t, 2) for t in ("e end", "the end")] == [2, 0] and surgery.distance_within("the end" * 9, "xyz" * 21, 2) is None


def test_texts_become_files_in_one_last_pass(spark, tmp_path):
    rows = [(3 * k, "\n".join(f"words {'and more ' * (j % 30)}of {k}" for j in range(k * 20))) for k in range(9)] + [(6, "later\nb"), (6, "early\n\nd"), (9, None), (4, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    apart = views.ocr_lines(spark, str(tmp_path)).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "line"))), lambda r: r["line"]), "\n").alias("text"))
    texts = views.ocr_texts(spark, str(tmp_path))
    assert sorted(texts.collect()) == sorted(apart.collect())
    q = catalog.Q["text_files"](spark, str(tmp_path))
    written = files.document_info(files.text_files(apart, fixed=562.5)).select("path", "page_count")
    assert sorted(q.collect()) == sorted(written.collect()) and q.count() == 9
    plan = q._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "posexplode" not in plan  # 4 before, of which two in one task


def test_words_are_built_and_replayed_in_one_pass(spark, tmp_path, monkeypatch):
    rows = [(1, "\n".join(f"a  b\tcé{k} dd 😀" if k % 3 else "" for k in range(95))), (2, ""), (3, None), (4, " \n\t"), (6, "later\nb c"), (6, "early\n\nd")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    whole, apart = streams.runs(views.unbuilt_words(views.page_texts(spark, str(tmp_path)))), streams.runs(views.word_streams(views.lines(spark, str(tmp_path))))
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, apart.collect())) and whole.count() > 95
    plan = catalog.Q["lines_from_runs"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "posexplode" not in plan  # 2 before, and a row a line in the shuffle
    data = b"\n".join(b"q 1 0 .5 rg BT /F2 12 Tf %d 700 Td <00410042> Tj ET Q" % k for k in range(50))
    seen, once = [], engine._GRAPHICS
    monkeypatch.setattr(engine, "_GRAPHICS", type("Counted", (), {"match": staticmethod(lambda *a: seen.append(a) or once.match(*a))}))
    assert [r.fill for r in engine.Interpreter().run(data).runs] == [(1.0, 0.0, 0.5)] * 50 and len(seen) == 1  # three a word before

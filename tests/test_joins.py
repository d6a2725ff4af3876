"""Joins by font, by ancestor, by place, by parts of a text and by an index, against plain loops."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from folioframe import catalog
from folioframe.content import fonts as tables
from folioframe.content import surgery
from folioframe.operators import fonts, locate, search, search_index

FONT = "font_key long, base_font string, subtype string, encoding string, entries array<struct<code:int,glyph:string>>, to_unicode string"
CMAP = "2 beginbfchar <0000> <0041> <D801> <0042> endbfchar 2 beginbfrange <0020> <007E> <0020> <0100> <0101> [<00660069> <0043>] endbfrange"


def kinds():
    return [
        (1, "Helvetica", "Type1", "WinAnsiEncoding", [], None), (2, "ABCDEF+Odd", "TrueType", None, [(0, None), (None, "A"), (None, "eacute"), (65, None), (None, "nosuchglyph")], None),
        (3, "ABCDEF+Wide", "Type0", "Identity-H", [], CMAP), (4, "Bare", "Type0", "Identity-H", [], None), (5, "Mac", "MMType1", "MacRomanEncoding", [], None), (6, None, None, None, None, None), (7, "Type3", "Type3", None, [], None),
    ]


def resolved(row):
    entries = [g if c is None else c for c, g in row[4] or ()]
    return tables.resolve(row[1] or "", row[2] or "", row[3], entries, row[5])


def test_texts_in_fonts_against_the_rows(spark):
    rng = random.Random(7)
    table = spark.createDataFrame(kinds(), FONT)
    letters = "ABC abcé€漢’Ω\U0001f600fi~"
    texts = ["", None, "A", "fi", *("".join(rng.choice(letters) for _ in range(rng.randrange(1, 12))) for _ in range(30))]
    rows = [(k * 100 + n, t, *kind[1:]) for n, t in enumerate(texts) for k, kind in enumerate(kinds())]
    df = spark.createDataFrame(rows, "id long, text string, " + FONT.split(", ", 1)[1])
    got = {r.id: r for r in fonts.encoded(df).collect()}
    assert len(got) == len(rows)
    for row in rows:
        f, r = resolved((None, *row[2:])), got[row[0]]
        raw, why = f.encode(row[1] or "")
        assert (None if r.bytes is None else bytes(r.bytes)) == raw and r.reason == why
        assert list(r.missing) == (f.missing(row[1] or "") if f.to_code else [])
        assert (r.is_subset, r.real_name) == (f.is_subset, f.real_name) and r.back == (None if raw is None else f.decode(raw))
    raws = [bytes(rng.randrange(256) for _ in range(rng.randrange(0, 9))) for _ in range(40)] + [b"\x00\x00\xd8\x01\x01\x00\x01\x01\x00A\x07"]
    shown = [(n, k[0], f"F{k[0]}", raw) for n, raw in enumerate(raws) for k in kinds()] + [(0, 99, "F1", b"\x80x"), (0, 1, "unknown", b"\x80x"), (0, 1, "F1", None)]
    named = spark.createDataFrame([(n, k[0], f"F{k[0]}", k[0]) for n in range(len(raws)) for k in kinds()], "doc_id long, page_number long, name string, font_key long")
    read = fonts.decoded_by_font(spark.createDataFrame(shown, "doc_id long, page_number long, font string, raw binary"), named, table).collect()
    assert len(read) == len(shown)
    by_key = {k[0]: resolved(k) for k in kinds()}
    for r in read:
        raw = None if r.raw is None else bytes(r.raw)
        want = None if raw is None else by_key[r.page_number].decode(raw) if r.font == f"F{r.page_number}" and r.page_number < 99 else raw.decode("latin-1")
        assert r.text == want


@pytest.mark.parametrize("depth", [1, 5, 64])
def test_nearest_ancestor_against_a_walk(spark, depth):
    rng = random.Random(depth)
    nodes, holders = [], []
    for doc in range(12):
        for n in range(30):
            nodes.append((doc, n, rng.choice([None, 99, *range(n)]) if doc % 3 else rng.randrange(30)))
            if rng.random() < 0.1:
                holders.append((doc, n))
    nodes += [(50, k, k + 1) for k in range(200)] + [(50, 200, None), nodes[0]]
    holders.append((50, 200))
    parent, held = {(d, n): p for d, n, p in nodes}, set(holders)

    def walk(doc, n):
        for _ in range(1 << depth.bit_length()):
            if (doc, n) in held:
                return n, False
            if (doc, n) not in parent:
                return None, False
            n = parent[doc, n]
        return None, n is not None

    got = {(r.doc_id, r.node): (r.holder, r.refused) for r in fonts.nearest_with(spark.createDataFrame(nodes, "doc_id long, node long, parent long"), spark.createDataFrame(holders, "doc_id long, node long"), depth).collect()}
    assert set(got) == set(parent)
    for key, (holder, refused) in got.items():
        assert (holder, refused) == walk(*key)
    assert any(r for _, r in got.values())


@pytest.mark.parametrize(
    "pattern,want",
    [
        ("tion", {"tio", "ion"}), ("TioN", {"tio", "ion"}), ("a.bcd", {"bcd"}), ("abc?de", set()), ("abcx?def", {"abc", "def"}), ("abcd+ef", {"abc", "bcd"}), ("abcd*efg", {"abc", "efg"}), ("ab{2}cde", {"cde"}),
        ("(abc)def", {"def"}), ("abc|def", set()), ("[abc]def", {"def"}), ("[abc|]def", {"def"}), (r"a\.bc", {"a.b", ".bc"}), (r"\bword\b", {"wor", "ord"}), (r"\x41xyz", {"xyz"}), (r"\p{L}bcd", {"bcd"}),
        (r"\Qa|b\E", set()), ("(?x)a b c", set()), ("éabc", {"abc"}), ("ab", set()), ("[a[b]c]def", set()), (r"abc\|def", {"abc", "bc|", "c|d", "|de", "def"}), ("abc{0,2}def", {"def"}), (r"\101xyz", {"xyz"}),
    ],
)
def test_trigrams_that_a_pattern_requires(pattern, want):
    assert search_index.required(pattern) == want


def test_indexed_search_finds_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(3)
    letters = "abcdeſK\u212aıİ É"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 30))) for _ in range(300)] + ["", None, "needle in a haystack", "NEEDLE needle", "Ta\u212ae it", "\x00abc", "ba(se)"]
    rows = [(None if k % 50 == 0 else k // 9, k // 40 + 1, k, t) for k, t in enumerate(texts)]
    lines = spark.createDataFrame(rows, "doc_id long, page_number long, line_idx long, line string")
    at = str(tmp_path / "index")
    search_index.build(lines, at)
    for pattern in ("needle", "abc", "a.?bcd", "take", "needle|take", "ss", "[a-c]{3}", r"a\(s", "(a)(b)\\2", "ebc?d", "absent words"):
        key = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
        assert key(search_index.find(spark, at, pattern)) == key(search.find(lines, pattern)), pattern
    with pytest.raises(ValueError):
        search_index.find(spark, at, "")


def test_indexed_search_reads_few_files(spark, tmp_path):
    """A rare pattern reads the buckets of its trigrams, and one part of the lines."""
    lines = spark.range(4000).selectExpr("id as doc_id", "1L as page_number", "0L as line_idx", "concat('line number ', id, if(id = 77, ' needle', '')) as line")
    at = str(tmp_path / "index")
    search_index.build(lines, at)
    found = search_index.find(spark, at, "needle")
    assert [r.doc_id for r in found.collect()] == [77]
    plan = found._jdf.queryExecution().executedPlan().toString()
    buckets = [len(b.split(",")) for b in re.findall(r"bucket#\d+ IN \(([\d,]+)\)", plan)]
    assert re.search(r"PartitionFilters: \[[^\]]*\(part#\d+ = \d+\)", plan) and (not buckets or max(buckets) <= 4)
    assert "PartitionFilters: [" in plan and "bucket#" in plan


def test_pairs_in_reach_against_all_pairs(spark):
    """A page of 10,000 runs, boxes of every size, edges included; each pair once."""
    rng = random.Random(5)
    spot = lambda: (float(rng.randrange(-50, 3000)) / 2, float(rng.randrange(-50, 3000)) / 2)
    runs = [(1, 1, k, *spot()) for k in range(10_000)] + [(1, 2, k, 96.0 * k, 24.0 * k) for k in range(5)] + [(1, 1, 10_000, None, 5.0), (None, 1, 1, 5.0, 5.0)]
    boxes = [(1, 1, f"t{k}", x, x + rng.choice([0, 7, 100, 400]), y, y + rng.choice([0, 3, 30, 800])) for k, (x, y) in enumerate(spot() for _ in range(150))]
    boxes += [(1, 2, "edge", 96.0, 192.0, 24.0, 48.0), (1, 1, "all", -1e6, 1e6, -1e6, 1e6), (1, 1, "none", 5.0, 4.0, 0.0, 9.0), (1, 1, "null", None, 4.0, 0.0, 9.0)]
    want = sorted((i, o) for d, p, i, a, b, c, e in boxes for d2, p2, o, x, y in runs if (d, p) == (d2, p2) and a is not None and x is not None and a <= x <= b and c <= y <= e)
    df = locate.in_reach(spark.createDataFrame(boxes, "doc_id long, page_number long, id string, low_x double, high_x double, low_y double, high_y double"), spark.createDataFrame(runs, "doc_id long, page_number long, ord long, x double, y double"))
    assert sorted((r.id, r.ord) for r in df.select("id", "ord").collect()) == want and len(want) > 10_000


def test_alike_texts_against_all_pairs(spark):
    """Every pair within the edits is there once, and of many words of a page few others are."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopé漢") for _ in range(n))
    said = ["", "a", "ab", "abc", "abcd", "abcde"] + [word(rng.randrange(1, 40)) for _ in range(250)] + [word(rng.randrange(60, 120)) for _ in range(30)]
    for t in rng.sample(said, 120):
        t = list(t)
        for _ in range(rng.randrange(0, 6)):
            p = rng.randrange(len(t) + 1)
            t[p : p + rng.choice([0, 1])] = rng.choice([[], ["x"], ["é"]])
        said.append("".join(t))
    allowed = lambda t: max(surgery.LEAST_EDITS, int(surgery.SHARE * len(t)))
    targets = spark.createDataFrame([(1, 1, f"{k}", t, len(t), allowed(t)) for k, t in enumerate(said)], "doc_id long, page_number long, id string, t string, n int, allowed int")
    runs = spark.createDataFrame([(1, 1, k, t) for k, t in enumerate(said)], "doc_id long, page_number long, ord long, r string")
    got = [(int(r.id), r.ord) for r in locate.alike(targets, runs).collect()]
    want = {(i, j) for i, t in enumerate(said) for j, r in enumerate(said) if t and abs(len(t) - len(r)) <= allowed(t) and surgery.distance(r, t) <= allowed(t)}
    assert len(got) == len(set(got)) and want <= set(got) and len(want) > len(said)
    by_length = sum(1 for t in said for r in said if t and abs(len(t) - len(r)) <= allowed(t))
    assert len(got) < by_length / 3


def test_unplaced_targets_take_the_nearest_run(spark):
    run = lambda k, text, y, form=False: (1, 1, k, text, 72.0, y, k, form)
    runs = spark.createDataFrame([run(0, "one two  three", 700.0), run(1, "one two thrxe", 650.0), run(2, "one two three", 600.0, True), run(3, "other words", 500.0)], "doc_id long, page_number long, ord long, text string, x double, y double, start long, in_xobject boolean")
    targets = spark.createDataFrame([(1, 1, "exact", "one two three"), (1, 1, "near", "ne two thrxe"), (1, 1, "far", "nothing like it"), (1, 1, "empty", ""), (1, 1, "null", None), (2, 1, "no page", "one two three")], "doc_id long, page_number long, id string, text string")
    got = {r.id: (r.ord, round(r.confidence, 6)) for r in locate.locate_anywhere(targets, runs).collect()}
    assert got == {"exact": (0, 0.85), "near": (1, round(0.85 - 1 / 12, 6)), "far": (None, 0.0), "empty": (None, 0.0), "null": (None, 0.0), "no page": (None, 0.0)}


def test_unplaced_lines_are_those_of_sql_where_another_run_is_nearer(spark, tmp_path):
    """``sthe.`` is nearer to the line ``Sthe.`` than to its own, ``the.`` to ``them`` than to its own, which is too far; two lines may be as near."""
    text = "Sthe.\nThsthe.\nWh the.\nthem\nIn the old house of the dean\nOn the old house of the dean\n😀😀the bar\nxthe\n\nthe"
    spark.createDataFrame([(1, text), (2, "the"), (3, None), (4, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    con.execute("CREATE VIEW events AS SELECT 1 AS event_id, 1 AS user_id, '' AS event_type, now() AS ts, '{}' AS props")
    want = con.execute(catalog.SQL["locate_unplaced"]).fetchall()
    got = catalog.Q["locate_unplaced"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and len(want) == 10


@pytest.mark.parametrize("many", [1000, 0])
def test_unplaced_targets_against_all_runs_of_their_page(spark, monkeypatch, many):
    """On pages of few and of many runs; of few, no pair goes through a join."""
    monkeypatch.setattr(locate, "MANY", many)
    rng = random.Random(6)
    said = ["".join(rng.choice("ab é😀") for _ in range(n)) for n in [*range(0, 30), 70, 71, 250, 251]]
    cut = lambda t: t[: rng.randrange(len(t) + 1)] + rng.choice(["", "b", "😀"]) + t[rng.randrange(len(t) + 1) :] if rng.random() < 0.3 else t[rng.randrange(3) :]
    want = [cut(t) for t in said] + ["zz" + said[-1][4:], "zz" + said[-3][5:]]
    runs = spark.createDataFrame([(1, 1, k, t, 72.0, 752.0 - 18 * k, k, False) for k, t in enumerate(said)], "doc_id long, page_number long, ord long, text string, x double, y double, start long, in_xobject boolean")
    targets = spark.createDataFrame([(1, 1, f"{k}", t) for k, t in enumerate(want)], "doc_id long, page_number long, id string, text string")
    asked, alike = [], locate.alike
    monkeypatch.setattr(locate, "alike", lambda t, r: asked.append((t, r)) or alike(t, r))
    got = {r.id: (r.ord, round(r.confidence, 9)) for r in locate.locate_anywhere(targets, runs).collect()}
    for k, t in enumerate(map(surgery.normalize, want)):
        d, at = min((surgery.distance(surgery.normalize(s), t), n) for n, s in enumerate(said))
        near = t and d <= max(2, int(0.15 * len(t)))
        assert got[f"{k}"] == ((at, round(0.85 if d == 0 else max(0.5, 0.85 - d / len(t)), 9)) if near else (None, 0.0)), (k, t)
    assert len(got) == len(want) and [bool(t.count()) for t, _ in asked] == [many == 0]


def test_an_index_has_a_row_a_trigram_and_block_of_lines(spark, tmp_path):
    texts = spark.range(0, 3000, 1, 2).selectExpr("id as doc_id", "1L as page_number", "0L as line_idx", "concat('the same words again, but ', id, if(id % 700 = 1, ' needle', '')) as line")
    at = str(tmp_path / "index")
    search_index.build(texts, at)
    rows, lines = spark.read.parquet(f"{at}/grams"), spark.read.parquet(f"{at}/lines")
    said = lines.select(F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit("(?=(.{3}))"), F.lit(1)))).alias("gram")).groupBy("gram").count()
    assert sorted(map(tuple, said.collect())) == sorted((r.gram, r.n) for r in spark.read.parquet(f"{at}/counts").collect())
    assert rows.count() < said.agg(F.sum("count")).first()[0] / 4  # as many before
    assert sorted(r.doc_id for r in search_index.find(spark, at, "needle").collect()) == [1, 701, 1401, 2101, 2801]

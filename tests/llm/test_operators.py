"""The training-data operators against brute force on small, awkward inputs."""

import hashlib
import random
import time
import tracemalloc
import zlib

import numpy as np
import pytest

from folioframe.llm import chat, decontaminate, licenses, packing, quality, sharding, simhash, suffixes, toxicity, vptree

DOCS = "doc_id long, text string, extra string, n_chars long"


def awkward(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "été", "niño", "omega"]
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts = [" ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(rng.randrange(1, 60))) for _ in range(30)]
    texts += [None, "", " ", "x", "Te " * 200, texts[0], texts[0], passage, "before " + passage + " after", passage[10:] + passage, "\n".join(texts[:3])]
    rows = [(i, t, "e", 0) for i, t in enumerate(texts)] + [(None, "no id " + passage, None, None), (5, texts[5], "e", 0)]
    return spark.createDataFrame(rows, DOCS)


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.TOKENIZER)
    docs = awkward(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    got = packing.pack(packing.pieces(docs, path, max_tokens=64), max_tokens=64).toPandas()
    plain = Tokenizer.from_file(path)
    want = 0
    for doc, text in docs.select("doc_id", "text").collect():
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 64)):
            part = np.array(ids[at : at + 64], dtype="<u4")
            row = got[(got.doc_id == doc) & (got.piece == k)].iloc[0]
            assert (row.start, row.length, row.ids_crc32) == (at, len(part), zlib.crc32(part.tobytes()))
            want += 1
    assert len(got) == want
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset.to_numpy() == np.r_[0, s.length.cumsum().to_numpy()[:-1]]).all() and s.length.sum() <= 64
    assert packing.pack(packing.pieces(docs.limit(0), path)).count() == 0


@pytest.mark.parametrize("rule", ["residual", "dot"])
def test_best_fit_respects_every_capacity(rule):
    rng = np.random.default_rng(1)
    size = np.sort(rng.integers(1, 50, 200).astype(float))[::-1]
    demand = np.stack([size, np.ones(200), size**2], axis=1)
    cap = np.array([100.0, 4.0, 4000.0])
    bins = packing.best_fit(demand, cap, np.array([1.0, 0.5, 0.5]), rule)
    for b in np.unique(bins):
        assert (demand[bins == b].sum(axis=0) <= cap).all()


def brute_repeats(docs, length):
    seen, out = set(), {}
    for doc, raw in docs:
        covered = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                covered[i : i + length] = b"\1" * length
            seen.add(w)
        out[doc] = bytes(covered)
    return out


def test_suffix_dedup(spark):
    docs = awkward(spark)
    got = {r.doc_id: r for r in suffixes.with_spans(docs, 100).select("doc_id", "text", "spans", "extra").collect()}
    order = sorted({(-1 if r.doc_id is None else r.doc_id): (r.text or "").encode() for r in docs.collect()}.items())
    for doc, covered in brute_repeats(order, 100).items():
        row = got[None if doc == -1 else doc]
        kept, removed, runs = suffixes.kept_parts((row.text or "").encode(), row.spans)
        assert removed == sum(covered)
        assert runs == len([x for x in covered.split(b"\0") if x])
        mine = b"".join((row.text or "").encode()[s:e] for s, e in kept)
        assert hashlib.sha256(mine).digest() == hashlib.sha256(bytes(c for c, x in zip((row.text or "").encode(), covered) if not x)).digest()


def test_rows_are_told_apart_by_content_not_by_key(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(14)
    text = lambda n=80: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage, item = text(30), text(20)
    rows = [(None, text()), (None, text()), (1, text()), (1, text()), (1, text() + passage), (2, passage + text()), (3, text())]
    rows += [(None, rows[2][1]), (4, rows[0][1]), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "web", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    content = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    # copies of one text: the row with a doc_id stays
    assert content(corpus_pipeline.drop_near_duplicates(spark, docs, "")) == sorted(rows[1:7] + rows[8:], key=repr)
    # only the later copy of the passage goes, and other rows of the same key keep every byte
    cut = content(corpus_pipeline.cut_repeats(spark, docs.filter("doc_id in (1, 2, 3)"), ""))
    assert cut == sorted([(i, t.removeprefix(passage) if i == 2 else t) for i, t in rows[2:7]], key=repr)
    twice = spark.createDataFrame([(1, passage + text()), (1, text()), (None, passage), (None, text())], "doc_id long, text string")
    left = {r.text: suffixes.kept_parts(r.text.encode(), r.spans)[1] for r in suffixes.with_spans(twice).collect()}
    assert sorted(left.values()) == [0, 0, 0, len(passage)]
    spark.createDataFrame([(9, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    bad = [(None, text() + item, "en", "web", 0), (1, item, "en", "web", 0)]
    assert content(corpus_pipeline.drop_contaminated(spark, docs.unionByName(spark.createDataFrame(bad, docs.schema)), str(tmp_path))) == sorted(rows, key=repr)


def test_merge_of_shards_equals_brute_force():
    rng = random.Random(5)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 40))).encode() for _ in range(40)]
    for shard in (10, 64, 10**6):
        block, string, at = suffixes.repeats(strings, 6, shard)
        got = {}
        for b, s, p in zip(block, string, at):
            got.setdefault(b, set()).add((int(s), int(p)))
        want = {}
        for s, x in enumerate(strings):
            for p in range(len(x) - 5):
                want.setdefault(x[p : p + 6], set()).add((s, p))
        assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_simhash(spark):
    docs = awkward(spark).filter("doc_id is not null")
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    prints = {r.doc_id: simhash.fingerprint(r.text) for r in docs.collect()}
    parent = {d: d for d in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {d: (p, root(d)) for d, p in prints.items()}


def test_near_duplicates_by_similarity(spark):
    rng, rows = random.Random(8), []
    for _ in range(40):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(60, 400))]
        for edits in (0, 1, 2, 4, 6, 9):
            copy = list(words)
            for at in rng.sample(range(len(copy)), edits):
                copy[at] = "edited"
            rows.append((len(rows), " ".join(copy), "clash"))
    rows += [(len(rows), None, ""), (len(rows) + 1, "", ""), (0, rows[0][1], ""), (len(rows) + 2, "one two", ""), (len(rows) + 3, "One  two", "")]
    sets = [(i, set(simhash.shingles(t, 5))) for i, t, _ in rows]
    least = {i: i for i, _ in sets}
    for _ in range(8):  # more rounds than any chain of copies is long
        for i, x in sets:
            for j, y in sets:
                if len(x & y) >= 0.8 * len(x | y):
                    least[i] = least[j] = min(least[i], least[j])
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, size=5, radius=20, keys=8).collect()}
    assert got == least
    assert len(set(least.values())) > 45


def test_groups_of_edited_copies_around_the_similarity(spark):
    """The groups are those of all pairs, whichever pair of two groups looks best."""
    rng, texts = random.Random(4), []
    for _ in range(3):
        base = [f"w{rng.randrange(4000)}" for _ in range(300)]
        for _ in range(150):
            copy = list(base)
            for at in rng.sample(range(len(copy)), rng.choice([3, 4, 5])):
                copy[at] = f"e{rng.randrange(4000)}"
            texts.append(" ".join(copy))
    sets = [np.unique(simhash.shingle_hashes(t, 5)) for t in texts]
    groups = simhash._Groups(len(sets))
    for i, x in enumerate(sets):
        for j in range(i):
            shared = len(np.intersect1d(x, sets[j], assume_unique=True))
            if shared >= 0.8 * (len(x) + len(sets[j]) - shared):
                groups.join(i, np.array([j]))
    assert 3 < len(set(groups.name)) < len(sets) // 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, size=5, radius=20, keys=8).collect()}
    assert got == dict(enumerate(groups.name.tolist()))


def test_equal_fingerprints_of_unlike_texts_do_not_link(spark):
    rng = random.Random(6)
    line = " ".join(f"b{k}" for k in range(7)) + " "
    texts = [line * 100 + " ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(6)]
    texts += [texts[0], line + texts[1]]  # an equal text, and one of the same shingle set
    assert len({simhash.fingerprint(t, 5) for t in texts}) == 1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, size=5, radius=20, keys=8).collect()}
    assert got == {**{i: i for i in range(6)}, 6: 0, 7: 1}


@pytest.mark.parametrize("radius", [0, 3, 7, 20])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 5, dtype=np.uint64)
    values = np.array([int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, radius + 5), replace=False)) for b in base for _ in range(60)], dtype=np.uint64)
    for sizes in ([300], [1] * 300, [1, 2, 3, 64, 65, 130, 35], [150, 1, 149]):
        cell = np.repeat(np.arange(len(sizes)), sizes)
        want = {(i, j) for j in range(300) for i in range(j) if cell[i] == cell[j] and (int(values[i]) ^ int(values[j])).bit_count() <= radius}
        got = [(int(x), int(y)) for a, b in simhash.near_pairs(values, cell, radius) for x, y in zip(a, b)]
        assert len(got) == len(set(got)) and set(got) == want
    assert list(simhash.near_pairs(values[:0], np.zeros(0, dtype=np.int64), radius)) == []


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    labels = {r.node: r.label for r in simhash.components(edges).collect()}
    assert len({labels[i] for i in range(61)}) == 1 and labels[100] == labels[101] != labels[0]


def test_stages_keep_columns_whose_names_clash(spark, tmp_path):
    """Every stage passes on columns of its own names untouched, and leaves no other scratch behind than its result."""
    import corpus_pipeline
    from folioframe.llm import _common

    rng = random.Random(15)
    text = lambda n=60: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage, item = text(30), text(20)
    texts = [text(), text(), passage + " " + text(), passage + text(), text() + " " + item, None, ""] + [text() + " rude" for _ in range(40)]
    extra = ["_row", "Spans", "_id", "_doc", "_h", "_g", "component_id", "row", "item_id", "label", "score", "first"]
    rows = [(k, t, "en", *[f"{name} {k}" for name in extra]) for k, t in enumerate([*texts, texts[0]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"{name} string" for name in extra))
    spark.createDataFrame([(9, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, 1, int(k >= 7)) for k in range(47)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    whole = {r[0]: r for r in rows}
    gone = {"simhash_near_dedup": {6, 47}, "benchmark_decontamination": {4}}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = set(_common._paths)
        left = _common.written(lambda: stage(spark, docs, str(tmp_path)), name)
        assert len(set(_common._paths) - before) == 1
        assert left.columns == docs.columns
        got = {r.doc_id: tuple(r) for r in left.collect()}
        assert all(v[2:] == whole[k][2:] for k, v in got.items())
        if name == "toxicity":
            assert {0, 1, 2, 3, 4, 5, 6} <= set(got)
        else:
            assert set(whole) - set(got) == gone.get(name, set())
        if name == "suffix_array_dedup":
            assert got[3][1] == texts[3].removeprefix(passage) and got[2][1] == texts[2] and got[5][1] is None
            assert got[47][1] == ""
        else:
            assert all(v[1] == whole[k][1] for k, v in got.items())


def test_contamination(spark):
    rng = random.Random(9)
    item = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(30))
    edited = item[:40] + "XX" + item[41:90] + item[92:]
    docs = spark.createDataFrame([(1, "clean " * 50), (2, "say " + item + " end"), (3, edited), (4, None), (5, ""), (None, item.upper()), (6, item[50:170])], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(2, 7), (3, 7), (None, 7), (6, 7)}


def test_contamination_is_charged_to_its_own_document(spark):
    rng = random.Random(10)
    item = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(13))
    texts = {0: "clean words " * 9, 1: item[1:], 2: "other words " * 9, 3: item[3:] + " and more of the text", 4: "words again " * 9, 5: item[:-1], 6: item[:-1] + "Z"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: (r.start, r.end) for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(got) == {1, 3, 5, 6}
    assert all(0 <= s < e <= len(texts[i]) for i, (s, e) in got.items())


def test_contamination_by_any_region_of_an_item(spark):
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    item = " ".join(word(6) for _ in range(40))
    short = word(29)
    texts = {k: "before it " + item[k : k + 48] + " after" for k in range(0, len(item) - 47, 7) if item[k : k + 48].strip() == item[k : k + 48]}
    texts |= {1000: item[39:153], 1001: item[60:75] + "XY" + item[77:108], 1002: short[:9] + "X" + short[10:19] + "Y" + short[20:], 1003: item[20:50], 1004: word(300), 1005: short[:9] + "X" + short[10:14] + "Z" + short[15:19] + "Y" + short[20:]}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, short)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(k, 7) for k in texts if k < 1002} | {(1002, 8)}


def test_windows_against_plain_alignment():
    rng = random.Random(13)
    item = "".join(rng.choice("abcdefghijklé漢 ") for _ in range(130))
    raw = decontaminate.normal(item).tolist()

    def distance(window, text):  # least edits between the window and any part of the text
        row = [0] * (len(text) + 1)
        for i, w in enumerate(window, 1):
            above, row = row, [i]
            for j, c in enumerate(text, 1):
                row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (w != c)))
        return min(row)

    bench = decontaminate.Benchmark([(1, item)])
    found = 0
    for _ in range(30):
        at = rng.randrange(0, len(raw) - 60)
        text = list(raw[at : at + rng.randrange(46, 60)])
        for _ in range(rng.randrange(0, 6)):
            p = rng.randrange(len(text))
            text[p : p + rng.choice([0, 1])] = rng.choice([[], [0x1F600], [97]])
        text = [122] * 70 + text + [122] * 70
        got = {o for *_, offsets in bench.find(np.array(text, dtype="<u4"), np.array([0]), np.array([len(text)])) for o in offsets}
        assert got == {o for o in range(len(raw) - 47) if distance(raw[o : o + 48], text) <= 3}
        found += len(got) > 0
    assert 5 < found < 30


def of_buffer(bench, texts):
    """What a benchmark finds in texts that come in one buffer."""
    gap = np.zeros(decontaminate.WHOLE + 16, dtype="<u4")
    parts = [decontaminate.normal(t) for t in texts]
    sizes = np.array([len(x) for x in parts])
    starts = np.cumsum(sizes + len(gap)) - sizes - len(gap)
    out = {}
    for row, item, size, s, e, d, offsets in bench.find(np.concatenate([x for p in parts for x in (p, gap)]), starts, sizes):
        seen = out.setdefault((row, item), [s, e, d, set()])
        seen[:] = min(seen[0], s), max(seen[1], e), min(seen[2], d), seen[3] | {(size, o) for o in offsets}
    return out


def test_repeated_grams_lose_nothing(monkeypatch):
    """Few hits held at a time, and places told apart by what surrounds them, give what all hits at once give."""
    rng = random.Random(31)
    unit = lambda: "".join(rng.choice("ab=. ") for _ in range(rng.randrange(1, 40)))
    for turn in range(12):
        units = [unit() for _ in range(3)]
        texts = ["".join(rng.choice(units) * rng.randrange(1, 30) + "".join(rng.choice("xyz") for _ in range(rng.randrange(0, 30))) for _ in range(4)) for _ in range(3)]
        items = [(1, units[0] * 30), (2, units[1] * 9), (3, texts[0][20:90]), (4, "x" + units[2] * 20 + "y"), (5, units[0][:12] * 2)]
        bench = decontaminate.Benchmark([(i, t[:260]) for i, t in items])
        whole = of_buffer(bench, texts)
        for hits in (64, 1000):
            monkeypatch.setattr(decontaminate, "HITS", hits)
            monkeypatch.setattr(decontaminate, "SAME", 4)
            assert of_buffer(bench, texts) == whole
            monkeypatch.undo()
        assert turn or whole


@pytest.mark.parametrize("unit", ["=", "ha ", "one phrase that is said again and again, "])
def test_long_runs_take_little(unit):
    """A million characters of one unit against 300 of it: seconds, bounded memory, and all windows."""
    item, text = (unit * 300)[:300].strip(), (unit * 1_000_000)[:1_000_000].strip()
    bench = decontaminate.Benchmark([(1, item), (2, "something else " * 9)])
    tracemalloc.start()
    began = time.time()
    found = of_buffer(bench, [text])
    took, peak = time.time() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert list(found) == [(0, 1)] and found[0, 1][:3] == [0, len(text), 0]
    assert found[0, 1][3] == {(48, o) for o in range(len(item) - 47)}
    assert took < 40 and peak < 500e6


def test_short_benchmark_texts_are_found_as_they_are(spark):
    texts = {1: "so A  Tiny one", 2: "tinyness", 3: "untiny", 4: "(tiny)", 5: "漢字tiny", 6: "a tin y", 7: None, 8: "漢字の話", 9: "tiny tiny"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(1, "Tiny"), (2, "漢字"), (3, "x"), (4, ""), (5, None), (6, "tiny")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.start, r.end) for r in decontaminate.contaminated(docs, bench, exact_from=2).collect()}
    want = {(1, 5, 9), (4, 1, 5), (5, 2, 6), (9, 0, 9)}
    assert got == {(d, i, s, e) for d, s, e in want for i in (1, 6)} | {(5, 2, 0, 2), (8, 2, 0, 2)}
    assert decontaminate.contaminated(docs, bench).collect() == []
    assert {(r.doc_id, r.item_id, r.start, r.end) for r in decontaminate.contaminated(docs, bench, 8, exact_from=2).collect()} == got


def test_rendezvous(spark):
    rows = spark.range(2000).withColumnRenamed("id", "doc_id")
    got = sharding.with_slots(sharding.rendezvous(rows, "doc_id", [1.0] * 9 + [3.0], [1.0] * 9 + [3.0, 1.0]), ["doc_id"], 3).toPandas()
    assert ((got.shard == got.grown_shard) | (got.grown_shard == 10)).all()
    for _, s in got.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    assert (got.shard == 9).mean() > 0.2
    null = spark.createDataFrame([(None,), (None,)], "doc_id long")
    assert sharding.rendezvous(null, "doc_id", [1.0, 1.0]).select("shard").distinct().count() == 1


def test_vp_tree_is_exact_at_factor_one(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 8))
    x[50:80] = x[49]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [None] * 8), (904, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = vptree.nearest(df, df.filter("vec_id % 20 = 0"), "vec_id", "v", k=5, factor=1.0, shard_rows=100, block_rows=7).toPandas()
    for q in range(0, 400, 20):
        s = (x * x[q]).sum(axis=1)
        want = [i for i in np.lexsort((np.arange(400), -s)) if i != q][:5]
        assert got[got.query_id == q].sort_values("rank").id.tolist() == want


def test_chat_reads_back(spark):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "a\\b \\\\ </s></s> <<SYS>> <s"), (2, 0, None, None), (2, 0, None, None), (None, 3, "[INST]", ""), (3, 0, "assistant", "x"), (3, 1, "\\0", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_segments(df), ordered=True).collect()}
    for conv in (1, 2, None, 3):
        turns = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda r: r[0])
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert got[conv].loss_chars == sum(len(x) for _, r, x in turns if r == "assistant")
    assert got[1].valid and not got[2].valid and not got[3].valid


def test_licences(spark):
    rows = [(1, "a/b/LICENSE", "Released under the MIT License."), (2, "a/b/c/x.py", "code"), (3, "z/y", "code"), (4, None, None), (5, "a/q", "some words here\nLicensed under the Apache License, Version 2.0.\nmore and more words and lines that are not about it at all"), (6, "a/b/c/y", "")]
    got = {r.id: (r.license, r.origin) for r in licenses.inherit(licenses.scan(spark.createDataFrame(rows, "id long, path string, text string"))).collect()}
    assert got == {1: ("MIT", "own"), 2: ("MIT", "inherited"), 3: (None, "none"), 4: (None, "none"), 5: ("Apache-2.0", "own"), 6: ("MIT", "inherited")}


def test_classifiers(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdeiou") for _ in range(5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(400):
        text = [rng.choice(words) for _ in range(40)]
        bad = i % 3 == 0
        if bad:
            text[5] = "zzqx" + rng.choice("abc")
            text[20] = "zzqx" + rng.choice("abc")
        rows.append((i, " ".join(text)))
        labels.append((i, 0 if bad else 1, int(bad)))
    rows += [(1000, None), (1001, ""), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    toxic = toxicity.score(docs, toxicity.fit(docs, known)).toPandas().set_index("doc_id")
    bad = toxic.loc[[i for i in range(400) if i % 3 == 0], "predicted"].mean()
    good = toxic.loc[[i for i in range(400) if i % 3], "predicted"].mean()
    assert bad > 0.9 and good < 0.1 and len(toxic) == 403
    fine = quality.score(docs, quality.fit(docs, known)).toPandas()
    assert fine["score"].between(0, 1).all() and len(fine) == 403
    none = known.limit(0)
    assert quality.score(docs, quality.fit(docs, none)).filter("score <> 0").count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, none)).count() == 403


def test_machine_identity():
    m = quality.Machine()
    m.factor = np.random.default_rng(1).normal(size=m.factor.shape)
    slots, values = np.array([3, 9, 11]), np.array([0.5, 1.0, 2.0])
    pairs = sum(m.factor[slots[i]] @ m.factor[slots[j]] * values[i] * values[j] for i in range(3) for j in range(i))
    z, _ = m.raw(slots, values, np.array([0]))
    assert np.isclose(z[0], pairs)

"""The registered training-data queries against brute force, on a small folder of awkward tables."""

import hashlib
import math
import random
import re
import struct
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe.llm import chat, decontaminate, licence_texts, licenses, packing, quality, queries, sharding, simhash, suffixes, toxicity, vptree

HUGE = 2**60 + 1


def words(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with null and shared ids, empty and long texts, copies, near copies, extra columns with names that clash."""
    rng = random.Random(21)
    at = str(tmp_path_factory.mktemp("tables"))
    items = [words(rng, 14), words(rng, 9, "aéñüö漢"), words(rng, 6)[:40], "tiny", None, words(rng, 25)]
    passage, notice = words(rng, 30), "Released under the MIT License."
    texts = [words(rng, rng.randrange(5, 60)) for _ in range(24)]
    texts += [None, "", " \n ", "One  two", "one two", texts[0], texts[0], texts[1] + " more", "x" * 5000, words(rng, 3000)]
    texts += [passage + " " + words(rng, 10), words(rng, 8) + " " + passage, passage[:99], passage[:100], passage[5:105] + passage[50:]]
    texts += [words(rng, 5) + " " + items[0] + " " + words(rng, 5), items[0][:30] + "#" + items[0][31:], items[1].upper(), words(rng, 9) + items[5][40:95] + words(rng, 9), items[2], items[3], items[5][:47]]
    texts += [words(rng, 20) + "\n" + notice, licence_texts.MIT, "# " + licence_texts.MPL_HEADER.replace(", You", ",\n# You"), "é" * 60 + "😀" * 60]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "no id " + passage), (None, words(rng, 12)), (HUGE, words(rng, 12) + " " + items[0]), (HUGE, words(rng, 12))]
    rude = ["zzqxa", "zzqxab", "zzqxabc"]
    labels = []
    for k in range(1000, 1400):
        bad = k % 3 == 0
        body = words(rng, 20).split()
        if bad:
            body[rng.randrange(20)] = rng.choice(rude)
        rows.append((k, " ".join(body)))
        labels.append((k, 0 if bad else 1, int(bad)))
    labels += [(1001, None, None), (None, 1, 1), (1002, 1, 0)]
    docs = [(i, t, "en", f"src{(i or 0) % 3}", 0, 9.0, 7, "x", 1) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, spans string, row int").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)) + [(None, items[0])], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    vectors = [(k, [float(rng.randrange(-3, 4)) for _ in range(4)]) for k in range(200)] + [(300, None), (320, [0.0] * 4), (340, [math.nan] * 4), (360, [1.0, 2.0]), (None, [1.0] * 4), (40, [3.0] * 4), (380, [1.0, None, 0.0, 0.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>").write.parquet(f"{at}/embeddings.parquet")
    said = "a\\ </s> [/INST]<s>[INST] <</SYS>> <"
    talks = [(1, 0, "user", said), (1, 1, "assistant", said), (1, 2, "tool", None), (2, 0, "assistant", ""), (2, 0, "assistant", ""), (HUGE, 5, None, "x"), (None, 1, "user", "no id"), (None, 2, "assistant", said)]
    spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return at


@pytest.fixture(scope="module")
def docs(spark, folder):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def result(spark, folder, name):
    return queries.queries()[name](spark, folder).toPandas().astype(object)


def known(value):
    return None if value is None or value != value else int(value)


def test_op1(spark, folder, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want, tokens = Counter(), 0
    for doc, text, _ in docs:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        tokens += len(ids)
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[doc, k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    got = [r.asDict() for r in packing.op1_best_fit_packing(spark, folder).collect()]
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in bins.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= 2048
    assert len(bins) <= -(-tokens // 2048) + 1


@pytest.mark.parametrize("which", ["documents", "attention"])
def test_op1_other_capacities_bind(spark, which):
    sizes = [10] * 60 + [40] * 10
    rows = [(k, 0, 0, n, 0) for k, n in enumerate(sizes)]
    items = spark.createDataFrame(rows, packing.PIECES)
    limit = {"max_documents": 4} if which == "documents" else {"max_attention": 2000.0}
    got = packing.pack(items, max_tokens=100, **limit).toPandas()
    held = got.groupby("sequence_id").length.agg(["count", "sum", lambda x: (x**2).sum()])
    assert (held["sum"] <= 100).all()
    if which == "documents":
        assert held["count"].max() == 4 and len(held) == 18
    else:
        assert held.iloc[:, 2].max() <= 2000 and len(held) > 11
    assert packing.pack(items, max_tokens=100).select("sequence_id").distinct().count() == 10


def covered(texts, length):
    """Bytes that repeat an earlier string of the length, for texts in order."""
    seen, out = set(), []
    for raw in texts:
        mark = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                mark[i : i + length] = b"\1" * length
            seen.add(w)
        out.append(bytes(mark))
    return out


def test_op2(spark, folder, docs):
    # null ids first; rows of one id and different texts in the order that the operator gives them
    keyed = suffixes.identified(spark.read.parquet(f"{folder}/documents.parquet")).select("_id", "doc_id", "text").collect()
    order = sorted({(r._id, r.text or "") for r in keyed})
    marks = dict(zip(order, covered([t.encode() for _, t in order], 100)))
    ids = [r.doc_id for r in sorted(keyed, key=lambda r: r._id)]
    assert [i is not None for i in ids] == sorted(i is not None for i in ids) and [i for i in ids if i is not None] == sorted(i for i in ids if i is not None)
    want = Counter()
    for r in keyed:
        mark, raw = marks[r._id, r.text or ""], (r.text or "").encode()
        left = bytes(c for c, m in zip(raw, mark) if not m)
        want[r.doc_id, len(raw), sum(mark), len([x for x in mark.split(b"\0") if x]), hashlib.sha256(left).hexdigest()] += 1
    got = Counter(tuple(r) for r in suffixes.op2_suffix_dedup(spark, folder).collect())
    assert got == want and sum(n for _, _, n, *_ in want) > 1000


@pytest.mark.parametrize("cell", [300, 2000])
def test_op2_minimisers_larger_than_a_cell(spark, cell):
    rng = random.Random(cell)
    shared = words(rng, 14)[:96]
    texts = [words(rng, 20)[: rng.randrange(20, 120)] + shared + words(rng, 20)[: rng.randrange(20, 120)] for _ in range(40)]
    texts += [texts[3][10:-5], texts[7] + texts[9]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: suffixes.kept_parts(r.text.encode(), r.spans)[1] for r in suffixes.with_spans(df, 100, cell).collect()}
    assert got == {k: sum(m) for k, m in enumerate(covered([t.encode() for t in texts], 100))}


def test_op2_a_hot_passage_spreads_over_cells(spark):
    """One passage of 150 bytes in 20,000 distinct texts: no cell holds much more than another, and the result is exact."""
    from pyspark import StorageLevel

    rng = random.Random(6)
    passage = words(rng, 40)[:150]
    text = lambda: "".join(rng.choices("abcdefghijklmnop ", k=90))
    texts = [text() + passage + text() for _ in range(20_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8, "doc_id").persist(StorageLevel.DISK_ONLY)
    need = suffixes._sorted_out(suffixes._fingerprints(df, 100, 4)).filter("m is not null")
    held = suffixes._dealt(df, need, 100, 1 << 18).groupBy("cell").agg(F.sum(F.octet_length("bytes") + 32).alias("n")).toPandas()
    assert len(held) > 100 and held.n.max() < 1 << 20 and held.n.max() < 4 * held.n.median()
    got = {r.doc_id: suffixes.kept_parts(r.text.encode(), r.spans)[1] for r in suffixes.with_spans(df, 100, 1 << 18).collect()}
    assert got == {k: sum(m) for k, m in enumerate(covered([t.encode() for t in texts], 100))}


def test_op2_merged_order_and_prefixes():
    rng = random.Random(8)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 25))) for _ in range(25)] + [b"", b"abab", b"abab"]
    flat = [(s[p:], k, p) for k, s in enumerate(strings) for p in range(len(s) + 1)]
    for shard in (6, 50, 10**6):
        for depth in (1, 5, 40):
            string, at, before, common = suffixes.merged(strings, depth, shard)
            assert sorted(zip(string, at)) == sorted((k, p) for _, k, p in flat)
            # a string's own end is like no other byte, and comes before all
            key = lambda k, p: [*([1, c] for c in strings[k][p : p + depth]), *([[0, k]] if len(strings[k]) - p < depth else [])]  # noqa: B023, E731
            keys = [key(k, p) for k, p in zip(string, at)]
            assert keys == sorted(keys)
            assert [int(b) for b in before] == [strings[k][p - 1] if p else -1 for k, p in zip(string, at)]
            prefix = [0] + [next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(keys, keys[1:])]
            assert common.tolist() == prefix
            block, s2, p2 = suffixes.repeats(strings, depth, shard)
            found = {}
            for b, k, p in zip(block, s2, p2):
                found.setdefault(b, set()).add((int(k), int(p)))
            whole = [{(int(string[i]), int(at[i])) for i in range(s, e)} for s, e in suffixes.intervals(common, depth)]
            assert sorted(map(sorted, found.values())) == sorted(map(sorted, whole))
    assert [len(x) for x in suffixes.merged([], 3)] == [0] * 4


def regions(raw):
    """Texts that must be found of a benchmark text, with the edits each may have."""
    n = len(raw)
    if n < 20:
        return []
    if n <= 96:
        own = [(raw, int(n * 0.07))]
        return own if n <= 48 else own + [(raw[k : k + 48], 3) for k in range(n - 47)]
    return [(raw[k : k + 48], 3) for k in range(n - 47)]


def least_edits(window, text):
    """Edits between a window and the part of a text that is nearest to it."""
    row = np.zeros(len(text) + 1, dtype=np.int64)
    chars = np.array([ord(c) for c in text], dtype=np.int64)
    steps = np.arange(len(text) + 1)
    for i, c in enumerate(window, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (chars != ord(c)))
        row = np.minimum.accumulate(np.r_[i, new] - steps) + steps
    return int(row.min())


@pytest.mark.parametrize("chunk", [None, 60])
def test_op3(spark, folder, docs, chunk):
    plain = lambda t: " ".join((t or "").lower().split())
    items = [(r.item_id, plain(r.text)) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r.item_id is not None]
    want = Counter()
    for doc, text, _ in docs:
        if doc is not None and 1000 <= doc < HUGE or len(text or "") > 4000:
            continue  # fillers, checked by the operator alone
        for item, raw in items:
            short = chunk is None and 0 < len(raw) < 20 and re.search(rf"(?<![a-z0-9]){re.escape(raw)}(?![a-z0-9])", plain(text))
            if short or any(least_edits(w, plain(text)) <= e for w, e in regions(raw)):
                want[doc, item] += 1
    if chunk is None:
        found = decontaminate.op3_qgram_decontamination(spark, folder)
    else:
        found = decontaminate.contaminated(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"), chunk)
    assert Counter((r.doc_id, r.item_id) for r in found.collect()) == want and len(want) >= 7


def test_op4(spark, folder, docs):
    got = [r.asDict() for r in sharding.op4_rendezvous_sharding(spark, folder).collect()]

    def best(doc, n):
        key = "null" if doc is None else str(doc)
        return max(range(n), key=lambda s: (-1 / math.log((int(hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52), -s))

    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "key", best(d, 40), best(d, 41)) for d, t, _ in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in got) == want
    for shard in range(40):
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))


def nearest_by_force(rows, k=20):
    sound = [(i, np.array(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in sound:
        if i % 20 == 0:
            scored = sorted((-float((q * x).sum()), j) for j, x in sound if j != i and len(x) == len(q))
            out.setdefault(i, []).append([(j, -s) for s, j in scored[:k]])
    return out


def test_op5_exactly_with_ties(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    rows = [r for r in rows if r[0] != 40] + [next(r for r in rows if r[0] == 40)]  # one row of the id that is there twice
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for shard_rows in (16, 8192):
        got = {}
        for r in vptree.nearest(df, df.filter("vec_id % 20 = 0"), "vec_id", "embedding", factor=1.0, shard_rows=shard_rows, block_rows=3).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = (r.id, r.score)
        assert {q: [[hits[k] for k in sorted(hits)]] for q, hits in got.items()} == {q: v for q, v in nearest_by_force(rows).items() if v[0]}
    assert vptree.nearest(df.limit(0), df, "vec_id", "embedding").count() == 0 and vptree.nearest(df, df.limit(0), "vec_id", "embedding").count() == 0


def test_op5_keeps_its_recall_and_prunes(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 16))
    x = centres[rng.integers(0, 60, 4000)] + rng.normal(size=(4000, 16)) * 0.2
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = vptree.nearest(df, df.filter("vec_id % 20 = 0"), "vec_id", "embedding", shard_rows=500, count_work=True).toPandas()
    top = got[got["rank"] <= 20]
    hits = 0
    for q in range(0, 4000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(top[top.query_id == q].id) & set(np.argsort(-s, kind="stable")[:20].tolist()))
    assert hits / (200 * 20) >= 0.9 and got.work.sum() < 0.5 * 200 * 4000


def test_op5_hot_vectors(spark):
    rows = [(k, [1.0, 0.0]) for k in range(600)] + [(600 + k, [0.0, float(k + 1)]) for k in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in vptree.nearest(df, df.filter("vec_id % 20 = 0"), "vec_id", "embedding", factor=1.0, shard_rows=50).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    assert [i for _, i in sorted(got[0])] == list(range(1, 21)) and [i for _, i in sorted(got[580])] == list(range(20)) and [i for _, i in sorted(got[600])][0] == 629


def test_op6(spark, folder, docs):
    import xxhash

    def fingerprint(text):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        parts = [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w]
        each = [" ".join(parts[k : k + 3]) for k in range(max(len(parts) - 2, 1))] if parts else []
        h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in each]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [fingerprint(t) for _, t, _ in docs]
    group = list(range(len(docs)))
    for _ in docs:
        before = list(group)
        for i, x in enumerate(prints):
            for j in range(i):
                if (x ^ prints[j]).bit_count() <= 3:
                    group[i] = group[j] = min(group[i], group[j])
        if before == group:
            break
    least = {g: min((docs[i][0] for i in range(len(docs)) if group[i] == g and docs[i][0] is not None), default=None) for g in set(group)}
    want = Counter((docs[i][0], f"{prints[i]:016x}", least[group[i]]) for i in range(len(docs)))
    assert Counter(tuple(r) for r in simhash.op6_simhash(spark, folder).collect()) == want


def test_op7(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()] + [(-1, 0, "user", chat.SAID), (-1, 1, "assistant", chat.SAID)]
    esc = chat.Escaper(chat.Template().controls)
    want = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t, r or "", x or "", r) for c, t, r, x in rows if c == conv), key=lambda r: r[:3])
        said = "".join(x for _, r, x, _ in turns if r == "assistant")
        size = sum(len("<s>[INST]" + (chat.NO_ROLE if raw is None else esc.escape(r)) + "[/INST]" + esc.escape(x) + "</s>") for _, r, x, raw in turns)
        want[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x, _ in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), size)
    got = {r.conv_id: tuple(r)[1:6] for r in chat.op7_chat_formatting(spark, folder).collect()}
    assert got == want and HUGE in got and None in got


def test_op8(spark, folder, docs):
    """Every unit of every text against every template, in plain Python."""
    idf, rare, vectors = licenses._vectors()

    def terms(text):
        return [t for t in re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", text.lower()) if t not in licenses.STOP]

    def score(text):
        n = Counter(terms(text))
        w = {t: (1 + math.log(k)) * idf.get(t, rare) for t, k in n.items()}
        norm = math.sqrt(sum(v * v for v in w.values()))
        return max(((round(sum(w[t] * v.get(t, 0.0) for t in w) / norm, 9), -k, name) for k, (name, v) in enumerate(vectors) if len(set(w) & set(v)) >= 2), default=(0, 0, None)) if norm else (0, 0, None)

    want, whole = [], {}
    for doc, text, source in docs:
        text = text or ""
        paragraphs = re.split(licenses.BLANK, text)
        blocks = [p for p in (paragraphs if len(paragraphs) > 1 else []) + re.findall(licenses.COMMENT_LINES, text) if "\n" in p]
        best = max([score(u) for u in [text, *text.split("\n"), *blocks]])
        mine = score(text)[0] >= licenses.THRESHOLD
        place = f"{source}/en"
        if best[0] < licenses.THRESHOLD:
            best = (None, 0, None)
        elif mine:
            whole.setdefault(place, []).append((-round(best[0], 6), best[2]))
        want.append((doc, best, mine, place))
    expected = Counter()
    for doc, best, mine, place in want:
        if doc is None:
            place = f"{place.split('/')[0]}"  # without an id the path ends with the language
        near = min(whole[place])[1] if place in whole and best[2] is None else None
        expected[doc, best[2] or near, None if best[0] is None else round(best[0], 6), mine, "own" if best[2] else "inherited" if near else "none"] += 1
    got = Counter((r.doc_id, r.license, r.score, r.is_license_file, r.origin) for r in licenses.op8_license_scan(spark, folder).collect())
    assert got == expected and {k[1] for k in got} >= {"MIT", "MPL-2.0"} and any(k[4] == "inherited" for k in got)


@pytest.mark.parametrize("text, license", [(licence_texts.MIT.replace("<year> <copyright holders>", "2021 Jane Doe"), "MIT"), (licence_texts.BSD_3, "BSD-3-Clause"), (licence_texts.ISC, "ISC"), ("\n".join("# " + x for x in re.sub(r"(.{60}\S*) ", "\\1\n", licence_texts.TEMPLATES["GPL-3.0"][1]).split("\n")) + "\n" + "value = compute(first, second)\n" * 9 + "\n".join(f"name{k} = other{k}" for k in range(200)), "GPL-3.0"), ("// SPDX-License-Identifier: Apache-2.0\nint main;", "Apache-2.0"), ("just a text about software and its use", None)])
def test_op8_whole_licences_and_wrapped_headers(spark, text, license):
    r = licenses.scan(spark.createDataFrame([(1, "a/b", text)], "id long, path string, text string")).first()
    assert r.license == license and r.is_license_file == (license in ("MIT", "BSD-3-Clause", "ISC"))


def test_op8_nearest_ancestor(spark):
    rows = [(1, "a/LICENSE", licence_texts.MIT), (2, "a/b/LICENSE", licence_texts.ISC), (3, "a/b/c/x", "code"), (4, "a/d/x", "code"), (5, "ab/x", "code"), (6, "x", "code"), (7, None, "code"), (8, "a/d//y", None)]
    got = {r.id: (r.license, r.from_folder) for r in licenses.inherit(licenses.scan(spark.createDataFrame(rows, "id long, path string, text string"))).collect()}
    assert got == {1: ("MIT", None), 2: ("ISC", None), 3: ("ISC", "a/b"), 4: ("MIT", "a"), 5: (None, None), 6: (None, None), 7: (None, None), 8: ("MIT", "a")}


class PlainSpelling:
    """The toxicity models in dictionaries, gram by gram."""

    def __init__(self, rows):
        self.counts = {0: Counter(), 1: Counter()}
        for text, label in rows:
            for word in self.words(text):
                self.counts[label].update(self.grams(word))
        top, above, lower = set(self.counts[0]) | set(self.counts[1]), None, None
        kinds, above = {}, top
        for n in (6, 3, 1):
            kinds[n] = Counter(g[-n:] for g in above)
            above = set(kinds[n])
        for n, below in ((1, None), (3, 1), (6, 3)):
            total, many, p = Counter(), Counter(), {}
            for g, k in kinds[n].items():
                total[g[:-1]] += k
                many[g[:-1]] += 1
            for g, k in kinds[n].items():
                p[g] = (max(k - 0.75, 0) + 0.75 * many[g[:-1]] * (lower[g[-below:]] if below else 1 / 256)) / total[g[:-1]]
            lower = p
        self.lower, self.stats = lower, {}
        for y, c in self.counts.items():
            total, many = Counter(), Counter()
            for g, k in c.items():
                total[g[:-1]] += k
                many[g[:-1]] += 1
            once, twice = (sum(v == k for v in c.values()) for k in (1, 2))
            self.stats[y] = (total, many, max(0.1, min(0.95, (once + 0.5) / (once + 2 * twice + 1))))
        self.known = top

    @staticmethod
    def words(text):
        return [w for w in re.split(rb"[ \t\n\v\f\r]+", (text or "").lower().encode()) if w]

    @staticmethod
    def grams(word):
        w = b" " + word + b" "
        return [w[max(0, k - 8) : k] for k in range(2, len(w) + 1)]

    def ratio(self, g):
        parts = []
        for y in (1, 0):
            total, many, d = self.stats[y]
            n, c = total.get(g[:-1], 0), self.counts[y].get(g, 0)
            weight = d * many[g[:-1]] / n if n else 1.0
            parts.append((max(c - d, 0) / n if n else 0.0) + weight * self.lower[g[-6:]] if g in self.known else weight)
        return math.log(parts[0]) - math.log(parts[1])

    def features(self, text):
        each = [self.words(text), []]
        r = sorted((sum(self.ratio(g) for g in self.grams(w)) for w in each[0]), reverse=True)
        size = sum(len(w) + 1 for w in each[0])
        if not r:
            return [0.0] * 5
        mean = math.log(sum(math.exp(min(max(x, -12), 12)) for x in r) / len(r))
        return [sum(r) / size, r[0], sum(r[:3]) / min(len(r), 3), mean, r[0] / math.log(8 + len(r))]


def fold(doc):
    return zlib.crc32(str(doc).encode()) % 5


@pytest.fixture(scope="module")
def labelled(spark, folder):
    return {r.doc_id: r for r in spark.read.parquet(f"{folder}/labels.parquet").filter("doc_id is not null").orderBy(F.col("toxic").asc_nulls_first()).collect()}


def test_op9(spark, folder, docs, labelled):
    learnt = [(t, labelled[d].toxic) for d, t, _ in docs if d in labelled and fold(d) not in (0, toxicity.CALIBRATION_FOLD) and labelled[d].toxic is not None]
    plain = PlainSpelling(learnt)
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.fit(frame.select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet"))
    some = [t for _, t, _ in docs][:70] + ["Zzqxab,", "zzqx\tnew\r\nzzqxabcd", "ünï 漢字 zzqxa"]
    got = toxicity.text_features(some, model.grams, model.contexts)
    whole = np.array([plain.features(t) for t in some])
    assert np.allclose(got, whole, atol=2e-4)  # no gram is lost
    assert np.allclose(model.score(some), 1 / (1 + np.exp(-(whole @ model.beta[:-1] + model.beta[-1]))), atol=5e-3)
    rows = toxicity.op9_toxicity(spark, folder).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _, _ in docs)
    assert all(r.held_out == (r.doc_id is not None and fold(r.doc_id) == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [(r.predicted, labelled[r.doc_id].toxic) for r in rows if r.held_out and r.doc_id in labelled and labelled[r.doc_id].toxic is not None]
    assert np.mean([p == y for p, y in held]) > 0.95 and len(held) > 50
    kept = toxicity.score(frame, model)
    assert set(kept.columns) == set(frame.columns) and kept.filter("score = 9").count() == 0


def test_op9_looks_up_what_it_does_not_broadcast(spark, folder):
    """With room for 2,000 grams of many, the scores are those of all grams."""
    frame, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    whole, little = toxicity.fit(frame, labels), toxicity.fit(frame, labels, most=2000)
    assert not any(whole.rest) and all(little.rest) and np.count_nonzero(~np.isnan(little.grams.ratio)) <= 2000 < np.count_nonzero(~np.isnan(whole.grams.ratio))
    assert np.allclose(whole.beta, little.beta, rtol=1e-4, atol=1e-6)
    a, b = ([(r.doc_id, r.text, r.score) for r in toxicity.score(frame, m).select("doc_id", "text", "score").collect()] for m in (whole, little))
    key = lambda r: (repr(r[0]), repr(r[1]))
    assert len(a) == len(b) and all(x[:2] == y[:2] and abs(x[2] - y[2]) < 1e-6 for x, y in zip(sorted(a, key=key), sorted(b, key=key)))
    # and they differ without the lookup
    alone = little.score([t for _, t, _ in b])
    assert max(abs(s - r[2]) for s, r in zip(alone, b)) > 1e-3


def test_slots_hold_all_that_is_put_in():
    rng = np.random.default_rng(4)
    g = rng.integers(0, 2**63, 50_000).astype(np.uint64)
    slots = toxicity.Slots(toxicity.hash_of_longs(g), np.arange(len(g), dtype=np.float32))
    assert (slots.get(g) == np.arange(len(g))).all() and np.isnan(slots.get(g[:1000] + np.uint64(2**63))).all()
    assert len(slots.tag) <= 2 * len(g) and np.isnan(toxicity.Slots(np.zeros(0, dtype=np.uint64), np.zeros(0)).get(g)).all()


def test_op9_long_texts_and_words():
    rng = random.Random(1)
    text = words(rng, 120_000) + " " + "y" * (toxicity.BLOCK + 50) + " end"
    parts = [raw.tobytes() for raw, _, _ in toxicity._blocks([text, None, "a"])]
    assert b"".join(parts).replace(b"  ", b" ").strip().replace(b" ", b"") == (text + "a").replace(" ", "").encode()
    short = [w for raw, _, _ in toxicity._blocks([text]) for w in raw.tobytes().split()]
    assert [w for w in short if w[:1] != b"y"] == text.encode().replace(b"y" * (toxicity.BLOCK + 50), b"").split()


def test_op10(spark, folder, docs, labelled):
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    machine = quality.fit(frame.select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet"))
    rows = quality.op10_quality(spark, folder).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _, _ in docs)
    assert all(r.held_out == (r.doc_id is not None and fold(r.doc_id) == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    held = [(r.score, labelled[r.doc_id].quality) for r in rows if r.held_out and r.doc_id in labelled and labelled[r.doc_id].quality is not None]
    pairs = [(a > b) + (a == b) / 2 for a, y in held for b, z in held if y > z]
    assert np.mean(pairs) > 0.9 and len(pairs) > 500
    # the machine pair by pair
    for _, text, _ in docs[:40]:
        slots, x = quality.Encoder().encode(text if text is None or len(text) < 3000 else text[:3000])
        z = machine.bias + sum(machine.linear[s] * v for s, v in zip(slots, x))
        z += sum(float(machine.factor[slots[i]] @ machine.factor[slots[j]]) * x[i] * x[j] for i in range(len(slots)) for j in range(i))
        got = machine.score([(slots, x)])[0]
        assert got == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)


def test_op10_learns_as_gradients_say():
    """One step of the fit moves weights against the gradient of the log-loss, taken by differences."""
    rng = np.random.default_rng(5)
    rows = [(rng.choice(quality.SLOTS, 6, replace=False), rng.random(6)) for _ in range(8)]
    y = np.array([0, 1, 0, 1, 1, 0, 1, 0], dtype=float)
    m = quality.Machine()
    m.factor[:] = rng.normal(0, 0.3, m.factor.shape)
    m.linear[:] = rng.normal(0, 0.3, m.linear.shape)
    before = (m.linear.copy(), m.factor.copy())
    bias = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))

    def loss(linear, factor):
        total = 0.0
        for (slots, x), t in zip(rows, y):
            z = bias + linear[slots] @ x + sum(float(factor[slots[i]] @ factor[slots[j]]) * x[i] * x[j] for i in range(6) for j in range(i))
            total += math.log1p(math.exp(-z)) if t else math.log1p(math.exp(z))
        return total / len(rows)

    m.fit(rows, y, epochs=1, batch=8, steps=1)
    slots = rows[0][0]
    for s in slots:
        up, down = before[0].copy(), before[0].copy()
        up[s] += 1e-5
        down[s] -= 1e-5
        slope = (loss(up, before[1]) - loss(down, before[1])) / 2e-5 + 1e-4 * before[0][s]
        assert np.sign(m.linear[s] - before[0][s]) == -np.sign(slope)
        up, down = before[1].copy(), before[1].copy()
        up[s, 0] += 1e-5
        down[s, 0] -= 1e-5
        slope = (loss(before[0], up) - loss(before[0], down)) / 2e-5 + 1e-4 * before[1][s, 0]
        assert np.sign(m.factor[s, 0] - before[1][s, 0]) == -np.sign(slope)


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark", "embeddings", "conversations"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    for name, query in queries.queries().items():
        assert query(spark, str(tmp_path)).count() == (1 if name.startswith("op7") else 0), name


# ---- the pipeline ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def plain_docs(spark, folder):
    import corpus_pipeline

    rows = [(d, t, "en", s, 0) for d, t, s in [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def contents(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_stage_toxicity(spark, folder, plain_docs):
    import corpus_pipeline

    model = toxicity.fit(plain_docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = plain_docs.collect()
    score = model.score([r.text for r in rows])
    left = corpus_pipeline.drop_toxic(spark, plain_docs, folder)
    assert contents(left) == Counter((r.doc_id, r.text) for r, s in zip(rows, score) if s < 0.5) and left.columns == plain_docs.columns


def test_stage_near_duplicates(spark, folder, plain_docs):
    import corpus_pipeline

    rows = plain_docs.filter("doc_id is null or doc_id < 1000 or doc_id >= 2000").collect()
    sets = [frozenset(simhash.shingles(r.text, 5)) for r in rows]
    group = list(range(len(rows)))
    for _ in range(6):
        for i, x in enumerate(sets):
            for j in range(i):
                if x == sets[j] or len(x & sets[j]) >= 0.8 * len(x | sets[j]) and x and sets[j]:
                    group[i] = group[j] = min(group[i], group[j])
    left = contents(corpus_pipeline.drop_near_duplicates(spark, plain_docs.filter("doc_id is null or doc_id < 1000 or doc_id >= 2000"), folder))
    assert sum(left.values()) == len(set(group))
    for g in set(group):
        members = [rows[i] for i in range(len(rows)) if group[i] == g]
        least = min((r.doc_id for r in members if r.doc_id is not None), default=None)
        assert sum(left[r.doc_id, r.text] for r in {(m.doc_id, m.text): m for m in members if m.doc_id == least}.values()) >= 1


def test_stage_suffixes(spark, folder, plain_docs):
    import corpus_pipeline

    keyed = suffixes.identified(plain_docs).select("_id", "doc_id", "text").collect()
    order = sorted({(r._id, r.text or "") for r in keyed})
    marks = dict(zip(order, covered([t.encode() for _, t in order], 100)))
    want = Counter()
    for r in keyed:
        text = r.text
        if text:
            at, out = 0, []
            for c in text:  # a character goes only if all its bytes do
                n = len(c.encode())
                if not all(marks[r._id, text][at : at + n]):
                    out.append(c)
                at += n
            text = "".join(out)
        want[r.doc_id, text] += 1
    left = corpus_pipeline.cut_repeats(spark, plain_docs, folder)
    assert contents(left) == want and left.columns == plain_docs.columns
    assert all(r.n_chars == len(r.text) for r in left.filter("text is not null").collect() if (r.doc_id, r.text) not in contents(plain_docs))


def test_stage_contamination(spark, folder, plain_docs):
    import corpus_pipeline

    bad = Counter((r.doc_id, r.text) for r in plain_docs.collect() if r.text and any(least_edits(w, " ".join(r.text.lower().split())) <= e for i in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if i.item_id is not None for w, e in regions(" ".join((i.text or "").lower().split()))) and len(r.text) < 4000 and not (r.doc_id and 1000 <= r.doc_id < 2000))
    left = contents(corpus_pipeline.drop_contaminated(spark, plain_docs, folder))
    assert left == contents(plain_docs) - bad and len(bad) >= 6


def test_whole_pipeline(spark, folder, plain_docs, tmp_path):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, folder).collect()
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in spans) <= 2048 for spans in bins.values())
    ids = {r.doc_id for r in got}
    assert None in ids and HUGE - 1 not in ids
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_normal_form_of_texts():
    assert unicodedata.normalize("NFC", "é") == "é" and "".join(map(chr, decontaminate.normal(" A\n  É "))) == "a é"

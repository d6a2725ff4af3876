"""TPUT search against a score of every document, with awkward rows and forced block sizes."""

import math
import random
import re
from collections import Counter

import pytest

from folioframe.llm import tput


def brute(docs, items, k=20):
    """docs and items: (id, text) in row order."""
    found = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    rows = [(i, c) for i, c in ((i, Counter(found(t))) for i, t in docs) if c]
    total, length = len(rows), sum(sum(c.values()) for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    out = []
    for item, said in items:
        scored = []
        for i, c in rows:
            m = 75 + (25 * sum(c.values()) * total) // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in found(said) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def tables(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["Été", "漢字", "Straße", "ÉTÉ"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    text = lambda n: rng.choice([" ", "-", "\x00 ", "\n"]).join(rng.choices(vocabulary, weights, k=n))
    docs = [(k, text(rng.randrange(1, 40)).upper() if k % 5 == 0 else text(rng.randrange(1, 40))) for k in range(300)]
    docs += [(1000 + k, docs[3][1]) for k in range(90)]  # a group of copies: ties
    docs += [(None, docs[4][1]), (None, docs[4][1]), (7, docs[9][1]), (2000, None), (2001, ""), (2002, " .,\x7f[`{ "), (2003, text(20000))]
    items = [(k, text(rng.randrange(1, 25))) for k in range(25)] + [(90, docs[3][1]), (91, "absent words"), (92, ""), (93, None), (None, text(5)), (3, text(6)), (94, "w1 w1 w1 W1 w50")]
    return docs, items


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, row int, n int").repartition(5),
        spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, rank int"),
    )


@pytest.mark.parametrize("limits", [{}, {"PART": 16, "BLOCK": 150, "VOCABULARY": 5, "CANDIDATES": 1, "SPAN_BITS": 5}])
def test_against_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(tput, name, value)
    docs, items = tables()
    got = [tuple(r) for r in tput.search(*frames(spark, docs, items)).collect()]
    assert sorted(got, key=repr) == brute(docs, items)


@pytest.mark.parametrize("docs,items", [([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")]), ([], [])])
def test_empty_tables(spark, docs, items):
    assert tput.search(*frames(spark, docs, items)).collect() == []


def test_a_document_is_found_that_no_head_shows(spark):
    """Two terms of middling weight in one document beat the heads of either list."""
    docs = [(k, "alpha " * 3 + f"x{k} " * 4) for k in range(40)] + [(100 + k, "beta " * 3 + f"y{k} " * 4) for k in range(40)] + [(999, "alpha alpha beta beta z z z")]
    docs += [(2000 + k, f"q{k} r{k}") for k in range(400)]
    items = [(1, "alpha beta")]
    got = [tuple(r) for r in tput.search(*frames(spark, docs, items)).collect()]
    assert sorted(got, key=repr) == brute(docs, items) and min(got, key=lambda r: r[1])[2] == 999

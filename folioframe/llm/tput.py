"""Operator 13: ranked lexical search by TPUT over term-partitioned postings.

Each list holds a term's documents by falling impact. Three rounds find an item's k best documents:
the heads of its lists give every document seen a lower bound, the k-th of which is divided by
the number of lists; every list then gives all postings of that contribution or more, and what a list
has not shown is below it (and below its head); the documents whose upper bound reaches the k-th lower bound are looked
up in all lists and scored exactly. A document that no list shows has less than the k-th score, so
the result is exact, ties included.

Terms are runs of ASCII letters, digits and all characters beyond ASCII, A-Z in lower case. With N
documents that hold a term, L terms in all and n in a document, a term that df of them hold weighs
w = floor(1000 ln((2N + 2) / (2df + 1))), m = 75 + (25 n N) div L, and a document's score is the sum of
w * ((10^9 tf) div (1000 tf + 12 m)) over the item's terms, repeats included, in 64-bit integers.

Scale: one pass over the texts writes the postings of the terms asked for (the set is broadcast up to
``VOCABULARY`` terms; more are joined) with the totals of each batch; one shuffle deals them to lists.
A list of more than ``PART`` documents is dealt to parts by a hash of the row, and each part gives a
head, so no list is gathered in one task. In round two a posting goes once to the sums of its span of
documents, where all items that ask for it add it up, whatever their number; a span hands on only the
documents whose upper bound reaches its own k-th lower bound. Items are taken in blocks of up to
``BLOCK`` terms, which are broadcast. Candidates are broadcast up to ``CANDIDATES``; more are joined.

Edge cases: null texts and texts without terms are no documents; an item without a known term gives no
rows; rows that are alike are documents of their own, as are rows with a null or shared doc_id; equal
scores go to the lesser doc_id (null is last), then in the order of rows. Items of null or shared
item_id are ranked each by itself. Extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import bounded_batches, groups_for, release, scratch, table

K = 20
VOCABULARY = 1_000_000  # terms of a broadcast set, some 64 MB
BLOCK = 500_000  # pairs of item and term of a block, some 32 MB
CANDIDATES = 1_000_000  # pairs of item and document of a broadcast, some 24 MB
PART = 1 << 15  # documents of a list's part
SPAN_BITS = 12  # a span of documents, for which sums are kept at once, has up to 2 ** 12
OUT_ROWS = 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())


def terms(text: str) -> list[bytes]:
    """The terms of a text, in UTF-8."""
    return _TERM.findall(text.encode("utf-8", "replace").translate(_LOWERED))


def asked(items: DataFrame, key: str, text: str) -> DataFrame:
    """``item`` (a number of its own), ``item_id``, ``term`` and how often the item has it."""
    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(key).alias("item_id"), F.translate(text, UPPER, LOWER).alias("said"))
    rows = rows.select("item", "item_id", F.explode(F.regexp_extract_all("said", F.lit(PATTERN), F.lit(0))).alias("term"))
    return rows.groupBy("item", "item_id", "term").agg(F.count(F.lit(1)).alias("times"))


def postings(docs: DataFrame, key: str, text: str, wanted: frozenset[bytes] | None) -> DataFrame:
    """``term``, ``row`` (a number of the document's own), ``doc_id``, ``tf`` and ``n``; only of the terms wanted, if given.

    A row without a term is the total of a batch: documents with a term (tf) and their terms (n).
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(wanted)
    names = ["term", "row", "doc_id", "tf", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found: list[bytes] = []
            often: list[int] = []
            at: list[int] = []
            sizes = np.zeros(batch.num_rows, dtype=np.int64)

            def block() -> pa.RecordBatch:
                places = pa.array(at, pa.int64())
                return pa.RecordBatch.from_arrays([pa.array(found, pa.binary()).cast(pa.string()), batch.column(0).take(places), batch.column(1).take(places), pa.array(often, pa.int64()), pa.array(sizes[at] if at else [], pa.int64())], names)

            for k in range(batch.num_rows):
                said = batch.column(2)[k].as_py()
                counts = Counter(terms(said)) if said else None
                if not counts:
                    continue
                sizes[k] = counts.total()
                mine = list(counts) if known is None else list(counts.keys() & known)
                found += mine
                often += [counts[t] for t in mine]
                at += [k] * len(mine)
                if len(found) >= OUT_ROWS:
                    yield block()
                    found, often, at = [], [], []
            yield block()
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([int((sizes > 0).sum())]), pa.array([int(sizes.sum())])], names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "term string, row long, doc_id long, tf long, n long")


def lists(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Term-partitioned postings (term, row, doc_id, impact and its place in its part of the list), and df and weight of the terms."""
    few = wanted.limit(VOCABULARY + 1).collect() if wanted.count() <= VOCABULARY else None
    raw = scratch(postings(docs, key, text, None if few is None else frozenset(r["term"].encode() for r in few)), "postings")
    total = raw.filter(F.col("term").isNull()).agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    held = raw.filter(F.col("term").isNotNull()).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    if few is None:
        held = held.join(wanted, "term", "left_semi")
    weight = F.floor(1000 * F.log(F.lit(2.0 * total["docs"] + 2) / (2.0 * F.col("df") + 1)))
    held = scratch(held.select("term", "df", weight.alias("weight"), F.monotonically_increasing_id().alias("number"), F.ceil(F.col("df") / PART).cast("int").alias("parts")), "terms")
    m = F.expr(f"75 + (25 * n * {total['docs']}L) div {max(total['terms'], 1)}L")
    impact = F.expr("(1000000000L * tf) div (1000 * tf + 12 * m)").cast("int")
    by_term = raw.filter(F.col("term").isNotNull()).join(F.broadcast(held) if few is not None else held, "term")
    by_term = by_term.select("term", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("part"), "row", "doc_id", "tf", m.alias("m")).withColumn("impact", impact).drop("tf", "m")
    place = F.row_number().over(Window.partitionBy("term", "part").orderBy(F.desc("impact"), "row"))
    dealt = scratch(by_term.repartition("term", "part").withColumn("place", place), "lists")
    release(raw)
    return dealt, held


def _kth(rows: DataFrame, score: str, k: int) -> DataFrame:
    """``item`` and its k-th highest score, for items that have k."""
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc(score)))
    return rows.select("item", score).withColumn("at", place).filter(F.col("at") == k).select("item", F.col(score).alias("kth"))


def _sums(asked: dict[str, np.ndarray], k: int):
    """What scores a span of documents: each item's documents whose upper bound reaches its k-th lower bound, as far as the span tells."""
    order = np.lexsort((asked["number"], asked["item"]))
    asked = {name: values[order] for name, values in asked.items()}
    starts = np.r_[np.flatnonzero(np.r_[True, asked["item"][1:] != asked["item"][:-1]]), len(order)] if len(order) else np.zeros(1, dtype=int)

    def scored(span: pa.Table) -> pa.Table:
        number, place, impact = (span.column(name).to_numpy() for name in ("number", "place", "impact"))
        by_term = np.argsort(number, kind="stable")
        number, place, impact = number[by_term], place[by_term], impact[by_term].astype(np.int64)
        first, last = np.searchsorted(number, asked["number"]), np.searchsorted(number, asked["number"], side="right")
        size, found = int(place.max()) + 1, []
        for a, b in zip(starts[:-1], starts[1:]):
            low, unseen = np.zeros(size, dtype=np.int64), np.full(size, asked["cap"][a:b].sum())
            least, bar = asked["least"][a], asked["kth"][a]
            for r in range(a, b):
                at, part = place[first[r] : last[r]], impact[first[r] : last[r]] * asked["factor"][r]
                enough = part >= least
                if not enough.all():
                    at, part = at[enough], part[enough]
                low[at] += part
                unseen[at] -= asked["cap"][r]
            if np.count_nonzero(low) >= k:
                bar = max(bar, np.partition(low, size - k)[size - k])
            some = np.flatnonzero((low > 0) & (low + unseen >= bar))
            found.append((np.full(len(some), asked["item"][a]), some, low[some], low[some] + unseen[some]))
        item, some, low, high = (np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in (zip(*found) if found else [()] * 4))
        row = (span.column("span")[0].as_py() << SPAN_BITS) + some
        return pa.table({"item": pa.array(item, pa.int64()), "row": pa.array(row, pa.int64()), "low": pa.array(low, pa.int64()), "high": pa.array(high, pa.int64())})

    return scored


def _ranked(dealt: DataFrame, block: DataFrame, k: int) -> DataFrame:
    """The k best of a block of items (item, term, number, times, weight): item, doc_id, score, rank."""
    many = Window.partitionBy("item")
    block = scratch(block.select("item", "term", "number", (F.col("times") * F.col("weight")).alias("factor")).filter("factor > 0"), "block")
    part = F.col("factor") * F.col("impact")
    # round one: the head of every list, from the heads of its parts
    head = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact"), "row"))
    heads = scratch(dealt.filter(F.col("place") <= k).withColumn("head", head).filter(F.col("head") <= k), "heads")
    first = heads.join(F.broadcast(block), "term").groupBy("item", "row").agg(F.sum(part).alias("low"))
    tops = heads.filter("head = 1").select("term", F.col("impact").alias("top"))
    # round two: every list gives what is not below the k-th lower bound over the number of lists
    limits = block.join(F.broadcast(tops), "term").join(_kth(first, "low", k), "item", "left").withColumn("kth", F.coalesce("kth", F.lit(0)))
    limits = limits.withColumn("least", F.greatest(F.ceil(F.col("kth") / F.count(F.lit(1)).over(many)), F.lit(1)))
    limits = scratch(limits.withColumn("cap", F.least(F.col("least") - 1, F.col("factor") * F.col("top"))), "limits")
    needed = limits.groupBy("term", "number").agg(F.min(F.ceil(F.col("least") / F.col("factor"))).alias("needed"))
    shown = dealt.drop("place").join(F.broadcast(needed), "term").filter(F.col("impact") >= F.col("needed"))
    shown = shown.select(F.shiftright("row", SPAN_BITS).alias("span"), "number", F.col("row").bitwiseAND((1 << SPAN_BITS) - 1).cast("int").alias("place"), "impact")
    asked = limits.select("item", "number", "factor", "cap", "least", "kth").toArrow()  # at most BLOCK rows
    sums = _sums({name: asked.column(name).to_numpy() for name in asked.column_names}, k)
    seen = scratch(shown.groupBy("span").applyInArrow(sums, "item long, row long, low long, high long"), "seen")
    bound = _kth(seen, "low", k).withColumnRenamed("kth", "now")
    found = scratch(seen.join(F.broadcast(bound), "item", "left").filter(F.col("high") >= F.coalesce("now", F.lit(0))).select("item", "row"), "candidates")
    # round three: every candidate in every list of its item
    near = found.count() <= CANDIDATES
    rows = found.select("row").distinct()
    there = dealt.join(F.broadcast(rows) if near else rows, "row", "left_semi").join(F.broadcast(block), "term")
    exact = there.join(F.broadcast(found) if near else found, ["item", "row"]).groupBy("item", "row", "doc_id").agg(F.sum(part).alias("score"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row"))
    best = scratch(exact.withColumn("rank", rank).filter((F.col("rank") <= k) & (F.col("score") > 0)).select("item", "doc_id", "score", "rank"), "best")
    release(block, heads, limits, seen, found)
    return best


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", said: str = "text", k: int = K) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of every item's k best documents."""
    wanted = scratch(asked(items, item, said), "asked")
    dealt, held = lists(docs, key, text, wanted.select("term").distinct())
    pairs = wanted.join(held, "term")
    blocks = groups_for(wanted.count(), BLOCK)
    of = F.pmod(F.xxhash64("item"), F.lit(blocks))
    best = functools.reduce(DataFrame.unionByName, [_ranked(dealt, pairs.filter(of == b), k) for b in range(blocks)])
    return best.join(wanted.select("item", "item_id").distinct(), "item").select("item_id", F.col("rank"), "doc_id", "score")


def op13_tput_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def sql() -> str:
    """Every document's score by every item, in DuckDB, from all terms of all texts."""
    found = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{PATTERN}')"
    return f"""WITH D AS (SELECT doc_id, unnest({found}) AS term FROM documents),
P AS (SELECT doc_id, term, count(*) AS tf FROM D GROUP BY ALL),
S AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM P GROUP BY ALL),
T AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM S),
W AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM P, T GROUP BY term),
Q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({found}) AS term FROM benchmark) GROUP BY ALL),
R AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score FROM Q JOIN P USING (term) JOIN W USING (term) JOIN S USING (doc_id), T GROUP BY ALL),
K AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM R WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM K WHERE rank <= {K}"""

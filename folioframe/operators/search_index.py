"""Search by an index of character trigrams: only lines that hold all that a pattern requires are read and matched.

The index is two tables in a folder: the lines, by parts, and for each trigram and block of 256 lines those that hold
it, as bits, by buckets of trigrams. A pattern's literal stretches give the trigrams that each match must
hold; their buckets are read, the lines that have them all are found, and the pattern is run over those lines alone, read
from the parts that hold one. A pattern that requires nothing (no three plain characters in a row) runs over all lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import search

PARTS, BUCKETS = 64, 64
MOST = 6  # trigrams of a pattern that are looked up: the rarest
#: Characters beyond ASCII that a match without regard to case takes for an ASCII letter.
ALIKE = {"\u017f": "s", "\u212a": "k", "\u0131": "i", "\u0130": "i"}
_NOT_PLAIN = re.compile(r"[^ -~]+")
WORDS = 4  # of 64 bits, a bit a line of a block
BITS = [f"m{k}" for k in range(WORDS)]
_SPECIAL = frozenset("\\^$.|?*+()[]{}")


def folded(line: Column) -> Column:
    """A line in which letters that match each other without regard to case are one."""
    return F.lower(F.translate(line, "".join(ALIKE), "".join(ALIKE.values())))


def required(pattern: str) -> set[str]:
    """Trigrams (in lower case) that every match of a regular expression holds, as far as its plain stretches tell.

    A stretch is a row of literal ASCII characters outside of groups, classes and choices; a
    character that may be left out ends it, and one that may be repeated ends it after itself.
    """
    stretches, now, depth, k = [], "", 0, 0
    if "|" in re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", "", pattern) or re.search(r"\(\?[a-zA-Z]*x|\\[QE]|\[[^\]]*\[", pattern):
        return set()
    while k < len(pattern):
        c, plain = pattern[k], ""
        if c == "\\":
            c, k = pattern[k : k + 2], k + 2
            plain = c[1:] if len(c) == 2 and not c[1].isalnum() else ""
            if c[1:] and c[1] in "xupPkNc0123456789":
                skip = re.compile(r"\{[^}]*\}|<[^>]*>|[0-9A-Fa-f]*").match(pattern, k)
                k = skip.end() if skip else k
        elif c == "[":
            end = re.compile(r"\[\^?\]?(?:\\.|\[:?[^\]]*\]|[^\]\\])*\]").match(pattern, k)
            k = end.end() if end else len(pattern)
        elif c in "()":
            depth += 1 if c == "(" else -1
            k += 1
        else:
            plain, k = "" if c in _SPECIAL else c, k + 1
        often = re.compile(r"[?*+][?+]?|\{\d*,?\d*\}[?+]?").match(pattern, k)
        if often:
            k = often.end()
        maybe = bool(often) and re.match(r"[?*]|\{0|\{,", often[0]) is not None
        if depth or not plain or not " " <= plain <= "~" or maybe:
            stretches.append(now)
            now = ""
        else:
            now += plain
            if often:
                stretches.append(now)
                now = ""
    stretches.append(now)
    return {s[k : k + 3].lower() for s in stretches for k in range(len(s) - 2)}


def _bucket(gram: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(n)).cast("int")


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, block, line of the block, text) in any order -> trigrams of each row of lines of one block, with the bits of the lines that hold them."""
    now, held = None, {}

    def packed() -> pa.RecordBatch:
        bits = np.frombuffer(b"".join([m.to_bytes(8 * WORDS, "little") for m in held.values()]), "<i8").reshape(-1, WORDS)
        part, block = (pa.array(np.full(len(held), v), kind) for v, kind in zip(now, (pa.int32(), pa.int64())))
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), part, block, *[pa.array(bits[:, k]) for k in range(WORDS)]], ["gram", "part", "block", *BITS])

    for batch in batches:
        for *at, line, text in zip(*(c.to_pylist() for c in batch.columns)):
            if at != now:
                if held:
                    yield packed()
                now, held = at, {}
            bit = 1 << line
            for gram in {s[k : k + 3] for s in _NOT_PLAIN.split(text) for k in range(len(s) - 2)}:
                held[gram] = held.get(gram, 0) | bit
    if held:
        yield packed()


def build(lines: DataFrame, path: str) -> None:
    """Write the index of lines (doc_id, page_number, line_idx, line) to a folder of any store.

    Scale: a map over the lines, one shuffle of the lines and one of a row a block and distinct trigram, by bucket and part,
    so that a trigram that most lines hold spreads over tasks. A block is 256 lines that follow each other, so a trigram
    that many of them hold is one row of 32 bytes of bits and not many; a task holds the trigrams of one block.
    """
    number = lines.select(F.monotonically_increasing_id().alias("number"), "doc_id", "page_number", "line_idx", "line")
    block = F.expr(f"number div {64 * WORDS}")
    rows = number.withColumn("part", F.pmod(F.xxhash64(block), F.lit(PARTS)).cast("int"))
    rows.repartition("part").write.partitionBy("part").mode("overwrite").parquet(f"{path}/lines")
    stored = lines.sparkSession.read.parquet(f"{path}/lines").filter("line is not null")
    each = stored.select("part", block.alias("block"), (F.col("number") % (64 * WORDS)).cast("int").alias("at"), folded(F.col("line")).alias("text"))
    held = each.mapInArrow(_held, f"gram string, part int, block long, {', '.join(f'{m} long' for m in BITS)}").withColumn("bucket", _bucket(F.col("gram"), BUCKETS))
    held.repartition("bucket", "part").sortWithinPartitions("bucket", "gram", "block").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/grams")
    n = sum((F.bit_count(m) for m in BITS), F.lit(0))
    counts = lines.sparkSession.read.parquet(f"{path}/grams").groupBy("gram").agg(F.sum(n).alias("n"))
    counts.write.mode("overwrite").parquet(f"{path}/counts")


def candidates(spark: SparkSession, path: str, pattern: str) -> DataFrame | None:
    """Lines (number, part) that hold all trigrams looked up, or None if the pattern requires none."""
    grams = sorted(required(pattern))
    if not grams:
        return None
    known = {r["gram"]: r["n"] for r in spark.read.parquet(f"{path}/counts").filter(F.col("gram").isin(grams)).collect()}
    some = sorted(grams, key=lambda g: (known.get(g, 0), g))[:MOST]
    buckets = [r[0] for r in spark.createDataFrame([(g,) for g in some], "gram string").select(_bucket(F.col("gram"), BUCKETS)).distinct().collect()]
    held = spark.read.parquet(f"{path}/grams").filter(F.col("bucket").isin(buckets) & F.col("gram").isin(some))
    whole = held.groupBy("block", "part", "gram").agg(*[F.bit_or(m).alias(m) for m in BITS])  # lines of a block may stand in several files
    both = whole.groupBy("block", "part").agg(F.count(F.lit(1)).alias("n"), *[F.bit_and(m).alias(m) for m in BITS]).filter(F.col("n") == len(some))
    word = both.select("block", "part", F.posexplode(F.array(*BITS)).alias("word", "bits")).filter("bits <> 0")
    return word.select(F.expr(f"explode(transform(filter(sequence(0, 63), k -> getbit(bits, k) = 1), k -> block * {64 * WORDS} + word * 64 + k))").alias("number"), "part")


def find(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """The hits of :func:`search.find`, of an index."""
    search.checked(spark, pattern)
    lines, few = spark.read.parquet(f"{path}/lines"), candidates(spark, path, pattern)
    if few is None:
        return search.find(lines, pattern)
    parts = [r["part"] for r in few.select("part").distinct().collect()]  # at most PARTS
    read = lines.filter(F.col("part").isin(parts)).join(few, ["number", "part"], "left_semi")
    return search.find(read, pattern)

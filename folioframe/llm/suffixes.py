"""Operator 2: removal of repeated byte strings by merging shard Burrows-Wheeler transforms.

:func:`merged` is the operator's core: strings are split into shards, each shard gets its suffix
order, BWT and LF mapping, and the shards' rows are interleaved by refinement: every step deals
the rows stably by the byte before them, so after ``h`` steps rows stand in the order of their
first ``h`` bytes over all shards. Where two rows part at step ``h + 1`` their common prefix is
``h``. No suffix of the union is ever sorted again. The result is the merged order, its BWT and
common prefixes; :func:`intervals` are its repeated strings. :func:`repeats` is the same for one
length only, and lets go of rows that no other row has followed so far.

Over a corpus, a string of ``length`` bytes is first dealt by its minimiser (the least hash of
its q-grams), which equal strings share. A run of neighbouring strings with one minimiser is kept
as one segment. Segments alone with their minimiser hold no repeat; equal segments (by 108 bits
of two hashes) collapse onto the earliest, which covers the others wholly; the rest, which share
a minimiser but differ, go through the merge, minimisers dealt over cells of bounded size. A
minimiser too large for a cell is that of a passage in many contexts: its strings are dealt one by one, by
128-bit digests, so that those inside the passage meet in one entry a task and all others spread evenly.

Scale: fingerprints travel as packed arrays (about 30 bytes for 39 of text), with equal segments
of a batch collapsed before the shuffle, so a hot passage sends one entry a batch to its bucket;
its other copies are known to be repeats and are dealt evenly. Only texts that take part are read
again.

Edge cases: null text is empty and null doc_id comes first; rows with the same doc_id and text
count as one document and both lose the same bytes, those of one doc_id (or none) and different
texts are documents of their own, in the order of a hash; texts shorter than ``length`` lose
nothing; empty tables give no rows; other columns are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded_batches, groups_for, scratch, table, unused

LENGTH, Q = 100, 24
SHARD_BYTES, CELL_BYTES = 1 << 18, 1 << 20
BUFFER = 1 << 19
NO_ID = -(2**63)
SEGMENT = np.dtype([("m", "<u8"), ("h", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("size", "<u2")])


# ---- the merge ---------------------------------------------------------------------------------


class Shard:
    """Suffix order, BWT and LF mapping of some strings, each ended by a terminator of its own."""

    def __init__(self, strings: list[bytes]) -> None:
        sizes = np.array([len(s) for s in strings], dtype=np.int64)
        self.text = np.frombuffer(b"\0".join(strings) + b"\0", dtype=np.uint8)
        ends = np.cumsum(sizes + 1) - 1
        self.is_end = np.zeros(len(self.text), dtype=bool)
        self.is_end[ends] = True
        rank = self.text.astype(np.int64) + len(strings)
        rank[ends] = np.arange(len(strings))
        n, step = len(rank), 1
        symbols = int(rank.max()) + 2
        while step < 4 and symbols ** (2 * step) < 2**62 and step < n:  # pack symbols before the first sort
            key = rank * symbols**step
            key[: n - step] += rank[step:] + (1 if step == 1 else 0)
            rank, step = key, 2 * step
        key = rank
        while True:
            order = np.argsort(key)  # equal keys get equal ranks, so the sort need not be stable
            new = np.empty(n, dtype=np.int64)
            new[order] = np.cumsum(np.r_[0, (key[order][1:] != key[order][:-1]).astype(np.int64)])
            rank = new
            if rank[order[-1]] == n - 1:
                break
            key = rank * (n + 1)
            key[: max(0, n - step)] += rank[step:] + 1
            step *= 2
        self.order = order  # suffix array
        before = np.where(order == 0, n - 1, order - 1)
        self.bwt = self.text[before]
        self.begins = self.is_end[before]  # the suffix opens its string: nothing stands before it
        self.lf = rank[before]


def _shards(strings: list[bytes], shard_bytes: int) -> list[Shard]:
    out, held, size = [], [], 0
    for s in strings:
        if held and size + len(s) > shard_bytes:
            out.append(Shard(held))
            held, size = [], 0
        held.append(s)
        size += len(s) + 1
    return [*out, Shard(held)] if held else out


def _places(shards: list[Shard], base: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(string, position) of rows."""
    place = np.concatenate([s.order + b for s, b in zip(shards, base)])[rows]
    ends = np.concatenate([np.flatnonzero(s.is_end) + b for s, b in zip(shards, base)])
    string = np.searchsorted(ends, place)
    return string, place - np.r_[0, ends[:-1] + 1][string]


def merged(strings: list[bytes], depth: int, shard_bytes: int = SHARD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(string, position, byte before, common prefix with the row above) of all suffixes, in order of their first ``depth`` bytes.

    A string's end comes before any byte, the ends in order of the strings; nothing stands before
    a string's opening, which has -1 there. Common prefixes are at most ``depth``; the first row has 0.
    """
    shards = _shards(strings, shard_bytes)
    if not shards:
        return (np.zeros(0, dtype=np.int64),) * 4
    base = np.cumsum([0] + [len(s.text) for s in shards])
    lf = np.concatenate([s.lf + b for s, b in zip(shards, base)])
    before = np.where(np.concatenate([s.begins for s in shards]), -1, np.concatenate([s.bwt for s in shards]).astype(np.int64))
    # ends are in their places from the start: they come first, in order of the strings
    ends = np.concatenate([b + np.arange(int(s.is_end.sum())) for s, b in zip(shards, base)])
    rows = np.concatenate([ends, np.setdiff1d(np.arange(base[-1]), ends)])
    common = np.full(len(rows), -1, dtype=np.int64)
    common[: len(ends) + 1] = 0
    common = common[: len(rows)]
    for h in range(depth):
        inner = before[rows] >= 0
        order = np.argsort(before[rows][inner], kind="stable")
        block = (np.cumsum(common >= 0) if h else np.zeros(len(rows), dtype=np.int64))[inner][order]  # rows of one prefix of h bytes
        byte = before[rows][inner][order]
        rows = np.concatenate([ends, lf[rows][inner][order]])
        parted = np.r_[np.ones(len(ends) + 1, dtype=bool), (block[1:] != block[:-1]) | (byte[1:] != byte[:-1])][: len(rows)]
        common[parted & (common < 0)] = h
        if (common >= 0).all():
            break
    common[common < 0] = depth
    string, at = _places(shards, base, rows)
    return string, at, before[rows], common


def intervals(common: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal ranges of at least two rows whose first ``length`` bytes are the same."""
    deep = np.r_[False, common[1:] >= length, False] if len(common) else np.zeros(1, dtype=bool)
    change = np.flatnonzero(deep[1:] != deep[:-1])
    return [(int(s), int(e) + 1) for s, e in zip(change[::2], change[1::2])]


def repeats(strings: list[bytes], length: int, shard_bytes: int = SHARD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, string, position) of every ``length``-byte string that occurs more than once."""
    shards = _shards(strings, shard_bytes)
    if not shards:
        return (np.zeros(0, dtype=np.int64),) * 3
    base = np.cumsum([0] + [len(s.text) for s in shards])
    bwt = np.concatenate([s.bwt for s in shards])
    stop = np.concatenate([s.begins for s in shards])
    lf = np.concatenate([s.lf + b for s, b in zip(shards, base)])
    # one byte a step, and two at once for all but an odd last one
    single = (bwt.astype(np.uint16), stop, lf)
    double = ((bwt[lf].astype(np.uint16) << 8) | bwt, stop | stop[lf], lf[lf])
    rows = np.arange(base[-1])  # shard by shard: the interleave before any refinement
    block = np.zeros(len(rows), dtype=np.int32)
    done = 0
    while done < length and len(rows):
        before, ends_here, back = double if length - done >= 2 else single
        done += 2 if length - done >= 2 else 1
        alive = ~ends_here[rows]
        rows, block = rows[alive], block[alive]
        before = before[rows]
        order = np.argsort(before, kind="stable")
        block, before = block[order], before[order]
        new = np.ones(len(rows) + 1, dtype=bool)
        np.not_equal(block[1:], block[:-1], out=new[1:-1])
        new[1:-1] |= before[1:] != before[:-1]
        shared = ~(new[:-1] & new[1:])
        rows = back[rows[order[shared]]]
        block = np.cumsum(new[:-1], dtype=np.int32)[shared]
    return block, *_places(shards, base, rows)


# ---- the corpus --------------------------------------------------------------------------------


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    u = np.uint64
    h = np.zeros(len(raw) - Q + 1, dtype=u)
    for k in range(Q):
        h *= u(0x9E3779B97F4A7C15)
        h += raw[k : k + len(h)]
    h ^= h >> u(31)
    h *= u(0xBF58476D1CE4E5B9)
    return (h & ~u((1 << 20) - 1)) | np.arange(len(h), dtype=u)  # leftmost of equals


def _segments(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, hash, start, size) of the segments of one buffer."""
    n = len(raw) - length + 1
    u = np.uint64
    least = _gram_hashes(raw)
    width, have = length - Q + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    starts = np.flatnonzero(np.r_[True, least[1:n] != least[: n - 1]])
    ends = np.r_[starts[1:], n] + length - 1
    odd = u(0xD6E8FEB86659FD93)
    powers = np.full(len(raw) + 1, odd, dtype=u)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    total = np.zeros(len(raw) + 1, dtype=u)
    mixed = (raw.astype(u) + u(1)) * u(0xA24BAED4963EE407)
    np.cumsum((mixed ^ (mixed >> u(29))) * powers[:-1], out=total[1:])
    back = np.multiply.accumulate(np.r_[u(1), np.full(len(raw), u(pow(int(odd), -1, 1 << 64)), dtype=u)])
    value = (total[ends] - total[starts]) * back[starts]
    value ^= value >> u(32)
    return least[starts] >> u(20), value * u(0x9FB21C651E98DF25), starts, ends - starts


def _fingerprints(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """(bucket, packed segments, packed repeats): of equal segments of a batch only the first goes into the first array."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            held, size = [], 0
            for doc, text in zip(frame["doc_id"], frame["text"]):
                raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
                for at in range(0, max(0, len(raw) - length + 1), BUFFER):
                    m, h, s, z = _segments(raw[at : at + BUFFER + length - 1], length)
                    part = np.empty(len(m), dtype=SEGMENT)
                    part["m"], part["h"], part["doc"], part["start"], part["size"] = m, h, doc, s + at, z
                    held.append(part)
                    size += len(part)
                if size > 400_000:
                    yield out(np.concatenate(held))
                    held, size = [], 0
            if held:
                yield out(np.concatenate(held))

    def out(part: np.ndarray) -> pd.DataFrame:
        first, later = collapsed(part)
        rows: dict[int, list] = {}
        for which, x in enumerate((first, later)):
            # repeats that are known already go to buckets of their own, whatever their minimiser
            bucket = (x["m"] % np.uint64(buckets)).astype(np.int64) if not which else buckets + np.arange(len(x)) * buckets // max(len(x), 1)
            order = np.argsort(bucket, kind="stable")
            x, bucket = x[order], bucket[order]
            cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(x) else np.zeros(0, dtype=int)
            for s, e in zip(cut, np.r_[cut[1:], len(x)]):
                rows.setdefault(int(bucket[s]), [b"", b""])[which] = x[s:e].tobytes()
        return pd.DataFrame([(b, *x) for b, x in rows.items()], columns=["bucket", "first", "later"])

    return docs.mapInPandas(run, "bucket int, first binary, later binary")


def collapsed(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The earliest of every class of equal segments, and the others."""
    part = part[np.lexsort((part["start"], part["doc"], part["h"], part["m"]))]
    same = (part["m"][1:] == part["m"][:-1]) & (part["h"][1:] == part["h"][:-1])
    first = np.r_[True, ~same] if len(part) else np.zeros(0, dtype=bool)
    leader = np.maximum.accumulate(np.where(first, np.arange(len(part)), 0)) if len(part) else np.zeros(0, dtype=int)
    itself = (part["doc"] == part["doc"][leader]) & (part["start"] == part["start"][leader])
    return part[first], part[~first & ~itself]


SPANS = "doc_id long, start long, end long, m long"


def _sorted_out(prints: DataFrame) -> DataFrame:
    """Spans per document: ``m`` null for repeats that are known, else segments that need the merge."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        first, later = collapsed(np.frombuffer(b"".join(frame["first"]), dtype=SEGMENT))
        later = np.concatenate([later, np.frombuffer(b"".join(frame["later"]), dtype=SEGMENT)])
        shared = np.zeros(len(first), dtype=bool)
        if len(first) > 1:
            twin = first["m"][1:] == first["m"][:-1]
            shared[1:] |= twin
            shared[:-1] |= twin
        need = first[shared]
        both = np.concatenate([later, need])
        m = pd.array(np.concatenate([np.zeros(len(later), dtype=np.int64), need["m"].astype(np.int64)]), dtype="Int64")
        m[: len(later)] = pd.NA
        start = both["start"].astype(np.int64)
        return pd.DataFrame({"doc_id": both["doc"], "start": start, "end": start + both["size"], "m": m})

    return prints.groupBy("bucket").applyInPandas(run, SPANS)


WINDOWS = 1 << 18  # windows of split minimisers that a task tells apart at once
PARTS = "cell long, doc_id long, start long, end long, kind int, bytes binary"
SEGMENT_PART, WINDOW_PART, KNOWN_PART = range(3)


def digests(raw: bytes, length: int) -> list[bytes]:
    """A 128-bit cryptographic digest of every string of the length."""
    return [hashlib.blake2b(raw[k : k + length], digest_size=16).digest() for k in range(len(raw) - length + 1)]


def _runs(doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places joined to (doc, start, end) where they touch or overlap."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + length)]) if len(doc) else np.zeros(0, dtype=int)
    last = np.r_[new[1:], len(doc)] - 1 if len(doc) else new
    return doc[new], start[new], start[last] + length


def first_and_later(digest: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the earliest place of each digest (two columns of 64 bits), and of its other places; a place that is there twice counts once."""
    order = np.lexsort((start, doc, digest[:, 1], digest[:, 0]))
    same = np.r_[False, (digest[order[1:]] == digest[order[:-1]]).all(axis=1)] if len(order) else np.zeros(0, dtype=bool)
    again = same & np.r_[False, (doc[order[1:]] == doc[order[:-1]]) & (start[order[1:]] == start[order[:-1]])] if len(order) else same
    return order[~same], order[same & ~again]


def _dealt(docs: DataFrame, need: DataFrame, length: int, cell_bytes: int) -> DataFrame:
    """What each cell gets: segments of the minimisers that it merges; digests of single strings of minimisers too large for a cell; repeats known by then."""
    sizes = scratch(need.groupBy("m").agg(F.sum(F.col("end") - F.col("start")).alias("n"), F.sum(F.col("end") - F.col("start") - length + 1).alias("strings")), "sizes")
    large = F.col("n") > cell_bytes
    cells = groups_for(int(sizes.agg(F.coalesce(F.sum(F.when(large, 48 * F.col("strings")).otherwise(F.col("n"))), F.lit(0))).first()[0]), cell_bytes)
    split = sizes.filter(large).select("m", F.lit(True).alias("large"))
    need = need.withColumn("large", F.lit(False)) if split.isEmpty() else need.join(split, "m", "left")
    wanted = need.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "m", "large")).alias("parts"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, found, docs_of, starts, held = [], [], [], [], 0
            for doc, text, parts in zip(frame["doc_id"], frame["text"], frame["parts"]):
                raw = text.encode("utf-8", "replace")
                for p in parts:
                    own = raw[p["start"] : p["end"]]
                    if not p["large"]:
                        rows.append((p["m"] % cells, doc, p["start"], p["end"], SEGMENT_PART, own))
                        continue
                    found += digests(own, length)
                    n = len(own) - length + 1
                    docs_of.append(np.full(n, doc))
                    starts.append(np.arange(n) + p["start"])
                    held += n
                    if held >= WINDOWS:
                        yield windows(found, docs_of, starts)
                        found, docs_of, starts, held = [], [], [], 0
            if held:
                yield windows(found, docs_of, starts)
            yield pd.DataFrame(rows, columns=["cell", "doc_id", "start", "end", "kind", "bytes"])

    def windows(found: list[bytes], docs_of: list[np.ndarray], starts: list[np.ndarray]) -> pd.DataFrame:
        digest, doc, start = np.frombuffer(b"".join(found), dtype="<u8").reshape(-1, 2), np.concatenate(docs_of), np.concatenate(starts)
        first, later = first_and_later(digest, doc, start)
        cell = (digest[first, 0] % np.uint64(cells)).astype(np.int64)
        one = pd.DataFrame({"cell": cell, "doc_id": doc[first], "start": start[first], "end": start[first] + length, "kind": WINDOW_PART, "bytes": [found[k] for k in first]})
        # repeats that are known already go to any cell
        d, s, e = _runs(doc[later], start[later], length)
        return pd.concat([one, pd.DataFrame({"cell": np.arange(len(d)) % cells, "doc_id": d, "start": s, "end": e, "kind": KNOWN_PART, "bytes": b""})], ignore_index=True)

    return docs.join(wanted, "doc_id").mapInPandas(cut, PARTS)


def _merged(docs: DataFrame, need: DataFrame, length: int, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """Repeats among segments that share a minimiser but differ."""

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        kind = frame["kind"].to_numpy()
        known = frame[kind == KNOWN_PART]
        single = frame[kind == WINDOW_PART]
        digest = np.frombuffer(b"".join(single["bytes"]), dtype="<u8").reshape(-1, 2)
        _, again = first_and_later(digest, single["doc_id"].to_numpy(), single["start"].to_numpy())
        frame = frame[kind == SEGMENT_PART].drop_duplicates(["doc_id", "start", "bytes"])
        block, string, at = repeats(frame["bytes"].tolist(), length)
        doc = frame["doc_id"].to_numpy()[string]
        start = frame["start"].to_numpy()[string] + at
        order = np.lexsort((start, doc, block))
        block, doc, start = block[order], doc[order], start[order]
        later = np.r_[False, block[1:] == block[:-1]] if len(block) else np.zeros(0, dtype=bool)
        # strings of two minimisers of one cell may overlap, so a place may be there twice
        later[1:] &= ~((doc[1:] == doc[:-1]) & (start[1:] == start[:-1]))
        d, s, e = _runs(np.r_[doc[later], single["doc_id"].to_numpy()[again]], np.r_[start[later], single["start"].to_numpy()[again]], length)
        return pd.DataFrame({"doc_id": np.r_[d, known["doc_id"]], "start": np.r_[s, known["start"]], "end": np.r_[e, known["end"]]}).astype("int64")

    return _dealt(docs, need, length, cell_bytes).groupBy("cell").applyInPandas(merge, "doc_id long, start long, end long")


def repeated_spans(docs: DataFrame, length: int = LENGTH, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """doc_id and ``spans``, the array of (start, end) byte ranges that repeat earlier bytes (they may overlap)."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = int(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    prints = _fingerprints(docs, length, groups_for(total, 8 << 20))
    spans = scratch(_sorted_out(prints), "spans")
    more = _merged(docs, spans.filter("m is not null"), length, cell_bytes)
    both = spans.filter("m is null").select("doc_id", "start", "end").unionByName(more)
    return both.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def kept_parts(raw: bytes, spans) -> tuple[list[tuple[int, int]], int, int]:
    """(kept ranges, bytes removed, maximal removed runs)."""
    kept, at, runs, removed = [], 0, 0, 0
    for s, e in sorted((p["start"], p["end"]) for p in (spans if spans is not None else ())):
        if s > at or not runs:
            kept.append((at, s))
            runs += 1
            removed += e - s
            at = e
        elif e > at:
            removed += e - at
            at = e
    kept.append((at, len(raw)))
    return kept, removed, runs


def identified(docs: DataFrame, name: str = "_id") -> DataFrame:
    """The documents with an id under that name, which no two different texts share, in the order of doc_id (null first).

    It is doc_id itself unless rows of one doc_id differ in their texts; then (doc_id, text) are
    ranked by doc_id and hashes of the text.
    """
    doc, h, g = names = [unused(docs, n) for n in ("_doc", "_h", "_g")]
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias(doc), F.xxhash64(F.coalesce("text", F.lit(""))).alias(h), F.hash(F.coalesce("text", F.lit(""))).alias(g)]
    texts = docs.select(*key).distinct()
    if texts.groupBy(doc).count().filter("count > 1").isEmpty():
        return docs.withColumn(name, key[0])
    ranked = scratch(texts.orderBy(*names).withColumn(name, F.monotonically_increasing_id()), "ranks")
    return docs.select("*", *key).join(ranked, names).drop(*names)


def with_spans(docs: DataFrame, length: int = LENGTH, cell_bytes: int = CELL_BYTES, into: str = "spans") -> DataFrame:
    """The documents with their repeated spans (null where there are none), in a new column of the given name."""
    if into in docs.columns:
        raise ValueError(f"there is a column {into!r} already")
    name = unused(docs, "_id")
    keyed = identified(docs, name)
    spans = repeated_spans(keyed.select(F.col(name).alias("doc_id"), "text"), length, cell_bytes)
    return keyed.join(spans.select(F.col("doc_id").alias(name), F.col("spans").alias(into)), name, "left").drop(name)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 100-byte strings that start earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, runs, digests = [], [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = (text or "").encode("utf-8", "replace")
                kept, n, k = kept_parts(raw, spans)
                sizes.append(len(raw))
                removed.append(n)
                runs.append(k)
                digests.append(hashlib.sha256(b"".join(raw[s:e] for s, e in kept)).hexdigest())
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in (sizes, removed, runs)), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_spans(docs).select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def sql(length: int = LENGTH) -> str:
    """The same in DuckDB: every string of the length by its first place, then runs of covered bytes."""
    return f"""WITH D AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS FIRST) AS o, hex(encode(coalesce(text, ''))) AS h FROM documents),
W AS (SELECT o, unnest(range(0, greatest(length(h) // 2 - {length - 1}, 0))) AS s, h FROM D),
H AS (SELECT o, s, md5_number(substr(h, (2 * s + 1)::INT, {2 * length})) AS k FROM W),
F AS (SELECT o, s, row_number() OVER (PARTITION BY k ORDER BY o, s) > 1 AS later FROM H),
L AS (SELECT o, s, CASE WHEN s <= lag(s) OVER (PARTITION BY o ORDER BY s) + {length} THEN 0 ELSE 1 END AS new FROM F WHERE later),
R AS (SELECT o, run, min(s) AS first, max(s) + {length} AS last FROM (SELECT o, s, sum(new) OVER (PARTITION BY o ORDER BY s ROWS UNBOUNDED PRECEDING) AS run FROM L) GROUP BY ALL),
E AS (SELECT o, first, last, coalesce(lag(last) OVER (PARTITION BY o ORDER BY first), 0) AS before FROM R),
K AS (SELECT D.o, string_agg(substr(h, (2 * before + 1)::INT, (2 * (first - before))::INT), '' ORDER BY first) AS head, max(last) AS last, sum(last - first)::BIGINT AS n, count(*) AS runs FROM E JOIN D USING (o) GROUP BY D.o)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(runs, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, (2 * coalesce(last, 0) + 1)::INT))) AS kept_sha256 FROM D LEFT JOIN K ON K.o = D.o"""

"""Operator 3: benchmark decontamination by q-gram lemma filtering.

A document is contaminated by a benchmark text of which it holds any ``REGION`` characters, or the
whole if that has at most ``WHOLE``, with edits of up to ``RATE`` of their number. Such a
window of n characters with at most e edits shares at least n - q + 1 - q * e q-grams with its
place, on diagonals no further apart than e. Shared character q-grams are counted in overlapping
bands of diagonals, for every window of a text: the count slides over the hits of a band. Windows
that reach the bound are verified by banded alignment.

Scale: documents are only mapped. The benchmark is taken in chunks of a bounded number of bytes,
each of which is collected and broadcast as an index of about 20 bytes a character, one after the other. If there are several, a
bit filter of all their q-grams (of a fixed size) goes first, by the same lemma; documents that it
lets through are written once, and only they are read again for each chunk.

Runs of one character (or phrase) in a text and in a benchmark share a q-gram at every pair of their
places. Where a buffer shares more than ``HITS``, only those q-grams go on that are the first or last
of their document with their surroundings, which loses no window, extent or distance; what is left is taken
in groups of benchmark texts of about ``HITS``, and equal windows at equal places are verified once.

Edge cases: null and empty texts hold nothing; a benchmark text of under ``LEAST`` characters is
ignored, since so short a phrase stands in clean texts too, unless ``exact_from`` asks for such texts as whole words; case and runs of white space do not
count; each row is searched by itself, whatever rows share its doc_id, and null ids are kept;
places are those in the text so normalised; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import groups_for, release, scratch, table

LEAST, REGION, WHOLE, RATE = 20, 48, 96, 0.07
Q, SHORT_Q = 10, 5  # texts shorter than REGION are found by shorter q-grams, for which the lemma leaves a bound
CHUNK_BYTES = 4 << 20
SIEVE_BITS = 27  # bits of a filter of the q-grams of one class, as a power of two
BLOCK = 1 << 20
BITS = 22
HITS = 1 << 20  # shared q-grams (or windows) that are held at once
SAME = 1 << 12  # windows from which on equal ones at equal places are verified once
COLUMNS = "doc_id long, item_id long, start long, end long, distance int, windows int"


def normal(text: str | None) -> np.ndarray:
    """Code points of a text in lower case with single spaces."""
    return np.frombuffer(" ".join((text or "").lower().split()).encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _hashes(raw: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q characters from each position."""
    n = len(raw) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(q):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += raw[k : k + n]
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def dense(hit: np.ndarray, reach: int, bound: int) -> np.ndarray:
    """The lemma without windows: known q-grams that have enough others within one window's reach."""
    if not hit.any():
        return np.zeros(0, dtype=np.int64)
    run = np.concatenate([[0], np.cumsum(hit)])
    spots = np.flatnonzero(hit)
    ahead = run[np.minimum(spots + reach, len(hit))] - run[np.maximum(spots - reach, 0)]
    return spots[ahead >= bound]


def classes(texts: list[tuple[int, np.ndarray]]) -> list[tuple[list[tuple[int, np.ndarray]], int, int]]:
    """(texts, q, window): short texts, middling ones as wholes, and all regions of the longer."""
    return [
        ([(i, t) for i, t in texts if LEAST <= len(t) < REGION], SHORT_Q, REGION),
        ([(i, t) for i, t in texts if REGION <= len(t) <= WHOLE], Q, WHOLE),
        ([(i, t) for i, t in texts if len(t) > REGION], Q, REGION),
    ]


class Sieve:
    """A bit filter of the q-grams of any number of texts, with the weakest bound of each class."""

    def __init__(self) -> None:
        self.bits = [np.zeros(1 << SIEVE_BITS - 3, dtype=np.uint8) for _ in range(3)]
        self.rule: list[tuple[int, int, int] | None] = [None, None, None]

    def add(self, texts: list[tuple[int, np.ndarray]]) -> None:
        for k, (own, q, window) in enumerate(classes(texts)):
            for _, raw in own:
                at = (_hashes(raw, q) >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)
                np.bitwise_or.at(self.bits[k], at >> 3, (1 << (at & 7)).astype(np.uint8))
                size = min(len(raw), window)
                edits = int(size * RATE)
                bound, reach = size - q + 1 - q * edits, size + edits
                old = self.rule[k]
                self.rule[k] = (q, min(bound, old[1]), max(reach, old[2])) if old else (q, bound, reach)

    def passes(self, raw: np.ndarray) -> bool:
        for bits, rule in zip(self.bits, self.rule):
            if rule:
                q, bound, reach = rule
                at = (_hashes(raw, q) >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)
                if len(dense(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0, reach, bound)):
                    return True
        return False


class Index:
    """The q-grams of some texts, of which every window of at most ``window`` characters is looked for."""

    def __init__(self, texts: list[tuple[int, np.ndarray]], q: int, window: int) -> None:
        self.q = q
        self.item = [item for item, _ in texts]
        parts = [raw for _, raw in texts]
        self.length = np.array([len(x) for x in parts], dtype=np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.flat = np.concatenate(parts) if parts else np.zeros(0, dtype="<u4")
        hashes = [_hashes(x, q) for x in parts]
        gram = np.concatenate(hashes) if parts else np.zeros(0, dtype=np.uint64)
        text = np.repeat(np.arange(len(parts), dtype=np.int32), [len(h) for h in hashes])
        at = np.concatenate([np.arange(len(h), dtype=np.int32) for h in hashes]) if parts else np.zeros(0, dtype=np.int32)
        order = np.argsort(gram, kind="stable")
        self.gram, self.text, self.at = gram[order], text[order], at[order]
        self.size = np.minimum(self.length, window)
        self.edits = np.floor(self.size * RATE).astype(np.int64)
        self.bound = self.size - q + 1 - q * self.edits
        assert (self.bound > 0).all()
        self.seen = np.zeros(1 << BITS, dtype=bool)
        self.seen[(self.gram >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def find(self, raw: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(text, offset in it, start, end, distance) of verified windows in one buffer of rows, as arrays."""
        if not len(self.gram):
            return
        h = _hashes(raw, self.q)
        spots = dense(self.seen[(h >> np.uint64(64 - BITS)).astype(np.int64)], int(self.size.max() + self.edits.max()), int(self.bound.min()))
        if not len(spots):
            return
        low = np.searchsorted(self.gram, h[spots], "left")
        n = np.searchsorted(self.gram, h[spots], "right") - low
        spots, low, n = spots[n > 0], low[n > 0], n[n > 0]
        if n.sum() > HITS:
            kept = _telling(raw, spots, np.searchsorted(starts, spots, "right"), int(self.size.max() + self.edits.max()) + self.q)
            spots, low, n = spots[kept], low[kept], n[kept]
        if not len(spots):
            return
        groups = -(-int(n.sum()) // HITS)
        for group in range(groups):
            found = [self._hits(spots[a:b], low[a:b], n[a:b], groups, group) for a, b in _slices(n, HITS)]
            yield from self._windows(raw, *(np.concatenate(c) for c in zip(*found)))

    def _hits(self, spots: np.ndarray, low: np.ndarray, n: np.ndarray, groups: int, group: int) -> tuple[np.ndarray, ...]:
        """(text, offset, diagonal) of what some q-grams of a buffer share with the texts of a group."""
        entry = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        text, at = self.text[entry].astype(np.int64), self.at[entry].astype(np.int64)
        own = slice(None) if groups == 1 else text % groups == group
        return text[own], at[own], (np.repeat(spots, n) - at)[own]

    def _windows(self, raw: np.ndarray, text: np.ndarray, at: np.ndarray, diagonal: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Windows of which enough hits lie in one band of diagonals, verified."""
        width, longest = int(self.edits.max()) + 1, int(self.length.max())
        band = (diagonal + longest) // width + 1
        # overlapping bands: a hit counts in its own band and in the one below
        keys = np.concatenate([text * (1 << 40) + band, text * (1 << 40) + band - 1])
        at = np.concatenate([at, at])
        order = np.lexsort((at, keys))
        keys, at = keys[order], at[order]
        text = keys >> 40
        # as many hits as the bound from the k-th on, all within one window: the windows from low to high
        size, last = self.size[text], np.arange(len(keys)) + self.bound[text] - 1
        inside = np.minimum(last, len(keys) - 1)
        k = np.flatnonzero((last < len(keys)) & (keys[inside] == keys) & (at[inside] - at <= size - self.q))
        if not len(k):
            return
        low = np.maximum(at[inside[k]] - size[k] + self.q, 0)
        high = np.minimum(at[k], self.length[text[k]] - size[k])
        same = np.r_[False, keys[k[1:]] == keys[k[:-1]]]
        low = np.where(same, np.maximum(low, np.r_[0, high[:-1] + 1]), low)
        n = np.maximum(high - low + 1, 0)
        for a, b in _slices(n, HITS):
            some = n[a:b]
            offset = np.repeat(low[a:b] - np.cumsum(some) + some, some) + np.arange(some.sum())
            key = np.repeat(keys[k[a:b]], some)
            yield self.verify(raw, key >> 40, offset, ((key & ((1 << 40) - 1)) - 1) * width - longest + offset, width)

    def verify(self, raw: np.ndarray, texts: np.ndarray, offsets: np.ndarray, lowest: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
        """Banded alignment of each window around its band of diagonals, all bands at once; equal windows at equal places once."""
        slack = width
        cols = 2 * width + 2 * slack
        base = lowest - slack
        place, size = base.copy(), self.size[texts]
        if len(texts) > SAME:
            # what decides is a window's characters and those of the buffer that its band can reach
            spans = np.unique(size)
            own, near = np.zeros((2, len(texts)), dtype=np.uint64), np.zeros((2, len(texts)), dtype=np.uint64)
            padded = np.concatenate([np.full(cols, 0xFFFFFFFF, dtype=raw.dtype), raw, np.full(int(size.max()) + cols, 0xFFFFFFFF, dtype=raw.dtype)])
            for span in spans:
                some = size == span
                own[:, some] = _wide(self.flat, int(span))[:, self.begin[texts[some]] + offsets[some]]
                near[:, some] = _wide(padded, int(span) + cols)[:, np.clip(base[some] + cols, 0, len(padded) - int(span) - cols)]
            _, first, back = np.unique(np.stack([own[0], own[1] ^ size.astype(np.uint64), near[0], near[1]]), axis=1, return_index=True, return_inverse=True)
            back = back.reshape(-1)
        else:
            first = back = np.arange(len(texts))
        begun, ended, cost = self._aligned(raw, texts[first], offsets[first], base[first], cols)
        good = (cost <= self.edits[texts[first]])[back]
        return texts[good], offsets[good], place[good] + begun[back][good], place[good] + ended[back][good], cost[back][good]

    def _aligned(self, raw: np.ndarray, texts: np.ndarray, offsets: np.ndarray, bases: np.ndarray, cols: int) -> tuple[np.ndarray, ...]:
        """(start, end, cost) of the best place of each window, counted from its base."""
        out: list[tuple[np.ndarray, ...]] = []
        for at in range(0, len(texts), 4096):
            x, o, base = texts[at : at + 4096], offsets[at : at + 4096], bases[at : at + 4096]
            size, first = self.size[x], self.begin[x] + o
            column = np.arange(cols)
            # cost * 256 + the column of the start: the least has the least cost, then the earliest start
            cost = np.tile(column, (len(x), 1))
            best, end = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
            for i in range(int(size.max())):
                place = base[:, None] + i + column[None, :]
                real = (place >= 0) & (place < len(raw))
                seen = np.where(real, raw[np.clip(place, 0, len(raw) - 1)], -2)
                mine = self.flat[np.minimum(first + i, len(self.flat) - 1)]
                step = cost + ((seen != mine[:, None]) << 8)
                step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 256)  # a character of the window is missing
                step = np.minimum.accumulate(step - (column << 8), axis=1) + (column << 8)  # characters inserted
                cost = step
                done = size == i + 1
                if done.any():
                    best[done] = cost[done].min(axis=1)
                    end[done] = i + cost[done].argmin(axis=1) + 1
            out.append((best & 255, end, best >> 8))
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, dtype=np.int64),) * 3


def _slices(n: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of rows whose counts sum up to about ``most`` each; a row of more has its own."""
    total = np.cumsum(n)
    edges = np.unique(np.r_[0, np.searchsorted(total, np.arange(most, int(total[-1]) if len(n) else 0, most), "right"), len(n)])
    return [(int(a), int(b)) for a, b in zip(edges[:-1], edges[1:])]


def _wide(raw: np.ndarray, size: int) -> np.ndarray:
    """Two 64-bit hashes of the ``size`` characters from each position, by doubling."""
    out = []
    for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        factor = np.uint64(seed)
        mixed = lambda a, b: ((a ^ (a >> np.uint64(29))) * factor + b) * np.uint64(0xBF58476D1CE4E5B9)
        h, n = mixed(raw.astype(np.uint64) + np.uint64(seed & 0xFFFF), np.uint64(1)), 1
        while 2 * n <= size:
            h, n = mixed(h[: len(h) - n], h[n:]), 2 * n
        out.append(mixed(h[: len(raw) - size + 1], h[size - n : size - n + len(raw) - size + 1]))
    return np.stack(out)


def _telling(raw: np.ndarray, spots: np.ndarray, rows: np.ndarray, reach: int) -> np.ndarray:
    """Which spots are a row's first or last with what stands up to ``reach`` characters around them.

    A window's first (and last) place in a row has only such spots: were one of them not the first
    of its kind, all that surrounds it, the place with it, would have stood there before. So all
    windows of the row, its first and its last place keep all their q-grams.
    """
    edge = np.full(reach, 0xFFFFFFFF, dtype=raw.dtype)
    around = _wide(np.concatenate([edge, raw, edge, edge]), 2 * reach + 1)[:, spots]
    order = np.lexsort((spots, around[1], around[0], rows))
    kind = np.stack([rows[order].astype(np.uint64), around[0][order], around[1][order]])
    new = np.r_[True, (kind[:, 1:] != kind[:, :-1]).any(axis=0)]
    return np.sort(order[new | np.r_[new[1:], True]])


class Phrases:
    """Texts too short for the lemma, which are looked up as they are, not within longer words."""

    def __init__(self, texts: list[tuple[int, np.ndarray]]) -> None:
        self.item = [item for item, _ in texts]
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in {len(t) for _, t in texts}:
            own = np.array([k for k, (_, t) in enumerate(texts) if len(t) == size])
            flat = np.stack([texts[k][1] for k in own])
            h = np.array([_hashes(t, size)[0] for t in flat])
            order = np.argsort(h, kind="stable")
            self.by_size[size] = h[order], own[order], flat[order]

    def find(self, raw: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        plain = lambda c: ((c >= 48) & (c <= 57)) | ((c >= 97) & (c <= 122))
        for size, (known, own, flat) in self.by_size.items():
            h = _hashes(raw, size)
            spots = np.flatnonzero(np.isin(h, known))
            for step in range(int(np.unique(known, return_counts=True)[1].max())):
                at = np.minimum(np.searchsorted(known, h[spots]) + step, len(known) - 1)
                same = (raw[spots[:, None] + np.arange(size)] == flat[at]).all(axis=1)
                left, right = raw[np.maximum(spots - 1, 0)], raw[np.minimum(spots + size, len(raw) - 1)]
                inner = ((spots > 0) & plain(left) & plain(raw[spots])) | ((spots + size < len(raw)) & plain(right) & plain(raw[spots + size - 1]))
                good = np.flatnonzero(same & ~inner & (known[at] == h[spots]))
                yield own[at[good]], np.zeros(len(good), dtype=np.int64), spots[good], spots[good] + size, np.zeros(len(good), dtype=np.int64)


class Benchmark:
    """Indexes of the classes of benchmark texts, and those of at least ``exact_from`` characters that are too short for them."""

    def __init__(self, items: list[tuple[int, str]], exact_from: int | None = None) -> None:
        texts = [(item, normal(text)) for item, text in items]
        self.indexes = [Index(*c) for c in classes(texts)]
        self.phrases = Phrases([(i, t) for i, t in texts if max(exact_from, 1) <= len(t) < LEAST] if exact_from is not None else [])

    def find(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int, list[int]]]:
        """(row of the buffer, item, window size, start, end, distance, offsets) of what was verified in a buffer, in a few pieces."""
        for index in (*self.indexes, self.phrases):
            for text, offset, s, e, d in index.find(raw) if index is self.phrases else index.find(raw, starts):
                if not len(text):
                    continue
                # an end lies in its document or in the gap after it, a start may lie in the gap before
                row = np.searchsorted(starts, e - 1, "right") - 1
                order = np.lexsort((offset, text, row))
                text, offset, s, e, d, row = (c[order] for c in (text, offset, s, e, d, row))
                s, e = np.maximum(s - starts[row], 0), np.minimum(e - starts[row], sizes[row])
                edges = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (row[1:] != row[:-1])])
                least, most, near = np.minimum.reduceat(s, edges), np.maximum.reduceat(e, edges), np.minimum.reduceat(d, edges)
                for k, (a, b) in enumerate(zip(edges, np.r_[edges[1:], len(text)])):
                    size = int(index.size[text[a]]) if isinstance(index, Index) else 0
                    yield int(row[a]), index.item[text[a]], size, int(least[k]), int(most[k]), int(near[k]), np.unique(offset[a:b]).tolist()


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("distance", pa.int32()), ("windows", pa.int32())])


def _matches(docs: DataFrame, items: DataFrame, exact_from: int | None) -> tuple[DataFrame, Broadcast]:
    """What :func:`contaminated` returns, and the broadcast index that it reads."""
    bench = docs.sparkSession.sparkContext.broadcast(Benchmark([(r[0], r[1]) for r in items.collect()], exact_from))
    least = LEAST - int(LEAST * RATE) if exact_from is None else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = bench.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: dict[tuple, list] = {}  # by the row, as rows may share a doc_id or have none
            for rows, starts, sizes, raw in _buffers(batch.column(1), least):
                for k, item, size, s, e, d, offsets in b.find(raw, starts, sizes):
                    seen = out.setdefault((rows[k], item), [s, e, d, set()])
                    seen[0], seen[1], seen[2] = min(seen[0], s), max(seen[1], e), min(seen[2], d)
                    seen[3].update((size, o) for o in offsets)
            found = [(ids[i], item, s, e, d, len(w)) for (i, item), (s, e, d, w) in out.items()]
            columns = zip(*found) if found else [()] * len(_SCHEMA)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, COLUMNS), bench


def _buffers(texts, least: int):
    """Rows' texts joined to about BLOCK characters, far enough apart that no window spans two: (rows, starts, sizes, characters)."""
    gap = np.zeros(WHOLE + 16, dtype="<u4")
    ids, parts, starts, sizes, size = [], [], [], [], 0
    for i, text in enumerate(texts):
        raw = normal(text.as_py())
        if len(raw) < least:
            continue
        ids.append(i)
        starts.append(size)
        sizes.append(len(raw))
        parts += [raw, gap]
        size += len(raw) + len(gap)
        if size >= BLOCK:
            yield ids, np.array(starts), np.array(sizes), np.concatenate(parts)
            ids, parts, starts, sizes, size = [], [], [], [], 0
    if parts:
        yield ids, np.array(starts), np.array(sizes), np.concatenate(parts)


def suspects(docs: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """The documents that the bit filter of all parts of the benchmark lets through, written once."""
    sieve = Sieve()
    for part in parts:
        sieve.add([(r[0], normal(r[1])) for r in part.collect()])
    shared = docs.sparkSession.sparkContext.broadcast(sieve)  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([shared.value.passes(normal(t.as_py())) for t in batch.column(1)], pa.bool_()))

    return scratch(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, text string"), "suspects")


def contaminated(docs: DataFrame, benchmark: DataFrame, chunk_bytes: int = CHUNK_BYTES, exact_from: int | None = None) -> DataFrame:
    """One row per document and benchmark text found in it: extent, least distance, windows found.

    Benchmark texts of at least ``exact_from`` but under ``LEAST`` characters are found where they stand exactly, as whole words.
    """
    items = benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).filter("item_id is not null")
    chunks = groups_for(int(items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]), chunk_bytes)
    if chunks == 1:
        return _matches(docs, items, exact_from)[0]
    parts = [items.filter(F.pmod(F.xxhash64("item_id"), F.lit(chunks)) == k) for k in range(chunks)]
    left, found = suspects(docs, parts) if exact_from is None else docs, []
    for part in parts:  # one after the other, so that one index is held at a time
        one, bench = _matches(left, part, exact_from)
        found.append(scratch(one, "found"))
        bench.destroy()
    if exact_from is None:
        release(left)
    return functools.reduce(DataFrame.unionByName, found)


def op3_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text found in a document, whole or in part, with up to 7 % edits; phrases of under 20 characters exactly."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), exact_from=1)

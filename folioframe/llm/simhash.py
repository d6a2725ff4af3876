"""Operator 6: near-duplicates by SimHash with bit-sliced comparison.

A fingerprint takes, bit by bit, the majority over the hashes of a text's word shingles. The 64
bits are cut into two fields more than the radius; fingerprints within the radius agree wholly on
two of them, so they meet in the bucket of a pair of fields. Buckets of a task lie side by side,
sorted, in one vertical block: bit planes hold one bit of 64 fingerprints a word. Every
fingerprint is compared with that some lanes further on by shifting the planes, differing bits
are added up by carry-save counters, lanes of other buckets are masked out, and words all of
whose lanes have passed the radius are abandoned. So buckets of any size, small ones too, go
through the same counters.

Scale: equal fingerprints are one record. With radius 3 a bucket's key has 25 bits or more, so at
ten thousand million fingerprints a bucket holds a few hundred by chance. Buckets are cut into blocks of
bounded size and every pair of a bucket's blocks is a task record of its own, so a hot bucket
spreads over tasks and none is capped. A pair of blocks yields links that span its components, at
most one a fingerprint, not every pair. Components come from contracting the links by random
priorities, each round written to the shared folder.

Edge cases: null and word-less texts have fingerprint zero and link like any other; repeated
rows and equal texts share a component; rows without a doc_id link what they are near to, and a
component of such rows alone has none; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded_batches, release, scratch, table

RADIUS = 3
BLOCK = 2048
COUNT_BITS = 7  # 2**7 counts of a byte
CELL_BYTES = 16 << 20  # shingle sets of one block
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None, size: int) -> list[str]:
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return []
    if len(words) <= size:
        return [" ".join(words)]
    return list(map(" ".join, zip(*(words[k:] for k in range(size)))))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    import xxhash

    each = shingles(text, size)
    return np.fromiter((xxhash.xxh64_intdigest(s.encode("utf-8", "replace"), 42) for s in each), dtype="<u8", count=len(each))


def majority(h: np.ndarray) -> int:
    """Bits that are set in over half of the hashes; zero for none."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, size: int = 3) -> int:
    return majority(shingle_hashes(text, size))


def node_of(fp: int, h: np.ndarray) -> int:
    """Class of a text, of its fingerprint and distinct shingle hashes; a signed long.

    The fingerprint alone would not do: shingles that repeat often decide every bit of it.
    """
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), int(fp))).view(np.int64))


def counts(h: np.ndarray) -> bytes:
    """How many of the distinct hashes lie in each of ``2**COUNT_BITS`` equal ranges, a byte each; 255 stands for more."""
    return np.minimum(np.bincount((h >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=1 << COUNT_BITS), 255).astype(np.uint8).tobytes()


def may_reach(one: np.ndarray, many: np.ndarray, n_one: int, n_many: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets could have the similarity by a bound of what they share; never False for sets that have it."""
    shared = np.minimum(one, many).sum(axis=1, dtype=np.int64)
    open_ = ((one == 255) & (many == 255)).any(axis=1)
    shared = np.where(open_, np.minimum(n_one, n_many), shared)
    return shared >= similarity * (n_one + n_many - shared)


def fingerprints(docs: DataFrame, size: int = 3, keys: int = 0) -> DataFrame:
    """doc_id and fingerprint (as a signed long); with ``keys``, also what :func:`links_by_text` takes.

    That is the class ``node``, as many least shingle hashes (each of another order), the number
    ``n`` of distinct shingles, their :func:`counts`, and a hash of the text that finds it again.
    """
    rng = np.random.default_rng(12)
    factors = rng.integers(0, 2**63, keys, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def least(h: np.ndarray) -> np.ndarray:
        if not len(h):
            return np.zeros(keys, dtype=np.int64)
        mixed = h ^ (h >> np.uint64(31))
        return np.array([(mixed * f).min() for f in factors], dtype=np.uint64).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, nodes, least_of, sizes, held = np.zeros(batch.num_rows, dtype=np.uint64), [], [], [], []
            for i, text in enumerate(batch.column(1)):
                h = shingle_hashes(text.as_py(), size)
                prints[i] = majority(h)
                if keys:
                    own = np.unique(h)
                    nodes.append(node_of(prints[i], own))
                    least_of.append(least(own))
                    sizes.append(len(own))
                    held.append(counts(own))
            fps = pa.array(prints.view(np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), fps, pa.array(nodes, pa.int64()), pa.array(least_of, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), pa.array(held, pa.binary())], ["doc_id", "text_hash", "fp", "node", "keys", "n", "counts"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), fps], ["doc_id", "fp"])

    made = docs.select(F.col("doc_id").cast("long"), "text", *([F.xxhash64("text").alias("text_hash")] if keys else []))
    return made.mapInArrow(run, "doc_id long, text_hash long, fp long, node long, keys array<long>, n long, counts binary" if keys else "doc_id long, fp long")


def planes(values: np.ndarray) -> np.ndarray:
    """64 x words matrix: row b holds bit b of every value, 64 values a word."""
    padded = np.zeros(-(-len(values) // 64) * 64, dtype="<u8")
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def _beyond(counter: np.ndarray, radius: int) -> np.ndarray:
    """Bits of the lanes whose counters exceed the radius."""
    above, equal = np.zeros_like(counter[0]), np.full_like(counter[0], np.uint64(0xFFFFFFFFFFFFFFFF))
    for d in reversed(range(len(counter))):
        if radius >> d & 1:
            equal &= counter[d]
        else:
            above |= equal & counter[d]
            equal &= ~counter[d]
    return above


def lanes_apart(vertical: np.ndarray, by: int, valid: np.ndarray, radius: int) -> np.ndarray:
    """Lanes (as positions) that differ in at most ``radius`` bits from the lane ``by`` further on.

    ``valid`` has a bit for every lane to be compared. Words all of whose lanes have passed the
    radius are abandoned, every eight planes.
    """
    word, bit = divmod(by, 64)
    at = np.flatnonzero(valid)
    last = vertical.shape[1] - 1
    low, high = np.minimum(at + word, last), np.minimum(at + word + 1, last)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    depth = (radius + 1).bit_length()
    counter = np.zeros((depth, len(at)), dtype=np.uint64)
    over = ~valid[at]  # lanes that are out, as they passed 2 ** depth or were not asked for
    for b in range(64):
        plane = vertical[b]
        carry = (plane[low] >> np.uint64(bit)) | (plane[high] << np.uint64(64 - bit)) if bit else plane[low]
        carry = carry ^ plane[at]
        for d in range(depth):
            counter[d], carry = counter[d] ^ carry, counter[d] & carry
        over |= carry
        if b % 8 == 7:
            alive = (over | _beyond(counter, radius)) != full
            if not alive.all():
                at, low, high, over, counter = at[alive], low[alive], high[alive], over[alive], counter[:, alive]
                if not len(at):
                    return np.zeros(0, dtype=np.int64)
    near = ~(over | _beyond(counter, radius))
    lanes = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little"))
    return at[lanes >> 6] * 64 + (lanes & 63)


def near_pairs(values: np.ndarray, cell: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (a, b), a before b, of values of one cell within the radius, in portions.

    Cells are consecutive. Lanes of cells that have no further partner are taken out as the
    distance between lanes grows, so the work is that of the pairs.
    """
    n = len(values)
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if n else np.zeros(0, dtype=np.int64)
    size = np.diff(np.r_[first, n])
    left = np.repeat(first + size, size) - np.arange(n)  # lanes of the cell from here on, itself included
    kept, by = np.arange(n), 1
    whole = np.repeat(size, size)
    vertical = planes(values)
    while True:
        if by & (by - 1) == 0 and len(kept):  # smaller cells have no partners any more
            stay = whole[kept] > by
            if not stay.all():
                kept = kept[stay]
                vertical = planes(values[kept])
        if not len(kept):
            return
        valid = left[kept] > by
        if not valid.any():
            return
        bits = np.zeros(vertical.shape[1] * 64, dtype=np.uint8)
        bits[: len(kept)] = valid
        lanes = lanes_apart(vertical, by, np.packbits(bits, bitorder="little").view("<u8"), radius)
        if len(lanes):
            yield kept[lanes], kept[lanes + by]
        by += 1


class _Groups:
    """Groups of n nodes, each named by its least member."""

    def __init__(self, n: int) -> None:
        self.name = np.arange(n)

    def join(self, a: int, others: np.ndarray) -> bool:
        """Put a and the others into one group; False if they are in one already."""
        names = np.unique(np.r_[self.name[a], self.name[others]])
        if len(names) > 1:
            self.name[np.isin(self.name, names)] = names[0]
        return len(names) > 1

    def join_all(self, a: np.ndarray, b: np.ndarray) -> None:
        """Put each a and its b into one group."""
        while True:
            x, y = self.name[a], self.name[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.name, np.maximum(x, y), np.minimum(x, y))
            while (self.name != (up := self.name[self.name])).any():
                self.name = up


def by_fields(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, field, value: distinct fingerprints by pairs of their radius + 2 bit fields; this misses no pair within the radius."""
    fields = radius + 2
    ends = [round(64 * k / fields) for k in range(fields + 1)]
    part = lambda k: f"(shiftrightunsigned(fp, {ends[k]}) & {(1 << (ends[k + 1] - ends[k])) - 1}L)"
    pairs = [(i, j) for i in range(fields) for j in range(i)]
    field = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.expr(f"shiftleft({part(i)}, {ends[j + 1] - ends[j]}) | {part(j)}").alias("value")) for k, (i, j) in enumerate(pairs)]))
    return prints.select("fp").distinct().select("fp", field.alias("x")).select("fp", "x.field", "x.value")


CHUNK = 1 << 15  # records compared side by side


def _whole_cells(frames: Iterator[pd.DataFrame], names: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """The frames, which come sorted by the names, as frames of whole cells, and the cell of each row."""

    def numbered(frame: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        cell = frame[names].to_numpy()
        return frame, np.cumsum(np.r_[False, (cell[1:] != cell[:-1]).any(axis=1)])

    kept: list[pd.DataFrame] = []
    rows = 0
    for frame in frames:
        if not len(frame):
            continue
        kept.append(frame)
        rows += len(frame)
        if rows >= CHUNK:
            whole, cell = numbered(pd.concat(kept, ignore_index=True))
            cut = int(np.searchsorted(cell, cell[-1]))
            if cut:
                yield whole.iloc[:cut].reset_index(drop=True), cell[:cut]
            kept, rows = [whole.iloc[cut:]], len(whole) - cut
    if kept and rows:
        yield numbered(pd.concat(kept, ignore_index=True))


CELL = ["field", "value", "i", "j"]


def _cells(keyed: DataFrame, blocks) -> DataFrame:
    """Records of buckets (field, value) that hold several, one for each cell (i, j) of two blocks that their own is in."""
    sizes = keyed.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n_records"), blocks.cast("int").alias("blocks")).filter("n_records > 1").drop("n_records")
    keyed = keyed.join(sizes, ["field", "value"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    # block i meets every block j >= i: a record goes to each pair that its own block is in
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(F.col("own"), o).alias("i"), F.greatest(F.col("own"), o).alias("j"))))
    return keyed.withColumn("p", pair).select("*", "p.i", "p.j").drop("p", "blocks")


def links(keyed: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Spanning links a, b (longs) between fingerprints ``fp`` of a bucket (field, value) within ``radius`` bits."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, cell in _whole_cells(frames, CELL):
            values = frame["fp"].to_numpy().view(np.uint64)
            groups = _Groups(len(values))
            for a, b in near_pairs(values, cell, radius):
                groups.join_all(a, b)
            child = np.flatnonzero(groups.name != np.arange(len(values)))
            if len(child):
                yield pd.DataFrame({"a": values[child].view(np.int64), "b": values[groups.name[child]].view(np.int64)})

    cells = _cells(keyed, F.ceil(F.count(F.lit(1)) / block)).select("fp", *CELL)
    return cells.repartition(*CELL).sortWithinPartitions(*CELL, "fp").mapInPandas(run, "a long, b long").distinct()


def _met(frame: pd.DataFrame, cell: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within the radius, except those that meet in another cell too.

    A pair counts in the first field whose keys agree, and there in the cell of its two blocks.
    """
    values, keys, own = frame["fp"].to_numpy().view(np.uint64), np.array(frame["keys"].tolist(), dtype=np.int64), frame["own"].to_numpy()
    field, two_blocks = frame["field"].to_numpy(), (frame["i"] != frame["j"]).to_numpy()
    for a, b in near_pairs(values, cell, radius):
        for at in range(0, len(a), 1 << 16):
            x, y = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
            first = (keys[x] == keys[y]).argmax(axis=1) == field[x]
            good = first & ~(two_blocks[x] & (own[x] == own[y]))
            if good.any():
                yield x[good], y[good]


def _candidates(frame: pd.DataFrame, cell: np.ndarray, radius: int, similarity: float) -> np.ndarray:
    """Positions of the records that have a pair which could reach the similarity."""
    held, n = np.frombuffer(b"".join(frame["counts"]), dtype=np.uint8).reshape(len(frame), -1), frame["n"].to_numpy()
    asked = np.zeros(len(frame), dtype=bool)
    for a, b in _met(frame, cell, radius):
        for at in range(0, len(a), 1 << 14):
            x, y = a[at : at + (1 << 14)], b[at : at + (1 << 14)]
            good = may_reach(held[x], held[y], n[x], n[y], similarity)
            asked[x[good]] = asked[y[good]] = True
    return np.flatnonzero(asked)


def _verified(frame: pd.DataFrame, cell: np.ndarray, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of links of the similarity that span the groups which all such pairs make.

    Only pairs of one group are spared the comparison of their sets: one pair of every two groups
    is tried first, then all pairs of the groups that are still apart.
    """
    groups, sets = _Groups(len(frame)), frame["h"].tolist()
    size = np.array([len(x) for x in sets], dtype=np.int64)
    start = np.cumsum(size) - size
    flat = np.unique(np.concatenate(sets).astype(np.int64), return_inverse=True)[1]
    mark = np.zeros(len(flat) + 1, dtype=bool)
    found, pairs = [], list(_met(frame, cell, radius))
    if not pairs:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    early, late = (np.concatenate(x) for x in zip(*pairs))
    near = np.minimum(size[early], size[late]) >= similarity * np.maximum(size[early], size[late])
    early, late = early[near], late[near]
    order = np.lexsort((early, late))
    early, late = early[order], late[order]
    cuts = np.flatnonzero(np.r_[True, late[1:] != late[:-1]]) if len(late) else np.zeros(0, dtype=np.int64)
    for s, e in zip(cuts, np.r_[cuts[1:], len(late)]):
        i, hits = late[s], early[s:e]
        marked = False
        for first in (True, False):
            hits = hits[groups.name[hits] != groups.name[i]]
            if not len(hits):
                break
            if not marked:
                mark[flat[start[i] : start[i] + size[i]]] = marked = True
            some = np.unique(groups.name[hits], return_index=True)[1] if first else np.arange(len(hits))
            tried, hits = hits[some], np.delete(hits, some)
            ends = np.cumsum(size[tried])
            total = np.r_[0, np.cumsum(mark[flat[np.repeat(start[tried] - ends + size[tried], size[tried]) + np.arange(ends[-1])]])]
            shared = total[ends] - total[ends - size[tried]]
            for j in tried[shared >= similarity * (size[tried] + size[i] - shared)]:
                if groups.join(i, np.array([j])):
                    found.append((i, j))
        if marked:
            mark[flat[start[i] : start[i] + size[i]]] = False
    a, b = np.array(found, dtype=np.int64).reshape(-1, 2).T
    return a, b


def links_by_text(prints: DataFrame, docs: DataFrame, size: int, radius: int, similarity: float, block: int = BLOCK) -> DataFrame:
    """Links a, b of classes of :func:`fingerprints` that share a key, lie within the radius and have the similarity.

    Cells are gone through twice. The first time, a bound drops pairs that cannot have the
    similarity; only texts of the others are read again, one a class, and the second time the
    sets of their shingles decide. Every pair is decided so unless its texts are in one group already.
    """
    bounded_batches(docs.sparkSession)
    no_id = lambda c: F.coalesce(c, F.lit(-(2**63)))

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, cell in _whole_cells(frames, CELL):
            asked = _candidates(frame, cell, radius, similarity)
            if len(asked):
                yield frame.iloc[asked][["node", "fp", "keys", "own", *CELL]]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sets = [], []
            for node, text in zip(batch.column(0), batch.column(1)):
                h = shingle_hashes(text.as_py(), size)
                own = np.unique(h)
                if node_of(majority(h), own) == node.as_py():
                    nodes.append(node.as_py())
                    sets.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "h"])

    def second(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole, cells in _whole_cells(frames, CELL):
            # sets are large: so many cells at once as hold about CELL_BYTES of them
            held = np.cumsum(whole["h"].map(len).to_numpy() * 8) // CELL_BYTES
            part = held[np.searchsorted(cells, cells)]
            for p in np.unique(part):
                frame, cell = whole[part == p].reset_index(drop=True), cells[part == p]
                a, b = _verified(frame, cell, radius, similarity)
                nodes = frame["node"].to_numpy()
                if len(a):
                    yield pd.DataFrame({"a": nodes[a], "b": nodes[b]})

    records = prints.select("node", "fp", "keys", "n", "counts").dropDuplicates(["node"])
    cells = _cells(records.select("*", F.posexplode("keys").alias("field", "value")), F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n") * 8 / CELL_BYTES)))
    asked = scratch(cells.repartition(*CELL).sortWithinPartitions(*CELL, "node").mapInPandas(first, "node long, fp long, keys array<long>, own int, field int, value long, i int, j int"), "asked")
    at = prints.groupBy("node").agg(F.min(F.struct(no_id(F.col("doc_id")).alias("id"), "text_hash")).alias("at")).join(asked.select("node").distinct(), "node").select("node", "at.id", "at.text_hash")
    texts = docs.select(no_id(F.col("doc_id").cast("long")).alias("id"), F.xxhash64("text").alias("text_hash"), "text").join(at, ["id", "text_hash"])
    sets = texts.select("node", "text").mapInArrow(hashed, "node long, h array<long>").dropDuplicates(["node"])
    return asked.join(sets, "node").repartition(*CELL).sortWithinPartitions(*CELL, "node").mapInPandas(second, "a long, b long").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node -> label over links (a, b); every node of a component gets the same label.

    Each round maps every node to the neighbour (or itself) of least random priority and
    contracts; a constant share of the nodes goes each round, whatever the shape.
    """
    edges = scratch(edges.select("a", "b").filter("a <> b"), "links")
    labels = None
    for k in range(max_rounds):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("r"), F.col(c).alias("n"))  # noqa: B023, E731
        best = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("node"), F.least(F.col("m"), rank("a")).getField("n").alias("to"))
        best = scratch(best, "moves")
        step = edges.join(best.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(best.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        before, edges = edges, scratch(step.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct(), "links")
        release(before)
        if labels is None:
            labels = best.select("node", F.col("to").alias("label"))
        else:
            moved = best.select(F.col("node").alias("label"), "to")
            before, labels = labels, scratch(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
            release(before, best)
    else:
        raise RuntimeError("links did not contract")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")) if labels is None else labels


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = RADIUS, keys: int = 0, similarity: float = 0.8) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that a document reaches, itself included.

    Without ``keys`` every pair within the radius is found, which needs a small radius. With
    them, buckets of equal least shingle hashes allow a wide radius: a pair of similarity s meets
    with chance 1 - (1 - s) ** keys, and only pairs whose texts' shingle sets have the
    ``similarity`` link.
    """
    prints = scratch(fingerprints(docs, size, keys), "fingerprints")
    if keys:
        found = links_by_text(prints, docs, size, radius, similarity)
    else:
        found = links(by_fields(prints, radius), radius)
        prints = prints.withColumn("node", F.col("fp"))
    classes = prints.groupBy("node").agg(F.min("doc_id").alias("first"))
    grouped = classes.join(components(found), "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = grouped.groupBy("label").agg(F.min("first").alias("component_id"))
    ids = grouped.select("node", "label").join(least, "label").select("node", "component_id")
    return prints.join(ids, "node").select("doc_id", "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

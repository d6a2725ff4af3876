"""Operator 1: vector best-fit packing of tokenised documents into training sequences.

Documents become *pieces* (a tokenised document, cut only where it exceeds a sequence), pieces
become items with three demands - tokens, documents, attention cost (length squared) - and bins
are sequences with a capacity in each. Items are placed largest first into the open bin that is
best by the chosen rule under every constraint.

Scale: tokenising is map-only. Placement runs in hash groups of a bounded number of pieces, so
no task ever sees the corpus; bins that stay noticeably empty are dissolved and their pieces
packed again over coarser groups, which leaves a handful of part-filled bins per group of groups.

Edge cases: null text counts as empty and yields one piece holding only the separator id; null
doc_id is kept; repeated rows yield repeated pieces; an empty table yields no rows; extra
columns are ignored.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import groups_for, scratch, table

MAX_TOKENS = 2048
TOKENIZER = "word_bpe_49k.json"
#: Words kept per Python worker; the cache starts anew beyond it, so memory is bounded.
WORD_CACHE = 1_000_000
PIECES_PER_GROUP = 16_384
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordIds(dict):
    """White-space-free chunk -> its token ids as little-endian uint32 bytes.

    The tokenizer lower-cases, drops white space and never joins text over it, so a text's ids
    are the concatenation of its chunks' ids. For texts within Latin-1, which lower-case letter
    by letter and need no composing, chunks are cut finer: a stop or comma that stands alone
    after a letter is a chunk, and runs of letters go straight to the tokenizer's model.
    """

    STOPS = re.compile(r"(?<=[a-z\xdf-\xf6\xf8-\xff])([.,])(?=\s|$)")
    LETTERS = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+")

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        spell = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelling = {c: "".join(x for x, _ in spell.pre_tokenize_str(chr(c))) for c in range(0xC0, 0x100)}

    def __missing__(self, chunk: str) -> bytes:
        if self.LETTERS.fullmatch(chunk):
            ids = [t.id for t in self.model.tokenize(chunk.translate(self.spelling))]
        else:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(chunk) <= 64:
            if len(self) >= WORD_CACHE:
                self.clear()
                self[""] = b""
            self[chunk] = packed
        return packed

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        try:
            text.encode("latin-1")
            text = self.STOPS.sub(r" \1", text.lower())
        except UnicodeEncodeError:
            pass
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@functools.lru_cache(maxsize=1)
def _words(path: str) -> WordIds:
    """One cache per Python worker, kept from task to task."""
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, separator: bytes = b"\0\0\0\0") -> DataFrame:
    """Tokenise whole texts (plus the separator id) and cut those over ``max_tokens``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(tokenizer_path)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = words.encode(text.as_py()) + separator
                n = len(ids) // 4
                for k, start in enumerate(range(0, n, max_tokens)):
                    part = ids[4 * start : 4 * (start + max_tokens)]
                    for column, value in zip(out, (doc_id, k, start, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def best_fit(demand: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "residual") -> np.ndarray:
    """Bin number of each item; ``demand`` is items x dimensions, in placement order.

    ``residual`` takes the feasible bin whose weighted residual norm after placement is least,
    ``dot`` the one with the largest weighted dot product of demand and residual. Residuals are
    scaled by capacity. Ties go to the oldest bin. A bin that cannot take even the smallest
    demand still to come is closed.
    """
    n, dims = demand.shape
    bins = np.full(n, -1, dtype=np.int64)
    if not n:
        return bins
    if (demand > capacity).any():
        raise ValueError("an item exceeds a sequence's capacity")
    least = np.minimum.accumulate(demand[::-1], axis=0)[::-1]
    left = np.empty((dims, n))
    name = np.empty(n, dtype=np.int64)
    scale = (weights / capacity**2)[:, None]
    opened = made = 0
    for i in range(n):
        need = demand[i][:, None]
        if i % 256 == 0 and opened:
            keep = (left[:, :opened] >= least[i][:, None]).all(axis=0)
            kept = int(keep.sum())
            left[:, :kept], name[:kept], opened = left[:, :opened][:, keep], name[:opened][keep], kept
        room = left[:, :opened] - need
        ok = (room >= 0).all(axis=0)
        if ok.any():
            score = (scale * room * room).sum(axis=0) if rule == "residual" else -(scale * need * left[:, :opened]).sum(axis=0)
            j = int(np.where(ok, score, np.inf).argmin())
            left[:, j] = room[:, j]
            bins[i] = name[j]
        else:
            left[:, opened], name[opened], bins[i] = capacity - demand[i], made, made
            opened, made = opened + 1, made + 1
    return bins


def pack(
    items: DataFrame,
    max_tokens: int = MAX_TOKENS,
    max_documents: int | None = None,
    max_attention: float | None = None,
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0),
    rule: str = "residual",
    per_group: int = PIECES_PER_GROUP,
    slack: float = 0.004,
    rounds: int = 2,
) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (see :func:`pieces`).

    ``items`` should be a table, not a recomputed plan: it is counted and read. Each round packs
    within groups of about ``per_group`` pieces, dealt by their place in the table so that no key
    or text makes a group large; between rounds, bins with more than ``slack`` of their tokens
    free are dissolved and only their pieces go on.

    A bin's residual counts by all three capacities. The default capacities of documents and
    attention are what a sequence of ``max_tokens`` can hold at most, so they choose bins but never
    cost a sequence; smaller ones bind.
    """
    capacity = np.array([max_tokens, max_documents or max_tokens, max_attention or float(max_tokens) ** 2], dtype=float)
    weight = np.array(weights, dtype=float)
    schema = f"{PIECES.replace('piece int', 'none boolean, piece int')}, sequence_id long, offset long, done boolean"

    def place(round_no: int, last: bool):
        def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(["length", "doc_id", "piece", "start"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
            size = part["length"].to_numpy(dtype=float)
            whole = int((size >= max_tokens).sum())  # these fill a sequence each, and come first
            demand = np.stack([size, np.ones_like(size), size * size], axis=1)
            bins = np.concatenate([np.arange(whole), whole + best_fit(demand[whole:], capacity, weight, rule)]).astype(np.int64)
            order = np.argsort(bins, kind="stable")
            ends = np.cumsum(size[order])
            first = np.r_[True, bins[order][1:] != bins[order][:-1]] if len(order) else np.zeros(0, bool)
            offset = np.empty(len(size))
            offset[order] = ends - size[order] - np.repeat((ends - size[order])[first], np.diff(np.r_[np.flatnonzero(first), len(order)]))
            fill = np.bincount(bins, weights=size) if len(bins) else np.zeros(0)
            part["sequence_id"] = (np.int64(round_no) << 60) + (np.int64(key[0]) << 28) + bins
            part["offset"] = offset.astype(np.int64)
            part["done"] = last | (fill[bins] >= (1 - slack) * max_tokens)
            return part.drop(columns="group")

        return run

    out, rest = None, items
    for k in range(rounds):
        n = groups_for(rest.count(), per_group)
        last = k == rounds - 1 or (n == 1 and k == 0)
        # in pandas a null would turn the ids beside it into doubles, so it travels as a mark of its own
        keyed = rest.select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), F.col("doc_id").isNull().alias("none"), "piece", "start", "length", "ids_crc32", F.pmod(F.xxhash64("ids_crc32", F.monotonically_increasing_id()), F.lit(n)).cast("int").alias("group"))
        placed = keyed.groupBy("group").applyInPandas(place(k, last), schema)
        placed = placed.withColumn("doc_id", F.when(~F.col("none"), F.col("doc_id"))).drop("none")
        if last:
            full = placed
        else:
            placed = scratch(placed, "packed")
            full, rest = placed.filter("done"), placed.filter("not done").select("doc_id", "piece", "start", "length", "ids_crc32")
        full = full.drop("done")
        out = full if out is None else out.unionByName(full)
        if last:
            break
    return out


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens, one row per piece."""
    import public_tokenizers

    cut = pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return pack(scratch(cut, "pieces"))

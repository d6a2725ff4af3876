"""Operator 9: toxicity by class-conditional Kneser-Ney models of how words are spelt.

Two models, of toxic and of ordinary labelled texts, predict each byte of a word from up to seven
before it, back to the word's start. A class's own counts are discounted into one shared
Kneser-Ney model, whose shorter contexts (six bytes, three, one) count continuations over both
classes; an expression that is rare in either class so falls back on what both say about its
parts, and what both back off to cancels. A word's log-likelihood ratio is the sum over its bytes.
A text is scored by its ratio a byte as a whole, and by the ratios of its words pooled: the
largest, the mean of the three largest, the logarithm of the mean likelihood ratio, and the
largest for the number of words. A logistic curve fitted on a calibration fold, which the counts
leave out, turns them into a probability.

Order, shorter contexts and pooling were chosen inside the folds that may be learnt from.

Scale: counting is a map with a combine per task (distinct grams only) and one shuffle on the
gram; the smoothing is a chain of joins on shrinking tables. Scoring is map-only against two
broadcast hash tables, which hold every gram and context, up to ``MOST`` of each. If there are more, the most seen
are broadcast and the rest stays a table: a bit filter of fixed size tells which texts hold one of it,
and what they hold is looked up by a shuffle join and goes into the scoring with them. No gram is lost at any size.

Edge cases: null and empty texts have ratios of zero; a word of over ``BLOCK`` bytes counts as
several; a null doc_id counts as not held out and learns nothing; without usable labels of both
classes every score is the share of toxic labels (0 without labels); repeated rows are scored
alike; columns named ``score`` or ``predicted`` are replaced; empty tables give no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fold, hash_of_longs, held_out, labelled, logistic, sampled, scratch, table, unused

LEVELS = (8, 6, 3, 1)  # bytes of a gram, and of the shorter ones it falls back on
ORDER = LEVELS[0]
MOST = 1 << 22  # grams (or contexts) of a broadcast table, which takes 12 bytes for each
FILTER_BITS = 26  # bits of the filter of the others, as a power of two
BLOCK = 1 << 19  # bytes handled at once
CALIBRATION_FOLD = 1
CALIBRATION_ROWS = 40_000  # bound on the rows the logistic curve is fitted on
FEATURES = 5
CLIP = 12.0
SPACE = bytes.maketrans(b"\t\n\v\f\r", b"     ")


def _blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, end of each part, text of each part), about BLOCK bytes at once.

    Each part begins and ends with a space. Long texts come in several parts, cut at spaces.
    """
    parts, docs, size = [], [], 0
    for i, text in enumerate(texts):
        raw = (text or "").lower().encode("utf-8", "replace").translate(SPACE)
        at = 0
        while at < len(raw):
            end = len(raw)
            if end - at > BLOCK:
                end = raw.rfind(b" ", at + 1, at + BLOCK) + 1 or at + BLOCK
            parts.append(b" " + raw[at:end] + b" ")
            docs.append(i)
            size += len(parts[-1])
            at = end
            if size >= BLOCK:
                yield np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum([len(p) for p in parts]), np.array(docs)
                parts, docs, size = [], [], 0
    if parts:
        yield np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum([len(p) for p in parts]), np.array(docs)


def _grams(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the bytes of words (the space after one is its last), and the gram that ends at each.

    A gram holds the byte and up to seven before it, none before the space that opens its word.
    """
    space = raw == 32
    place = np.flatnonzero(~space[1:] | ~space[:-1]) + 1
    if not len(place):
        return place, np.zeros(0, dtype=np.uint64)
    opened = np.maximum.accumulate(np.where(space, np.arange(len(raw)), 0))[place - 1]
    reach = np.minimum(place - opened + 1, ORDER)
    g = np.zeros(len(place), dtype=np.uint64)
    for back in range(ORDER):
        inside = reach > back
        g |= np.where(inside, raw[np.maximum(place - back, 0)].astype(np.uint64) << np.uint64(8 * back), np.uint64(0))
    return place, g


def count_grams(rows: DataFrame) -> DataFrame:
    """Gram counts by class: g long, toxic long, ordinary long."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {0: [], 1: []}
        size = 0

        def merged(chunks):
            keys = np.concatenate([k for k, _ in chunks])
            n = np.concatenate([c for _, c in chunks])
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            return keys[first], np.add.reduceat(n, first)

        def out():
            for label, chunks in held.items():
                if chunks:
                    keys, n = merged(chunks)
                    yield pd.DataFrame({"g": keys.view(np.int64), "label": np.int32(label), "n": n})
                    chunks.clear()

        for frame in frames:
            for label in (0, 1):
                for raw, _, _ in _blocks(frame["text"][frame["label"] == label].tolist()):
                    place, g = _grams(raw)
                    if len(place):
                        held[label].append(np.unique(g, return_counts=True))
                        size += len(held[label][-1][0])
                    if size > 2_000_000:
                        for k in (0, 1):
                            if held[k]:
                                held[k] = [merged(held[k])]
                        size = sum(len(c[0][0]) for c in held.values() if c)
                        if size > 1_500_000:
                            yield from out()
                            size = 0
        yield from out()

    counts = rows.select("text", "label").mapInPandas(run, "g long, label int, n long")
    toxic = F.col("label") == 1
    return counts.groupBy("g").agg(F.sum(F.when(toxic, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(toxic, 0).otherwise(F.col("n"))).alias("ordinary"))


def _last(n: int) -> Column:
    """The last n bytes of a gram."""
    return F.col("g").bitwiseAND(F.lit((1 << 8 * n) - 1))


def _context() -> Column:
    return F.shiftrightunsigned("g", 8)


def smoothed(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g, w, ratio) of grams and of contexts (as ``g``), from gram counts; w is how often each was seen.

    The ratio is log P(byte | context, toxic) - log P(byte | context, ordinary). For a byte not
    seen after a context it is the ratio of the two weights that the classes give to the shared
    model, which itself cancels; after a context that neither class has seen it is zero.
    """
    types = {}
    above = counts
    for n in LEVELS[1:]:  # written, as two users would else aggregate the longer grams each
        types[n] = above = scratch(above.groupBy(_last(n).alias("g")).agg(F.count(F.lit(1)).alias("k")), "types")

    def discount(column, where):
        once, twice = F.sum(F.when(column == 1, 1.0).otherwise(0.0)), F.sum(F.when(column == 2, 1.0).otherwise(0.0))
        return F.greatest(F.lit(0.1), F.least(F.lit(0.95), (once + 0.5) / (once + 2 * twice + 1.0))).alias(where)

    lower, below, d = None, 0, 0.75
    for n in reversed(LEVELS[1:]):
        level = types[n].select("g", "k", _context().alias("c"))
        level = level.join(level.groupBy("c").agg(F.sum("k").alias("n_c"), F.count(F.lit(1)).alias("t_c")), "c")
        base = F.lit(1 / 256)
        if lower is not None:
            level, base = level.withColumn("s", _last(below)).join(lower.select(F.col("g").alias("s"), "p"), "s"), F.col("p")
        lower, below = level.select("g", ((F.greatest(F.col("k") - d, F.lit(0.0)) + d * F.col("t_c") * base) / F.col("n_c")).alias("p")), n

    marks = counts.agg(discount(F.col("toxic"), "dt"), discount(F.col("ordinary"), "do")).first()
    dt, do = marks["dt"], marks["do"]
    contexts = counts.groupBy(_context().alias("c")).agg(
        *[x for c in ("toxic", "ordinary") for x in (F.sum(c).alias(f"n_{c}"), F.sum((F.col(c) > 0).cast("long")).alias(f"t_{c}"))]
    )
    contexts = scratch(contexts, "contexts")
    weight = lambda c, dd: F.when(F.col(f"n_{c}") > 0, dd * F.col(f"t_{c}") / F.col(f"n_{c}")).otherwise(1.0)
    own = lambda c, dd: F.when(F.col(f"n_{c}") > 0, F.greatest(F.col(c) - dd, F.lit(0.0)) / F.col(f"n_{c}")).otherwise(0.0)
    grams = (
        counts.withColumn("c", _context()).join(contexts, "c").withColumn("s", _last(below)).join(lower.select(F.col("g").alias("s"), "p"), "s")
        .select("g", (F.col("toxic") + F.col("ordinary")).alias("w"), (F.ln(own("toxic", dt) + weight("toxic", dt) * F.col("p")) - F.ln(own("ordinary", do) + weight("ordinary", do) * F.col("p"))).alias("ratio"))
    )
    backoff = contexts.select(F.col("c").alias("g"), (F.col("n_toxic") + F.col("n_ordinary")).alias("w"), (F.ln(weight("toxic", dt)) - F.ln(weight("ordinary", do))).alias("ratio"))
    return grams, backoff


class Slots:
    """Ratios of grams by their hashes, in an open table two thirds full; a tag of 32 of their bits tells grams of a slot apart."""

    def __init__(self, hashes: np.ndarray, ratios: np.ndarray) -> None:
        self.size = size = len(hashes) * 3 // 2 + 251
        self.tag, self.ratio = np.zeros(size, dtype=np.uint32), np.full(size, np.nan, dtype=np.float32)
        left, at = np.arange(len(hashes)), (hashes % np.uint64(size)).astype(np.int64)
        while len(left):  # each round one of those that want a free slot gets it, all others go one on
            _, first = np.unique(at, return_index=True)
            placed = first[np.isnan(self.ratio[at[first]])]
            self.tag[at[placed]] = hashes[left[placed]] >> np.uint64(32)
            self.ratio[at[placed]] = ratios[left[placed]]
            rest = np.setdiff1d(np.arange(len(left)), placed, assume_unique=True)
            left, at = left[rest], (at[rest] + 1) % size

    def get(self, g: np.ndarray) -> np.ndarray:
        """Ratios of grams, NaN of those that the table does not hold."""
        h = hash_of_longs(g)
        at, tag = (h % np.uint64(self.size)).astype(np.int64), (h >> np.uint64(32)).astype(np.uint32)
        out = self.ratio[at].astype(np.float64)
        left = np.flatnonzero((self.tag[at] != tag) & ~np.isnan(out))
        out[left] = np.nan
        while len(left):
            at[left] = (at[left] + 1) % self.size
            ratio, same = self.ratio[at[left]], self.tag[at[left]] == tag[left]
            out[left[same]] = ratio[same]
            left = left[~same & ~np.isnan(ratio)]
        return out


class Filter:
    """Bits of the hashes of grams that are not in the broadcast table."""

    def __init__(self, rest: DataFrame) -> None:
        """Words of 64 bits are put together on the cluster, of which there are so many at most as the filter has."""
        at = F.shiftrightunsigned("h", 64 - FILTER_BITS)
        words = rest.select(F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int")).alias("bit"))
        found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        self.words = np.zeros(1 << FILTER_BITS - 6, dtype=np.uint64)
        self.words[found.column(0).to_numpy()] = found.column(1).to_numpy().view(np.uint64)

    def may_hold(self, g: np.ndarray) -> np.ndarray:
        at = hash_of_longs(g) >> np.uint64(64 - FILTER_BITS)
        return self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1) > 0


def tabled(found: DataFrame, total: int, most: int) -> tuple[Slots, DataFrame | None, Filter | None]:
    """A broadcast table of ``total`` rows (g, w, ratio); if they are more than ``most``, of the most seen, with the others and their filter."""
    found = found.select(F.xxhash64("g").alias("h"), "g", "w", F.col("ratio").cast("float").alias("ratio"))
    kept, rest = found, None
    if total > most:
        found = scratch(found, "ratios")
        # how many were seen how often: the counts of counts are few
        cut, have = 0, 0
        for r in found.groupBy("w").count().orderBy(F.desc("w")).toLocalIterator():
            if have + r["count"] > most:
                cut = r["w"]
                break
            have += r["count"]
        kept, rest = found.filter(F.col("w") > cut), found.filter(F.col("w") <= cut)
    table = kept.select("h", "ratio").toArrow()
    slots = Slots(table.column(0).to_numpy().view(np.uint64), table.column(1).to_numpy())
    if rest is None:
        return slots, None, None
    return slots, rest.select("g", "ratio"), Filter(rest)


def looked_up(g: np.ndarray, slots: Slots, more: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Ratios of grams by the table, or else by the few (in order, with their ratios) that were looked up for these texts."""
    out = slots.get(g)
    if more is not None and len(more[0]):
        miss = np.flatnonzero(np.isnan(out))
        at = np.minimum(np.searchsorted(more[0], g[miss]), len(more[0]) - 1)
        same = more[0][at] == g[miss]
        out[miss[same]] = more[1][at[same]]
    return out


def text_features(texts: list[str | None], grams: Slots, contexts: Slots, more: tuple = (None, None)) -> np.ndarray:
    """Per text: ratio a byte, and its words' ratios pooled: largest, mean of the three largest, log of the mean likelihood ratio, largest for their number."""
    total, size, odds, words = (np.zeros(len(texts)) for _ in range(4))
    top_doc, top_ratio = [], []
    for raw, ends, docs in _blocks(texts):
        place, g = _grams(raw)
        if not len(place):
            continue
        ratio = looked_up(g, grams, more[0])
        miss = np.isnan(ratio)
        ratio[miss] = np.nan_to_num(looked_up(g[miss] >> np.uint64(8), contexts, more[1]))
        begins = np.flatnonzero(raw[place - 1] == 32)
        word = np.add.reduceat(ratio, begins)
        doc = docs[np.searchsorted(ends, place[begins], "right")]
        np.add.at(total, doc, word)
        np.add.at(odds, doc, np.exp(np.clip(word, -CLIP, CLIP)))
        np.add.at(words, doc, 1)
        np.add.at(size, doc, np.diff(np.r_[begins, len(place)]))
        order = np.lexsort((-word, doc))
        word, doc = word[order], doc[order]
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        rank = np.arange(len(doc)) - np.repeat(first, np.diff(np.r_[first, len(doc)]))
        top_doc.append(doc[rank < 3])
        top_ratio.append(word[rank < 3])
    most, three = np.zeros(len(texts)), np.zeros(len(texts))
    if top_doc:
        doc, word = np.concatenate(top_doc), np.concatenate(top_ratio)
        order = np.lexsort((-word, doc))
        word, doc = word[order], doc[order]
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        rank = np.arange(len(doc)) - np.repeat(first, np.diff(np.r_[first, len(doc)]))
        most[doc[first]] = word[first]
        np.add.at(three, doc[rank < 3], word[rank < 3])
        three /= np.maximum(np.minimum(words, 3), 1)
    with np.errstate(divide="ignore"):
        mean = np.where(words > 0, np.log(np.maximum(odds, 1e-300) / np.maximum(words, 1)), 0.0)
    return np.column_stack([total / np.maximum(size, 1), most, three, mean, most / np.log(8 + words)])


class Tables:
    """Broadcast tables of grams and contexts, and filters of what they leave to tables of the cluster."""

    def __init__(self, grams: Slots, contexts: Slots, filters: tuple = (None, None)) -> None:
        self.grams, self.contexts, self.filters = grams, contexts, filters

    def pending(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Grams and contexts of texts that are not in the tables, though the filters say that they may be elsewhere."""
        found: tuple[list, list] = ([], [])
        for raw, _, _ in _blocks(texts):
            _, g = _grams(raw)
            for which, (slots, keys) in enumerate(((self.grams, g), (self.contexts, g >> np.uint64(8)))):
                if self.filters[which] is not None:
                    keys = np.unique(keys)
                    keys = keys[np.isnan(slots.get(keys))]
                    found[which].append(keys[self.filters[which].may_hold(keys)])
        return tuple(np.unique(np.concatenate(x)) if x else np.zeros(0, dtype=np.uint64) for x in found)

    def features(self, texts: list[str | None], more: tuple = (None, None)) -> np.ndarray:
        return text_features(texts, self.grams, self.contexts, more)


class ToxicityModel:
    """Tables, broadcast once, with the tables of the cluster that hold the rest (or None), and logistic coefficients."""

    def __init__(self, tables: Tables, shared: Broadcast, rest: tuple[DataFrame | None, DataFrame | None]) -> None:
        self.tables, self.shared, self.rest, self.whole = tables, shared, rest, rest == (None, None)
        self.grams, self.contexts, self.beta, self.share = tables.grams, tables.contexts, np.zeros(0), 0.0

    def score(self, texts: list[str | None], more: tuple = (None, None)) -> np.ndarray:
        return _scored(self.tables, self.beta, self.share, texts, more)


def _scored(tables: Tables, beta: np.ndarray, share: float, texts: list[str | None], more: tuple = (None, None)) -> np.ndarray:
    if not len(beta):
        return np.full(len(texts), share)
    z = np.column_stack([tables.features(texts, more), np.ones(len(texts))]) @ beta
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


KEYS = "array<struct<which:int,g:long,ratio:float>>"


def with_rest(rows: DataFrame, fitted: ToxicityModel, into: str) -> DataFrame:
    """Rows (with ``text``) and the ratios of their grams that only the cluster's tables hold: joined by a digest of the text.

    Null for most texts; where nothing is left to the tables, for all, and nothing is read.
    """
    if fitted.whole:
        return rows.withColumn(into, F.lit(None).cast(KEYS))
    shared, digest = fitted.shared, unused(rows, "_digest")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, text in zip(frame["digest"], frame["text"]):
                for which, keys in enumerate(shared.value.pending([text])):
                    if len(keys):
                        yield pd.DataFrame({"digest": key, "which": np.int32(which), "g": keys.view(np.int64)})

    keyed = rows.withColumn(digest, F.sha2(F.coalesce("text", F.lit("")), 256))
    pending = keyed.select(F.col(digest).alias("digest"), "text").mapInPandas(run, "digest string, which int, g long").distinct()
    found = functools.reduce(DataFrame.unionByName, [pending.filter(F.col("which") == k).join(rest, "g") for k, rest in enumerate(fitted.rest) if rest is not None])
    more = found.groupBy("digest").agg(F.collect_list(F.struct("which", "g", "ratio")).alias(into)).withColumnRenamed("digest", digest)
    return keyed.join(scratch(more, "rest"), digest, "left").drop(digest)


def _more(values) -> tuple:
    """Ratios looked up for some texts, as :func:`text_features` takes them."""
    rows = sorted({(r["which"], r["g"] % 2**64, r["ratio"]) for v in values if v is not None for r in v})
    if not rows:
        return None, None
    return tuple((np.array([g for w, g, _ in rows if w == k], dtype=np.uint64), np.array([r for w, _, r in rows if w == k])) for k in (0, 1))


def fit(docs: DataFrame, labels: DataFrame, most: int | None = None) -> ToxicityModel:
    """Counts over every labelled text outside the held-out and calibration folds, then the curve; ``most`` grams are broadcast (by default ``MOST``)."""
    spark = docs.sparkSession
    rows = labelled(docs, labels, "toxic")
    counts = scratch(count_grams(rows.filter(F.col("fold") != CALIBRATION_FOLD)), "grams")
    of_all, after_all = smoothed(counts)
    grams, more_grams, of_grams = tabled(of_all, counts.count(), most or MOST)
    contexts, more_contexts, of_contexts = tabled(after_all, after_all.count(), most or MOST)
    tables = Tables(grams, contexts, (of_grams, of_contexts))
    shared = spark.sparkContext.broadcast(tables)
    fitted = ToxicityModel(tables, shared, (more_grams, more_contexts))
    names = [f"f{k}" for k in range(FEATURES)]

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = pd.DataFrame(shared.value.features(frame["text"].tolist(), _more(frame["more"])), columns=names)
            yield out.assign(label=frame["label"].to_numpy())

    held = labels.filter(F.col("toxic").isNotNull() & (fold(F.col("doc_id")) == CALIBRATION_FOLD)).count()
    kept = sampled(rows.filter(F.col("fold") == CALIBRATION_FOLD), "doc_id", held, CALIBRATION_ROWS)
    kept = with_rest(kept.select("text", "label"), fitted, "more")
    seen = kept.mapInPandas(features, ", ".join(f"{n} double" for n in names) + ", label int").toPandas()
    if len(seen):
        fitted.share = float(seen["label"].mean())
        if 0 < fitted.share < 1:
            seen = seen.sort_values([*names, "label"], ignore_index=True)  # sums then do not hang on the order in which rows came
            fitted.beta = logistic(seen[names].to_numpy(), seen["label"].to_numpy())
    return fitted


def rated(docs: DataFrame, fitted: ToxicityModel, into: str) -> DataFrame:
    """The documents with the probability that each is toxic, in a new column."""
    shared, beta, share = fitted.shared, fitted.beta, fitted.share
    if fitted.whole:

        @F.pandas_udf("double")
        def scored(texts: pd.Series) -> pd.Series:
            return pd.Series(_scored(shared.value, beta, share, texts.tolist()))

        return docs.withColumn(into, scored("text"))

    @F.pandas_udf("double")
    def scored_with(texts: pd.Series, more: pd.Series) -> pd.Series:
        return pd.Series(_scored(shared.value, beta, share, texts.tolist(), _more(more)))

    more = unused(docs, "_more")
    return with_rest(docs, fitted, more).withColumn(into, scored_with("text", more)).drop(more)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Add ``score`` and ``predicted`` to the documents, in place of columns of these names; every other column is kept."""
    return rated(docs.drop("score", "predicted"), model, "score").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")

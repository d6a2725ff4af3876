"""Operator 10: quality by a factorisation machine.

Inputs of a text are its words hashed to slots (weights: log counts, normalised), structure
statistics and length metadata, each statistic also cut into steps. The machine scores single
inputs and low-rank products of every pair, in time linear in the inputs by the identity
sum_{i<j} <v_i, v_j> x_i x_j = (|sum v_i x_i|^2 - sum |v_i|^2 x_i^2) / 2.

Scale: the machine is fitted on a sample of labelled rows bounded by ``sample``; its tables have
a fixed size, so the broadcast does. Scoring is map-only.

Edge cases: null and empty texts are scored on their statistics alone; without labels of both
classes every score is the share of good labels (0 without labels); repeated rows are scored
alike; a null doc_id is not held out and not learnt from; columns named ``score`` or ``predicted``
are replaced; empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import held_out, labelled, sampled, table

WORD_SLOTS, STEPS, RANK = 1 << 15, 12, 8
STATISTICS = 12
SLOTS = WORD_SLOTS + STATISTICS * STEPS + STATISTICS
SAMPLE = 8_000  # bound on labelled rows that the machine is fitted on


def statistics(text: str, words: list[str], counts: Counter) -> list[float]:
    """Structure and length figures, each about 0 to 1."""
    n, chars = max(1, len(words)), max(1, len(text))
    lines = text.split("\n")
    top = counts.most_common(1)[0][1] if counts else 0
    return [
        np.log1p(len(words)) / 12,
        np.log1p(chars) / 15,
        len(counts) / n,
        top / n,
        sum(map(len, words)) / n / 16,
        sum(w[-1] in ".!?" for w in words) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        sum(not any(map(str.isalpha, w)) for w in counts) / max(1, len(counts)),
        sum(text.count(c) for c in "|{}<>#$%^&*_=~") / chars * 8,
        sum(text.count(c) for c in "0123456789") / chars * 4,
        len(set(lines)) / len(lines),
        sum(w[0].isupper() for w in words) / n,
    ]


class Encoder:
    """Texts to (slots, values); word slots are cached up to a bound."""

    def __init__(self) -> None:
        self.cache: dict[str, int] = {}

    def slot(self, word: str) -> int:
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            found = self.cache[word] = zlib.crc32(word.encode("utf-8", "replace")) % WORD_SLOTS
        return found

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        words = text.split()
        counts = Counter(words)
        stats = np.clip(statistics(text, words, counts), 0, 1)
        slots = np.fromiter((self.slot(w) for w in counts), dtype=np.int64, count=len(counts))
        values = np.log1p(np.fromiter(counts.values(), dtype=np.float64, count=len(counts)))
        values /= max(1e-9, np.sqrt((values**2).sum()))
        steps = np.minimum((stats * STEPS).astype(np.int64), STEPS - 1) + WORD_SLOTS + STEPS * np.arange(STATISTICS)
        plain = WORD_SLOTS + STATISTICS * STEPS + np.arange(STATISTICS)
        return np.concatenate([slots, steps, plain]), np.concatenate([values, np.full(STATISTICS, 0.5), stats])


class Machine:
    """Bias, linear weights and rank-RANK factors over a fixed number of slots."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.bias, self.linear = 0.0, np.zeros(SLOTS)
        self.factor = rng.normal(0, 0.02, (SLOTS, RANK))

    def raw(self, slots: np.ndarray, values: np.ndarray, starts: np.ndarray):
        x = values[:, None]
        v = self.factor[slots] * x
        total = np.add.reduceat(v, starts)
        squares = np.add.reduceat((v**2).sum(axis=1), starts)
        return self.bias + np.add.reduceat(self.linear[slots] * values, starts) + 0.5 * ((total**2).sum(axis=1) - squares), total

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 6, batch: int = 64, steps: int = 600, rate: float = 0.05, decay: float = 1e-4) -> None:
        rng = np.random.default_rng(11)
        seen_linear, seen_factor, seen_bias = np.full(SLOTS, 1e-6), np.full((SLOTS, RANK), 1e-6), 1e-6
        self.bias = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        for _ in range(max(epochs, -(-steps * batch // max(len(rows), 1)))):  # few rows are gone through more often
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                slots, values, starts = pooled([rows[i] for i in pick])
                z, total = self.raw(slots, values, starts)
                err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]
                per = np.repeat(err, np.diff(np.r_[starts, len(slots)])) / len(pick)
                sums = np.repeat(total, np.diff(np.r_[starts, len(slots)]), axis=0)
                g_linear = per * values
                g_factor = per[:, None] * values[:, None] * (sums - self.factor[slots] * values[:, None])
                uniq, name = np.unique(slots, return_inverse=True)
                gl = np.bincount(name, weights=g_linear, minlength=len(uniq)) + decay * self.linear[uniq]
                gf = np.stack([np.bincount(name, weights=g_factor[:, k], minlength=len(uniq)) for k in range(RANK)], axis=1) + decay * self.factor[uniq]
                seen_linear[uniq] += gl**2
                seen_factor[uniq] += gf**2
                seen_bias += err.mean() ** 2
                self.linear[uniq] -= rate * gl / np.sqrt(seen_linear[uniq])
                self.factor[uniq] -= rate * 0.2 * gf / np.sqrt(seen_factor[uniq])
                self.bias -= rate * err.mean() / np.sqrt(seen_bias)

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        z, _ = self.raw(*pooled(rows))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def pooled(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts = np.cumsum([0] + [len(s) for s, _ in rows[:-1]])
    return np.concatenate([s for s, _ in rows]), np.concatenate([v for _, v in rows]), starts


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine | float:
    """A machine, or the share of good labels where there are not both classes to learn from."""
    known = labels.filter(F.col("quality").isNotNull())
    total = known.count()
    known = sampled(known, "doc_id", total, sample)
    encode = Encoder()

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [encode.encode(t) for t in frame["text"]]
            yield pd.DataFrame({"slots": [s.astype(np.int32) for s, _ in rows], "x": [v.astype(np.float32) for _, v in rows], "label": frame["label"].to_numpy()})

    # in one executor's task: the sample is bounded and its model leaves as fixed-size rows
    def train(frame: pd.DataFrame) -> pd.DataFrame:
        # in an order of their own, so that the same rows give the same machine whatever task brought them
        frame = frame.assign(order=[zlib.crc32(np.asarray(s, dtype=np.int32).tobytes()) for s in frame["slots"]]).sort_values(["order", "label"], kind="stable", ignore_index=True)
        y = frame["label"].to_numpy(dtype=float)
        machine = Machine()
        if 0 < y.mean() < 1:
            machine.fit([(np.asarray(s, dtype=np.int64), np.asarray(v, dtype=float)) for s, v in zip(frame["slots"], frame["x"])], y)
        state = np.concatenate([[y.mean(), machine.bias], machine.linear, machine.factor.ravel()])
        return pd.DataFrame({"state": [state.tobytes()]})

    rows = labelled(docs, known, "quality").select("text", "label").mapInPandas(features, "slots array<int>, x array<float>, label int")
    found = rows.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(train, "state binary").collect()
    if not found:
        return 0.0
    state = np.frombuffer(found[0]["state"])
    if not 0 < state[0] < 1:
        return float(state[0])
    machine = Machine()
    machine.bias, machine.linear, machine.factor = float(state[1]), state[2 : 2 + SLOTS], state[2 + SLOTS :].reshape(SLOTS, RANK)
    return machine


def score(docs: DataFrame, machine: Machine | float, threshold: float = 0.3) -> DataFrame:
    """Add ``score`` and ``predicted`` to the documents, in place of columns of these names; every other column is kept."""
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        if isinstance(shared.value, float):
            return pd.Series(np.full(len(texts), shared.value))
        encode, out = Encoder(), []
        for at in range(0, len(texts), 128):
            out.append(shared.value.score([encode.encode(t) for t in texts.iloc[at : at + 128]]))
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.withColumn("score", scored(F.col("text"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, machine).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")

"""Event-time behaviours: debounce, throttle, latest wins, lockout after failures, answers, running totals, chunked text.

Each works on batches; debounce and throttle also on streams as they are, lockout and latest wins
in a form of their own, whose state timers end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def debounce(events: DataFrame, key: str, ts: str, gap: str, value: str) -> DataFrame:
    """The last value of each burst of a key; bursts end after ``gap`` without an event.

    Works on streams too: give the input a watermark.
    """
    burst = events.groupBy(key, F.session_window(ts, gap).alias("w"))
    return burst.agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(F.col(ts), F.col(value))).alias("last")).select(key, F.col("w.start").alias("first_ts"), F.col(f"last.{ts}").alias("last_ts"), "n", F.col(f"last.{value}").alias("value"))


def throttle(events: DataFrame, key: str, ts: str, period: str, value: str) -> DataFrame:
    """The first value of each period of a key. Works on streams too: give the input a watermark."""
    each = events.groupBy(key, F.window(ts, period).alias("w"))
    return each.agg(F.min(F.struct(F.col(ts), F.col(value))).alias("f")).select(key, F.col("w.start").alias("period"), F.col(f"f.{value}").alias("value"))


def latest(events: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """A key's last request; those before it are cancelled. Equal moments go by the greatest value."""
    at = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(value))
    return events.withColumn("state", F.when(F.row_number().over(at) == 1, "current").otherwise("cancelled"))


class _Lock:
    """Recent failures of one key, and until when it is locked."""

    def __init__(self, recent=(), until: float = float("-inf")) -> None:
        self.recent, self.until = list(recent), until

    def fail(self, t: float, window_s: float, limit: int, lock_s: float) -> tuple[bool, bool]:
        """(recorded, locked by this one); failures while locked are not recorded."""
        if t < self.until:
            return False, False
        self.recent = [x for x in self.recent if t - x < window_s] + [t]
        full = len(self.recent) >= limit
        if full:
            self.until = t + lock_s
        return True, full


LOCK = "key long, id long, t double, recorded boolean, locked boolean"


def _times(failures: DataFrame, key: str, ts: str) -> DataFrame:
    return failures.select(F.col(key).cast("long").alias("key"), F.col("id").cast("long").alias("id"), F.col(ts).cast("timestamp").cast("double").alias("t"))


def lockout(failures: DataFrame, key: str, ts: str, window_s: float, limit: int, lock_s: float) -> DataFrame:
    """Each failure with ``recorded`` and ``locked``; failures while locked are not recorded.

    Rows are dealt by key, sorted and streamed: the state is a few times, whatever the key's size.
    A null key is a key of its own.
    """

    def run(batches) -> Iterator:
        import pyarrow as pa

        at, lock = object(), _Lock()
        for batch in batches:
            states = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if k != at:
                    at, lock = k, _Lock()
                states.append(lock.fail(t, window_s, limit, lock_s))
            recorded, locked = zip(*states) if states else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(recorded, pa.bool_()), pa.array(locked, pa.bool_())], ["key", "id", "t", "recorded", "locked"])

    return _times(failures, key, ts).repartition("key").sortWithinPartitions("key", "t", "id").mapInArrow(run, LOCK)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _keyed(rows: DataFrame, processor, schema: str) -> DataFrame:
    """Rows grouped by ``key`` and ``keyless`` (whether it is null) through a processor with event-time timers.

    Such state needs the RocksDB store, which is set for the session.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    whole = rows.withColumns({"keyless": F.col("key").isNull(), "key": F.coalesce("key", F.lit(0).cast("long"))})
    found = whole.groupBy("key", "keyless").transformWithStateInPandas(processor, schema, "append", "eventTime")
    return found.withColumn("key", F.when(~F.col("keyless"), F.col("key"))).drop("keyless")


class _Timed(StatefulProcessor):
    """A processor whose state of a key, one row, is cleared by a timer, the only one of that key."""

    state: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.state)

    def keep(self, value: tuple, until_s: float) -> None:
        self.held.update(value)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(math.ceil(until_s * 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter([])

    def close(self) -> None:
        pass


class _Lockouts(_Timed):
    state = "recent array<double>, until double"

    def __init__(self, window_s: float, limit: int, lock_s: float) -> None:
        self.rule = window_s, limit, lock_s

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        recent, until = self.held.get() if self.held.exists() else ([], float("-inf"))
        lock = _Lock(recent, until)
        every = pd.concat(list(rows)).sort_values(["t", "id"], kind="stable")
        states = [lock.fail(t, *self.rule) for t in every["t"]]
        self.keep((lock.recent, lock.until), max(lock.until, lock.recent[-1] + self.rule[0]))
        yield every[["key", "keyless", "id", "t"]].assign(recorded=[r for r, _ in states], locked=[x for _, x in states])


def lockout_stream(failures: DataFrame, key: str, ts: str, window_s: float, limit: int, lock_s: float, late: str = "1 minute") -> DataFrame:
    """The same over a stream: a key's state is its recent failures and its lock, kept across micro-batches.

    A micro-batch's failures of a key are taken in order of time, and answered at once. Once the
    watermark, ``late`` behind the latest failure, passes the end of a key's lock and window, a timer
    clears its state, so the store holds only keys that failed of late. Failures older than the watermark of the batch before are dropped.
    """
    rows = failures.withWatermark(ts, late).select(F.col(key).cast("long").alias("key"), F.col("id").cast("long").alias("id"), F.col(ts).cast("timestamp").cast("double").alias("t"), ts)
    return _keyed(rows, _Lockouts(window_s, limit, lock_s), "key long, keyless boolean, id long, t double, recorded boolean, locked boolean")


class _Latest(_Timed):
    state = "at double, id long"

    def __init__(self, keep_s: float) -> None:
        self.keep_s = keep_s

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = tuple(self.held.get()) if self.held.exists() else None
        out = []
        every = pd.concat(list(rows))
        for t, i in sorted(zip(every["t"], every["id"])):
            if now is None or (t, i) > now:
                if now is not None:
                    out.append((now[1], "cancelled", i))
                out.append((i, "current", None))
                now = (float(t), int(i))
            else:
                out += [(i, "current", None), (i, "cancelled", now[1])]
        self.keep(now, now[0] + self.keep_s)
        yield pd.DataFrame({"key": key[0], "keyless": key[1], "id": [o[0] for o in out], "state": [o[1] for o in out], "by": pd.array([o[2] for o in out], dtype="Int64")})


def latest_stream(requests: DataFrame, key: str, ts: str, value: str, keep_s: float = 3600.0, late: str = "1 minute") -> DataFrame:
    """Latest wins over a stream: (key, id, state, by), where each request becomes ``current`` and, once another takes its place, ``cancelled``.

    The state of a key is its current request, which a timer lets go ``keep_s`` after it, when it is
    taken as answered. A request older than the current one of its key is cancelled at once; one
    older than the watermark is dropped. After all batches the requests without a cancellation are those of :func:`latest`.
    """
    rows = requests.withWatermark(ts, late).select(F.col(key).cast("long").alias("key"), F.col(value).cast("long").alias("id"), F.col(ts).cast("timestamp").cast("double").alias("t"), ts)
    return _keyed(rows, _Latest(keep_s), "key long, keyless boolean, id long, state string, by long")


def answered(requests: DataFrame, responses: DataFrame, within: str) -> DataFrame:
    """Requests (id, at, ...) with what became of them: ``state`` resolved or rejected, ``payload`` or ``error``.

    A request's first response (id, answered_at, kind, payload, error) from its own moment to
    ``within`` later settles it: a result resolves it, anything else rejects it; without one it is
    rejected for time. Responses to no request, and a request's second one, are let go. A null id meets none.

    Works on batches and, where both sides have a watermark, on streams: an outer join on the id and a
    range of time, so either side's state ends with the range, and a request is rejected when the
    watermark passes it. On a stream the first response is the one that comes first, and what is older than
    the watermark of the batch before is dropped on either side.

    Scale: one shuffle of both sides by id; a hot id (repeated responses) is cut to its first before the join.
    """
    if responses.isStreaming:
        first = responses.dropDuplicatesWithinWatermark(["id"])
    else:
        asked = requests.select("id", F.col("at").alias("_at")).filter("id is not null").distinct()
        valid = responses.join(asked, "id").filter(F.col("answered_at").between(F.col("_at"), F.col("_at") + F.expr(f"INTERVAL {within}")))
        first = valid.groupBy("id", "_at").agg(F.min(F.struct("answered_at", "kind", "payload", "error")).alias("f")).select("id", "f.*")
    r = first.select(F.col("id").alias("_id"), "answered_at", "kind", "payload", F.col("error").alias("_error"))
    met = (F.col("id") == F.col("_id")) & (F.col("answered_at") >= F.col("at")) & (F.col("answered_at") <= F.col("at") + F.expr(f"INTERVAL {within}"))
    joined = requests.join(r, met, "left_outer")
    done = F.col("kind") == "result"
    state = F.when(done, "resolved").otherwise("rejected")
    error = F.when(F.col("_id").isNull(), "no answer in time").when(~done, F.coalesce("_error", F.lit("failed")))
    return joined.select(*requests.columns, state.alias("state"), F.when(done, F.col("payload")).alias("payload"), error.alias("error"))


def add_totals(outcomes: DataFrame, batch_id: int, path: str) -> None:
    """Counts of a micro-batch's outcomes (doc_id, path) under ``path``, for ``foreachBatch``: a batch that is replayed replaces its own counts."""
    counts = outcomes.groupBy("doc_id", F.col("path").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    counts.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def running_totals(spark: SparkSession, path: str, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Totals of all batches so far, every re-bake counted: surgery, legacy and refused by the given keys (none: of the session)."""
    rows = spark.read.schema("doc_id long, outcome string, n long, batch long").option("basePath", path).parquet(f"{path}/batch=*")
    return rows.groupBy(*by).agg(*[F.coalesce(F.sum(F.when(F.col("outcome") == full, F.col("n"))), F.lit(0)).alias(name) for full, name in (("tj-surgery", "surgery"), ("legacy", "legacy"), ("refused", "refused"))])


def chunks(texts: DataFrame, text: str) -> DataFrame:
    """Chunks of a word and the white space after it, numbered; an empty text is one empty chunk, a null one a null."""
    parts = F.regexp_extract_all(F.col(text), F.lit(r"(?U)\S+\s*|\s+"), F.lit(0))
    kept = F.when(F.size(parts) > 0, parts).otherwise(F.array(F.col(text)))
    return texts.select("*", F.posexplode(kept).alias("seq", "chunk")).drop(text)


def reassembled(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks of a key put together; a key of null chunks only is null."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "chunk")))
    whole = F.array_join(F.transform(ordered, lambda x: x["chunk"]), "")
    return parts.groupBy(*keys).agg(F.when(F.count("chunk") > 0, whole).alias("text"))


def chunk_stream(requests: DataFrame) -> DataFrame:
    """What requests (request_id, channel, at, text, error) send: chunks, then done, error or cancelled.

    A later request of a channel cancels the earlier ones, which send no chunk; a failed one sends its error only.
    """
    last = F.row_number().over(Window.partitionBy("channel").orderBy(F.desc("at"), F.desc("request_id"))) == 1
    end = F.when(~F.col("_last"), "cancelled").when(F.col("error").isNotNull(), "error").otherwise("done")
    parts = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?U)\S+\s*|\s+"), F.lit(0))
    sent = F.when(end == "done", F.transform(parts, lambda c, i: F.struct(i.alias("seq"), F.lit("chunk").alias("kind"), c.alias("text")))).otherwise(F.array().cast("array<struct<seq:int,kind:string,text:string>>"))
    close = F.array(F.struct(F.size(sent).alias("seq"), end.alias("kind"), F.when(end == "error", F.col("error")).alias("text")))
    return requests.withColumn("_last", last).select("request_id", F.inline(F.concat(sent, close)))


def generate(prompts: DataFrame, provider) -> DataFrame:
    """Texts of a provider: a function from a batch of prompts (pandas) to as many texts, given by the caller."""
    answer = F.pandas_udf(provider, "string")
    return prompts.withColumn("text", answer(F.col("prompt")))

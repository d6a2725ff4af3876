"""Shared plumbing of the training-data operators: table access and lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the data tables, read by Spark so that any store it can open works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """Folder shared by driver and executors, from ``spark.checkpoint.dir``.

    Only where that is unset (tests, a laptop) a temporary folder of this machine is used.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='folioframe-')}")
        root = sc.getCheckpointDir()
    return f"{root.rstrip('/')}/folioframe-{sc.applicationId}"


def scratch(df: DataFrame, tag: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    This cuts the lineage (a lost executor re-reads files instead of recomputing) and, unlike
    ``checkpoint()``, computes the plan only once. The folder goes when the driver ends.
    """
    spark = df.sparkSession
    root = scratch_root(spark)
    path = f"{root}/{tag}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    _clean_at_exit(spark, root)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (out, path)
    return out


_paths: dict[int, tuple[DataFrame, str]] = {}


def release(*frames: DataFrame | None) -> None:
    """Delete what :func:`scratch` wrote for these frames, once nothing reads them any more; other frames are left alone."""
    for df in frames:
        held = _paths.pop(id(df), None) if df is not None else None
        if held:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(held[1])
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def written(make, tag: str) -> DataFrame:
    """What ``make()`` returns, written and read back; all that was written on the way there is deleted."""
    before = set(_paths)
    out = scratch(make(), tag)
    release(*[df for k, (df, _) in list(_paths.items()) if k not in before and df is not out])
    return out


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores after it as no column of the frame has (case does not tell names apart)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_roots: set[str] = set()


def _clean_at_exit(spark: SparkSession, root: str) -> None:
    if root in _roots:
        return
    _roots.add(root)
    sc = spark.sparkContext

    def remove() -> None:
        try:
            path = sc._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the JVM has gone before us; the folder is the cluster's to expire
            pass

    atexit.register(remove)


#: Bytes of one batch between an executor and its Python worker, each of which holds a few at once.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches of this session by bytes, since 10,000 long texts could be any size.

    The setting stays: plans are run later than they are made. A smaller one is left as it is.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = (spark.conf.get(name, None) or "").removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def groups_for(rows: int, per_group: int) -> int:
    """Number of hash groups so that each holds about ``per_group`` rows."""
    return max(1, -(-rows // per_group))


def bucket_of(*cols: str, n: int):
    """Stable bucket 0..n-1 of the given columns (nulls hash like any other value)."""
    return F.pmod(F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols]), F.lit(n)).cast("int")


#: A label table up to this many rows is broadcast (about 16 bytes a row); a larger one is shuffled.
BROADCAST_ROWS = 2_000_000


def held_out(doc_id) -> "F.Column":
    """True for the fifth of the keys whose labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fold(doc_id) -> "F.Column":
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def labelled(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """``doc_id``, ``text``, ``label`` and ``fold`` of the documents that may be learnt from.

    A doc_id with several labels has the greatest of them; every row of it is learnt from.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("label").isNotNull() & (fold(F.col("doc_id")) != 0))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    if labels.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(known, "doc_id").select("doc_id", "text", "label", fold(F.col("doc_id")).cast("int").alias("fold"))


def sampled(rows: DataFrame, key: str, total: int, most: int) -> DataFrame:
    """About ``most`` of the ``total`` rows by a hash of their key, the same ones on every run; all if there are no more."""
    if total <= most:
        return rows
    return rows.filter(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1_000_000)) < int(1_000_000 * most / total))


def logistic(x, y, rounds: int = 60, ridge: float = 0.1):
    """Newton fit of a logistic regression on standardised columns, steps halved until they help.

    Coefficients are those of the columns as they came; the last is the intercept.
    """
    import numpy as np

    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    penalty = np.r_[np.full(x.shape[1], ridge), 1e-6]
    loss = lambda b: float(np.logaddexp(0, z @ b).sum() - y @ (z @ b) + penalty @ b**2 / 2)
    beta, at = np.zeros(z.shape[1]), loss(np.zeros(z.shape[1]))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * beta)
        for _ in range(30):
            if (new := loss(beta + step)) <= at:
                break
            step /= 2
        else:
            break
        beta, done, at = beta + step, at - new < 1e-9, new
        if done:
            break
    scale = beta[:-1] / spread
    return np.r_[scale, beta[-1] - scale @ mean]


def hash_of_longs(values):
    """What Spark's ``xxhash64`` gives for longs, over an array of 64-bit integers (as unsigned)."""
    import numpy as np

    u = np.uint64
    # The five primes of the hash function.
    p1, p2, p3, p4, p5 = u(0x9E3779B185EBCA87), u(0xC2B2AE3D27D4EB4F), u(0x165667B19E3779F9), u(0x85EBCA77C2B2AE63), u(0x27D4EB2F165667C5)
    turn = lambda x, k: (x << u(k)) | (x >> u(64 - k))
    with np.errstate(over="ignore"):
        h = (u(42) + p5 + u(8)) ^ (turn(values.view(np.uint64) * p2, 31) * p1)
        h = turn(h, 27) * p1 + p4
        h = (h ^ (h >> u(33))) * p2
        h = (h ^ (h >> u(29))) * p3
    return h ^ (h >> u(32))

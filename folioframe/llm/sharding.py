"""Operator 4 [native]: weighted rendezvous hashing of stable record keys over shards.

Every record scores each shard by ``-weight / ln(u)``, where ``u`` in (0, 1) comes from a hash of
(key, shard number), and goes to the best. A score depends on the key and one shard only, so a
new shard can only take records, never move them between old ones.

Scale: the assignment is a map, and its narrow rows are written once. Slots within a shard are gapless without sorting a shard in one
task: records are ranked within (shard, sub-bucket) groups of bounded size and shifted by the
running counts of the sub-buckets, a table of shards x sub-buckets rows.

Edge cases: a null key counts as the text ``null``; a null text has no bytes (size 16, crc32 0);
repeated keys share a shard and take consecutive slots; an empty table yields no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import groups_for, scratch, table

SHARDS = 40
ROWS_PER_SLOT_GROUP = 200_000


def shard_scores(key: Column, weights: list[float]) -> Column:
    """Array of (score, -shard) structs; ``array_max`` gives the winner, ties to the lower shard.

    52 bits of an MD5 digest make ``u``: uniform, stable over engines and releases.
    """
    text = F.coalesce(key.cast("string"), F.lit("null"))

    def score(weight: Column, shard: Column) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(text, F.lit(":"), shard.cast("string"))), 1, 13), 16, 10).cast("double")
        return F.struct((-weight / F.ln((bits + 0.5) / F.lit(float(2**52)))).alias("score"), (-shard).alias("neg"))

    return F.transform(F.array(*[F.lit(float(w)) for w in weights]), score)


def rendezvous(df: DataFrame, key: str, weights: list[float], grown: list[float] | None = None) -> DataFrame:
    """Add ``shard`` and, with ``grown`` weights (the same plus new shards), ``grown_shard``."""
    every = grown or weights
    if grown and list(grown[: len(weights)]) != list(weights):
        raise ValueError("grown weights must extend the old ones")
    n = len(weights)
    out = df.withColumn("_scores", shard_scores(F.col(key), every))
    out = out.withColumn("shard", (-F.array_max(F.slice("_scores", 1, n)).getField("neg")).cast("int"))
    if grown:
        out = out.withColumn("grown_shard", (-F.array_max("_scores").getField("neg")).cast("int"))
    return out.drop("_scores")


def with_slots(df: DataFrame, order: list[str], sub_buckets: int) -> DataFrame:
    """Add ``slot``: positions 0.. within ``shard``, without gaps. ``df`` should be a table: it is read twice.

    Every order column goes into the sub-bucket hash, so only wholly equal rows (whose slots are
    interchangeable) meet in one sub-bucket whatever their number.
    """
    keyed = df.withColumn("_sub", F.pmod(F.xxhash64(*order), F.lit(sub_buckets)).cast("int"))
    counts = keyed.groupBy("shard", "_sub").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_sub", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rank = Window.partitionBy("shard", "_sub").orderBy(*order)
    return keyed.withColumn("_rank", F.row_number().over(rank)).join(starts, ["shard", "_sub"]).withColumn("slot", F.col("_start") + F.col("_rank") - 1).drop("_sub", "_rank", "_start")


def op4_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over shards 0 to 39 under the law ``key``, and where a 41st shard would put them."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = scratch(rendezvous(rows, "doc_id", [1.0] * SHARDS, [1.0] * (SHARDS + 1)), "placed")
    subs = groups_for(placed.count(), SHARDS * ROWS_PER_SLOT_GROUP)
    return with_slots(placed, ["doc_id", "size", "text_crc32"], subs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _crc_table() -> list[int]:
    """What each byte adds to a CRC-32, by the polynomial's rule."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def sql() -> str:
    """The same in DuckDB, for tables of one sub-bucket: slots by rank of the key, check sums folded byte by byte."""
    return f"""WITH D AS (SELECT doc_id, coalesce(text, '') AS text, text IS NULL AS none, hex(encode(coalesce(text, ''))) AS h FROM documents),
C AS (SELECT doc_id, (CASE WHEN none THEN 0 ELSE strlen(text) END + 16)::BIGINT AS size,
 CASE WHEN h = '' THEN 0 ELSE xor(list_reduce(list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT), lambda a, b: xor(a >> 8, ([{", ".join(map(str, _crc_table()))}])[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) END AS text_crc32 FROM D),
S AS (SELECT doc_id, s, -1 / ln((('0x' || substr(md5(doc_id || ':' || s), 1, 13))::BIGINT + 0.5) / {2**52}::DOUBLE) AS score FROM C, range(0, {SHARDS + 1}) t(s)),
P AS (SELECT doc_id, arg_max(s, (score, -s)) FILTER (s < {SHARDS})::INT AS shard, arg_max(s, (score, -s))::INT AS grown_shard FROM S GROUP BY doc_id)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard FROM C JOIN P USING (doc_id)"""

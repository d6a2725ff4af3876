"""Corpus pipeline: toxicity, near-dedup, suffix dedup, decontamination and packing over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. :func:`run` writes every stage's result to the shared folder and reads
it back, so a lost executor re-reads files instead of repeating earlier stages; what a stage wrote
on its way is deleted.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm import decontaminate, packing, simhash, suffixes, toxicity
from folioframe.llm._common import bounded_batches, release, scratch, table, unused, written


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a number of each row, and the name of its column, which no other has.

    They are written once, so that the number stays the same: doc_id may be null or shared.
    """
    row = unused(docs, "_row")
    return scratch(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models do not reject.

    Scale: see the operator; rejecting is map-only, against tables of a bounded size. Null and empty
    texts score as texts without words, and stay unless most labelled texts are toxic; rows that
    are alike share a fate; a null doc_id is kept; other columns go along untouched.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rated = unused(docs, "rated")
    return toxicity.rated(docs, model, rated).filter(F.col(rated) < 0.5).drop(rated)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of SimHash neighbours over five-word shingles.

    Fingerprints of texts of similarity 0.8 differ in 9.7 of 64 bits on average, with a deviation
    of 2.9, so the radius is 20, within buckets of equal least shingle hashes; eight of these meet
    all but 3 in a million such pairs. Links of less similarity are taken out again.

    Texts of fewer than five words have one shingle, so only equal word sequences of theirs meet;
    word-less texts form one group.

    Rows are told apart by their number, not by doc_id. The first of a group has the least doc_id
    (null is last), then the least hash of the text. Other columns go along, whatever their names.

    Scale: texts become fingerprints, hashes and shingle sets in a map; buckets of any size are
    compared in blocks dealt over tasks, components found by rounds of contraction, and no
    group is gathered. The rows are written once with their numbers.
    """
    rows, row = numbered(docs)
    found = simhash.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), size=5, radius=20, keys=8).select(F.col("doc_id").alias("row"), "component_id")
    order = rows.select(F.col(row).alias("row"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("h"), F.col(row).alias("row")).alias("first"))
    kept = order.join(found, "row").groupBy("component_id").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    return rows.join(scratch(kept, "kept"), row, "left_semi").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that an earlier text has.

    A character is dropped only if all its bytes are; a text that repeats wholly stays as an empty
    one, a null one as null. Earlier means of lesser doc_id (null is least), then by a hash of the
    text; rows with the same doc_id and text count as one and lose the same. ``n_chars``, where there is such a column, is that of the text left (null
    texts keep theirs); other columns go along, whatever their names. Scale: see the operator.
    """

    @F.arrow_udf("string")
    def left_of(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, found in zip(texts.to_pylist(), spans.to_pylist()):
            if not found:
                out.append(text)
                continue
            raw = text.encode("utf-8", "replace")
            kept, _, _ = suffixes.kept_parts(raw, found)
            parts = []
            for s, e in kept:
                while 0 < s < len(raw) and raw[s] & 0xC0 == 0x80:
                    s -= 1
                while e < len(raw) and raw[e] & 0xC0 == 0x80:
                    e += 1
                parts.append(raw[s:e])
            out.append(b"".join(parts).decode("utf-8", "replace"))
        return pa.array(out, pa.string())

    bounded_batches(spark)
    spans = unused(docs, "spans")
    left = suffixes.with_spans(docs, into=spans)
    left = left.withColumn("text", F.when(F.size(spans) > 0, left_of("text", spans)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return left.select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark text was found.

    Rows are told apart by their number, not by doc_id, which may be null or shared; null and
    empty texts stay; other columns go along, whatever their names. Very long texts, and runs of
    one phrase in them, are searched in blocks of bounded size. Benchmark texts of under 20 characters
    are no reason to drop a document. Scale: a map over the texts, then an anti join by row number.
    """
    rows, row = numbered(docs)
    hits = decontaminate.contaminated(rows.select(F.col(row).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    found = scratch(hits.select(F.col("doc_id").alias(row)).distinct(), "contaminated")
    return rows.join(found, row, "left_anti").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of what is left: a row a piece, every document's pieces in full.

    Null and empty texts give a piece of the separator alone; rows that are alike are packed each.
    Scale: tokenising is a map, placing runs in groups of bounded size.
    """
    import public_tokenizers

    return packing.pack(scratch(packing.pieces(docs, public_tokenizers.path(packing.TOKENIZER)), "pieces"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", packed),
]

#: No stage but the last two could be put in SQL, so the whole has none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(functools.partial(stage, spark, docs, sf_dir), name)
        release(before)  # what the next stage reads is written
    return STAGES[-1][1](spark, docs, sf_dir)

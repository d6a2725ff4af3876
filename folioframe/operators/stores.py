"""Keyed stores of annotations and edits: feed, counts, upsert, update, delete, sidecars, signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The last change of each key replaces the row; new keys are added.

    ``seq`` orders changes; of equal ones that with the greatest values wins, whatever the plan.
    """
    every = rows.withColumn("seq", F.lit(-1).cast("long")).unionByName(changes)
    values = [F.desc(c) for c in rows.columns if c not in keys]
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("seq"), *values))
    return every.withColumn("_r", last).filter("_r = 1").drop("_r", "seq")


def update(rows: DataFrame, patch: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Non-null patch values win. Several patches of a key apply in order of ``seq`` (if there is one): each value is the last that is not null."""
    order = F.struct("seq") if "seq" in patch.columns else F.struct(F.lit(0))
    values = [F.max(F.when(F.col(c).isNotNull(), F.struct(order.alias("at"), F.col(c).alias("v"))))["v"].alias(f"_{c}") for c in columns]
    once = patch.groupBy(*keys).agg(*values)
    joined = rows.join(once, keys, "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])


def comment(rows: DataFrame, patch: DataFrame, at) -> DataFrame:
    """Annotations with the patch's (id, comment) and its moment as ``updated_at``."""
    new = patch.groupBy("id").agg(F.max("comment").alias("_comment"))
    said = F.col("_comment").isNotNull()
    return rows.join(new, "id", "left").withColumns({"comment": F.coalesce("_comment", "comment"), "updated_at": F.when(said, at).otherwise(F.col("updated_at"))}).drop("_comment")


def newest(rows: DataFrame, keys: list[str], at: str, most: int) -> DataFrame:
    """The last ``most`` rows of each key, newest first by ``position``."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(at), F.desc("id")))
    return rows.withColumn("position", place).filter(F.col("position") <= most)


def delete(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys), keys, "left_anti")


def changed(edits: DataFrame) -> DataFrame:
    return edits.filter(F.col("new_text") != F.col("original_text"))


def signature(edits: DataFrame) -> DataFrame:
    """Sorted ``id:new_text`` of a document's changed edits, joined by bars."""
    each = F.concat_ws(":", "id", "new_text")
    return changed(edits).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(each)), "|").alias("signature"))


SIDECAR = "map<string,array<struct<id:bigint,type:string,x:double,y:double,w:double,h:double>>>"


def to_sidecar(annotations: DataFrame, pretty: bool = False) -> DataFrame:
    """One JSON object per document: page number to its annotations."""
    item = F.struct("id", "type", "x", "y", "w", "h")
    page = annotations.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(item)).alias("items"))
    entry = F.struct(F.col("page_number").cast("string"), "items")
    return page.groupBy("doc_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry))), {"pretty": str(pretty).lower()}).alias("json"))


def from_sidecar(sidecars: DataFrame) -> DataFrame:
    """Annotations of sidecars; a null or unreadable one has none."""
    pages = sidecars.select("doc_id", F.explode(F.from_json("json", SIDECAR)).alias("page", "items"))
    return pages.select("doc_id", F.col("page").cast("long").alias("page_number"), F.inline("items"))

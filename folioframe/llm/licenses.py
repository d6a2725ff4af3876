r"""Operator 8 [native]: licence scan by TF-IDF cosine, then inheritance from ancestor directories.

A text's units are its lines, its blocks (runs of lines between blank ones, and runs of comment
lines) and the text as a whole. Each is compared with whole licence texts and with notices as
sparse TF-IDF vectors: a term weighs (1 + ln count) times its inverse frequency over the
templates, a term that no template has counts as the rarest, and function words count for nothing.
A text takes its best unit's licence at ``THRESHOLD`` or more, if they share two terms at least
(one word alone, such as a licence's name, is none). A text that is a licence as a whole is a licence file and
speaks for its directory; texts without a licence inherit from the nearest directory above them
that has one.

No unit is left out by guess: a cosine of c needs shared terms with at least c^2 of the
template's squared weight, so a unit must share a number of each template's rarer terms that
follows from their weights; only units that do not are passed over.

Scale: one scan of the texts, in which hash sets of terms decide; the terms of the few units left
are written, weighed by a broadcast table of the templates' terms (a few thousand rows, whatever
the corpus) and summed up. Inheritance is resolved per distinct directory by equi-joins over its
ancestors, then joined to the files by directory, a join whose hot directories AQE splits; no
directory is gathered.

Edge cases: null and empty texts have no licence of their own; a null path lies in no directory
and inherits nothing; equal scores (to nine decimals) go to the template that comes first by
name; several licence files of one directory give the one of highest score, then first name;
repeated rows are reported each; empty tables give no rows; other columns are left out.
"""

from __future__ import annotations

import functools
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import scratch, table
from .licence_texts import TEMPLATES

THRESHOLD = 0.6
SHARED = 2  # terms that a unit and a template have in common at least
# English function words.
STOP = (
    "a about all also an and any are as at be been but by can for from had has have he her his i if in into is it its may more no nor not of on one only or other our out she should so "
    "some such than that the their them then there these they this those to under up upon was we were what when where which who whom whose will with would you your"
).split()
TERM = r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"
COMMENT_LINES = r"(?m)(?:^[ \t]*(?:#|//|/\*|\*|--|;|%)[^\n]*\n?){2,}"
BLANK = r"\n[ \t\r]*\n\s*"


def _terms(text: str) -> list[str]:
    return [t for t in re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", text.lower()) if t not in STOP]


@functools.cache
def _vectors() -> tuple[dict[str, float], float, list[tuple[str, dict[str, float]]]]:
    """(inverse frequency of each term, that of any other term, [(licence, unit vector)])."""
    statements = [(name, _terms(t)) for name, texts in sorted(TEMPLATES.items()) for t in texts]
    n = len(statements)
    df: dict[str, int] = {}
    for _, terms in statements:
        for t in set(terms):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in df.items()}
    out = []
    for name, terms in statements:
        v = {t: (1 + math.log(terms.count(t))) * idf[t] for t in sorted(set(terms))}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out.append((name, {t: x / norm for t, x in v.items()}))
    return idf, math.log(1 + n) + 1, out


def needed(vector: dict[str, float], idf: dict[str, float], threshold: float) -> tuple[list[str], int]:
    """Rarer terms of a template, and how many of them a text shares at least whose cosine reaches the threshold.

    What the common terms weigh together may be shared for nothing; of the rest the heaviest weigh most.
    """
    least = threshold**2 - 1e-9
    common, free = set(), 0.0
    for t in sorted(vector, key=lambda t: (idf[t], t)):
        if free + vector[t] ** 2 >= least / 2:
            break
        common.add(t)
        free += vector[t] ** 2
    rare = [t for t in vector if t not in common]
    left, many = least - free, 0
    for w in sorted((vector[t] ** 2 for t in rare), reverse=True):
        if left <= 0:
            break
        left -= w
        many += 1
    return (rare, many) if many >= SHARED else (list(vector), SHARED)


def _array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))


def units(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (id, path, row, units): the units that may reach the threshold, each of a kind and its terms; written once."""
    idf, _, vectors = _vectors()
    rules = [needed(v, idf, threshold) for _, v in vectors]
    every = _array(sorted({t for rare, _ in rules for t in rare}))
    possible = lambda w: functools.reduce(lambda a, b: a | b, [F.size(F.array_intersect(w, _array(rare))) >= n for rare, n in rules])
    unit = lambda kind, w: F.struct(F.lit(kind).alias("kind"), w.alias("words"))
    text = F.col("text")
    several = lambda x: F.filter(x, lambda p: p.contains("\n"))
    paragraphs = F.split(text, BLANK)
    blocks = F.concat(F.when(F.size(paragraphs) > 1, several(paragraphs)).otherwise(F.array().cast("array<string>")), several(F.regexp_extract_all(text, F.lit(COMMENT_LINES), F.lit(0))))
    of = lambda kind, parts: F.transform(F.filter(F.transform(parts, words_of), lambda w: F.arrays_overlap(w, every)), lambda w: unit(kind, w))
    found = F.filter(F.concat(F.array(unit("whole", F.col("words"))), of("line", F.split(text, "\n")), of("block", blocks)), lambda u: possible(u["words"]))
    none = F.array().cast("array<struct<kind:string,words:array<string>>>")
    read = files.select("id", "path", F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    read = read.select("*", F.explode(F.array(words_of(text))).alias("words"))  # explode: taken once, not again in each use
    return scratch(read.select("id", "path", "row", F.when(F.arrays_overlap("words", every), found).otherwise(none).alias("units")), "units")


def scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Files (id, path, text) -> id, path, license, score, is_license_file; nulls where there is none."""
    spark = files.sparkSession
    idf, rare, vectors = _vectors()
    held = units(files, threshold)
    each = held.filter(F.size("units") > 0).select("row", F.posexplode("units").alias("unit", "u")).select("row", "unit", "u.kind", F.explode("u.words").alias("term")).filter(~F.col("term").isin(STOP))
    counts = each.groupBy("row", "unit", "kind", "term").agg(F.count(F.lit(1)).alias("n"))
    terms = spark.createDataFrame(list(idf.items()), "term string, idf double")
    weighed = counts.join(F.broadcast(terms), "term", "left").select("row", "unit", "kind", "term", ((1 + F.ln("n")) * F.coalesce("idf", F.lit(rare))).alias("w"))
    weighed = scratch(weighed, "weights")
    norms = weighed.groupBy("row", "unit", "kind").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    entries = spark.createDataFrame([(t, k, name, x) for k, (name, v) in enumerate(vectors) for t, x in v.items()], "term string, template int, license string, x double")
    products = weighed.join(F.broadcast(entries), "term").groupBy("row", "unit", "template", "license").agg(F.sum(F.col("w") * F.col("x")).alias("product"), F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= SHARED)
    scored = products.join(norms, ["row", "unit"]).select("row", "kind", "template", "license", F.round(F.col("product") / F.col("norm"), 9).alias("score")).filter(F.col("score") >= threshold)
    best = scored.groupBy("row").agg(F.max(F.struct("score", (-F.col("template")).alias("order"), "license")).alias("best"), F.bool_or(F.col("kind") == "whole").alias("whole"))
    return held.select("id", "path", "row").join(best, "row", "left").select("id", "path", F.col("best.license").alias("license"), F.round("best.score", 6).alias("score"), F.coalesce("whole", F.lit(False)).alias("is_license_file"))


def inherit(scanned: DataFrame) -> DataFrame:
    """Add ``origin`` (own, inherited or none), and the nearest ancestor's licence where a file has none.

    ``scanned`` should be a table, not a recomputed plan: it is read several times.
    """
    folder = F.regexp_replace(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), r"/+$", "")
    filed = scanned.withColumn("folder", F.when(F.col("path").isNotNull(), folder))
    best = F.min(F.struct((-F.col("score")).alias("order"), F.col("license")))
    folders = filed.filter("is_license_file and folder is not null").groupBy("folder").agg(best.alias("b")).select(F.col("folder").alias("above"), F.col("b.license").alias("from_license"))
    steps = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(steps, 1, k), "/").alias("above")))
    nearest = (
        filed.filter("license is null and folder is not null").select("folder").distinct().select("folder", F.inline(above)).join(folders, "above")
        .groupBy("folder").agg(F.max(F.struct("depth", "from_license", "above")).alias("near")).select("folder", F.col("near.from_license").alias("from_license"), F.col("near.above").alias("from_folder"))
    )
    own = F.col("license").isNotNull()
    joined = filed.join(nearest, "folder", "left")
    return joined.select(
        "id", "path", F.coalesce("license", "from_license").alias("license"), "score", "is_license_file",
        F.when(own, "own").when(F.col("from_license").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~own, F.col("from_folder")).alias("from_folder"),
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document; a document's path is source/lang/doc_id."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string"))
    found = scan(docs.select(F.col("doc_id").alias("id"), path.alias("path"), "text"))
    return inherit(scratch(found, "scanned")).withColumnRenamed("id", "doc_id")


def sql() -> str:
    """The same in DuckDB: every unit against every template, nothing passed over."""
    idf, rare, vectors = _vectors()
    text = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({text(t)}, {k}, {text(name)}, {x!r}::DOUBLE)" for k, (name, v) in enumerate(vectors) for t, x in v.items())
    weights = ", ".join(f"({text(t)}, {x!r}::DOUBLE)" for t, x in idf.items())
    return rf"""WITH V(term, template, license, x) AS (VALUES {values}), I(term, idf) AS (VALUES {weights}),
D AS (SELECT doc_id, coalesce(source, '') || '/' || coalesce(lang, '') || '/' || doc_id AS path, coalesce(source, '') AS top, coalesce(source, '') || '/' || coalesce(lang, '') AS folder, coalesce(text, '') AS text FROM documents),
PR AS (SELECT doc_id, string_split_regex(text, '\n[ \t\r]*\n\s*') AS parts, regexp_extract_all(text, {text(COMMENT_LINES)}) AS comments FROM D),
U AS (SELECT doc_id, 'whole' AS kind, 0 AS unit, text FROM D
 UNION ALL SELECT doc_id, 'line', unnest(range(0, len(string_split(text, chr(10))))), unnest(string_split(text, chr(10))) FROM D
 UNION ALL SELECT doc_id, 'block', unnest(range(0, len(parts))), unnest(parts) FROM PR WHERE len(parts) > 1
 UNION ALL SELECT doc_id, 'comment', unnest(range(0, len(comments))), unnest(comments) FROM PR),
W AS (SELECT doc_id, kind, unit, unnest(regexp_extract_all(lower(text), {text(TERM)})) AS term FROM U WHERE kind IN ('whole', 'line') OR contains(text, chr(10))),
N AS (SELECT doc_id, kind, unit, term, (1 + ln(count(*))) * coalesce(any_value(idf), {rare!r}::DOUBLE) AS w FROM W LEFT JOIN I USING (term) WHERE term NOT IN ({", ".join(map(text, STOP))}) GROUP BY ALL),
M AS (SELECT doc_id, kind, unit, sqrt(sum(w * w)) AS norm FROM N GROUP BY ALL),
S AS (SELECT doc_id, kind, unit, template, license, sum(w * x) AS product FROM N JOIN V USING (term) GROUP BY ALL HAVING count(*) >= {SHARED}),
B AS (SELECT doc_id, kind, template, license, round(product / norm, 9) AS score FROM S JOIN M USING (doc_id, kind, unit) WHERE round(product / norm, 9) >= {THRESHOLD}),
O AS (SELECT doc_id, arg_max(license, (score, -template)) AS license, round(max(score), 6) AS score, bool_or(kind = 'whole') AS whole FROM B GROUP BY doc_id),
R AS (SELECT D.doc_id, path, top, folder, license, score, coalesce(whole, false) AS whole FROM D LEFT JOIN O ON O.doc_id = D.doc_id),
F AS (SELECT folder, arg_min(license, (-score, license)) AS license FROM R WHERE whole GROUP BY folder)
SELECT doc_id, path, coalesce(R.license, F.license) AS license, score, whole AS is_license_file, CASE WHEN R.license IS NOT NULL THEN 'own' WHEN F.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, CASE WHEN R.license IS NULL AND F.license IS NOT NULL THEN F.folder END AS from_folder
FROM R LEFT JOIN F ON F.folder = R.folder"""



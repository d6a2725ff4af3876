"""Queries of search, pages, recognised text, annotations, events and scalars, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar
from .operators import ocr, pages, search, stores
from .plans import views
from .registry import Q, SQL, query
from .streaming import events

PATTERN = "tion"
SPLIT = [[0, 2], [1]]
ORDER = [2, 1, 3]
HIT = ["doc_id", "page_number", "line_idx", "match_index", "start", "text", "snippet"]

# ---- search ------------------------------------------------------------------------------------

_HITS = """WITH X{k} AS (SELECT *, string_split(lower(line), 'tion') AS p FROM {t}),
Y{k} AS (SELECT *, unnest(range(1, len(p))) AS k FROM X{k}),
Z{k} AS (SELECT doc_id, page_number, line_idx, line, CAST(list_sum(list_transform(p[1:k], lambda q: length(q))) + (k - 1) * 4 AS BIGINT) AS "start" FROM Y{k}),
H{k} AS (SELECT doc_id, page_number, line_idx, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY line_idx, "start") - 1 AS match_index, "start", substr(line, "start" + 1, 4) AS text,
 (CASE WHEN "start" > 40 THEN '…' ELSE '' END) || trim(regexp_replace(substr(line, greatest("start" - 40, 0) + 1, least("start" + 44, length(line)) - greatest("start" - 40, 0)), '\\s+', ' ', 'g')) || (CASE WHEN "start" + 44 < length(line) THEN '…' ELSE '' END) AS snippet FROM Z{k})"""
_TEXT = _HITS.format(k=1, t="L")


@query("search_hits", _TEXT + " SELECT * FROM H1 ORDER BY doc_id, page_number, match_index")
def search_hits(spark: SparkSession, sf: str) -> DataFrame:
    return search.find(views.lines(spark, sf), PATTERN).select(HIT).orderBy("doc_id", "page_number", "match_index")


@query("search_hits_ocr_union", _TEXT + ", " + _HITS.format(k=2, t="OCR_ROWS")[5:].replace("OCR_ROWS", "(SELECT * REPLACE (line || ' recognition' AS line) FROM O)") + " SELECT *, 'text' AS source FROM H1 UNION ALL SELECT *, 'ocr' AS source FROM H2 WHERE NOT EXISTS (SELECT 1 FROM H1 WHERE H1.doc_id = H2.doc_id AND H1.page_number = H2.page_number)")
def search_hits_ocr_union(spark, sf):
    """The recognised lines end in a word that the text layer lacks, so pages without a text hit have recognised ones."""
    read = views.ocr_lines(spark, sf).withColumn("line", F.concat("line", F.lit(" recognition")))
    return search.find_with_ocr(views.lines(spark, sf), read, PATTERN).select(*HIT, "source")


@query("search_page_filter", _TEXT + " SELECT * FROM H1 WHERE page_number = 2")
def search_page_filter(spark, sf):
    return search.find(views.lines(spark, sf).filter("page_number = 2"), PATTERN).select(HIT)


@query("search_next_prev", _TEXT + """, N AS (SELECT doc_id, page_number, match_index, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, match_index) - 1 AS position, count(*) OVER (PARTITION BY doc_id) AS n FROM H1)
 SELECT doc_id, page_number, match_index, position, (position + 1) % n AS target FROM N""")
def search_next_prev(spark, sf):
    return search.step(search.find(views.lines(spark, sf), PATTERN), 1).select("doc_id", "page_number", "match_index", "position", "target")


# ---- pages -------------------------------------------------------------------------------------


@query("page_merge", 'SELECT doc_id // 10 AS "group", doc_id, page_number, n_lines, row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id, page_number) AS new_page FROM P')
def page_merge(spark, sf):
    merged = pages.merge(views.pages(spark, sf).withColumn("group", F.expr("doc_id div 10")), "doc_id")
    return merged.select("group", "doc_id", "page_number", "n_lines", "new_page")


@query("page_split", "SELECT doc_id, page_number, n_lines, CASE page_number WHEN 2 THEN 2 ELSE 1 END AS part, CASE page_number WHEN 3 THEN 2 ELSE 1 END AS new_page FROM P WHERE page_number <= 3")
def page_split(spark, sf):
    return pages.split(views.pages(spark, sf), SPLIT).select("doc_id", "page_number", "n_lines", "part", "new_page")


_LISTED = "SELECT doc_id, page_number, n_lines, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS new_page FROM P JOIN (VALUES {v}) AS V(o, page_number) USING (page_number)"


@query("page_extract", _LISTED.format(v="(0, 2), (1, 1), (2, 2)"))
def page_extract(spark, sf):
    return pages.select_pages(views.pages(spark, sf), [2, 1, 2]).select("doc_id", "page_number", "n_lines", "new_page")


@query("page_reorder", _LISTED.format(v="(0, 2), (1, 1), (2, 3)"))
def page_reorder(spark, sf):
    return pages.select_pages(views.pages(spark, sf), ORDER).select("doc_id", "page_number", "n_lines", "new_page")


@query("page_delete", "SELECT doc_id, page_number, n_lines, row_number() OVER (PARTITION BY doc_id ORDER BY page_number) AS new_page FROM P WHERE page_number <> 1")
def page_delete(spark, sf):
    return pages.delete(views.pages(spark, sf), 1).select("doc_id", "page_number", "n_lines", "new_page")


@query("page_rotate", "SELECT doc_id, page_number, n_lines, CASE page_number WHEN 1 THEN 90 ELSE 0 END AS rotation FROM P")
def page_rotate(spark, sf):
    return pages.rotate(views.pages(spark, sf), 1, 90).select("doc_id", "page_number", "n_lines", "rotation")


_SPEC = "a || '-' || b || ', ' || c || ',x, ' || a || ' , 99999999999, ' || b || '-' || a"


@query("page_ranges", f"""WITH V AS (SELECT DISTINCT n_nationkey % 13 AS a, n_regionkey * 3 AS b, n_nationkey % 7 AS c FROM nation),
 X AS (SELECT *, {_SPEC} AS spec FROM V)
 SELECT spec, coalesce((SELECT string_agg(p, ',' ORDER BY p) FROM range(1, 9) t(p) WHERE p BETWEEN least(a, b) AND greatest(a, b) OR p IN (a, c)), '') AS pages FROM X""")
def page_ranges(spark, sf):
    v = views.table(spark, sf, "nation").selectExpr("n_nationkey % 13 AS a", "n_regionkey * 3 AS b", "n_nationkey % 7 AS c").distinct()
    return v.selectExpr(f"{_SPEC} AS spec").select("spec", F.array_join(scalar.page_ranges(F.col("spec"), 8), ",").alias("pages"))


@query("partial_save_remap", "SELECT E.doc_id, id, V.n AS page_number, new_text FROM E JOIN (VALUES (1, 2), (2, 1)) AS V(n, p) ON E.page_number = V.p")
def partial_save_remap(spark, sf):
    return pages.remap(views.edits(spark, sf), [2, 1]).select("doc_id", "id", "page_number", "new_text")


@query("library_listing", "SELECT doc_id, source || '/' || doc_id || '.pdf' AS path, strlen(text) AS size, row_number() OVER (PARTITION BY source ORDER BY strlen(text) DESC, doc_id) AS position FROM documents", view=False)
def library_listing(spark, sf):
    from pyspark.sql import Window

    docs = views.table(spark, sf, "documents").select("doc_id", "source", F.octet_length("text").cast("long").alias("size"))
    path = F.concat("source", F.lit("/"), "doc_id", F.lit(".pdf"))
    return docs.select("doc_id", path.alias("path"), "size", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("size"), "doc_id")).cast("long").alias("position"))


# ---- recognised text ---------------------------------------------------------------------------


@query("text_layer_sufficient", r"SELECT doc_id, n, n >= 200 AS sufficient FROM (SELECT doc_id, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS n FROM documents)", view=False)
def text_layer_sufficient(spark, sf):
    return ocr.text_layer(views.table(spark, sf, "documents"))


@query("ocr_page_result", "SELECT doc_id, page_number, string_agg(line, chr(10) ORDER BY line_idx) AS text, round(avg(mean), 6) AS confidence FROM O GROUP BY ALL")
def ocr_page_result(spark, sf):
    return ocr.page_results(views.ocr_lines(spark, sf)).withColumn("confidence", F.round("confidence", 6))


_PAGE = "WITH TP AS (SELECT doc_id, page_number, string_agg(line, chr(10) ORDER BY line_idx) AS text FROM O GROUP BY ALL) "


@query("ocr_transcript_md", _PAGE + "SELECT doc_id, string_agg(chr(10) || chr(10) || '## Page ' || page_number || chr(10) || chr(10) || CASE WHEN text = '' THEN '[no text]' ELSE text END || chr(10), '' ORDER BY page_number) AS markdown FROM TP GROUP BY doc_id")
def ocr_transcript_md(spark, sf):
    found = ocr.transcript(ocr.page_results(views.ocr_lines(spark, sf)))
    return found.select("doc_id", ocr.markdown(F.col("transcript")).alias("markdown"))


# ---- annotations and edits ---------------------------------------------------------------------


@query("annotation_feed", "SELECT id, doc_id, page_number, type, updated_at FROM A ORDER BY updated_at DESC, id")
def annotation_feed(spark, sf):
    return views.annotations(spark, sf).select("id", "doc_id", "page_number", "type", "updated_at").orderBy(F.desc("updated_at"), "id")


@query("annotation_counts", "SELECT doc_id, type, count(*) AS n FROM A GROUP BY ALL")
def annotation_counts(spark, sf):
    return views.annotations(spark, sf).groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"))


@query("annotation_upsert", "SELECT id, doc_id, page_number, CASE WHEN id % 7 = 0 THEN 'note' ELSE type END AS type FROM A UNION ALL SELECT id + 100000000, doc_id, page_number, 'note' FROM A WHERE id % 7 = 0")
def annotation_upsert(spark, sf):
    rows = views.annotations(spark, sf).select("id", "doc_id", "page_number", "type")
    notes = rows.filter("id % 7 = 0").withColumn("type", F.lit("note"))
    old = notes.withColumn("type", F.lit("stamp")).withColumn("seq", F.lit(0).cast("long"))
    new = notes.unionByName(notes.withColumn("id", F.col("id") + 100000000)).withColumn("seq", F.lit(1).cast("long"))
    return stores.upsert(rows, old.unionByName(new), ["doc_id", "page_number", "id"])


@query("annotation_update", "SELECT id, doc_id, CASE WHEN id % 5 = 0 THEN 'x' || id ELSE type END AS type, x FROM A")
def annotation_update(spark, sf):
    rows = views.annotations(spark, sf).select("id", "doc_id", "type", "x")
    patch = rows.filter("id % 5 = 0").select("id", F.concat(F.lit("x"), "id").alias("type"), F.lit(None).cast("double").alias("x"))
    return stores.update(rows, patch, ["id"], ["type", "x"]).select("id", "doc_id", "type", "x")


@query("annotation_delete", "SELECT id, doc_id, type FROM A WHERE type <> 'error'")
def annotation_delete(spark, sf):
    rows = views.annotations(spark, sf).select("id", "doc_id", "type")
    return stores.delete(rows, rows.filter("type = 'error'"), ["id"])


@query("annotation_sidecar_roundtrip", "SELECT doc_id, page_number, id, type, x, y, w, h FROM A")
def annotation_sidecar_roundtrip(spark, sf):
    return stores.from_sidecar(stores.to_sidecar(views.annotations(spark, sf)))


@query("edit_changed", "SELECT doc_id, id, new_text FROM E WHERE new_text <> original_text")
def edit_changed(spark, sf):
    return stores.changed(views.edits(spark, sf)).select("doc_id", "id", "new_text")


@query("edit_signature", "SELECT doc_id, string_agg(id || ':' || new_text, '|' ORDER BY (id || ':' || new_text) COLLATE \"C\") AS signature FROM E WHERE new_text <> original_text GROUP BY doc_id")
def edit_signature(spark, sf):
    return stores.signature(views.edits(spark, sf))


# ---- scalars -----------------------------------------------------------------------------------


@query("color_roundtrip", "SELECT event_id, '#' || lower(lpad(to_hex(event_id * 7919 % 16777216), 6, '0')) AS color FROM events", view=False)
def color_roundtrip(spark, sf):
    color = F.concat(F.lit("#"), F.lower(F.lpad(F.hex(F.col("event_id") * 7919 % 16777216), 6, "0")))
    return views.table(spark, sf, "events").select("event_id", scalar.rgb_to_hex(*scalar.hex_to_rgb(color)).alias("color"))


@query("cmyk_rgb", "SELECT event_id, round((1 - c) * 0.75::DOUBLE, 6) AS r, round((0.9 * 0.75)::DOUBLE, 6) AS g, round((0.8 * 0.75)::DOUBLE, 6) AS b FROM (SELECT event_id, (event_id % 101) / 100.0::DOUBLE AS c FROM events)", view=False)
def cmyk_rgb(spark, sf):
    c = (F.col("event_id") % 101) / F.lit(100.0)
    r, g, b = scalar.cmyk_to_rgb(c, F.lit(0.1), F.lit(0.2), F.lit(0.25))
    return views.table(spark, sf, "events").select("event_id", F.round(r, 6).alias("r"), F.round(g, 6).alias("g"), F.round(b, 6).alias("b"))


@query("chunk_reassemble", "SELECT conv_id, turn, text FROM conversations", view=False)
def chunk_reassemble(spark, sf):
    return events.reassembled(events.chunks(views.table(spark, sf, "conversations").select("conv_id", "turn", "text"), "text"), ["conv_id", "turn"])


# ---- event time --------------------------------------------------------------------------------


@query("debounce_sessions", """WITH B AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
 C AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM B)
 SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, arg_max(event_id, (ts, event_id)) AS value FROM C GROUP BY user_id, burst""", view=False)
def debounce_sessions(spark, sf):
    return events.debounce(views.table(spark, sf, "events"), "user_id", "ts", "6 hours", "event_id")


@query("auth_fail_window", "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM events WHERE event_type = 'error'", view=False)
def auth_fail_window(spark, sf):
    from pyspark.sql import Window

    fails = views.table(spark, sf, "events").filter("event_type = 'error'")
    day = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-86_400_000_000, 0)
    return fails.select("event_id", "user_id", F.count(F.lit(1)).over(day).alias("n"))


@query("auth_lockout", """WITH RECURSIVE F AS (SELECT user_id AS "key", event_id AS id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'error'),
 S AS (SELECT "key", 0::BIGINT AS k, NULL::BIGINT AS id, []::BIGINT[] AS recent, -9e15::DOUBLE AS until, false AS recorded, false AS locked FROM (SELECT DISTINCT "key" FROM F)
  UNION ALL SELECT "key", k, id, new, CASE WHEN recorded AND len(new) >= 3 THEN t + 43200e6 ELSE until END, recorded, recorded AND len(new) >= 3
  FROM (SELECT F."key", F.k, F.id, F.t, S.until, F.t >= S.until AS recorded, CASE WHEN F.t >= S.until THEN list_append(list_filter(S.recent, lambda x: F.t - x < 86400e6), F.t) ELSE S.recent END AS new FROM S JOIN F ON F."key" IS NOT DISTINCT FROM S."key" AND F.k = S.k + 1))
 SELECT "key", id, recorded, locked FROM S WHERE k > 0""", view=False)
def auth_lockout(spark, sf):
    fails = views.table(spark, sf, "events").filter("event_type = 'error'").withColumnRenamed("event_id", "id")
    return events.lockout(fails, "user_id", "ts", 86_400, 3, 43_200).select("key", "id", "recorded", "locked")


# ---- labels -------------------------------------------------------------------------------------


@query("file_size_label", """SELECT doc_id, CASE WHEN n < 1024 THEN n || ' Bytes' WHEN n < 1048576 THEN regexp_replace(regexp_replace(printf('%.2f', round(n / 1024.0::DOUBLE, 2)), '0+$', ''), '\\.$', '') || ' KB' ELSE 'big' END AS label FROM (SELECT doc_id, strlen(text) AS n FROM documents)""", view=False)
def file_size_label(spark, sf):
    docs = views.table(spark, sf, "documents")
    return docs.select("doc_id", scalar.file_size(F.octet_length("text").cast("long")).alias("label"))


from . import catalog_content, catalog_more, catalog_joins  # noqa: E402, F401  they register their queries

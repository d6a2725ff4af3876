"""Finding the runs that show a line: exact text first, then groups, then the nearest by edit distance."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..content import engine, surgery
from ..functions.scalar import normalize
from ._arrow import Made, made, map_rows
from .streams import by_font


LONG = 200  # characters
BY_PARTS = 64  # characters of a target
MANY = 1000  # runs of a page that are held against each target
RUN = ("ord", "text", "x", "y", "start", "in_xobject")  # of a run, what locating needs
CELL, LAST = (192.0, 72.0), (6.0, 22.0)  # points across and along a page; number of the last cell, which has no end


@F.pandas_udf(IntegerType())
def _distances(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.Series:
    """Edit distances; null of a null, and of texts that their parts show to be further apart than ``most``."""
    return pd.Series([None if x is None or y is None else surgery.distance_within(x, y, k) for x, y, k in zip(a, b, most)], dtype="Int32")


def in_reach(targets: DataFrame, runs: DataFrame) -> DataFrame:
    """Pairs of targets (with low_x, high_x, low_y, high_y) and runs (x, y) of a page that lie inside them, edges included, each once.

    Pages are cut into cells: a run is in one, a target in all that it touches (mostly one or two), and only
    those of a cell are compared, so a page of any number of runs is many small groups. The outermost cells
    have no end, so a target of any width touches 192 at most, and no run need stand for its page a second time.
    """
    cell = lambda c, k: F.floor(F.greatest(F.least(F.col(c) / CELL[k], F.lit(LAST[k])), F.lit(-1.0))).cast("int")
    t = targets.filter("high_x >= low_x and high_y >= low_y")
    t = t.withColumn("cx", F.explode(F.sequence(cell("low_x", 0), cell("high_x", 0)))).withColumn("cy", F.explode(F.sequence(cell("low_y", 1), cell("high_y", 1))))
    r = runs.filter("x is not null and y is not null").withColumns({"cx": cell("x", 0), "cy": cell("y", 1)})
    return t.join(r, ["doc_id", "page_number", "cx", "cy"]).filter("x between low_x and high_x and y between low_y and high_y").drop("cx", "cy", "low_x", "high_x", "low_y", "high_y")


def locate(targets: DataFrame, runs: DataFrame, font_size: float = 12.0) -> DataFrame:
    """Targets (doc_id, page_number, id, text, bx, by, bw, bh) -> best single run near the box, and confidence (0 and null if none).

    A relational form for lines of one run: the join is by cells of a page (:func:`in_reach`); edit
    distances are taken only of targets without an exact match and of runs whose length alone
    does not rule them out. White space is evened out only of pairs that differ as they are, and
    no text goes further than its distance. Runs inside forms are left out.
    """
    wide, tall = surgery.tolerances(font_size)
    top, bottom = F.lit(792.0) - F.col("by"), F.lit(792.0) - F.col("by") - F.col("bh")
    t = targets.select(
        "doc_id", "page_number", "id", F.col("text").alias("t"), (F.col("bx") - wide).alias("low_x"), (F.col("bx") + F.col("bw") + wide).alias("high_x"), (bottom - tall).alias("low_y"), (top + tall).alias("high_y"),
    )
    own = runs.filter("not in_xobject").select("doc_id", "page_number", "ord", "start", F.col("text").alias("r"), "x", "y")
    pairs = in_reach(t.filter(F.col("t").rlike(r"(?U)\S")), own)
    unlike = F.col("t") != F.col("r")
    pairs = pairs.withColumns({"t": F.when(unlike, normalize(F.col("t"))), "r": F.when(unlike, normalize(F.col("r"))), "same": ~unlike})
    pairs = pairs.withColumn("n", F.length("t")).withColumn("allowed", F.greatest(F.lit(surgery.LEAST_EDITS), F.floor(surgery.SHARE * F.col("n")).cast("int")))
    same = F.col("same") | (F.col("t") == F.col("r"))
    open_ = ~same & (F.abs(F.col("n") - F.length("r")) <= F.col("allowed"))
    # the built-in function takes time by length and edits allowed; texts go to bit vectors in Arrow batches
    far = _distances(F.when(open_, F.col("t")), F.when(open_, F.col("r")), F.col("allowed"))
    distance = F.when(same, 0).when(open_, far)
    scored = pairs.withColumn("d", F.explode(F.array(distance))).filter("d between 0 and allowed")  # explode: taken once, not again in the filter
    order = F.struct("d", (-F.round(F.col("y") * 2)).alias("above"), F.round(F.col("x") * 2).alias("left"), "start", "ord", "n")
    best = scored.select("doc_id", "page_number", "id", order.alias("o")).groupBy("doc_id", "page_number", "id").agg(F.min("o").alias("o")).select("doc_id", "page_number", "id", "o.*")
    confidence = F.when(F.col("d") == 0, 1.0).otherwise(F.greatest(F.lit(surgery.FLOOR), 1 - F.col("d") / F.col("n")))
    found = best.select("doc_id", "page_number", "id", "ord", confidence.alias("confidence"))
    return targets.select("doc_id", "page_number", "id").join(found, ["doc_id", "page_number", "id"], "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def _stretches(text: Column, size: int) -> Column:
    """Every stretch of ``size`` characters, with its size and place, in one pass."""
    found = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))."), F.lit(1))  # a whole character is passed each time, also one of two code units
    return F.transform(found, lambda s, at: F.struct(F.lit(size).alias("size"), at.alias("at"), s.alias("part")))


def alike(targets: DataFrame, runs: DataFrame) -> DataFrame:
    """Pairs of targets (t, n, allowed) and runs (r) of a page that may be within ``allowed`` edits of each other, each once.

    Of ``allowed`` + 1 parts of a target at least one stands unchanged in such a run, no further
    from its place than the edits can move it: an equi-join on part, then the place. The parts have
    1 to 7 characters; a target too short to be cut has an empty part, as have all runs that are as short.

    Parts tell little of long texts, where so many edits are allowed that parts meet by chance: targets of more than
    ``BY_PARTS`` characters are joined by length, in steps of a tenth, of which a run is in one.
    """
    step = lambda c: F.floor(F.log(c.cast("double")) / F.log(F.lit(1.1))).cast("long")
    most = BY_PARTS + max(surgery.LEAST_EDITS, int(surgery.SHARE * BY_PARTS))
    far = targets.filter(F.col("n") > BY_PARTS).withColumn("step", F.explode(F.sequence(step(F.col("n") - F.col("allowed")), step(F.col("n") + F.col("allowed")))))
    sized = runs.select("doc_id", "page_number", "ord", "r", step(F.greatest(F.length("r"), F.lit(1))).alias("step"))
    by_length = far.join(sized, ["doc_id", "page_number", "step"]).filter(F.abs(F.length("r") - F.col("n")) <= F.col("allowed"))
    targets, runs = targets.filter(F.col("n") <= BY_PARTS), runs.filter(F.length("r") <= most)
    count = F.col("allowed") + 1
    begin, end = F.floor(F.col("k") * F.col("n") / count).cast("int"), F.floor((F.col("k") + 1) * F.col("n") / count).cast("int")
    cut = targets.filter("t <> ''").withColumn("k", F.explode(F.when(F.col("n") > F.col("allowed"), F.sequence(F.lit(0), F.col("allowed"))).otherwise(F.array(F.lit(0)))))
    short = F.col("n") <= F.col("allowed")
    cut = cut.select("doc_id", "page_number", "id", "t", "n", "allowed", F.when(short, 0).otherwise(begin).alias("at"), F.when(short, 0).otherwise(end - begin).alias("size"), F.when(short, "").otherwise(F.substring("t", begin + 1, end - begin)).alias("part"))
    none = F.array().cast("array<struct<size:int,at:int,part:string>>")
    empty = F.when(F.length("r") <= 2 * surgery.LEAST_EDITS, F.array(F.struct(F.lit(0).alias("size"), F.lit(0).alias("at"), F.lit("").alias("part")))).otherwise(none)
    held = runs.select("doc_id", "page_number", "ord", "r", F.explode(F.concat(none, *[_stretches(F.col("r"), s) if s else empty for s in range(8)])).alias("s"))
    held = held.select("doc_id", "page_number", "ord", "r", F.col("s.size").alias("size"), F.col("s.part").alias("part"), F.col("s.at").alias("place"))
    met = cut.join(held, ["doc_id", "page_number", "size", "part"]).filter((F.abs(F.col("place") - F.col("at")) <= F.col("allowed")) & (F.abs(F.length("r") - F.col("n")) <= F.col("allowed")))
    columns = ["doc_id", "page_number", "id", "ord", "t", "n", "allowed", "r"]
    return met.select(columns).distinct().unionByName(by_length.select(columns))


def _held(t: Column, runs: Column) -> Column:
    """The first, by rank, of the runs of an array that hold a target or stand in it, whose distance is the difference of their lengths, if that is allowed; null if there is none."""
    away = lambda r: F.abs(F.length(r["r"]) - t["n"])
    near = F.filter(runs, lambda r: (away(r) <= t["allowed"]) & (r["r"].contains(t["t"]) | t["t"].contains(r["r"])))
    return F.array_min(F.transform(near, lambda r: _ranked(t, r, away(r))))


def _ranked(t: Column, r: Column, d: Column) -> Column:
    """What runs are chosen by: those that say the whole line, where it is known, then the nearest, then reading order."""
    other = F.coalesce(r["r"] != t["whole"], F.lit(False))
    return F.struct(other.alias("other"), d.cast("int").alias("d"), (-F.round(r["y"] * 2)).alias("above"), F.round(r["x"] * 2).alias("left"), r["start"].alias("start"), r["ord"].alias("ord"))


def locate_anywhere(targets: DataFrame, runs: DataFrame) -> DataFrame:
    """Targets (doc_id, page_number, id, text) without a place -> best single run of their page, and confidence (0 and null if none).

    Targets may have ``whole``, all that their line is known to say: of the runs within the edits allowed, one that says it goes
    before nearer ones, and ``as_known`` tells whether the run does.

    Scale: the targets and the runs of a page meet in one row, so texts go through one shuffle each and no pair does. Runs
    that hold the target are looked for first, without any distance; where they do not settle it, it is held against those
    of its page whose length allows it, as they stream by. Pages of more than ``MANY`` runs are joined by :func:`alike` instead.
    """
    single, _, ceiling = surgery.CONFIDENCE[False]
    known = "whole" in targets.columns
    t = targets.select("doc_id", "page_number", "id", normalize(F.col("text")).alias("t"), (normalize(F.col("whole")) if known else F.lit(None).cast("string")).alias("whole"))
    t = t.withColumn("n", F.length("t")).withColumn("allowed", F.greatest(F.lit(surgery.LEAST_EDITS), F.floor(surgery.SHARE * F.col("n")).cast("int")))
    own = runs.filter("not in_xobject").select("doc_id", "page_number", "ord", "start", normalize(F.col("text")).alias("r"), "x", "y")
    wanted = t.groupBy("doc_id", "page_number").agg(F.collect_list(F.struct("id", "t", "whole", "n", "allowed")).alias("targets"))
    said = own.groupBy("doc_id", "page_number").agg(F.collect_list(F.struct("ord", "start", "r", "x", "y")).alias("runs"))
    pages = wanted.join(said, ["doc_id", "page_number"], "left").withColumn("runs", F.coalesce("runs", F.array().cast(said.schema["runs"].dataType)))

    each = pages.select("doc_id", "page_number", "runs", F.posexplode("targets").alias("at", "target"))
    few, many = each.filter(F.size("runs") <= MANY), each.filter(F.size("runs") > MANY)
    w, r, c = F.col("target"), F.col("run"), F.col("close")
    few = few.withColumn("close", F.explode(F.array(F.when(w["t"] != "", _held(w, F.col("runs"))))))  # explode: taken once
    settled = F.coalesce(w["t"] == "", F.lit(True)) | F.when(w["whole"].isNull(), c["d"] == 0).otherwise(~c["other"]).eqNullSafe(True)
    most = F.when(w["whole"].isNull(), F.least(w["allowed"], c["d"])).otherwise(w["allowed"])
    left = F.filter("runs", lambda r: ~settled & (F.abs(F.length(r["r"]) - w["n"]) <= most))
    pairs = few.select("doc_id", "page_number", "at", "target", "close", F.explode_outer(left).alias("run"))
    large = many.select("doc_id", "page_number", "at", "target").filter("target.t <> ''")
    held = pages.filter(F.size("runs") > MANY).select("doc_id", "page_number", F.explode("runs").alias("run"))
    near = alike(large.select("doc_id", "page_number", F.col("at").alias("id"), "target.t", "target.n", "target.allowed"), held.select("doc_id", "page_number", "run.ord", "run.r"))
    near = near.select("doc_id", "page_number", F.col("id").alias("at"), "ord").join(large, ["doc_id", "page_number", "at"]).join(held.withColumn("ord", F.col("run.ord")), ["doc_id", "page_number", "ord"]).drop("ord")
    none = many.select("doc_id", "page_number", "at", "target", F.lit(None).cast(pairs.schema["run"].dataType).alias("run"))
    pairs = pairs.unionByName(near.unionByName(none).withColumn("close", F.lit(None).cast(pairs.schema["close"].dataType)))

    far = F.when((w["n"] > LONG) & (w["t"] != r["r"]), r["r"])
    d = F.when(w["t"] == r["r"], 0).when(far.isNotNull(), _distances(F.when(far.isNotNull(), w["t"]), far, w["allowed"])).otherwise(F.call_function("levenshtein", w["t"], r["r"], w["allowed"]))
    best = F.least(F.when(F.col("d").between(0, w["allowed"]), _ranked(w, r, F.col("d"))), c)
    found = pairs.withColumn("d", d).select("doc_id", "page_number", "at", w["id"].alias("id"), w["n"].alias("n"), best.alias("best"))
    found = found.groupBy("doc_id", "page_number", "at").agg(F.first("id").alias("id"), F.first("n").alias("n"), F.min("best").alias("b"))  # nulls do not count
    confidence = F.when(F.col("b.d") == 0, single).when(F.col("b.d").isNotNull(), F.greatest(F.lit(surgery.FLOOR), ceiling - F.col("b.d") / F.col("n"))).otherwise(0.0)
    return found.select("doc_id", "page_number", "id", F.col("b.ord").alias("ord"), confidence.alias("confidence"), *([(~F.col("b.other")).alias("as_known")] if known else []))


FOUND = "doc_id long, page_number long, id string, runs array<long>, confidence double, reason string, stream_size long"


def locate_on_pages(targets: DataFrame, streams: DataFrame | Made, decode=by_font, page_height: float = 792.0) -> DataFrame:
    """The whole cascade, for lines of several runs and targets without a place: run numbers, confidence, reason.

    One pass a page; a page's targets come together, its stream is replayed once and never edited.
    Streams that are not built yet (``streams.unbuilt``) are built in that pass, so none goes through the join.
    """
    rows, columns, make = made(streams)
    wanted = targets.groupBy("doc_id", "page_number").agg(F.collect_list(F.struct("id", "text", "bx", "by", "bw", "bh")).alias("targets"))

    def each(doc, page, targets, *held):
        data = make(*held)
        runs = surgery.Shown(engine.Interpreter(decode).run(data or b"").runs)
        for t in targets:
            box = None if t["bx"] is None else surgery.Box(t["bx"], t["by"], t["bw"], t["bh"], page_height)
            f = surgery.locate(runs, t["text"] or "", box)
            yield doc, page, t["id"], f.runs, f.confidence, f.reason, len(data or b"")

    return map_rows(wanted.join(rows.select("doc_id", "page_number", *columns), ["doc_id", "page_number"], "left"), each, FOUND)


def gated(found: DataFrame, gate: float = surgery.GATE) -> DataFrame:
    """Located targets that are sure enough to be edited."""
    return found.filter(F.col("confidence") >= gate)

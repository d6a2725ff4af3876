"""Operator 5: nearest neighbours by vantage-point trees, one per shard.

Largest inner product becomes least distance by one more coordinate, sqrt(M^2 - |x|^2), with one M
for all rows. A tree node holds a vantage point and the median distance of its rows to it; a
query skips the side where its distance to the shell, times ``factor``, exceeds its k-th distance
so far. Factor one is exact; larger factors prune more. Unless it is given, the factor is the
boldest of a few that keeps a recall of 0.95 on a bounded sample of the queries, which are
compared with all rows.

The top levels of a tree over a bounded sample deal rows to shards, so a shard's rows lie
together. Each shard's tree is built once and written. A query first searches its home shard,
takes its k-th distance along, and visits only the shards that the triangle inequality, with the
factor, admits.

Scale: the router's size is bounded by the sample; a shard that is too large is cut into parts by
a hash of the id; queries are cut into blocks, so a part that many queries visit spreads over
tasks. Of equal vectors only the smallest k + 1 ids can be among the k nearest, and no others go
on, cut per task before the shuffle. The work is that of the distances that are not pruned: where
vectors lie in clusters it is a small share of rows x queries, where they are spread evenly over
a sphere (as in random data) hardly anything can be pruned at a high recall.

Edge cases: vectors that are null, zero, or hold a null or non-finite component take no part;
vectors of different lengths are never compared; repeated ids are separate candidates; equal
products go to the smaller id; fewer candidates than k give all of them; extra columns are
ignored; empty tables give no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import bounded_batches, sampled, scratch, table

K = 20
SHARD_ROWS, BLOCK_ROWS, LEAF = 8192, 4096, 64
SAMPLE = 4096  # bound on the rows from which the router is built
SAMPLE_LEAF = 8  # sampled rows that a shard has at least
TRIED = 6  # rows of which a vantage point is chosen
SLACK = 4  # candidates beyond k that are compared by the exact product
#: Pruning factors that are tried, from the boldest; the first that keeps ``RECALL`` on ``TUNE_QUERIES`` queries is taken.
FACTORS, RECALL, TUNE_QUERIES = (8.0, 7.0, 6.0, 5.0, 4.0, 3.0, 2.0, 1.5, 1.0), 0.95, 128
NEAR = 1e-9


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T, 0))


def raised(x: np.ndarray, norm: float) -> np.ndarray:
    """Rows with the coordinate that gives all of them one norm."""
    return np.column_stack([x, np.sqrt(np.maximum(norm**2 - (x**2).sum(axis=1), 0))])


class Tree:
    """Vantage-point tree over ``points``. Leaves are arrays of rows.

    An inner node is (vantage, least, shell, most, inner, outer): the vantage row, the least,
    median and greatest distance of its rows to it, and the two sides.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF, seed: int = 0) -> None:
        self.points, self.leaf, self.rng = points, leaf, np.random.default_rng(seed)
        self.root = self._build(np.arange(len(points)))
        self.computed = 0

    def _vantage(self, rows: np.ndarray) -> int:
        """Of a few rows the one whose distances to some others vary most."""
        few = self.rng.choice(rows, min(TRIED, len(rows)), replace=False)
        some = self.rng.choice(rows, min(16 * TRIED, len(rows)), replace=False)
        return int(few[_distance(self.points[few], self.points[some]).var(axis=1).argmax()])

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        vantage = self._vantage(rows)
        d = _distance(self.points[[vantage]], self.points[rows])[0]
        shell = float(np.median(d))
        inner = d <= shell
        if inner.all() or not inner.any():
            return rows
        return vantage, float(d.min()), shell, float(d.max()), self._build(rows[inner]), self._build(rows[~inner])

    def search(self, queries: np.ndarray, k: int, factor: float | np.ndarray = 1.0, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(rows, distances) of the k nearest of each query, -1 and inf where there are fewer.

        ``reach`` is a distance beyond which a query wants nothing.
        """
        near, who = np.full((len(queries), k), np.inf), np.full((len(queries), k), -1, dtype=np.int64)
        reach = np.full(len(queries), np.inf) if reach is None else reach
        bold = np.broadcast_to(factor, len(queries))

        def visit(node, active: np.ndarray) -> None:
            if not len(active):
                return
            if isinstance(node, np.ndarray):
                d = _distance(queries[active], self.points[node])
                self.computed += d.size
                # equal distances stay for the exact comparison: all of a leaf that is no further than the k-th
                better = (d <= np.minimum(near[active, -1], reach[active])[:, None] + NEAR).any(axis=1)
                active, d = active[better], d[better]
                if len(active):
                    both = np.concatenate([near[active], d], axis=1)
                    names = np.concatenate([who[active], np.broadcast_to(node, (len(active), len(node)))], axis=1)
                    best = np.lexsort((names, both), axis=1)[:, :k]
                    near[active] = np.take_along_axis(both, best, axis=1)
                    who[active] = np.take_along_axis(names, best, axis=1)
                return
            vantage, least, shell, most, inner, outer = node
            d = _distance(queries[active], self.points[[vantage]])[:, 0]
            self.computed += len(active)
            # by the triangle inequality no row of a side is nearer than this
            bounds = {id(inner): np.maximum(d - shell, least - d) * bold[active], id(outer): np.maximum(shell - d, d - most) * bold[active]}
            for first, then, side in ((inner, outer, d <= shell), (outer, inner, d > shell)):
                mine = active[side]
                for child in (first, then):
                    limit = np.minimum(near[mine, -1], reach[mine])
                    visit(child, mine[bounds[id(child)][side] <= limit + NEAR])

        visit(self.root, np.arange(len(queries)))
        return who, near


class Router:
    """Top levels of a vantage-point tree over sampled rows; its leaves are the shards."""

    def __init__(self, points: np.ndarray, shards: int) -> None:
        self.tree = Tree(points, leaf=max(SAMPLE_LEAF, -(-len(points) // max(shards, 1))))
        self.shards = 0
        self.root = self._numbered(self.tree.root)

    def _numbered(self, node):
        if isinstance(node, np.ndarray):
            self.shards += 1
            return self.shards - 1
        vantage, _, shell, _, inner, outer = node
        return vantage, shell, self._numbered(inner), self._numbered(outer)

    def home(self, x: np.ndarray) -> np.ndarray:
        """Shard of each row."""
        out = np.zeros(len(x), dtype=np.int64)

        def visit(node, rows: np.ndarray) -> None:
            if isinstance(node, int):
                out[rows] = node
            elif len(rows):
                vantage, shell, inner, outer = node
                within = _distance(x[rows], self.tree.points[[vantage]])[:, 0] <= shell
                visit(inner, rows[within])
                visit(outer, rows[~within])

        visit(self.root, np.arange(len(x)))
        return out

    def admitted(self, x: np.ndarray, reach: np.ndarray, factor: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, positions of the queries that it could serve)."""

        def visit(node, rows: np.ndarray):
            if isinstance(node, int):
                yield node, rows
            elif len(rows):
                vantage, shell, inner, outer = node
                gap = (_distance(x[rows], self.tree.points[[vantage]])[:, 0] - shell) * factor[rows]
                yield from visit(inner, rows[gap <= reach[rows] + NEAR])
                yield from visit(outer, rows[-gap <= reach[rows] + NEAR])

        yield from visit(self.root, np.arange(len(x)))


def _usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    x = F.col(vector).cast("array<double>")
    sound = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    return df.select(F.col(key).cast("long").alias("id"), x.alias("x")).filter(F.col("id").isNotNull() & F.col("x").isNotNull()).filter(sound)


def _by_length(frame: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, positions, matrix) of the vectors of a frame."""
    lengths = frame["x"].map(len).to_numpy(dtype=np.int64)
    for size in np.unique(lengths):
        at = np.flatnonzero(lengths == size)
        yield int(size), at, np.stack(frame["x"].iloc[at].tolist()).astype(float)


def _parts(column, sizes: dict[tuple, int]):
    """Number of parts of a shard, as a column."""
    many = {f"{s[0]}:{s[1]}": n for s, n in sizes.items() if n > 1}
    if not many:
        return F.lit(1)
    spec = F.create_map(*[F.lit(x) for kv in many.items() for x in kv])
    return F.coalesce(F.try_element_at(spec, column), F.lit(1))


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices, each added up from the first component to the last."""
    return np.add.accumulate(a * b, axis=1)[:, -1]


HIT = "query_id long, factor double, id long, score double"


def nearest(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int = K, factor: float | None = None, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, count_work: bool = False) -> DataFrame:
    """query_id, rank, id, score: the k rows of largest inner product other than the query's own id.

    Without a ``factor`` one is chosen, see above.

    With ``count_work`` the hits also have ``work``: the distances that their query's task computed, on its first row.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    same = F.row_number().over(Window.partitionBy("x").orderBy("id"))
    rows = scratch(_usable(rows, key, vector).withColumn("r", same).filter(F.col("r") <= k + 1).drop("r"), "vectors")
    queries = _usable(queries, key, vector)
    stats = rows.select(F.size("x").alias("n"), F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v).alias("s")).groupBy("n").agg(F.count(F.lit(1)).alias("count"), F.max("s").alias("s")).collect()
    if not stats:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    total = sum(r["count"] for r in stats)
    norm = float(np.sqrt(max(r["s"] for r in stats))) * (1 + 1e-12)
    taken: dict[int, list] = {}
    for r in sampled(rows, "id", total, SAMPLE).limit(2 * SAMPLE).collect():
        taken.setdefault(len(r["x"]), []).append(r["x"])
    shards = {r["n"]: -(-r["count"] // shard_rows) for r in stats}
    routers = spark.sparkContext.broadcast((norm, {n: Router(raised(np.array(x), norm), shards[n]) for n, x in taken.items() if n in shards}))

    def routed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        norm, known = routers.value
        for frame in frames:
            home = np.empty(len(frame), dtype=object)
            for size, at, x in _by_length(frame):
                own = known[size].home(raised(x, norm)) if size in known else np.zeros(len(at), dtype=np.int64)
                home[at] = [f"{size}:{s}" for s in own]
            yield frame.assign(home=home)

    dealt = scratch(rows.mapInPandas(routed, "id long, x array<double>, home string"), "routed")
    held = dealt.groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect()
    parts = {tuple(map(int, r["home"].split(":"))): -(-r["n"] // shard_rows) for r in held}

    def built(frame: pd.DataFrame) -> pd.DataFrame:
        norm, _ = routers.value
        x, ids = np.stack(frame["x"].tolist()).astype(float), frame["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        x, ids = x[order], ids[order]
        _, rep, name = np.unique(x.view(f"V{x.itemsize * x.shape[1]}").ravel(), return_index=True, return_inverse=True)
        by_id = np.argsort(rep)  # distinct vectors in order of their least id, so that ties by row are ties by id
        place = np.empty(len(rep), dtype=np.int64)
        place[by_id] = np.arange(len(rep))
        name = place[name]
        members = np.argsort(name, kind="stable")
        tree = Tree(raised(x[rep[by_id]], norm))
        state = pickle.dumps((x[rep[by_id]], ids[members], np.searchsorted(name[members], np.arange(len(rep) + 1)), tree.root))
        return pd.DataFrame({"home": [frame["home"].iloc[0]], "part": [frame["part"].iloc[0]], "tree": [state]})

    part = lambda c: F.pmod(F.xxhash64(F.col(c)), _parts(F.col("home"), parts)).cast("int")
    trees = scratch(dealt.withColumn("part", part("id")).groupBy("home", "part").applyInPandas(built, "home string, part int, tree binary"), "trees")

    def found(asked: DataFrame) -> DataFrame:
        """Hits of queries (id, x, factor, home, part, reach) in the trees of their shards."""
        asked = scratch(asked.select("id", "x", "factor", "home", "part", "reach"), "asked")
        blocks = asked.groupBy("home", "part").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
        blocks = F.broadcast(blocks) if sum(parts.values()) < 100_000 else blocks
        left = trees.join(blocks, ["home", "part"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        right = asked.join(blocks, ["home", "part"]).withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int")).drop("blocks")
        return left.groupBy("home", "part", "block").cogroup(right.groupBy("home", "part", "block")).applyInPandas(searched, HIT + ", work long")

    def searched(tree: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        kinds = {"query_id": "int64", "factor": "float64", "id": "int64", "score": "float64", "work": "int64"}
        if not len(tree) or not len(block):
            return pd.DataFrame(columns=list(kinds)).astype(kinds)
        norm, _ = routers.value
        points, ids, begins, root = pickle.loads(tree["tree"].iloc[0])
        t = Tree.__new__(Tree)
        t.points, t.root, t.computed = raised(points, norm), root, 0
        q, q_ids = np.stack(block["x"].tolist()).astype(float), block["id"].to_numpy()
        reach, bold = block["reach"].to_numpy(dtype=float), block["factor"].to_numpy(dtype=float)
        who, _ = t.search(np.column_stack([q, np.zeros(len(q))]), min(k + 1 + SLACK, len(points)), bold, reach)
        at, column = np.nonzero(who >= 0)
        hit = who[at, column]
        score = dot(points[hit], q[at])
        n = begins[hit + 1] - begins[hit]
        at, score = np.repeat(at, n), np.repeat(score, n)
        own = ids[np.repeat(begins[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        other = own != q_ids[at]
        at, score, own = at[other], score[other], own[other]
        order = np.lexsort((own, -score, at))
        at, score, own = at[order], score[order], own[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, dtype=np.int64)
        top = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)])) < k
        out = pd.DataFrame({"query_id": q_ids[at[top]], "factor": bold[at[top]], "id": own[top], "score": score[top], "work": 0}).astype(kinds)
        if len(out):
            out.iloc[0, 4] = t.computed
        return out

    def elsewhere(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        norm, known = routers.value
        for frame in frames:
            for size, at, x in _by_length(frame):
                lifted, far, bold = np.column_stack([x, np.zeros(len(x))]), frame["reach"].to_numpy(dtype=float)[at], frame["factor"].to_numpy(dtype=float)[at]
                for shard, some in known[size].admitted(lifted, far, bold) if size in known else [(0, np.arange(len(at)))]:
                    if len(some) and (size, shard) in parts:
                        yield frame.iloc[at[some]].assign(home=f"{size}:{shard}", parts=parts[size, shard])

    def both_rounds(asked: DataFrame) -> DataFrame:
        """Hits of queries (id, x, factor): in their home shards, then wherever something nearer may be."""
        asked = asked.mapInPandas(routed, "id long, x array<double>, factor double, home string").withColumn("part", part("id")).withColumn("reach", F.lit(float("inf")))
        asked = scratch(asked, "queries")
        first = scratch(found(asked), "home-hits")
        # a query's k-th product so far gives the distance beyond which nothing helps it
        last = first.groupBy(F.col("query_id").alias("id"), "factor").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth"))
        squared = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
        reach = F.when(F.col("n") >= k, F.sqrt(F.greatest(squared + norm**2 - 2 * F.col("kth"), F.lit(0.0)))).otherwise(float("inf"))
        onward = asked.drop("reach").join(last, ["id", "factor"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
        onward = onward.select("id", "x", "factor", F.col("home").alias("own_home"), F.col("part").alias("own_part"), reach.alias("reach"))
        visits = onward.mapInPandas(elsewhere, "id long, x array<double>, factor double, own_home string, own_part int, reach double, home string, parts int")
        visits = visits.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter("home <> own_home or part <> own_part")
        hits = first.unionByName(found(visits))
        rank = F.row_number().over(Window.partitionBy("query_id", "factor").orderBy(F.desc("score"), "id"))
        return hits.withColumn("rank", rank)

    if factor is None:
        factor = _tuned(rows, sampled(queries, "id", queries.count(), TUNE_QUERIES), k, both_rounds)
    hits = both_rounds(queries.select("id", "x", F.lit(float(factor)).alias("factor")))
    columns = ["query_id", "rank", "id", "score"]
    return hits.select(*columns, "work", "factor") if count_work else hits.filter(F.col("rank") <= k).select(*columns)


def _tuned(rows: DataFrame, some: DataFrame, k: int, search) -> float:
    """The boldest factor whose search keeps the recall on some queries, which are compared with all rows."""
    some = scratch(some.select("id", "x"), "tuning")
    asked = some.limit(4 * TUNE_QUERIES).collect()
    if not asked:
        return 1.0
    shared = rows.sparkSession.sparkContext.broadcast([(r["id"], np.array(r["x"])) for r in asked])

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for frame in frames:
            for size, at, x in _by_length(frame):
                ids = frame["id"].to_numpy()[at]
                for n, (q_id, q) in enumerate(shared.value):
                    if len(q) == size:
                        own = ids != q_id
                        score, who = (x @ q)[own], ids[own]
                        if n in top:
                            score, who = np.r_[top[n][0], score], np.r_[top[n][1], who]
                        order = np.lexsort((who, -score))[:k]
                        top[n] = score[order], who[order]
        for n, (score, who) in top.items():
            yield pd.DataFrame({"query_id": shared.value[n][0], "id": who, "score": score})

    truth = rows.mapInPandas(best, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    truth = scratch(truth.withColumn("r", rank).filter(F.col("r") <= k).select("query_id", "id"), "truth")
    total = truth.count()
    tried = search(some.select("id", "x", F.explode(F.array(*map(F.lit, FACTORS))).alias("factor"))).filter(F.col("rank") <= k)
    caught = {r["factor"]: r["n"] for r in tried.join(truth, ["query_id", "id"]).groupBy("factor").agg(F.count(F.lit(1)).alias("n")).collect()}
    return next((f for f in FACTORS if caught.get(f, 0) >= RECALL * total), 1.0)


def op5_vp_tree_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose vec_id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings")
    found = nearest(rows, rows.filter(F.col("vec_id") % 20 == 0), "vec_id", "embedding")
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def exact_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same at factor one, which searches exactly."""
    rows = table(spark, sf_dir, "embeddings")
    found = nearest(rows, rows.filter(F.col("vec_id") % 20 == 0), "vec_id", "embedding", factor=1.0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def sql() -> str:
    """All products of queries and rows in DuckDB, added up from the first component to the last."""
    return f"""WITH X AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
S AS (SELECT q.vec_id AS query_id, r.vec_id, list_reduce(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * r.x[i]), lambda a, b: a + b) AS score FROM X q JOIN X r ON q.vec_id <> r.vec_id AND len(q.x) = len(r.x) WHERE q.vec_id % 20 = 0),
K AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM S)
SELECT query_id, rank, vec_id, score FROM K WHERE rank <= {K}"""

"""Approximate nearest neighbours by low-dimensional stable projections in a kd-tree.

Vectors are projected to ``m`` dimensions with a Gaussian (2-stable) matrix: the squared
projected distance of a point at distance d is d^2 times a chi-square variable with m degrees
of freedom. A query takes points in the order of their projected distance, leaf by leaf of a
kd-tree, and verifies each on the original vectors. It stops when a point nearer than its
k-th best would by now have been met with probability ``p``: when the chi-square distribution
function of (next projected distance / k-th distance)^2 reaches p.

Nearness is the largest inner product: with one more component that fills each vector up to
the largest norm, that is the smallest Euclidean distance, so vectors need not be normalised.

The tree's upper levels are cells fitted on a bounded sample of projected points; every row is
in the index. A query first searches its own cell, and with the k-th distance found there goes
on to just the cells that the same test cannot rule out. A cell's points are copied once per
``QUERY_CHUNK`` queries that come to that cell, and points of a cell without queries not at
all. Equal vectors are one class in the index.

Defined results: vectors that are null, zero, or hold null or non-finite components, that
have a null vec_id, or whose length is not the most frequent one, take no part; a query with
fewer candidates than ``k`` gets all of them; ties go to the smaller vec_id; repeated rows
with one vec_id count as one vector if they are equal, and as several, each with results of its
own as a query, if they differ; an empty table gives an empty result.
"""

from __future__ import annotations

from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table
from .vectors import MOST_CELLS, box_gap2, cell_of, kd_tree, marked, matrix, sample_points

#: Projected dimensions and the probability of the stopping test: on the given tables 0.95 of the nearest are found, and 55 to 70 % of the
#: candidates verified (8 and 0.98: 0.98 and 80 to 85 %).
M = 16
P = 0.95
SEED = 20
#: Classes that a cell holds on average (more than twice as many are split), and a leaf in it.
CELL = 4_096
LEAF = 64
#: Queries that meet a tile in one group.
QUERY_CHUNK = 8_192


def chi2_cdf(x: np.ndarray, m: int) -> np.ndarray:
    """Distribution function of chi-square with an even number m of degrees of freedom."""
    h = np.minimum(np.asarray(x, np.float64) / 2, 700.0)
    return 1 - np.exp(-h) * sum(h**i / factorial(i) for i in range(m // 2))


def chi2_quantile(p: float, m: int) -> float:
    """Where the distribution function reaches p, by bisection."""
    low, high = 0.0, 1400.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (low, mid) if chi2_cdf(np.array(mid), m) >= p else (mid, high)
    return high


def ruled_out(gap2: np.ndarray, best2: np.ndarray | float, reach: float) -> np.ndarray:
    """Whether the stopping test holds for a projected distance and a k-th distance (both squared).

    ``reach`` is the quantile of p, so this is: distribution function of the ratio >= p. With
    a k-th distance of 0 only points at a projected distance of 0 are still open.
    """
    return (gap2 >= reach * best2) & (gap2 > 0)


class Leaves:
    """A kd-tree over projected points: leaves are runs of a permutation, with boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        runs, todo = [], [np.arange(len(points))]
        while todo:
            own = todo.pop()
            if len(own) <= leaf:
                runs.append(own)
                continue
            d = int(np.argmax(np.ptp(points[own], axis=0)))
            half = len(own) // 2
            order = own[np.argpartition(points[own, d], half)]
            todo += [order[:half], order[half:]]
        self.order = np.concatenate(runs)
        self.leaf_of = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
        self.low = np.array([points[r].min(axis=0) for r in runs])
        self.high = np.array([points[r].max(axis=0) for r in runs])


def search(x: np.ndarray, ids: np.ndarray, px: np.ndarray, q: np.ndarray, pq: np.ndarray, best2: np.ndarray, most2: float, k: int, reach: float):
    """For each query the k best (position, score) of x; ``best2`` is a k-th distance known before, or infinity.

    Leaves come in the order of their distance, 8 first, then twice as many at a time; those
    that the test rules out by then, and all behind them, are never looked at. Of the others'
    points those are verified that the test, for their own projected distance, leaves open.
    """
    tree = Leaves(px)
    x, ids, px = x[tree.order], ids[tree.order], px[tree.order]
    gaps = box_gap2(pq, pq, tree.low, tree.high)
    orders = np.argsort(gaps, axis=1, kind="stable")
    for at in range(len(q)):
        order = orders[at]
        gap, own, limit = gaps[at][order], float(q[at] @ q[at]), float(best2[at])
        found_i, found_s, n, step = np.zeros(0, np.int64), np.zeros(0), 0, 8
        while True:
            stop = len(gap) if limit == np.inf else max(int(np.searchsorted(gap, reach * limit)), int(np.searchsorted(gap, 0.0, side="right")))
            if n >= stop:
                break
            chosen = np.zeros(len(order), bool)
            chosen[order[n : min(n + step, stop)]] = True
            i = np.flatnonzero(chosen[tree.leaf_of])
            if limit < np.inf:
                i = i[~ruled_out(((px[i] - pq[at]) ** 2).sum(axis=1), limit, reach)]
            s = x[i] @ q[at]
            if len(found_s) == k:  # only what reaches the k-th score can enter
                enter = s >= found_s[-1]
                i, s = i[enter], s[enter]
            elif len(s) > 4 * k:
                enter = s >= np.partition(s, len(s) - k)[len(s) - k]
                i, s = i[enter], s[enter]
            i, s = np.concatenate((found_i, i)), np.concatenate((found_s, s))
            top = np.lexsort((ids[i], -s))[:k]
            found_i, found_s = i[top], s[top]
            if len(top) == k:
                limit = min(limit, max(0.0, most2 + own - 2 * float(found_s[-1])))
            n, step = n + step, step * 2
        yield tree.order[found_i], found_s


def nearest(vectors: DataFrame, is_query: F.Column | None = None, k: int = 20, m: int = M, p: float = P) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k vectors of largest inner product found for each query.

    ``is_query`` (a condition on vec_id) picks the queries; by default vec_id is divisible by 20.
    """
    spark = vectors.sparkSession
    is_query = is_query if is_query is not None else F.pmod("vec_id", F.lit(20)) == 0
    rows = cut(marked(vectors).where("fine").select("vec_id", "v").distinct())
    most = k + 1  # a query's own id may be among them
    # The smallest ids of each class: limited per hash first, so that a class of millions is never in one task.
    by_hash = Window.partitionBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(32))).orderBy("vec_id")
    few = rows.withColumn("r", F.row_number().over(by_hash)).where(F.col("r") <= most)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= most)
    asked = rows.where(is_query).select("vec_id", "v")
    members = few.groupBy("v").agg(F.min("vec_id").alias("id"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = cut(members.join(asked.select("v").distinct().withColumn("asked", F.lit(True)), "v", "left").withColumn("asked", F.coalesce("asked", F.lit(False))))
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    n, most2 = classes.agg(F.count("*"), F.max(norm2)).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = len(classes.select("v").first()["v"])
    reach = chi2_quantile(p, m)
    stable = np.random.default_rng(SEED).standard_normal((d + 1, m))

    def project(x: np.ndarray, fill: bool) -> np.ndarray:
        more = np.sqrt(np.maximum(0.0, most2 - (x * x).sum(axis=1))) if fill else np.zeros(len(x))
        return x @ stable[:d] + more[:, None] * stable[d]

    sample = sample_points(classes, n, lambda x: project(x, True))
    tree = kd_tree(sample, min(n / CELL, MOST_CELLS, len(sample) / 8))
    kind = classes.schema["v"].dataType.simpleString()

    def place(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            x = matrix(batch.column(1))
            if len(x):
                px = project(x, True)
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(cell_of(px, tree).astype(np.int32)), pa.FixedSizeListArray.from_arrays(pa.array(px.ravel()), m).cast(pa.list_(pa.float64()))], names=["id", "v", "cell", "px"])

    points = cut(classes.select("id", "v").mapInArrow(place, f"id long, v {kind}, cell int, px array<double>"))
    ends = [f(F.col("px")[j]).alias(f"{s}{j}") for j in range(m) for f, s in ((F.min, "lo"), (F.max, "hi"))]
    cells = points.groupBy("cell").agg(F.count("*").alias("n"), *ends).orderBy("cell").collect()  # at most MOST_CELLS rows
    numbers = np.array([r["cell"] for r in cells], np.int32)
    low, high = (np.array([[r[f"{s}{j}"] for j in range(m)] for r in cells]) for s in ("lo", "hi"))
    parts = F.broadcast(spark.createDataFrame([(int(r["cell"]), max(1, round(r["n"] / CELL)) if r["n"] > 2 * CELL else 1) for r in cells], "cell int, parts int"))  # MOST_CELLS rows
    dealt = points.join(parts, "cell").select("cell", F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts")).cast("int").alias("part"), "id", "v")

    def route(first: bool):  # noqa: ANN202
        def run(batches):  # noqa: ANN001, ANN202
            for whole in batches:
                for start in range(0, whole.num_rows, 256):  # rows x cells stays small
                    batch = whole.slice(start, 256)
                    x = matrix(batch.column(1))
                    gap = box_gap2(*(2 * [project(x, False)]), low, high)
                    home = gap.argmin(axis=1)
                    if first:
                        to = np.zeros_like(gap, bool)
                        to[np.arange(len(x)), home] = True
                        best2 = np.full(len(x), np.inf)
                    else:
                        best2 = batch.column(2).to_numpy(zero_copy_only=False)
                        to = ~ruled_out(gap, best2[:, None], reach)
                        to[np.arange(len(x)), home] = False
                    i, c = np.nonzero(to)
                    for at in range(0, len(i), 4096):  # a query may go to many cells: small results
                        j = pa.array(i[at : at + 4096])
                        yield pa.record_batch([batch.column(0).take(j), batch.column(1).take(j), pa.array(numbers[c[at : at + 4096]]), pa.array(best2[i[at : at + 4096]])], names=["id", "v", "cell", "best2"])

        return run

    def visit(points_: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if points_.num_rows and queries.num_rows:
            x, q = matrix(points_.column("v")), matrix(queries.column("v"))
            ids, asking = points_.column("id").to_numpy(), queries.column("id").to_numpy()
            best2 = queries.column("best2").to_numpy()
            for at, (i, s) in enumerate(search(x, ids, project(x, True), q, project(q, False), best2, most2, most, reach)):
                out.append((np.full(len(i), asking[at]), ids[i], s))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(c) for c in cols], names=["asking", "id", "score"])

    def visited(queries: DataFrame) -> DataFrame:
        queries = cut(queries)
        chunks = F.broadcast(queries.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_CHUNK).cast("int").alias("chunks")))  # MOST_CELLS rows
        asked_ = queries.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(chunks, "cell")
        asked_ = asked_.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(9)), F.col("chunks")).cast("int"))
        held = dealt.join(chunks, "cell").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("cell", "part", "chunk", "id", "v")
        return held.groupBy("cell", "part", "chunk").cogroup(asked_.select("cell", "part", "chunk", "id", "v", "best2").groupBy("cell", "part", "chunk")).applyInArrow(visit, "asking long, id long, score double")

    asking = classes.where("asked").select("id", "v")
    routed = f"id long, v {kind}, cell int, best2 double"
    home = cut(visited(asking.mapInArrow(route(True), routed)))
    order = Window.partitionBy("asking").orderBy(F.desc("score"), "id")
    kth = home.withColumn("r", F.row_number().over(order)).where(F.col("r") == most).select(F.col("asking").alias("id"), F.col("score").alias("kth"))
    bound = F.greatest(F.lit(0.0), F.lit(float(most2)) + norm2 - 2 * F.col("kth"))
    second = asking.join(kth, "id", "left").select("id", "v", F.coalesce(bound, F.lit(float("inf"))).alias("best2"))
    away = visited(second.mapInArrow(route(False), routed))
    best = home.unionByName(away).withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    full = best.join(classes.select("id", "ids"), "id").select("asking", F.explode("ids").alias("vec_id"), "score")
    # The k + 1 best of a class, nearest first; each query of the class leaves itself out.
    ranked = full.withColumn("r", F.row_number().over(Window.partitionBy("asking").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= most)
    lists = ranked.groupBy("asking").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("best"))
    per_query = asked.join(classes.where("asked").select("v", F.col("id").alias("asking")), "v").join(lists, "asking")
    chosen = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("vec_id")), 1, k)
    out = per_query.select(F.col("vec_id").alias("query_id"), F.posexplode(chosen).alias("pos", "b"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the 20 nearest found for every vector whose id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"))

"""Near-duplicate embeddings by a PCA-ordered tiled comparison.

Vectors are turned so that the leading dimensions carry the most variance. Two vectors are
linked when their cosine is at least ``threshold``. A pair first gets the product of its
leading dimensions; what the others can add is at most the product of the two suffix norms
(Cauchy-Schwarz). When the sum cannot reach the threshold the pair is done; what is left
after the last step gets the cosine of the original vectors in double precision.

Equal vectors become one weighted class. Classes are dealt into tiles by the cells of a
kd-tree over the leading dimensions; each pair of tiles whose boxes come near enough is one
group of bounded size. A group returns link counts and a spanning forest, never its pairs.

Defined results: vectors that are null, zero, or hold null or non-finite components, that
have a null vec_id, or whose length is not the most frequent one, link with nothing (no
links, own component, kept); repeated rows with one vec_id count as vectors of their own; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, cut, merge_labels, table
from .vectors import MOST_CELLS, box_gap2, cell_of, kd_tree, marked, matrix, sample_matrix, sample_points, scaled

#: Classes that a tile holds on average; a cell of more than twice as many is split by a hash.
TILE = 6_144
#: Leading dimensions after which a pair is tested, and those of the cells.
STEPS = (8, 16, 32)
BOX = 8
_SLACK = 1e-4  # single precision of the bounds; links themselves are decided in double precision


def rotation(sample: np.ndarray) -> np.ndarray:
    """Orthonormal columns, most variance first, of unit vectors."""
    sample = scaled(sample)
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    values, vectors = np.linalg.eigh(unit.T @ unit)
    return vectors[:, np.argsort(-values, kind="stable")]


def _suffix(turned: np.ndarray, k: int) -> np.ndarray:
    return np.sqrt((turned[:, k:].astype(np.float64) ** 2).sum(axis=1)).astype(np.float32)


def tile_links(a: np.ndarray, b: np.ndarray | None, turn: np.ndarray, threshold: float, block: int = 1024):
    """Yield position pairs (i, j) with cosine >= threshold between rows of a and b; with b None, i < j within a."""
    a, b = scaled(a), None if b is None else scaled(b)
    unit_a = a / np.linalg.norm(a, axis=1, keepdims=True)
    unit_b = unit_a if b is None else b / np.linalg.norm(b, axis=1, keepdims=True)
    d = a.shape[1]
    ta, tb = (unit_a @ turn).astype(np.float32), (unit_b @ turn).astype(np.float32)
    steps = [k for k in STEPS if k < d] or [d]
    sa, sb = {k: _suffix(ta, k) for k in steps}, {k: _suffix(tb, k) for k in steps}
    norm_a, own_b = np.linalg.norm(a, axis=1), a if b is None else b
    norm_b = np.linalg.norm(own_b, axis=1)
    reach = np.float32(threshold - _SLACK)
    for x in range(0, len(ta), block):
        ax, wide = ta[x : x + block], steps[0]
        for y in range(x if b is None else 0, len(tb), block):
            by = tb[y : y + block]
            bound = ax[:, :wide] @ by[:, :wide].T
            bound += sa[wide][x : x + block, None] * sb[wide][None, y : y + block]
            i, j = np.nonzero(bound >= reach)
            if b is None and x == y:
                i, j = i[i < j], j[i < j]
            for at in range(0, len(i), 1 << 16):  # survivors in slices: memory stays even where all are alike
                p, q = i[at : at + (1 << 16)] + x, j[at : at + (1 << 16)] + y
                done, part = wide, np.einsum("nk,nk->n", ta[p, :wide], tb[q, :wide])
                for k in steps[1:]:
                    part = part + np.einsum("nk,nk->n", ta[p, done:k], tb[q, done:k])
                    open_ = part + sa[k][p] * sb[k][q] >= reach
                    p, q, part, done = p[open_], q[open_], part[open_], k
                cosine = np.einsum("nk,nk->n", a[p], own_b[q]) / (norm_a[p] * norm_b[q])
                fine = cosine >= threshold
                yield p[fine], q[fine]


def near_vectors(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``vectors(vec_id, embedding)``."""
    spark = vectors.sparkSession
    rows = marked(vectors)
    classes = cut(rows.where("fine").groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("w")))
    n = classes.count()
    alone = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not n:
        return alone
    sample = sample_matrix(classes, n)
    turn = rotation(sample)
    box = min(BOX, turn.shape[1])

    def leading(x: np.ndarray) -> np.ndarray:
        x = scaled(x)
        return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ turn[:, :box]

    points = sample_points(classes, n, leading)
    tree = kd_tree(points, min(n / TILE, MOST_CELLS, len(points) / 8))

    def place(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            x = matrix(batch.column(2))
            if not len(x):
                continue
            lead = leading(x)
            yield pa.record_batch([*batch.columns, pa.array(cell_of(lead, tree).astype(np.int32)), pa.FixedSizeListArray.from_arrays(pa.array(lead.ravel()), box).cast(pa.list_(pa.float64()))], names=["id", "w", "v", "cell", "lead"])

    kind = classes.schema["v"].dataType.simpleString()
    placed = classes.select("id", "w", "v").mapInArrow(place, f"id long, w long, v {kind}, cell int, lead array<double>")
    ends = [f(F.col("lead")[k]).alias(f"{s}{k}") for k in range(box) for f, s in ((F.min, "lo"), (F.max, "hi"))]
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), *ends).orderBy("cell").collect()  # at most MOST_CELLS rows
    low, high = (np.array([[r[f"{s}{k}"] for k in range(box)] for r in cells]) for s in ("lo", "hi"))
    parts = [max(1, round(r["n"] / TILE)) if r["n"] > 2 * TILE else 1 for r in cells]
    numbers = np.array([r["cell"] for r in cells], np.int32)
    tiles = spark.createDataFrame([(int(c), p) for c, p in zip(numbers, parts)], "cell int, parts int")

    def near(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            own = np.searchsorted(numbers, batch.column(0).to_numpy())
            for at in range(0, len(own), 64):  # cells x cells in slices
                some = own[at : at + 64]
                i, j = np.nonzero(box_gap2(low[some], high[some], low, high) <= 2 - 2 * threshold + _SLACK)
                yield pa.record_batch([pa.array(numbers[some[i]]), pa.array(numbers[j])], names=["cell", "other"])

    beside = tiles.repartition(max(1, len(cells) // 256)).select("cell").mapInArrow(near, "cell int, other int")
    tiles = tiles.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = (
        tiles.join(beside, "cell").select(F.struct("cell", "part").alias("lo"), "other")
        .join(tiles.select(F.col("cell").alias("other"), F.col("part").alias("other_part")), "other")
        .select("lo", F.struct(F.col("other").alias("cell"), F.col("other_part").alias("part")).alias("hi")).where("lo <= hi")
    )
    dealt = placed.join(tiles.groupBy("cell").agg(F.count("*").alias("parts")), "cell")
    dealt = dealt.select("id", "w", "v", F.struct("cell", F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts")).cast("int").alias("part")).alias("tile"))
    left = dealt.join(pairs, dealt.tile == pairs.lo).select("lo", "hi", F.lit(0).alias("side"), "id", "w", "v")
    right = dealt.join(pairs.where("lo < hi"), F.col("tile") == F.col("hi")).select("lo", "hi", F.lit(1).alias("side"), "id", "w", "v")

    def compare(t: pa.Table) -> pa.Table:
        side, ids, w = (t.column(c).to_numpy() for c in ("side", "id", "w"))
        order = np.argsort(side, kind="stable")
        ids, w, x = ids[order], w[order].astype(np.int64), matrix(t.column("v"))[order]
        split = int((side == 0).sum())
        within = split == len(ids)
        links, labels, held, many = np.zeros(len(ids), np.int64), np.arange(len(ids)), [], 0
        for i, j in tile_links(x[:split], None if within else x[split:], turn, threshold):
            j = j if within else j + split
            np.add.at(links, i, w[j])
            np.add.at(links, j, w[i])
            held.append((i, j))
            many += len(i)
            if many > 1 << 20:
                labels, held, many = merge_labels(labels, *map(np.concatenate, zip(*held))), [], 0
        if held:
            labels = merge_labels(labels, *map(np.concatenate, zip(*held)))
        some, child = np.flatnonzero(links), np.flatnonzero(labels != np.arange(len(ids)))
        a = np.concatenate((ids[some], ids[child]))
        b = pa.array(np.concatenate((np.zeros(len(some), np.int64), ids[labels[child]])), mask=np.arange(len(a)) < len(some))
        return pa.table([pa.array(a, pa.int64()), b, pa.array(np.concatenate((links[some], np.zeros(len(child), np.int64))))], names=["a", "b", "n"])

    found = cut(left.unionByName(right).groupBy("lo", "hi").applyInArrow(compare, "a long, b long, n long"))
    components = connected_components(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    done = (
        classes.join(links, "id", "left").join(components, F.col("id") == F.col("node"), "left")
        .select("v", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    out = rows.where("fine").join(done, "v").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return out.unionByName(alone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: links, component and representative of every vector."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS row, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (
  SELECT row, vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(e, lambda c: c <> 0)) > 0
), l AS (SELECT a.row AS a, b.row AS b FROM u a JOIN u b ON a.row <> b.row WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
r(a, b) AS (SELECT row, row FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT r.a AS row, min(vec_id) AS component_id FROM r JOIN v ON v.row = r.b GROUP BY 1)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = v.row) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c USING (row)
"""

"""What the two embedding operators share: usable vectors, samples as matrices, kd-tree cells."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample

#: Vectors that rotations, projections' cells and tiles are fitted on at most.
SAMPLE = 16_384
#: Points of few dimensions that the cells are fitted on at most, and cells at most; beyond, a cell's rows are split by a hash, into parts whose number follows the rows.
CELL_SAMPLE, MOST_CELLS = 131_072, 16_384


def marked(vectors: DataFrame) -> DataFrame:
    """``(vec_id, v, fine)``: ``fine`` if the vector has an id and only finite components, is not zero and has the usual length.

    The usual length is the most frequent one among vectors that pass the other tests.
    """
    element = vectors.schema["embedding"].dataType.elementType.typeName()
    x = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>" if element == "float" else "array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    fine = F.coalesce(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda c: c != 0), F.lit(False))
    x = x.withColumn("fine", fine)
    top = x.where("fine").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return x.withColumn("fine", F.col("fine") & (F.size("v") == (top["d"] if top else 0)))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column without nulls as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that their largest components are 0.5 to 1 in size; digits stay as they are and squares neither vanish nor overflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0, keepdims=True))[1])


def sample_matrix(classes: DataFrame, rows: int, bound: int = SAMPLE) -> np.ndarray:
    """At most ``bound`` vectors of ``classes(id, v)``, the same ones in each run."""
    return matrix(hash_sample(classes, "id", bound, rows).select("v").toArrow().column("v"))


def sample_points(classes: DataFrame, rows: int, to: Callable[[np.ndarray], np.ndarray], bound: int = CELL_SAMPLE) -> np.ndarray:
    """At most ``bound`` vectors of ``classes(id, v)`` as the points of few dimensions that ``to`` makes of them."""

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            x = matrix(batch.column(0))
            if len(x):
                px = to(x)
                yield pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(px.ravel()), px.shape[1]).cast(pa.list_(pa.float64()))], names=["px"])

    return matrix(hash_sample(classes, "id", bound, rows).select("v").mapInArrow(run, "px array<double>").toArrow().column("px"))


def kd_tree(points: np.ndarray, cells: int) -> list[tuple[int, float]]:
    """Median splits of the points, level by level; node k has children 2k+1 and 2k+2, leaves are the cells."""
    depth = max(0, round(np.log2(max(1.0, cells))))
    tree, groups = [], [np.arange(len(points))]
    for _ in range(depth):
        halves = []
        for own in groups:
            d = int(np.argmax(points[own].var(axis=0))) if len(own) else 0
            at = float(np.median(points[own, d])) if len(own) else 0.0
            tree.append((d, at))
            high = points[own, d] > at
            halves += [own[~high], own[high]]
        groups = halves
    return tree


def cell_of(points: np.ndarray, tree: list[tuple[int, float]]) -> np.ndarray:
    """The cell of each point."""
    node = np.zeros(len(points), np.int64)
    if not tree:
        return node
    dims, values = np.array([d for d, _ in tree]), np.array([v for _, v in tree])
    for _ in range(int(np.log2(len(tree) + 1))):
        node = 2 * node + 1 + (points[np.arange(len(points)), dims[node]] > values[node])
    return node - len(tree)


def box_gap2(low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray) -> np.ndarray:
    """Squared distances between boxes (rows x other rows); points are boxes without extent."""
    out = np.zeros((len(low), len(other_low)))
    for d in range(low.shape[1] if low.ndim > 1 else 0):
        gap = np.maximum(0.0, np.maximum(low[:, d, None] - other_high[None, :, d], other_low[None, :, d] - high[:, d, None]))
        out += gap * gap
    return out

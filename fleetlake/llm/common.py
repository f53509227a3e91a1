"""Helpers shared by the text and embedding operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: space and the five controls 09-0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables in ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting (a test) gets a temporary folder.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
    return sc.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"


_SCOPE: ContextVar[list[str] | None] = ContextVar("cuts", default=None)


@contextmanager
def scoped_cuts(spark: SparkSession) -> Iterator[None]:
    """Remove the tables cut inside when the block ends; for work whose result is then stored and reread."""
    made: list[str] = []
    token = _SCOPE.set(made)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        for path in made:
            remove(spark, path)


def write_cut(df: DataFrame) -> str:
    """Write ``df`` as Parquet into the shared folder and return the path."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    if (made := _SCOPE.get()) is not None:
        made.append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df``: a lost executor costs a re-read, not a recomputation."""
    return df.sparkSession.read.parquet(write_cut(df))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table written by :func:`write_cut` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def free(docs: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``docs`` is called so."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hash_sample(df: DataFrame, id_col: str, bound: int, rows: int) -> DataFrame:
    """At most ``bound`` rows, chosen by a hash of ``id_col`` so that reruns agree.

    ``rows`` is the row count of ``df``. The expected size is 0.9 * bound; of an unlikely
    excess the rows of the least hashes stay.
    """
    if rows <= bound:
        return df
    share = int(0.9 * bound / rows * (1 << 30))
    h = F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(1 << 30))
    some = df.where(h < share)
    return some if some.count() <= bound else some.orderBy(h, id_col).limit(bound)


def labelled_sample(docs: DataFrame, known: DataFrame, bound: int) -> DataFrame:
    """At most ``bound`` different labelled texts: ``(text, y, w)``, where w says how often a row occurs.

    ``docs(doc_id, text)`` meets ``known(doc_id, y)``, of which a hash keeps about ``bound``
    ids at most. Joined rows can still be many (an id may be repeated over different texts),
    so equal ones become one weighted row and those of the least hashes stay: the bound holds
    exactly, and reruns agree.
    """
    known = known.select("doc_id", "y").distinct()
    n = known.count()
    some = known if n <= bound else known.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int(0.9 * bound / n * (1 << 30)))
    rows = cut(docs.join(F.broadcast(some), "doc_id").select("doc_id", "text", "y", F.xxhash64("doc_id", "text", "y", F.lit(11)).alias("h")))  # about bound ids
    kinds = rows.groupBy("h").agg(F.count("*").alias("w"))
    if kinds.count() > bound:
        kinds = kinds.orderBy("h").limit(bound)
    first = rows.dropDuplicates(["h"])
    return cut(first.join(kinds, "h").select("text", F.col("y").cast("int").alias("y"), "w"))


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union-find over array positions: join a[i] with b[i], each label the least position of its set."""
    while len(a):
        la, lb = labels[a], labels[b]
        differ = la != lb
        if not differ.any():
            break
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            nxt = labels[labels]
            if np.array_equal(nxt, labels):
                break
            labels = nxt
    return labels


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of the graph ``edges(a, b)``: one row ``(node, component)`` per node of an edge.

    ``component`` is the least node that can be reached. Alternates the large-star and
    small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond"),
    each a grouped minimum and an equi-join, until the edges stay the same. The edges of
    every round are written to the shared folder; no round keeps an earlier lineage.
    """
    spark = edges.sparkSession
    first = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    path = write_cut(first.where("a <> b").distinct())
    mark = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(3)))).first()
    before = mark(spark.read.parquet(path))
    for _ in range(max_rounds):
        if not before[0]:
            break
        e = spark.read.parquet(path)
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = write_cut(least.select("a", F.col("m").alias("b")).unionByName(moved).distinct())
        remove(spark, path)
        path, now = new, mark(spark.read.parquet(new))
        if tuple(now) == tuple(before):
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    e = spark.read.parquet(path)
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)

"""The corpus pipeline: toxicity, line dedup, near-duplicate removal, mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes what a stage
returns as Parquet into the shared folder and hands the reread table to the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlake.llm import bpe, line_dedup, mixing, simhash, toxicity
from fleetlake.llm.common import free, remove, scoped_cuts, shared_path, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score below 0.5), as they are."""
    names = free(docs, "score"), free(docs, "predicted")
    return toxicity.predict(docs, table(spark, sf_dir, "labels"), names=names).where(F.col(names[1]) == 0).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that three or more share; ``n_chars`` follows the text."""
    out = line_dedup.dedup_lines(docs, counts=(free(docs, "n_lines"), free(docs, "n_dropped"))).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the least doc_id.

    Links are pairs whose sets of five-word shingles have a similarity of 0.8 or more; a
    pigeonring of SimHash fingerprints, one for each part of the shingles, finds the candidates.
    """
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights: rows come as often as they are taken."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row of the mix: doc_id, n_tokens and digests of ids and decoded text."""
    return bpe.digest(bpe.encode(docs, bpe.default_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("BPE encoding", encode),
]

#: The classifier is trained, which SQL cannot express; tests hold run() against brute-force versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, path = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        new = shared_path(spark)
        with scoped_cuts(spark):  # what a stage keeps in between goes when its output is stored
            stage(spark, docs, sf_dir).write.parquet(new)
        if path:
            remove(spark, path)
        docs, path = spark.read.parquet(new), new
    return STAGES[-1][1](spark, docs, sf_dir)

"""Quality by hierarchical empirical Bayes over hosts and paths.

A logistic regression on hashed words, word shapes and repetition of the whole text gives
each document's own evidence (a log likelihood ratio). Hosts, and paths within hosts, have
rates of good documents: grouped sums of known labels and, where there is none, of the
classifier's probabilities. A host's rate is drawn to the global rate and a path's rate to
its host's, each as a Beta posterior whose prior strength comes from how much rates differ
between groups beyond what their sizes explain (method of moments), so sparse sites fall
back on what is known above them. A document's posterior odds are its path's odds times its
own likelihood ratio; the rates that it meets leave the document itself out, so its evidence
counts once.

Labels of held-out rows are never used. The classifier is fitted on at most ``TRAIN_ROWS``
different labelled rows and has ``BUCKETS`` weights; both bounds are fixed, so the model may
be sent to every task.

Defined results: a null or empty text has the features of an empty one; null host and path
are groups of their own; repeated rows are rows of their own, each left out of its own rates
alone; of several labels of one doc_id the largest holds; without both classes among the
labels the classifier has no evidence and rates decide; a lone document of a host gets the
global rate; an empty table gives an empty result; extra columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log, sqrt
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, labelled_sample, table
from .linear import Sparse, fit
from .toxicity import held_out

TRAIN_ROWS = 8_000
BUCKETS = 1 << 16
#: How far a text's evidence may go.
MOST_EVIDENCE = 12.0
_RUN = re.compile(r"(.)\1\1+")
_LOWER, _UPPER, _DIGIT = re.compile(r"[^\W\d_A-ZÀ-Þ]+"), re.compile(r"[A-ZÀ-Þ]+"), re.compile(r"\d+")
#: Tokens that are remembered, and how long those are at most; longer ones are read anew each time.
_MEMO, _SHORT = 300_000, 64


def bucket(feature: str) -> int:
    """Place of a feature among the weights."""
    return crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS


def shape(token: str) -> str:
    """A token with its letters and digits as classes and runs of equal signs cut to two: Are. is Aa., OF!!! is A!!"""
    return _RUN.sub(r"\1\1", _DIGIT.sub("0", _UPPER.sub("A", _LOWER.sub("a", token))))


class Features:
    """Features of whole texts; remembers those of tokens up to a bound."""

    def __init__(self) -> None:
        self._memo: dict[str, tuple[int, int]] = {}

    def token(self, token: str) -> tuple[int, int]:
        found = self._memo.get(token)
        if found is None:
            found = bucket("w" + token.lower()), bucket("s" + shape(token))
            if len(token) <= _SHORT:
                if len(self._memo) >= _MEMO:
                    self._memo.clear()
                self._memo[token] = found
        return found

    def of(self, text: str | None) -> dict[int, float]:
        """Value by bucket: each different word by its share of the vector, each shape by its share of the tokens,
        and the rates of repeated tokens, of different tokens and of different lines, and the length, by steps."""
        t = text or ""
        tokens = t.split()
        counts, n = Counter(tokens), max(1, len(tokens))
        word = 1 / sqrt(max(1, len(counts)))
        out: dict[int, float] = {}
        for token, k in counts.items():
            w, s = self.token(token)
            out[w] = word
            out[s] = out.get(s, 0.0) + 4 * k / n
        lines = t.split("\n")
        for name, value in (
            ("length", log(1 + len(tokens)) / log(4)), ("repeated", 8 * sum(map(eq, tokens, tokens[1:])) / n),
            ("different", 8 * len(counts) / n), ("lines", 4 * len(set(lines)) / len(lines)),
        ):
            out[bucket(f"{name}={int(value)}")] = 1.0
        return out


def strength(groups: DataFrame, above: Column) -> float:
    """Prior strength of group rates around their parents' by the method of moments, within 1 to 10,000.

    ``groups`` has ``n`` (documents), ``s`` (sum of good) and the columns of ``above``, the
    parent's rate. Compares the variance between groups with what sampling alone would give.
    """
    rate = F.col("s") / F.col("n")
    big = groups.where("n >= 2")
    r = big.agg(F.sum(F.col("n") * (rate - above) ** 2).alias("spread"), F.sum(above * (1 - above)).alias("noise"), F.sum(F.col("n") * above * (1 - above)).alias("most"), F.count("*").alias("k")).first()
    if not r["k"] or not r["most"]:
        return 1e4
    between = (r["spread"] - r["noise"]) / max(1e-12, r["most"] - r["noise"])  # the intra-class correlation
    return float(min(1e4, max(1.0, 1 / max(1e-4, between) - 1)))


def train(docs: DataFrame, known: DataFrame) -> tuple[np.ndarray, float, float]:
    """Weights and bias of the text classifier and the share of label 1, from ``known(doc_id, y)``."""
    rows = labelled_sample(docs, known, TRAIN_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Features()
        for batch in batches:
            own = [made.of(t.as_py()) for t in batch.column(0)]
            yield pa.record_batch([batch.column(1), batch.column(2), pa.array([list(f) for f in own], pa.list_(pa.int32())), pa.array([list(f.values()) for f in own], pa.list_(pa.float32()))], names=["y", "w", "ids", "values"])

    got = rows.mapInArrow(run, "y int, w long, ids array<int>, values array<float>").toArrow()  # TRAIN_ROWS rows at most
    order = sorted(zip(got.column("y").to_pylist(), got.column("w").to_pylist(), got.column("ids").to_pylist(), got.column("values").to_pylist()))
    y, w = np.array([r[0] for r in order], float), np.array([r[1] for r in order], float)
    share = float((w * y).sum() / w.sum()) if len(w) else 0.5
    if not 0 < share < 1:
        return np.zeros(BUCKETS), _logit(share), share
    weights, bias = fit(Sparse([r[2:] for r in order], BUCKETS), y, w, l2=1e-4, steps=250)
    return weights, bias, share


def _logit(p: float) -> float:
    p = min(1 - 1e-6, max(1e-6, p))
    return log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, label: str = "quality") -> DataFrame:
    """``(doc_id, held_out, host, path, evidence, site_rate, score, predicted)`` for every document.

    ``evidence`` is the text's log likelihood ratio, ``site_rate`` the shrunken rate of the
    other documents on its path, ``score`` the posterior probability of label 1.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), "text")
    known = labels.where(~held_out()).where(F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    weights, bias, prior = train(base.select("doc_id", "text"), known)
    odds = _logit(prior)
    model = spark.sparkContext.broadcast((weights.astype(np.float64).tolist(), bias - odds))  # BUCKETS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shift = model.value
        made = Features()
        for batch in batches:
            z = [shift + sum(own[k] * v for k, v in made.of(t.as_py()).items()) for t in batch.column(3)]
            yield pa.record_batch([*batch.columns[:3], pa.array(np.clip(z, -MOST_EVIDENCE, MOST_EVIDENCE), pa.float64())], names=["doc_id", "host", "path", "evidence"])

    x = base.mapInArrow(run, "doc_id long, host string, path string, evidence double").join(known, "doc_id", "left")
    scored = cut(x.withColumn("good", F.coalesce(F.col("y").cast("double"), 1 / (1 + F.exp(-(F.col("evidence") + odds))))))
    paths = cut(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("good").alias("s")))
    hosts = cut(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    whole = hosts.agg(F.sum("s") / F.sum("n")).first()[0]
    rate = float(whole) if whole is not None else prior
    k_host = strength(hosts, F.lit(rate))
    above = hosts.select(F.col("host").alias("_h"), F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    paths = cut(paths.join(above, F.col("host").eqNullSafe(F.col("_h"))).drop("_h"))
    k_path = strength(paths, (F.col("host_s") + k_host * rate) / (F.col("host_n") + k_host))
    sites = paths.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "n", "s", "host_n", "host_s")
    out = scored.join(sites, F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p")))
    out = out.withColumn("host_rate", (F.col("host_s") - F.col("good") + k_host * rate) / (F.col("host_n") - 1 + k_host))
    out = out.withColumn("site_rate", (F.col("s") - F.col("good") + k_path * F.col("host_rate")) / (F.col("n") - 1 + k_path))
    safe = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("site_rate")))
    score = 1 / (1 + F.exp(-(F.log(safe / (1 - safe)) + F.col("evidence"))))
    out = out.select("doc_id", held_out().alias("held_out"), "host", "path", "evidence", "site_rate", score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: posterior quality of every document; source stands for the host, language for the path."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))

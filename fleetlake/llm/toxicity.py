"""Counterfactually regularised toxicity classifier.

A logistic regression over the presence of words and word beginnings. Each labelled text
brings counterfactual pairs: its mentions of identity groups swapped for the next group of
their family, and, as few texts mention any, one group put in for another of its family in
turn. Training adds a penalty on the squared change of the logit over all pairs
(counterfactual logit pairing). Words and beginnings that only some groups of a family share
(an insult can begin like a group's name) so lose what tells the groups apart, and a sentence
is not scored higher for whom it mentions.

The model is fitted on at most ``TRAIN_ROWS`` different labelled rows and has at most
``FEATURES`` weights and those of the identity terms; both bounds are fixed, so the model may
be sent to every task. The features are those whose rates differ most between the labels,
weighed by how often they occur; more of them bring in words of single texts and lower the
held-out recall (README). Scoring reads every whole text.

Defined results: null and empty texts score like a text without features; labels that are
null are not learnt from, and of several labels of one doc_id the largest holds; repeated
labelled rows count as often as they occur; without both classes among the labels every text
scores the share of label 1 (0 for no labels); an empty table gives an empty result; extra
columns pass through :func:`score`, where a column of the new one's name gives way (the
name is a parameter).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import exp, fsum
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import labelled_sample, table
from .linear import Sparse, fit

TRAIN_ROWS = 8_000
FEATURES = 1_024
PENALTY = 100.0
#: Families of group mentions in the corpus's languages; within a family each swaps for the next.
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("woman", "man"), ("women", "men"), ("girl", "boy"), ("female", "male"),
    ("immigrant", "refugee", "foreigner", "native"), ("immigrants", "refugees", "foreigners", "natives"),
    ("deaf", "blind", "disabled"), ("old", "young"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"), ("frau", "mann"), ("frauen", "männer"), ("mädchen", "junge"),
    ("ausländer", "flüchtlinge", "einwanderer", "einheimische"), ("schwule", "lesben"), ("taube", "blinde", "behinderte"), ("alte", "junge"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"), ("femme", "homme"), ("femmes", "hommes"), ("fille", "garçon"),
    ("immigrés", "réfugiés", "étrangers", "autochtones"), ("noirs", "blancs", "asiatiques"), ("sourds", "aveugles", "handicapés"), ("vieux", "jeunes"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"), ("mujer", "hombre"), ("mujeres", "hombres"), ("niña", "niño"),
    ("inmigrantes", "refugiados", "extranjeros", "nativos"), ("negros", "blancos", "asiáticos"), ("sordos", "ciegos", "discapacitados"), ("viejos", "jóvenes"),
)
_WORD = re.compile(r"[^\W\d_]+")
_MEMO = 300_000


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters."""
    return _WORD.findall((text or "").lower())


def features_of(word: str) -> list[str]:
    """The features that a word brings: itself and its beginnings of 3 to 6 letters."""
    return [word, *("^" + word[:k] for k in range(3, 7) if len(word) >= k)]


def swap(found: list[str], families: tuple[tuple[str, ...], ...] = IDENTITY) -> list[str] | None:
    """The words with each identity term swapped for the next of its family; None if there is none."""
    to = {t: family[(k + 1) % len(family)] for family in families for k, t in enumerate(family)}
    return [to.get(w, w) for w in found] if any(w in to for w in found) else None


class Model:
    """Vocabulary and weights; scores texts."""

    def __init__(self, vocabulary: list[str], weights: list[float], bias: float):
        self.vocabulary, self.weights, self.bias = vocabulary, weights, bias
        self._index = {f: k for k, f in enumerate(vocabulary)}
        self._memo: dict[str, tuple[int, ...]] = {}

    def __reduce__(self):
        return Model, (self.vocabulary, self.weights, self.bias)

    def ids(self, found: list[str]) -> set[int]:
        """Positions of the features that a text has."""
        memo, index, out = self._memo, self._index, set()
        for w in set(found):
            own = memo.get(w)
            if own is None:
                if len(memo) >= _MEMO:
                    memo.clear()
                own = memo[w] = tuple(index[f] for f in features_of(w) if f in index)
            out.update(own)
        return out

    def logit(self, text: str | None) -> float:
        """Log-odds of label 1; summed exactly, so any order gives the same."""
        return self.bias + fsum(map(self.weights.__getitem__, self.ids(words(text))))

    def score(self, text: str | None) -> float:
        """Probability of label 1."""
        return 1 / (1 + exp(-max(-700.0, min(700.0, self.logit(text)))))


def contrasts(families: tuple[tuple[str, ...], ...]) -> list[tuple[str, str]]:
    """Each term with the next of its family; families come in turn."""
    pairs = [[(t, f[(k + 1) % len(f)]) for k, t in enumerate(f)] for f in families if len(f) > 1]
    return [p[k] for k in range(max(map(len, pairs), default=0)) for p in pairs if k < len(p)]


def held_out(col: str = "doc_id") -> F.Column:
    """Whether a row is kept from training: crc32 of its id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", families: tuple[tuple[str, ...], ...] = IDENTITY, penalty: float = PENALTY, rows: int = TRAIN_ROWS, features: int = FEATURES) -> Model:
    """Fit on at most ``rows`` different labelled texts that are not held out."""
    own = labels.where(~held_out()).where(F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    texts = labelled_sample(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), own, rows)
    n_one, n_all = texts.agg(F.sum(F.col("y") * F.col("w")), F.sum("w")).first()
    if not n_all or n_one in (0, n_all):
        rate = (n_one or 0) / n_all if n_all else 0.0
        return Model([], [], float(np.log(max(rate, 1e-9) / max(1 - rate, 1e-9))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for t, y, w in zip(*(c.to_pylist() for c in batch.columns)):
                for f in {f for w_ in set(words(t)) for f in features_of(w_)}:
                    seen[y][f] += w
        keys = list(dict.fromkeys([*seen[0], *seen[1]]))
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000]
            yield pa.record_batch([pa.array(part), *(pa.array([c[f] for f in part], pa.int64()) for c in seen)], names=["f", "n0", "n1"])

    counts = texts.select("text", "y", "w").mapInArrow(count, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    rate0, rate1 = (F.col("n0") + 0.5) / (n_all - n_one + 1.0), (F.col("n1") + 0.5) / (n_one + 1.0)
    weight = F.abs(F.log(rate1 / rate0)) * F.sqrt(F.least(F.col("n0") + F.col("n1"), F.lit(int(n_one)) * 4))
    named = {f for family in families for t in family for f in features_of(t)}
    vocabulary = sorted(named.union(r["f"] for r in counts.orderBy(F.desc(weight), "f").limit(features).select("f").collect()))
    blank, terms = Model(vocabulary, [0.0] * len(vocabulary), 0.0), contrasts(families)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, changes = [], []
            for t in batch.column(0).to_pylist():
                found = words(t)
                held = blank.ids(found)
                pairs = [(found, swap(found, families))]
                if terms:
                    one, other = terms[crc32((t or "").encode("utf-8", "surrogatepass")) % len(terms)]
                    pairs.append(([*found, one], [*found, other]))
                ids.append(sorted(held))
                changes.append([sorted(blank.ids(a) ^ blank.ids(b)) + [-1] + sorted(blank.ids(b) - blank.ids(a)) for a, b in pairs if b is not None])
            yield pa.record_batch([batch.column(1), batch.column(2), pa.array(ids, pa.list_(pa.int32())), pa.array(changes, pa.list_(pa.list_(pa.int32())))], names=["y", "w", "ids", "changes"])

    got = texts.select("text", "y", "w").mapInArrow(indexed, "y int, w long, ids array<int>, changes array<array<int>>").toArrow()  # within rows x vocabulary
    order = sorted(zip(*(got.column(c).to_pylist() for c in ("y", "w", "ids", "changes"))))
    y, w = np.array([r[0] for r in order], float), np.array([r[1] for r in order], float)
    share = float((w * y).sum() / w.sum())
    w = np.where(y == 1, min(4.0, (1 - share) / share), 1.0) * w  # label 1 is rare
    x = Sparse([(r[2], [1.0] * len(r[2])) for r in order], len(vocabulary))
    pairs = []
    for change in (c for r in order for c in r[3]):
        at = change.index(-1)
        more = set(change[at + 1 :])
        if at:
            pairs.append((change[:at], [1.0 if k in more else -1.0 for k in change[:at]]))
    weights, bias = fit(x, y, w, Sparse(pairs, len(vocabulary)), penalty)
    return Model(vocabulary, weights.tolist(), bias)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name`` (in place of one so called): the probability of label 1 from the text alone."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights and those of the identity terms
    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != name.lower()])
    at = own.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_ = held.value
        for batch in batches:
            yield pa.record_batch([*batch.columns, pa.array([model_.score(t.as_py()) for t in batch.column(at)], pa.float64())], names=[*batch.schema.names, name])

    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField(name, T.DoubleType())]))


def predict(docs: DataFrame, labels: DataFrame, label: str = "toxic", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with its score and prediction (1 if the score is at least 0.5) under ``names``."""
    return score(docs, train(docs, labels, label), names[0]).withColumn(names[1], (F.col(names[0]) >= 0.5).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: score of every whole text; learns from labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model).select(F.col("doc_id").cast("long"), "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

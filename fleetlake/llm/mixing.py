"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions alone.

Sources get target sizes (words) from weights. A source whose target is r times its size
takes every document floor(r) times for certain; the rest of the target is a sample without
replacement, in which documents have unequal inclusion probabilities: p = min(1, c * q), with
a document's own weight q (by default the whole part of the square root of its size, so that
longer ones are drawn more often) and one c per source, calibrated so that the expected size
of the sample, the sum of p * size, is the rest of the target. Documents with p = 1 are
certain whole copies too. The others have a uniform number u from a hash of their id and rank
by the odds u / (1 - u) divided by the inclusion odds p / (1 - p) (Rosén's Pareto sampling);
the first ones whose sizes fill the rest of the target are taken once more.

The calibration runs over sums per (source, q), of which there are few. The order is never
sorted per source: the ranks fall into bins, bins are summed per source by grouped
aggregation, and only the bin in which the target is reached is ordered.

Defined results: a null or empty text has size 0 and is not taken; null is a source of its
own, last in the order; a table without words has targets 0 and takes nothing; repeated rows
with one doc_id share their u and are ordered as equals, first come by (doc_id, size); an
empty table gives an empty result; columns of ``docs``, whatever their names, pass through
:func:`mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, free, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
#: Bins of the order in each source.
BINS = 4096


def uniform(col: Column) -> Column:
    """A number in (0, 1) from 52 bits of the MD5 of the value as text."""
    return (F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``(source, source_size, target)`` from ``sizes(source, size)``.

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share``
    times all sizes; no target is above ``most`` times its source's size, and the excess is
    shared anew by weight. Solved in one pass: with sources in the order of cap / weight,
    those up to some point get their cap and the others weight times one level. The windows
    run over one row per source.
    """
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    own = own.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    own = own.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_ratio = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    level = (F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    own = own.withColumn("level", level).withColumn("at", F.row_number().over(by_ratio)).withColumn("fits", F.col("level") <= F.col("cap") / F.col("w"))
    # The level of the first source that stays below its cap holds for it and all after it.
    final = F.min(F.when(F.col("fits"), F.struct("at", "level"))).over(whole)
    own = own.withColumn("final", final.getField("level"))
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("final")))
    return own.select("source", "source_size", target.alias("target"))


def sized(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size)``: words of each document."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long"), "source", size.alias("size"))


def calibrated(x: DataFrame) -> DataFrame:
    """``(source, q, p)`` from ``x(source, q, size, rest)``: p = min(1, c * q), where p * size sums to the source's rest.

    With classes of equal q from the largest down, those before some class are certain and
    the others share what is left: c is that of the first class for which c * q is at most 1.
    """
    own = x.groupBy("source", "q").agg(F.sum("size").alias("size"), F.first("rest").alias("rest"))
    down = Window.partitionBy("source").orderBy(F.desc("q"))
    above = F.coalesce(F.sum("size").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.sum(F.col("q") * F.col("size")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    own = own.withColumn("c", (F.col("rest") - above) / F.nullif(below.cast("double"), F.lit(0.0)))
    c = F.max(F.when(F.col("c") * F.col("q") <= 1.0, F.struct("q", "c"))).over(Window.partitionBy("source"))
    return own.select("source", "q", F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c.getField("c") * F.col("q"))), F.lit(1.0)).alias("p"))


def copies(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, own_weight: Column | None = None, seed: str = "") -> DataFrame:
    """``(doc_id, source, size, source_size, target, p, copies)`` for ``rows(doc_id, source, size)``.

    ``own_weight`` (a positive whole number of few different values; by default the whole part
    of the square root of ``size``) is what inclusion probabilities are proportional to;
    ``p`` is that of the copy beyond the certain ones. Another ``seed`` draws another sample.

    Each step reads the ones before several times, so the small tables that steps hand on are
    cut, as are the ranked rows: else the plan would repeat all earlier steps in each later
    one, and planning it would fill the driver's heap.
    """
    t = cut(targets(rows, weights, share, most))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    x = rows.join(t.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    x = x.withColumn("sure", F.floor(rate).cast("long"))
    x = x.withColumn("rest", F.col("target") - F.col("sure") * F.col("source_size"))  # words still to be taken, of the whole source
    x = x.withColumn("q", (own_weight if own_weight is not None else F.floor(F.sqrt(F.col("size").cast("double")))).cast("long"))
    p = cut(calibrated(x).select(F.col("source").alias("_s"), F.col("q").alias("_q"), "p"))
    x = x.join(p, F.col("source").eqNullSafe(F.col("_s")) & (F.col("q") == F.col("_q"))).drop("_s", "_q")
    u = uniform(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rank = F.when(F.col("p") >= 1, 0.0).when(F.col("p") <= 0, float("inf")).otherwise(u / (F.lit(1.0) - u) / (F.col("p") / (F.lit(1.0) - F.col("p"))))
    x = x.withColumn("rank", rank)
    # Bins of rank / (1 + rank): about half of each way is taken, whatever p, so the last taken bin holds a small share.
    x = x.withColumn("bin", F.when(F.col("p") <= 0, BINS - 1).otherwise(F.least(F.lit(BINS - 1), F.floor(F.col("rank") / (F.lit(1.0) + F.col("rank")) * F.lit(BINS)))).cast("int"))
    x = cut(x)
    bins = x.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"), F.first("rest").alias("bin_rest"))
    upto = F.sum("bin_size").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    bins = bins.withColumn("upto", upto)
    bins = cut(bins.select(F.col("source").alias("_s"), F.col("bin").alias("_b"), (F.col("upto") - F.col("bin_size")).alias("below"), (F.col("upto") <= F.col("bin_rest")).alias("full")))
    x = x.join(bins, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bin") == F.col("_b"))).drop("_s", "_b")
    # Certain documents are taken; their bin is never ordered.
    open_ = ~F.col("full") & (F.col("below") < F.col("rest")) & (F.col("p") < 1) & (F.col("size") > 0)
    plain = x.where(~open_).withColumn("more", (F.col("full") | (F.col("p") >= 1)).cast("long"))
    head = x.where(F.col("p") >= 1).groupBy("source", "bin").agg(F.sum("size").alias("head")).withColumnsRenamed({"source": "_s", "bin": "_b"})
    edge = x.where(open_).join(head, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bin") == F.col("_b")), "left")
    inside = Window.partitionBy("source", "bin").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.col("below") + F.coalesce("head", F.lit(0)) + F.sum("size").over(inside)
    # A document that straddles the target is taken if most of it lies below.
    edge = edge.withColumn("more", (end - F.col("size") / F.lit(2.0) <= F.col("rest")).cast("long"))
    cols = ["doc_id", "source", "size", "source_size", "target", "p"]
    both = plain.select(*cols, "sure", "more").unionByName(edge.select(*cols, "sure", "more"))
    return both.select(*cols, F.when(F.col("size") > 0, F.least(F.lit(int(most)).cast("long"), F.col("sure") + F.col("more"))).otherwise(F.lit(0)).cast("long").alias("copies"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken (repeated doc_ids share one decision)."""
    plan = cut(copies(cut(sized(docs)), weights, share, most))
    own, times, k = free(docs, "_id"), free(docs, "_copies"), free(docs, "_k")
    taken = plan.groupBy(F.col("doc_id").alias(own)).agg(F.max("copies").alias(times)).where(F.col(times) > 0)
    out = docs.join(taken, F.col("doc_id").eqNullSafe(F.col(own)))
    return out.withColumn(k, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: size, target of its source and words taken, for every document."""
    rows = cut(sized(table(spark, sf_dir, "documents")))
    return copies(rows).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3) + 1] AS w
  FROM d GROUP BY source
), c AS (SELECT *, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level, row_number() OVER b0 AS pos
  FROM c WINDOW b AS (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), b0 AS (ORDER BY cap / w, source ASC NULLS LAST)
), f AS (SELECT (min({'pos': pos, 'level': level}) FILTER (WHERE level <= cap / w)).level AS final FROM l),
t AS (SELECT source, source_size, CASE WHEN final IS NULL THEN cap ELSE least(cap, w * final) END AS target FROM l, f),
x AS (
  SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), y AS (
  SELECT *, CAST(floor(rate) AS BIGINT) AS sure, target - CAST(floor(rate) AS BIGINT) * source_size AS rest, CAST(floor(sqrt(CAST(size AS DOUBLE))) AS BIGINT) AS q FROM x
), k AS (
  SELECT source, q, CAST(sum(size) AS BIGINT) AS class_size, any_value(rest) AS class_rest FROM y GROUP BY source, q
), cc AS (
  SELECT *, (class_rest - coalesce(CAST(sum(class_size) OVER (PARTITION BY source ORDER BY q DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
    / nullif(CAST(CAST(sum(q * class_size) OVER (PARTITION BY source ORDER BY q DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS DOUBLE), 0) AS c FROM k
), pp AS (
  SELECT source, q, coalesce(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (max(CASE WHEN c * q <= 1.0 THEN {'q': q, 'c': c} END) OVER (PARTITION BY source)).c * q)), 1.0::DOUBLE) AS p FROM cc
), z0 AS (
  SELECT y.*, p, CASE WHEN p >= 1 THEN 0 WHEN p <= 0 THEN 'inf'::DOUBLE ELSE u / (1 - u) / (p / (1 - p)) END AS rnk FROM y JOIN pp ON y.source IS NOT DISTINCT FROM pp.source AND y.q = pp.q
), z AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY rnk, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM z0
)
SELECT doc_id, size, source_size, target,
  CASE WHEN size = 0 THEN 0 ELSE size * least(2, sure + CASE WHEN p >= 1 OR upto - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) END AS taken
FROM z
"""

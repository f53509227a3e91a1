"""Ranks and running totals on two levels, so that no group is one task.

A window that orders all rows of a key puts the key into one task. Here the rows fall into
pieces by value or time first. Pieces are summed by grouped aggregation, and running sums over
the few pieces of a key give what each begins with; inside a piece the order is cheap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join on ``keys`` for which null equals null; the keys come once."""
    other = right.withColumnsRenamed({k: f"_{k}_" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_{k}_")) for k in keys]
    return left.join(other, on, how).drop(*[f"_{k}_" for k in keys])


def value_ranks(rows: DataFrame, value: str, by: list[str], width: float | None = None) -> DataFrame:
    """``(<by>, <value>, upto, total, place, kinds)``: one row per different value of a group.

    ``upto`` counts the rows of at most that value (the rank with ties at the last place),
    ``total`` all of the group, ``place`` is the rank among different values and ``kinds``
    their number; null values are out. Rows are only counted, by a grouped aggregation; with
    ``width``, the different values of a group are ordered in pieces of that width, for groups
    of very many values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    before = lambda c, order: F.sum(c).over(order)
    if width is None:
        group, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(value)
        return counts.select(*by, value, before("n", order).alias("upto"), F.sum("n").over(group).alias("total"), F.row_number().over(order).cast("long").alias("place"), F.count("*").over(group).alias("kinds"))
    counts = counts.withColumn("_piece", F.floor(F.col(value) / F.lit(width)))
    pieces = counts.groupBy(*by, "_piece").agg(F.sum("n").alias("_n"), F.count("*").alias("_k"))
    group = Window.partitionBy(*by)
    past = group.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select(*by, "_piece", *[F.coalesce(F.sum(c).over(past), F.lit(0)).alias(f"{c}0") for c in ("_n", "_k")], F.sum("_n").over(group).alias("total"), F.sum("_k").over(group).alias("kinds"))
    inner = Window.partitionBy(*by, "_piece").orderBy(value)
    x = matched(counts.withColumns({"upto": before("n", inner), "place": F.row_number().over(inner)}), starts, [*by, "_piece"])
    return x.select(*by, value, (F.col("upto") + F.col("_n0")).alias("upto"), "total", (F.col("place") + F.col("_k0")).alias("place"), "kinds")


def running_total(rows: DataFrame, value: str, key: str, order: list[str], piece: Column, name: str = "total") -> DataFrame:
    """``rows`` with the running sum of ``value`` per ``key`` in ``order``.

    ``piece`` is a coarser form of the first column of the order, such as the day of a time:
    sums per piece are carried over the pieces of a key, rows are ordered inside their piece.
    A null adds nothing.
    """
    x = rows.withColumn("_piece", piece)
    sums = x.groupBy(key, "_piece").agg(F.sum(value).alias("_sum"))
    past = Window.partitionBy(key).orderBy(F.col("_piece").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(key, "_piece", F.coalesce(F.sum("_sum").over(past), F.lit(0)).alias("_carried"))
    inner = Window.partitionBy(key, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = matched(x.withColumn("_own", F.coalesce(F.sum(value).over(inner), F.lit(0))), carried, [key, "_piece"])
    return x.withColumn(name, F.col("_own") + F.col("_carried")).drop("_piece", "_own", "_carried")

"""Joins and minima whose keys may hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds one row in SHARE, and LEAST rows at least; so at most SHARE keys are hot.
SHARE, LEAST = 1000, 64


def hot_bound(rows: int) -> int:
    """Rows from which a key is hot, given the number of all rows; at most SHARE keys reach it."""
    return max(LEAST, -(-rows // SHARE))


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)])


def hot_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", rows: int | None = None) -> DataFrame:
    """``left`` with the columns of ``right``, which has each key once; null is a key. ``how`` is left or inner.

    Rows of hot keys stay where they are and meet a broadcast of at most SHARE rows; the others meet in a shuffle.
    Both inputs are read twice: pass stored ones.
    """
    rows = left.count() if rows is None else rows
    hot = left.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") >= hot_bound(rows)).select(*[F.col(c).alias(f"_hot_{c}") for c in on])
    values = [c for c in right.columns if c not in on]
    named = right.select(*[F.col(c).alias(f"_key_{c}") for c in on], *values, F.lit(True).alias("_met"))
    keys, hots = [f"_key_{c}" for c in on], [f"_hot_{c}" for c in on]
    few = F.broadcast(hot.join(named, _same(hots, keys), "left").drop(*keys))
    seen = left.join(few, _same(on, hots), "left").withColumn("_is", F.expr(" OR ".join(f"{h} IS NOT NULL" for h in hots)))
    # A null key is never hot by this mark; it meets its row in the shuffle.
    first = seen.where("_is").select(*left.columns, *values, "_met")
    rest = seen.where("NOT _is").select(*left.columns).join(named, _same(on, keys), "left").select(*left.columns, *values, "_met")
    met = first.unionByName(rest)
    return (met.where("_met") if how == "inner" else met).drop("_met")


def least_neighbors(edges: DataFrame, rows: int) -> DataFrame:
    """(a, b, m): each row of ``edges`` (a, b) with the smallest b of its a. A hub's rows stay where they are."""
    stats = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_n"))
    hubs = F.broadcast(stats.where(F.col("_n") >= hot_bound(rows)).select("a", F.col("m").alias("_hub")))
    seen = edges.join(hubs, "a", "left")
    near = seen.where("_hub IS NOT NULL").select("a", "b", F.col("_hub").alias("m"))
    rest = seen.where("_hub IS NULL").select("a", "b").join(stats.select("a", "m"), "a")
    return near.unionByName(rest)

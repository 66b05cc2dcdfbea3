"""Joins of rows with a table of unique keys in which no task gathers a hot key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_join(rows: DataFrame, lookup: DataFrame, key: str, how: str = "inner", share: int = 1000, least: int = 100_000) -> DataFrame:
    """``rows``, a scan or written table (it is read more than once), joined with ``lookup``, which has each ``key`` once at most.

    Keys with more than one in ``share`` of all rows (and over ``least`` rows) are fewer than ``share``: their rows of
    ``lookup`` are broadcast, a proven bound, and the other rows join by a shuffle. Null keys match nothing.
    """
    if rows.count() <= least:
        return rows.join(lookup, key, how)
    per = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.agg(F.count(F.lit(1)).alias("_all"))
    hot = per.crossJoin(F.broadcast(total)).where(F.col("_n") > F.greatest(F.col("_all") / share, F.lit(least)))  # the total is one row
    hot = F.broadcast(hot.where(F.col(key).isNotNull()).select(key, F.lit(True).alias("_hot")))
    tagged = rows.join(hot, key, "left")
    cold = tagged.where("_hot is null").drop("_hot").join(lookup, key, how)
    warm = tagged.where("_hot").drop("_hot").join(F.broadcast(lookup.join(hot.drop("_hot"), key, "left_semi")), key, how)
    return cold.unionByName(warm)

"""Time buckets with a spine: every bucket of the period comes out, empty ones with zeros."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.operators.aggregates import percentiles_distributed

LABEL = {"hour": "yyyy-MM-dd'T'HH:00", "day": "yyyy-MM-dd"}


def parse_ts(c: Column) -> Column:
    """ISO time, Z or offset as UTC; null where it is none."""
    return F.try_to_timestamp(c)


def bucket(ts: Column, unit: str) -> Column:
    return F.date_format(F.date_trunc(unit, ts), LABEL[unit])


def spine(rows: DataFrame, ts: str, days: int, unit: str) -> DataFrame:
    """All bucket labels of the ``days`` before the newest row, that row's bucket included."""
    end = rows.agg(F.date_trunc(unit, F.max(F.col(ts).cast("timestamp"))).alias("e"))
    step = F.expr(f"interval 1 {unit}")
    return end.where("e is not null").select(F.explode(F.sequence(F.col("e") - F.expr(f"interval {days} days"), F.col("e"), step)).alias("at")).select(F.date_format("at", LABEL[unit]).alias("bucket"))


def usage(rows: DataFrame, ts: str, route: str, routes: list[str], days: int = 7, unit: str = "day") -> DataFrame:
    """Rows per bucket, in all and by route (no route is UNKNOWN); rows outside the spine vanish."""
    r = rows.select(bucket(F.col(ts).cast("timestamp"), unit).alias("bucket"), F.upper(F.coalesce(F.col(route), F.lit("UNKNOWN"))).alias("route"))
    per = r.groupBy("bucket").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("route") == x).alias(x.lower()) for x in routes])
    out = spine(rows, ts, days, unit).join(per, "bucket", "left")
    return out.fillna(0, ["total", *[x.lower() for x in routes]])


def latency(rows: DataFrame, ts: str, value: str, days: int = 7, unit: str = "day") -> DataFrame:
    """avg, p95 and count of non-zero durations per bucket, zero where there are none."""
    r = rows.select(bucket(F.col(ts).cast("timestamp"), unit).alias("bucket"), F.col(value).alias("v")).where("v > 0")
    per = percentiles_distributed(r, ["bucket"], "v").select("bucket", "count", "avg", "p95")
    return spine(rows, ts, days, unit).join(per, "bucket", "left").fillna(0, ["count", "avg", "p95"])


def errors(rows: DataFrame, ts: str, severity: Column, days: int = 7, unit: str = "day", period: DataFrame | None = None) -> DataFrame:
    """Errors per bucket by severity; no severity counts as error. ``period`` are the rows whose newest ends the spine."""
    r = rows.select(bucket(F.col(ts).cast("timestamp"), unit).alias("bucket"), F.coalesce(severity, F.lit("error")).alias("s"))
    kinds = ["warning", "error", "critical"]
    per = r.groupBy("bucket").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("s") == k).alias(k) for k in kinds])
    return spine(rows if period is None else period, ts, days, unit).join(per, "bucket", "left").fillna(0, ["total", *kinds])


def drift(current: DataFrame, prior: DataFrame, key: str, count: str, threshold: float = 0.10) -> DataFrame:
    """Relative change of counts per key against a former run, and whether it makes the former run stale."""
    j = current.select(key, F.col(count).alias("cur")).join(prior.select(key, F.col(count).alias("old")), key, "full")
    change = F.abs(F.coalesce("cur", F.lit(0)) - F.coalesce("old", F.lit(0))) / F.greatest(F.coalesce("old", F.lit(0)), F.lit(1))
    return j.select(key, F.round(change, 6).alias("drift"), (F.col("old").isNull() | (change >= threshold)).alias("stale"))


def validity(date: Column, first: Column, last: Column) -> Column:
    """Whether a text is in force on a date: not_yet, expired or valid; open ends are unbounded."""
    return F.when(first > date, "not_yet").when(last < date, "expired").otherwise("valid")

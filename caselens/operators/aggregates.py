"""Aggregates over cases, runs, steps and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.operators.skew import hot_join
from caselens.session import Scratch


def recurring(membership: DataFrame, entity: str, case: str, limit: int | None = 10, min_cases: int = 2) -> DataFrame:
    """Entities by number of distinct cases: the largest ``limit`` first, and of those the ones in ``min_cases`` or more."""
    per = (
        membership.where(F.col(entity).isNotNull() & F.col(case).isNotNull())
        .groupBy(F.col(entity).alias("entity"))
        .agg(F.countDistinct(case).alias("n_cases"), F.sort_array(F.collect_set(case)).alias("case_ids"))
    )
    if limit is not None:
        per = per.orderBy(F.desc("n_cases"), "entity").limit(limit)
    return per.where(F.col("n_cases") >= min_cases)


def group_counts(rows: DataFrame, column: str, top: int = 15) -> DataFrame:
    """The ``top`` values of a column by count, empty ones as ``unknown``, with the total considered."""
    value = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("unknown"))
    per = rows.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return per.orderBy(F.desc("n"), "value").limit(top).crossJoin(F.broadcast(total))  # one row


def safe_pct(part: Column, whole: Column) -> Column:
    """Percent with one decimal, 0 for nothing."""
    return F.when(whole > 0, F.bround(part / whole * 100, 1)).otherwise(F.lit(0.0))


def percentiles(value: Column) -> list[Column]:
    """count, avg, p50, p95, max of non-negative values; avg and p50 are cut, p95 is the nearest rank, halves to even."""
    v = F.when(value >= 0, value)
    n = F.count(v)
    ordered = F.sort_array(F.collect_list(v))
    rank = F.greatest(F.lit(1), F.least(n, F.bround(n * F.lit(0.95), 0).cast("long")))
    return [
        n.alias("count"),
        F.coalesce(F.avg(v).cast("long"), F.lit(0)).alias("avg"),
        F.coalesce(F.median(v).cast("long"), F.lit(0)).alias("p50"),
        F.coalesce(F.try_element_at(ordered, rank.cast("int")).cast("long"), F.lit(0)).alias("p95"),
        F.coalesce(F.max(v).cast("long"), F.lit(0)).alias("max"),
    ]


def percentiles_distributed(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``percentiles`` for groups of any size: values are counted first, ranks come from running counts, so no task
    holds all values of a group."""
    from pyspark.sql import Window as W

    h = rows.where(F.col(value) >= 0).groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    part = W.partitionBy(*keys)
    h = h.withColumn("hi", F.sum("c").over(part.orderBy("v"))).withColumn("n", F.sum("c").over(part))
    lo = F.col("hi") - F.col("c")
    rank = F.greatest(F.lit(1), F.least(F.col("n"), F.bround(F.col("n") * F.lit(0.95), 0).cast("long")))
    a, b = F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)
    at = lambda r: F.max(F.when((lo < r) & (F.col("hi") >= r), F.col("v")))
    return h.groupBy(*keys).agg(
        F.max("n").alias("count"),
        (F.sum(F.col("v") * F.col("c")) / F.max("n")).cast("long").alias("avg"),
        ((at(a) + at(b)) / 2).cast("long").alias("p50"),
        at(rank).cast("long").alias("p95"),
        F.max("v").cast("long").alias("max"),
    )


def routing(runs: DataFrame, route: str, outcome: str, duration: str) -> DataFrame:
    """Per route: count, share, success (an outcome other than safe), avg and p95 of non-zero durations."""
    key = F.upper(F.coalesce(F.nullif(F.col(route), F.lit("")), F.lit("UNKNOWN")))
    rows = runs.select(key.alias("route"), F.col(outcome).alias("o"), F.when(F.col(duration) != 0, F.col(duration)).alias("d"))
    per = rows.groupBy("route").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce((F.col("o") != "") & (F.col("o") != "safe"), F.lit(False))).alias("good")
    )
    total = runs.agg(F.count(F.lit(1)).alias("total"))
    lat = percentiles_distributed(rows.where("d is not null"), ["route"], "d").select("route", F.col("avg").alias("avg_ms"), F.col("p95").alias("p95_ms"))
    out = per.crossJoin(F.broadcast(total)).join(lat, "route", "left")  # the total is one row
    return out.select(
        "route",
        F.col("n").alias("count"),
        safe_pct(F.col("n"), F.col("total")).alias("share_pct"),
        safe_pct(F.col("good"), F.col("n")).alias("success_pct"),
        F.coalesce("avg_ms", F.lit(0)).alias("avg_ms"),
        F.coalesce("p95_ms", F.lit(0)).alias("p95_ms"),
    )


def verifier_stats(runs: DataFrame, passed: str, regenerated: str) -> DataFrame:
    """Of the runs a verifier saw: passed, regenerated and their shares."""
    gated = runs.where(F.col(passed).isNotNull())
    a = gated.agg(F.count(F.lit(1)).alias("gated"), F.count_if(F.col(passed) != 0).alias("passed"), F.count_if(F.coalesce(F.col(regenerated), F.lit(0)) != 0).alias("regenerated"))
    return a.select("*", safe_pct(F.col("passed"), F.col("gated")).alias("pass_pct"), safe_pct(F.col("regenerated"), F.col("gated")).alias("regen_pct"))


def edge_weights(associated: DataFrame, shared: DataFrame, per_confidence: float = 3.0, per_case: float = 1.0) -> DataFrame:
    """Undirected weights ``(a, b, weight)`` from associations ``(a, b, confidence)`` and shared cases ``(a, b, n)``.

    A missing confidence counts 1; pairs of a vertex with itself are dropped.
    """
    x = associated.select("a", "b", (F.coalesce("confidence", F.lit(1.0)) * per_confidence).alias("w"))
    y = shared.select("a", "b", (F.col("n") * per_case).alias("w"))
    both = x.unionByName(y).where("a <> b")
    return both.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.round(F.sum("w"), 6).alias("weight"))


def shared_groups(membership: DataFrame, entity: str, group: str, at_once: int = 1000) -> DataFrame:
    """Pairs ``(a, b, n)`` of entities with their number of common groups.

    The members of a group are dealt to one part per ``at_once`` of them, and every part meets the whole group in a
    task of its own, so no task holds a large group; the counts are added up before they are shuffled.
    """
    m = membership.select(F.col(entity).alias("e"), F.col(group).alias("g")).where("e is not null and g is not null").distinct()
    m = Scratch(membership.sparkSession, "groups").save(m, "members")  # read four times
    sizes = m.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g", F.ceil(F.col("n") / at_once).alias("parts"))
    m = hot_join(m, sizes, "g")
    a = m.select("g", F.pmod(F.xxhash64("e"), F.col("parts")).alias("part"), F.col("e").alias("a"))
    b = m.select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("e").alias("b"))
    return a.join(b, ["g", "part"]).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def confusable(rows: DataFrame, name: str, mark: str) -> DataFrame:
    """Names borne with several identity numbers, with the first two: pairs that must not be merged."""
    return (
        rows.where(F.col(name).isNotNull() & F.col(mark).isNotNull())
        .groupBy(F.col(name).alias("name"))
        .agg(F.sort_array(F.collect_set(mark)).alias("m"))
        .where(F.size("m") > 1)
        .select("name", F.col("m")[0].alias("first"), F.col("m")[1].alias("second"))
    )


def prefix_contaminated(names: DataFrame, name: str) -> DataFrame:
    """Names of three or more words whose words but the last occur strictly more often as a name of their own."""
    per = names.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    words = F.split("name", " ")
    longer = per.where(F.size(words) >= 3).select("name", "n", F.array_join(F.slice(words, 1, F.size(words) - 1), " ").alias("prefix"))
    return longer.join(per.select(F.col("name").alias("prefix"), F.col("n").alias("pn")), "prefix").where("pn > n").select("name", "prefix")


def recall_mrr(ranked: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """Recall@k and mean reciprocal rank over the queries with an expectation: ``ranked(query, item, rank)``, ``expected(query, item)``."""
    hits = ranked.join(expected, ["query", "item"]).groupBy("query").agg(F.min("rank").alias("first"))
    per = expected.select("query").distinct().join(hits, "query", "left")
    return per.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.coalesce((F.col("first") <= k).cast("int"), F.lit(0))), 6).alias("recall"),
        F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
    )

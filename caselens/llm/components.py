"""Problem 2: groups of records from pairwise links (connected components by seed-tree pruning).

Vertices point their neighbourhood at its minimum; a vertex that is nobody's minimum leaves the graph and hangs
below its minimum in a propagation forest; when no edge is left, the remaining vertices are the seeds, and their
identifiers flow down the forest, youngest level first. Every round is a few aggregations and equi-joins on the
vertex, so a vertex with a third of all links costs no more per task than any other (see ``_with_min``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.operators.skew import hot_join
from caselens.session import Scratch


def _with_min(pairs: DataFrame, mins: DataFrame, n_pairs: int, hot_share: int) -> DataFrame:
    """``pairs(k, x)`` joined with ``mins(k, m, deg)``.

    Keys with more than ``n_pairs / hot_share`` pairs are fewer than ``hot_share``; their rows of ``mins`` are
    broadcast (a proven bound), so that no task gathers a hot key. The other keys are joined by a shuffle.
    """
    limit = max(n_pairs // hot_share, 10_000)
    if n_pairs <= limit:
        return pairs.join(mins.select("k", "m"), "k")
    hot = F.broadcast(mins.where(F.col("deg") > limit).select("k", F.col("m").alias("hm")))
    tagged = pairs.join(hot, "k", "left")
    return (
        tagged.where(F.col("hm").isNotNull()).select("k", "x", F.col("hm").alias("m"))
    ).unionByName(
        tagged.where(F.col("hm").isNull()).select("k", "x").join(mins.where(F.col("deg") <= limit).select("k", "m"), "k")
    )


def connected_components(links: DataFrame, src: str = "src", dst: str = "dst", hot_share: int = 1000, max_rounds: int = 60) -> DataFrame:
    """One row ``(id, group_id)`` per non-null value of ``src`` or ``dst``; ``group_id`` is the group's smallest id.

    Links are undirected; repeated links, links of a record with itself and links with an empty side are allowed
    (an empty side links nothing, the other side still comes out). An empty input gives an empty result. Extra
    columns of ``links`` are ignored. Ids compare by code point (bytes).
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "components")
    base = scratch.save(links.select(F.col(src).alias("k"), F.col(dst).alias("x")).distinct(), "links")
    both = base.where("k is not null and x is not null and k <> x")
    edges = scratch.save(both.unionByName(both.select(F.col("x").alias("k"), F.col("k").alias("x"))).distinct(), "edges")
    levels: list[DataFrame] = []
    for _ in range(max_rounds):
        n = edges.count()
        if n == 0:
            break
        # the minimum of every closed neighbourhood, told to the whole neighbourhood
        mins = edges.groupBy("k").agg(F.min("x").alias("mx"), F.count(F.lit(1)).alias("deg"))
        mins = scratch.save(mins.select("k", F.least("k", "mx").alias("m"), "deg"), "mins")
        told = _with_min(edges, mins, n, hot_share).select(F.col("x").alias("k"), F.col("m").alias("x"))
        told = scratch.save(told.unionByName(mins.select("k", F.col("m").alias("x"))).distinct(), "told")
        # vertices that nobody chose drop out below their own minimum; the minima stay connected to each other
        chosen = told.groupBy("k").agg(
            F.min("x").alias("m"), F.count(F.lit(1)).alias("deg"), F.max(F.col("x") == F.col("k")).alias("kept")
        )
        chosen = scratch.save(chosen, "chosen")
        levels.append(chosen.where(~F.col("kept")).select(F.col("k").alias("id"), F.col("m").alias("parent")))
        nxt = _with_min(told, chosen, told.count(), hot_share).where("x <> m").select(F.col("x").alias("k"), F.col("m").alias("x"))
        nxt = scratch.save(nxt.unionByName(nxt.select(F.col("x").alias("k"), F.col("k").alias("x"))).distinct(), "edges")
        scratch.drop(edges, mins, told)
        edges = nxt
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")

    # seeds flow down: a level's parents are seeds or dropped out later
    labels: DataFrame | None = None
    for level in reversed(levels):
        if labels is None:
            new = level.select("id", F.col("parent").alias("group_id"))
        else:
            up = labels.select(F.col("id").alias("parent"), F.col("group_id").alias("g"))
            new = hot_join(level, up, "parent", "left").select("id", F.coalesce("g", "parent").alias("group_id"))
        new = scratch.save(new, "labels")
        labels = new if labels is None else labels.unionByName(new)
    ids = base.select(F.explode(F.array("k", "x")).alias("id")).where("id is not null").distinct()
    if labels is None:
        return ids.select("id", F.col("id").alias("group_id"))
    return ids.join(labels, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))

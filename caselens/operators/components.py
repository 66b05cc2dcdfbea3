"""Groups of linked records for the graph and the review queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.operators.skew import hot_join
from caselens.session import Scratch


def connected_components(links: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """One row ``(id, group_id)`` per non-null value of ``src`` or ``dst``; ``group_id`` is the smallest linked id.

    Every record hangs below the least record it knows of; in each round neighbours of a record are linked to that
    least one, and chains are halved, until nothing changes. Repeated links, links with oneself and links with an
    empty side are allowed; the other side still comes out.
    """
    scratch = Scratch(links.sparkSession, "groups")
    base = scratch.save(links.select(F.col(src).alias("a"), F.col(dst).alias("b")).distinct(), "links")
    ids = base.select(F.explode(F.array("a", "b")).alias("id")).where("id is not null").distinct()
    edges = base.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("k"), F.least("a", "b").alias("x")).distinct()
    edges = scratch.save(edges, "edges")
    if edges.limit(1).count() == 0:
        return ids.select("id", F.col("id").alias("group_id"))
    for _ in range(max_rounds):
        # every larger neighbour of a record, and the record itself, is linked to the least of its neighbourhood
        both = edges.unionByName(edges.select(F.col("x").alias("k"), F.col("k").alias("x")))
        least = both.groupBy("k").agg(F.min("x").alias("m")).select("k", F.least("k", "m").alias("m"))
        spread = hot_join(both, least, "k").where("x > k").select(F.col("x").alias("k"), F.col("m").alias("x"))
        large = scratch.save(spread.unionByName(least.where("m < k").select("k", F.col("m").alias("x"))).where("k <> x").distinct(), "large")
        # every smaller neighbour is linked to the least one
        least = large.groupBy("k").agg(F.min("x").alias("m"))
        down = hot_join(large, least, "k").where("x > m").select(F.col("x").alias("k"), F.col("m").alias("x"))
        small = scratch.save(down.unionByName(least.select("k", F.col("m").alias("x"))).distinct(), "small")
        same = small.count() == edges.count() and small.join(edges, ["k", "x"], "left_anti").limit(1).count() == 0
        scratch.drop(edges, large)
        edges = small
        if same:
            return ids.join(edges.groupBy(F.col("k").alias("id")).agg(F.min("x").alias("group_id")), "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")

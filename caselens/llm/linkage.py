"""Average-linkage clustering of the groups that pairwise links make, from the links alone.

Two clusters' similarity is the mean over all pairs between them, where a pair without a link counts ``missing``; so
only links are ever held, never a matrix. Groups with few links are clustered each in one call; a group with more
links than one task should hold is merged in Spark rounds, in which all pairs of clusters that are each other's
nearest merge at once. Average linkage is reducible (a merger brings nobody nearer), so both ways merge the same
clusters.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.llm.components import connected_components
from caselens.operators.clustering import map_groups
from caselens.operators.skew import hot_join
from caselens.session import Scratch


def average_linkage(links: list[tuple], threshold: float, missing: float = 0.0) -> dict:
    """The cluster of every end of ``links(a, b, similarity)``, named by its smallest member; each pair stands once.

    The two clusters of largest mean similarity merge while it is at least ``threshold``, which must be over
    ``missing``; ties take the smallest names, so the order of the links does not matter.
    """
    near: dict = {}
    for a, b, s in links:
        near.setdefault(a, {})[b] = (s, 1)
        near.setdefault(b, {})[a] = (s, 1)
    size = dict.fromkeys(near, 1)
    into = {v: v for v in near}

    def mean(a, b) -> float:  # noqa: ANN001
        s, n = near[a][b]
        whole = size[a] * size[b]
        return (s + missing * (whole - n)) / whole

    heap = [(-s, a, b) if a < b else (-s, b, a) for a, b, s in links if s >= threshold]
    heapq.heapify(heap)
    while heap:
        m, a, b = heapq.heappop(heap)
        # a later merger of either end has made the entry stale, or the mean would be the same
        if into[a] != a or into[b] != b or mean(a, b) != -m:
            continue
        into[b] = a
        size[a] += size[b]
        del near[a][b]
        for c, (s, n) in near.pop(b).items():
            if c == a:
                continue
            t, k = near[a].get(c, (0.0, 0))
            near[a][c] = near[c][a] = (s + t, n + k)
            del near[c][b]
        for c in near[a]:
            m = mean(a, c)
            if m >= threshold:
                heapq.heappush(heap, (-m, a, c) if a < c else (-m, c, a))

    def root(v):  # noqa: ANN001, ANN202
        while into[v] != v:
            into[v] = into[into[v]]
            v = into[v]
        return v

    return {v: root(v) for v in into}


def merge_rounds(links: DataFrame, threshold: float, missing: float = 0.0, max_rounds: int = 200) -> DataFrame:
    """``average_linkage`` of ``links(a, b, s)`` in Spark rounds: ``(id, cluster)`` for every end."""
    scratch = Scratch(links.sparkSession, "linkage")
    edges = scratch.save(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("s").alias("t"), F.lit(1).cast("long").alias("n")), "edges")
    ids = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    label = scratch.save(ids.select("id", F.col("id").alias("cluster"), F.lit(1).cast("long").alias("size")), "label")
    for _ in range(max_rounds):
        size = label.groupBy(F.col("cluster").alias("k")).agg(F.sum("size").alias("size"))
        e = hot_join(edges.withColumnRenamed("a", "k"), size.withColumnRenamed("size", "na"), "k").withColumnRenamed("k", "a")
        e = hot_join(e.withColumnRenamed("b", "k"), size.withColumnRenamed("size", "nb"), "k").withColumnRenamed("k", "b")
        whole = F.col("na") * F.col("nb")
        e = e.withColumn("m", (F.col("t") + missing * (whole - F.col("n"))) / whole).where(F.col("m") >= threshold)
        # one order of all pairs: mean, then the smallest names
        rank = F.struct((-F.col("m")).alias("m"), "a", "b")
        both = e.select(F.col("a").alias("v"), rank.alias("r")).unionByName(e.select(F.col("b").alias("v"), rank.alias("r")))
        best = both.groupBy("v").agg(F.min("r").alias("r")).select("r.a", "r.b")
        pairs = scratch.save(best.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("a", "b"), "pairs")
        if pairs.limit(1).count() == 0:
            return label.select("id", "cluster")
        move = pairs.select(F.col("b").alias("k"), F.col("a").alias("to"))

        def moved(df: DataFrame, c: str) -> DataFrame:
            j = hot_join(df.withColumnRenamed(c, "k"), move, "k", "left")
            return j.withColumn(c, F.coalesce("to", "k")).drop("k", "to")

        nxt = moved(moved(edges, "a"), "b").where("a <> b")
        nxt = nxt.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
        nxt, now = scratch.save(nxt, "edges"), scratch.save(moved(label, "cluster"), "label")
        scratch.drop(edges, label)
        edges, label = nxt, now
    raise RuntimeError(f"still merging after {max_rounds} rounds")


def cluster_links(links: DataFrame, threshold: float, missing: float = 0.0, held: int = 200_000) -> DataFrame:
    """``(id, cluster)`` for every end of ``links(a, b, s)``, each unordered pair once.

    A task holds the links of one group if they are at most ``held``; larger groups are merged in rounds, to the same
    clusters. Empty links give an empty result.
    """
    scratch = Scratch(links.sparkSession, "clusters")
    links = scratch.save(links.select("a", "b", "s"), "links")
    groups = connected_components(links, "a", "b").select(F.col("id").alias("k"), F.col("group_id").alias("g"))
    e = scratch.save(hot_join(links.withColumnRenamed("a", "k"), groups, "k").withColumnRenamed("k", "a"), "grouped")
    large = e.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > held).select("g")
    large = scratch.save(large, "large")
    kind = dict(links.dtypes)["a"]
    schema = f"id {kind}, cluster {kind}"

    def one(rows: list[tuple]) -> list[tuple]:
        return list(average_linkage([(r[0], r[1], r[2]) for r in rows], threshold, missing).items())

    # groups over ``held`` are fewer than links / held
    big = e.join(F.broadcast(large), "g", "left_semi").select("a", "b", "s")
    few = e.join(F.broadcast(large), "g", "left_anti").select("a", "b", "s", "g")
    out = map_groups(few, "g", ["a", "b"], one, schema)
    return out if large.limit(1).count() == 0 else out.unionByName(merge_rounds(big, threshold, missing))


def same_cluster_pairs(linked: DataFrame, record: str = "record", cluster: str = "cluster", at_once: int = 1000) -> DataFrame:
    """``(record_a, record_b)``: all pairs of records of a cluster, smaller key first, each once.

    The records of a cluster are dealt to one part per ``at_once`` of them, and every part meets the whole cluster in
    a task of its own.
    """
    scratch = Scratch(linked.sparkSession, "pairs")
    m = scratch.save(linked.select(F.col(cluster).alias("c"), F.col(record).alias("record")).where("c is not null and record is not null").distinct(), "members")
    sizes = m.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / at_once).alias("parts"))
    m = hot_join(m, sizes.where("parts > 1"), "c", "left").select("c", "record", F.coalesce("parts", F.lit(1).cast("long")).alias("parts"))
    a = m.select("c", F.pmod(F.xxhash64("record"), F.col("parts")).alias("part"), F.col("record").alias("record_a"))
    b = m.select("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("record").alias("record_b"))
    return a.join(b, ["c", "part"]).where("record_a < record_b").select("record_a", "record_b").distinct()

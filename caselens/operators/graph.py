"""Versioned property graph: current state, history, bounded traversal, communities, conflicts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.operators.components import connected_components
from caselens.session import Scratch


def current(edges: DataFrame) -> DataFrame:
    """Edges nothing supersedes."""
    return edges.where(F.col("superseded_by").isNull())


def append_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """``new(edge_id, src, dst, supersedes)`` with a status: written, or refused because an end is missing or the
    superseded edge is unknown, locked, superseded already, or claimed by another new edge."""
    known = nodes.select("node").distinct()
    n = new.join(known.select(F.col("node").alias("src"), F.lit(True).alias("s_ok")), "src", "left").join(known.select(F.col("node").alias("dst"), F.lit(True).alias("d_ok")), "dst", "left")
    old = edges.select(F.col("edge_id").alias("supersedes"), F.col("superseded_by").alias("by"), F.coalesce("locked", F.lit(False)).alias("locked"), F.lit(True).alias("known"))
    first = new.where("supersedes is not null").groupBy("supersedes").agg(F.min("edge_id").alias("first"))
    n = n.join(old, "supersedes", "left").join(first, "supersedes", "left")
    status = (
        F.when(F.col("s_ok").isNull() | F.col("d_ok").isNull(), "missing_end")
        .when(F.col("supersedes").isNull(), "written")
        .when(F.col("known").isNull(), "unknown_prior")
        .when(F.col("locked"), "locked")
        .when(F.col("by").isNotNull() | (F.col("edge_id") != F.col("first")), "already_superseded")
        .otherwise("written")
    )
    return n.select("edge_id", "src", "dst", "supersedes", status.alias("status"))


def history(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``(edge_id, newest, versions)``: the end of each edge's chain of versions, by doubling the pointers until none
    moves. A chain that runs in a circle has no end and raises."""
    scratch = Scratch(edges.sparkSession, "history")
    p = scratch.save(edges.select("edge_id", F.coalesce("superseded_by", "edge_id").alias("to"), F.when(F.col("superseded_by").isNull(), 0).otherwise(1).alias("n")), "p")
    for _ in range(max_rounds):
        nxt = p.join(p.select(F.col("edge_id").alias("to"), F.col("to").alias("to2"), F.col("n").alias("n2")), "to", "left")
        nxt = scratch.save(nxt.select("edge_id", F.coalesce("to2", "to").alias("to"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n")), "p")
        before = p.select("edge_id", F.col("to").alias("was"))
        if nxt.join(before, "edge_id").where("to <> was").limit(1).count() == 0:
            return nxt.select("edge_id", F.col("to").alias("newest"), (F.col("n") + 1).alias("versions"))
        p = nxt
    raise RuntimeError(f"no fixed point after {max_rounds} rounds: versions run in a circle")


def canonical(same_as: DataFrame) -> DataFrame:
    """``(id, canonical)`` from confirmed identities ``(a, b)``."""
    return connected_components(same_as, "a", "b").select("id", F.col("group_id").alias("canonical"))


def traverse(seeds: DataFrame, edges: DataFrame, hops: int = 2, allowed: DataFrame | None = None, pending_cap: float = 0.80) -> DataFrame:
    """``(node, hop, confidence)`` reached from ``seeds(node)`` over ``edges(a, b, kind, confidence)`` within ``hops`` <= 3.

    ``same`` edges keep hop and confidence, ``pending`` ones keep the hop and cap the confidence, ``associated`` ones
    add a hop and multiply it. Of several ways the one with fewest hops, then the surest counts. ``allowed(node)``
    limits every step, also over identities; None does not narrow.
    """
    if not 0 <= hops <= 3:
        raise ValueError("hops must be 0 to 3")
    scratch = Scratch(seeds.sparkSession, "traverse")
    e = edges.where("a is not null and b is not null and a <> b").select("a", "b", "kind", F.coalesce("confidence", F.lit(1.0)).alias("c"))
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "kind", "c"))
    both = scratch.save(both.groupBy("a", "b", "kind").agg(F.max("c").alias("c")), "edges")
    limit = (lambda df: df) if allowed is None else (lambda df: df.join(allowed.select("node").distinct(), "node", "left_semi"))
    seen = scratch.save(limit(seeds.select("node").distinct()).select("node", F.lit(0).alias("hop"), F.lit(1.0).alias("confidence")), "seen")

    def fold(frontier: DataFrame) -> DataFrame:
        f = frontier.withColumnRenamed("node", "a").join(both.where("kind <> 'associated'"), "a")
        c = F.when(F.col("kind") == "pending", F.least("confidence", F.lit(pending_cap))).otherwise(F.col("confidence"))
        return f.select(F.col("b").alias("node"), "hop", c.alias("confidence"))

    def merge(new: DataFrame) -> DataFrame:
        x = seen.unionByName(limit(new))
        return scratch.save(x.groupBy("node").agg(F.min(F.struct("hop", (-F.col("confidence")).alias("c"))).alias("m")).select("node", "m.hop", (-F.col("m.c")).alias("confidence")), "seen")

    seen = merge(fold(seen))
    for h in range(1, hops + 1):
        f = seen.where(F.col("hop") == h - 1).withColumnRenamed("node", "a").join(both.where("kind = 'associated'"), "a")
        seen = merge(f.select(F.col("b").alias("node"), F.lit(h).alias("hop"), (F.col("confidence") * F.col("c")).alias("confidence")))
        seen = merge(fold(seen.where(F.col("hop") == h)))
    return seen.select("node", "hop", F.round("confidence", 6).alias("confidence"))


def unconfirmed(pending: DataFrame, visited: DataFrame) -> DataFrame:
    """Open identities that touch visited nodes, each unordered pair once."""
    p = pending.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    v = visited.select("node").distinct()
    left = p.join(v.withColumnRenamed("node", "a"), "a", "left_semi")
    return left.unionByName(p.join(v.withColumnRenamed("node", "b"), "b", "left_semi")).select("a", "b").distinct()


def louvain(edges: list[tuple[str, str, float]], seed: int = 42) -> dict[str, str]:
    """Communities of one weighted graph by modularity: local moves in a seeded order, then the graph of communities,
    until nothing improves. Named by their smallest member."""
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    at = {x: i for i, x in enumerate(nodes)}
    member = np.arange(len(nodes))
    links = [(at[a], at[b], w) for a, b, w in edges if w > 0]
    rng = np.random.default_rng(seed)
    n = len(nodes)
    while True:
        near: list[dict[int, float]] = [{} for _ in range(n)]
        loops = np.zeros(n)
        for a, b, w in links:
            if a == b:
                loops[a] += w
            else:
                near[a][b] = near[a].get(b, 0) + w
                near[b][a] = near[b].get(a, 0) + w
        deg = np.array([sum(x.values()) for x in near]) + 2 * loops
        m2 = deg.sum()
        if m2 == 0:
            break
        com, tot = np.arange(n), deg.copy()
        moved_any = True
        improved = False
        while moved_any:
            moved_any = False
            for v in rng.permutation(n).tolist():
                own = com[v]
                tot[own] -= deg[v]
                gain = {own: 0.0}
                for u, w in near[v].items():
                    gain[com[u]] = gain.get(com[u], 0.0) + w
                best = max(sorted(gain), key=lambda c: (gain[c] - tot[c] * deg[v] / m2, c == own))
                if gain[best] - tot[best] * deg[v] / m2 <= gain[own] - tot[own] * deg[v] / m2 + 1e-12:
                    best = own
                tot[best] += deg[v]
                if best != own:
                    com[v] = best
                    moved_any = improved = True
        if not improved:
            break
        names = {c: i for i, c in enumerate(sorted(set(com.tolist())))}
        com = np.array([names[c] for c in com.tolist()])
        member = com[member]
        merged: dict[tuple[int, int], float] = {}
        for a, b, w in links:
            k = (min(com[a], com[b]), max(com[a], com[b]))
            merged[k] = merged.get(k, 0.0) + w
        links, n = [(a, b, w) for (a, b), w in merged.items()], len(names)
    first: dict[int, str] = {}
    for x, c in zip(nodes, member.tolist()):
        first.setdefault(c, x)
    return {x: first[c] for x, c in zip(nodes, member.tolist())}


def communities(weights: DataFrame, largest: int = 200_000, max_rounds: int = 100) -> DataFrame:
    """``(id, community)`` from ``(a, b, weight)``: Louvain within each connected component of up to ``largest`` edges;
    larger components, which no single task should hold, by weighted label propagation over all workers until no label
    changes in two rounds (or ``max_rounds`` are over: labels may go on changing places)."""
    spark = weights.sparkSession
    scratch = Scratch(spark, "communities")
    w = scratch.save(weights.where("a <> b and weight > 0").select("a", "b", "weight"), "w")
    comp = scratch.save(connected_components(w, "a", "b"), "comp")
    e = w.join(comp.select(F.col("id").alias("a"), "group_id"), "a")
    sizes = e.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        got = louvain(sorted(zip(pdf["a"], pdf["b"], pdf["weight"])))
        return pd.DataFrame({"id": list(got), "community": list(got.values())})

    small = e.join(sizes.where(F.col("n") <= largest), "group_id", "left_semi").groupBy("group_id").applyInPandas(local, "id string, community string")
    big = scratch.save(e.join(sizes.where(F.col("n") > largest), "group_id", "left_semi").select("a", "b", "weight"), "big")
    if big.limit(1).count() == 0:
        return small
    both = scratch.save(big.unionByName(big.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")), "both")
    label = scratch.save(both.select(F.col("a").alias("id")).distinct().withColumn("community", F.col("id")), "label")
    still = 0
    for k in range(max_rounds):
        votes = both.join(label.select(F.col("id").alias("b"), "community"), "b").groupBy("a", "community").agg(F.sum("weight").alias("s"))
        # of equally strong labels the own one stays
        own = votes.join(label.select(F.col("id").alias("a"), F.col("community").alias("own")), "a")
        win = own.groupBy(F.col("a").alias("id")).agg(F.max_by("community", F.struct("s", F.col("community") == F.col("own"), "community")).alias("won"))
        # half of the vertices move in each round, so that two neighbours don't swap for ever
        turn = F.pmod(F.xxhash64("id"), F.lit(2)) == k % 2
        nxt = scratch.save(label.join(win, "id").select("id", F.when(turn, F.col("won")).otherwise(F.col("community")).alias("community"), F.col("community").alias("was")), "label")
        still = still + 1 if nxt.where("community <> was").limit(1).count() == 0 else 0
        label = nxt.select("id", "community")
        if still == 2:
            break
    return small.unionByName(label)


def date_conflicts(incidents: DataFrame, case: str, incident: str, date: str) -> DataFrame:
    """Incidents with more than one date in cases with two or more incident rows: ``(case, incident, dates)``."""
    d = incidents.where(F.col(case).isNotNull() & F.col(incident).isNotNull())
    rows = d.groupBy(F.col(case).alias("c")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("c")
    per = d.groupBy(F.col(case).alias("c"), F.col(incident).alias("incident")).agg(F.sort_array(F.collect_set(date)).alias("dates"))
    return per.where(F.size("dates") > 1).join(rows, "c", "left_semi").select(F.col("c").alias("case_id"), "incident", "dates")


def conflict_state(conflict: Column, checked: Column) -> Column:
    """CONFLICT, NONE only where the case was checked, else UNKNOWN."""
    return F.when(conflict, "CONFLICT").when(checked.isNotNull(), "NONE").otherwise("UNKNOWN")


def display(*names: Column) -> Column:
    """The first name that is not empty."""
    return F.coalesce(*[F.nullif(n, F.lit("")) for n in names])

"""Problem 9: items of varying size in containers of fixed capacities, by vector best fit.

A container has three capacities: tokens, documents and attention cost (the sum of squared sizes). Items go, largest
first, into the open container that has room in every dimension and, with the item in it, the least weighted norm of
what is left; if none has room a new one is opened. Items are dealt to groups of bounded size by a hash of their key,
each group is packed by one task, so the work grows with the items and a group wastes at most about one container.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.session import Scratch

#: Weights of what is left of tokens, documents and attention cost.
WEIGHTS = (1.0, 0.02, 0.1)
#: Share of a capacity squared that the cost of a container may reach: one long item leaves less of it than of tokens.
COST = 0.9


def vector_best_fit(sizes: np.ndarray, capacity: int, max_items: int, max_cost: float, weights=WEIGHTS) -> np.ndarray:
    """Container number of each item; ``sizes`` (at most ``capacity`` each, largest first) are packed in order."""
    n = len(sizes)
    where = np.empty(n, dtype=np.int64)
    tokens, items, cost = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64), np.empty(n)  # room left where open
    label = np.empty(n, dtype=np.int64)
    w_tokens, w_items, w_cost = weights[0] / capacity**2, weights[1] / max_items**2, weights[2] / max_cost**2
    smallest = int(sizes[-1]) if n else 0
    opened = used = 0
    for k, size in enumerate(sizes.tolist()):
        square = float(size) * size
        at = np.flatnonzero(tokens[:opened] >= size)
        if len(at):
            at = at[(items[at] > 0) & (cost[at] >= square)]
        if len(at):
            norm = w_tokens * (tokens[at] - size) ** 2.0 + w_items * (items[at] - 1) ** 2.0 + w_cost * (cost[at] - square) ** 2
            j = at[norm.argmin()]
        else:
            j = opened
            tokens[j], items[j], cost[j], label[j] = capacity, max_items, max_cost, used
            used += 1
            opened += 1
        tokens[j] -= size
        items[j] -= 1
        cost[j] -= square
        where[k] = label[j]
        # a container without room for the smallest item is closed: the last one takes its place
        if tokens[j] < smallest or items[j] < 1 or cost[j] < float(smallest) ** 2:
            opened -= 1
            tokens[j], items[j], cost[j], label[j] = tokens[opened], items[opened], cost[opened], label[opened]
    return where


_OUT = "window_id int, container_id string, doc_id bigint, piece_no int, token_start bigint, tokens bigint"


def _pack(limits: dict[int, tuple[int, int, float]], key, pdf: pd.DataFrame) -> pd.DataFrame:
    window, group = int(key[0]), int(key[1])
    capacity, max_items, max_cost = limits[window]
    pdf = pdf.sort_values(["tokens", "doc_id", "piece_no"], ascending=[False, True, True], kind="stable")
    where = vector_best_fit(pdf["tokens"].to_numpy(dtype=np.int64), capacity, max_items, max_cost)
    pdf["container_id"] = [f"{window}-{group}-{w}" for w in where]
    return pdf[["window_id", "container_id", "doc_id", "piece_no", "token_start", "tokens"]]


def pack(
    items: DataFrame,
    capacities: dict[int, int],
    key: str = "doc_id",
    size: str = "tokens",
    max_items: int = 256,
    max_cost: dict[int, float] | None = None,
    group_items: int = 4096,
) -> DataFrame:
    """``(window_id, container_id, doc_id, piece_no, token_start, tokens)``: every item in a container of each window.

    ``capacities`` maps window ids to token capacities. An item larger than a capacity is cut into pieces of exactly
    the capacity and a rest (piece_no from 1, token_start the place in the item); every other item is one piece,
    items of size 0 included. Null sizes count as 0, null keys are packed like any other, repeated rows are separate
    items. ``max_items`` and ``max_cost`` are the other two capacities; the cost of a container is the sum of its
    items' squares (what attention within items costs), by default at most ``COST`` of the capacity squared. An item
    whose square is over it has a container of its own.
    """
    max_cost = max_cost or {}
    limits = {w: (int(c), max_items, float(max_cost.get(w, COST * c * c))) for w, c in capacities.items()}
    if not limits or min(c for c, _, _ in limits.values()) < 1:
        raise ValueError("capacities must be positive")
    base = items.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"))
    base = Scratch(items.sparkSession, "packing").save(base, "sizes")  # sizes are dear: measured once, read three times
    groups = max(1, math.ceil(base.count() / group_items))
    each = F.array(*[F.struct(F.lit(w).alias("window_id"), F.lit(c).cast("long").alias("capacity")) for w, (c, _, _) in sorted(limits.items())])
    cut = base.withColumn("w", F.explode(each)).select("doc_id", "size", "w.window_id", "w.capacity")
    pieces = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("capacity"))).cast("int"))
    cut = cut.select("window_id", "doc_id", "size", "capacity", F.explode(pieces).alias("piece_no"))
    cut = cut.withColumn("token_start", (F.col("piece_no") - 1) * F.col("capacity")).withColumn(
        "tokens", F.least("capacity", F.col("size") - F.col("token_start"))
    )
    names = ["window_id", "container_id", "doc_id", "piece_no", "token_start", "tokens"]
    exact = (F.col("tokens") == F.col("capacity")) & (F.col("size") > F.col("capacity"))
    # full pieces fill a container each; the others are dealt to groups
    filled = cut.where(exact).withColumn("container_id", F.format_string("%d-whole-%s-%d", "window_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "piece_no"))
    rest = cut.where(~exact).withColumn("g", F.pmod(F.xxhash64("doc_id", "size"), F.lit(groups)))
    packed = (
        rest.select("window_id", "doc_id", "piece_no", "token_start", "tokens", "g")
        .groupBy("window_id", "g")
        .applyInPandas(lambda k, pdf: _pack(limits, k, pdf), _OUT)
    )
    return filled.select(*names).unionByName(packed)


def fill(packed: DataFrame, capacities: dict[int, int], max_items: int = 256) -> DataFrame:
    """Per window: containers, pieces, tokens, and the share of each capacity that is used (tokens, documents, cost)."""
    cap = F.create_map(*[F.lit(x) for w, c in sorted(capacities.items()) for x in (w, c)])[F.col("window_id")]
    each = packed.groupBy("window_id", "container_id").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"), F.sum(F.col("tokens") * F.col("tokens")).alias("c"))
    per = each.groupBy("window_id").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("n").alias("pieces"), F.sum("t").alias("tokens"), F.sum("c").alias("cost")
    )
    share = lambda x, most: F.round(F.col(x) / (F.col("containers") * most), 6)
    return per.select(
        "window_id", "containers", "pieces", "tokens",
        share("tokens", cap).alias("fill"), share("pieces", F.lit(max_items)).alias("fill_documents"), share("cost", COST * cap * cap).alias("fill_cost"),
    )


def windows(table: DataFrame) -> dict[int, int]:
    """The capacities of a table of windows, as ``pack`` takes them; a bounded table (three rows)."""
    rows: Iterator = table.select("window_id", "capacity_tokens").where("window_id is not null and capacity_tokens > 0").distinct().toLocalIterator()
    return {int(r[0]): int(r[1]) for r in rows}

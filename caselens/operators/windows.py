"""Rankings, caps, budgets and chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def case_cap(rows: DataFrame, case: str, score: str, tie: str, per_case: int = 5, total: int = 15) -> DataFrame:
    """The best ``per_case`` rows of each case (no case is a case), of those the best ``total``; none for ``total`` <= 0."""
    if total <= 0:
        return rows.limit(0)
    n = F.row_number().over(W.partitionBy(case).orderBy(F.desc(score), tie))
    return rows.withColumn("_n", n).where(F.col("_n") <= per_case).drop("_n").orderBy(F.desc(score), tie).limit(total)


def supersede_chain(rows: DataFrame, key: list[str], order: list[Column], id_: str) -> DataFrame:
    """Each version is superseded by the next of its key: adds ``superseded_by``."""
    return rows.withColumn("superseded_by", F.lead(id_).over(W.partitionBy(*key).orderBy(*order)))


def best_candidate(pairs: DataFrame, mention: str, score: str, tie: str) -> DataFrame:
    """The best-scored candidate of each mention; ties take the smallest ``tie``. Aggregated before the shuffle, so a
    mention with very many candidates loads no task."""
    best = F.min_by(F.struct(*pairs.columns), F.struct((-F.col(score)).alias("s"), F.col(tie).alias("t")))
    return pairs.groupBy(F.col(mention).alias("_m")).agg(best.alias("_b")).select("_b.*")


def message_budget(messages: DataFrame, conversation: str, order: list[str], text: str, budget: int = 2000, keep: int = 2) -> DataFrame:
    """Oldest messages dropped two at a time while more than ``keep`` remain and the rest exceeds ``budget`` tokens
    (a token is four characters)."""
    new = W.partitionBy(conversation).orderBy(*[F.desc(c) for c in order])
    old = W.partitionBy(conversation).orderBy(*order)
    m = messages.withColumn("_rest", F.sum(F.length(F.coalesce(text, F.lit("")))).over(new.rowsBetween(W.unboundedPreceding, 0)))
    m = m.withColumn("_at", F.row_number().over(old) - 1).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(conversation)))
    fits = (F.col("_at") % 2 == 0) & ((F.floor(F.col("_rest") / 4) <= budget) | (F.col("_n") - F.col("_at") <= keep))
    m = m.withColumn("_cut", F.min(F.when(fits, F.col("_at"))).over(W.partitionBy(conversation)))
    return m.where(F.col("_at") >= F.coalesce("_cut", F.lit(0))).drop("_rest", "_at", "_n", "_cut")


def char_budget(rows: DataFrame, group: str, order: str, text: str, budget: int = 24_000) -> DataFrame:
    """Texts of a group in order, cut where their running length reaches ``budget``; texts beyond it are dropped."""
    over = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length(text)).over(over), F.lit(0))
    return rows.withColumn("_left", F.lit(budget) - used).where("_left > 0").withColumn(text, F.expr(f"substring({text}, 1, cast(_left as int))")).drop("_left")


def echoes(messages: DataFrame, conversation: str, order: list[str], role: str, text: str, least: int = 40, prefix: int = 80) -> DataFrame:
    """Messages of a user that echo any earlier answer of at least ``least`` characters in their conversation: one text
    holds the other, or both start with the same characters (``prefix`` of them or the shorter text, ``least`` or more).

    Cases are folded and blank texts echo nothing. ``order`` identifies a message in its conversation. Texts meet by ``least`` characters that the
    shorter one starts with; a shorter text of a user, which every answer may hold, meets the answers of its conversation.
    """
    at = F.struct(*order)
    said = messages.where((F.col(role) == "assistant") & (F.length(text) >= least)).groupBy(F.col(conversation).alias("c"), F.lower(text).alias("said")).agg(F.min(at).alias("said_at"))
    asked = messages.where((F.col(role) == "user") & F.col(text).isNotNull()).select(F.col(conversation).alias("c"), F.lower(F.trim(text)).alias("now"), at.alias("now_at")).where("now <> ''").distinct()
    # a window of ``least`` characters is known by the least hash of its grams, wherever it stands: neighbours share it
    gram = max(1, least // 5)
    span = least - gram + 1
    grams = lambda x, n: F.transform(F.sequence(F.lit(1), n), lambda k: F.xxhash64(F.substring(F.col(x), k, F.lit(gram))))
    start = lambda x: F.array_min(grams(x, F.lit(span)))
    windows = lambda x, g: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - least + 1), lambda k: F.array_min(F.slice(g, k, F.lit(span)))))
    every = lambda x: F.explode(F.transform(F.array(grams(x, F.length(x) - gram + 1)), lambda g: windows(x, g))[0])
    long = asked.where(F.length("now") >= least)
    holds = long.withColumn("h", every("now")).join(said.withColumn("h", start("said")), ["c", "h"]).where(F.col("now").contains(F.col("said")))
    held = long.withColumn("h", start("now")).join(said.withColumn("h", every("said")), ["c", "h"])
    n = F.least(F.length("now"), F.length("said"), F.lit(prefix))
    held = held.where(F.col("said").contains(F.col("now")) | (F.left("now", n) == F.left("said", n)))
    short = asked.where(F.length("now") < least).join(said, "c").where(F.col("said").contains(F.col("now")))
    hits = [x.where("said_at < now_at").select("c", "now_at") for x in (holds, held, short)]
    hits = hits[0].unionByName(hits[1]).unionByName(hits[2]).distinct().select(F.col("c").alias("_c"), F.col("now_at").alias("_at"))
    return messages.where(F.col(role) == "user").join(hits, (F.col(conversation) == F.col("_c")) & (at == F.col("_at")), "left_semi")


def timeline_order(raw: Column) -> list[Column]:
    """Parseable times first, in order; then the others by their text, no text last of all by being empty."""
    t = F.try_to_timestamp(raw)
    return [t.isNull().asc(), t.asc(), F.coalesce(raw, F.lit("")).asc()]


def union_first(lists: DataFrame, key: str, *order: str) -> DataFrame:
    """The first occurrence of each key over ranked lists."""
    n = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return lists.withColumn("_n", n).where("_n = 1").drop("_n")

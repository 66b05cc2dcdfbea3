"""Entity resolution against known entities, and the review queue of open matches."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from caselens.operators.clustering import map_groups
from caselens.operators.components import connected_components
from caselens.operators.skew import hot_join
from caselens.session import Scratch

# Thresholds of the tiers.
FLAG, FLAG_WITH_EVIDENCE, ADJUDICATE, REVIEW = 0.90, 0.75, 0.55, 0.40


def indel_ratio(a: str, b: str) -> float:
    """1 minus the share of characters to insert or delete: twice the longest common subsequence over both lengths."""
    if not a and not b:
        return 1.0
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b):
            cur.append(prev[j] + 1 if x == y else max(prev[j + 1], cur[j]))
        prev = cur
    return 2 * prev[-1] / (len(a) + len(b))


def token_sort_ratio(a: str | None, b: str | None) -> float:
    """``indel_ratio`` of two names with their words in order; 0 if either is missing."""
    if not a or not b:
        return 0.0
    return indel_ratio(" ".join(sorted(a.lower().split())), " ".join(sorted(b.lower().split())))


@F.pandas_udf(T.DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_sort_ratio(x, y) for x, y in zip(a, b)], dtype=float)


#: Names compared at a time, the most in a block of the left and of the right; names of more characters than a machine word are compared one by one.
NAMES_PER_BLOCK, MOST_LEFT, MOST_RIGHT, WORD = 256, 1024, 4096, 64
#: Buckets of characters and how many of a bucket are told apart in the bound on common characters.
_BUCKETS, _LEVELS = 32, 4


class _Names:
    """Names with their words in order, as code points, lengths and signatures of the characters they hold."""

    def __init__(self, names: list[str]):
        self.text = [" ".join(sorted(x.lower().split())) for x in names]
        self.given = np.array([x != "" for x in names], bool)
        self.size = np.array([len(x) for x in self.text], np.int32)
        width = min(WORD, int(self.size.max(initial=0)))
        self.points = np.array([x[:WORD] for x in self.text], f"U{max(width, 1)}").view(np.uint32).reshape(len(names), -1)
        held = np.arange(self.points.shape[1])[None, :] < self.size[:, None]
        i, k = np.nonzero(held)
        count = np.zeros((len(names), _BUCKETS), int)
        np.add.at(count, (i, self.points[i, k] % _BUCKETS), 1)
        bits = np.zeros((len(names), _BUCKETS * _LEVELS // 64), np.uint64)
        for level in range(_LEVELS):
            for c in range(_BUCKETS):
                at = level * _BUCKETS + c
                bits[:, at // 64] |= (count[:, c] > level).astype(np.uint64) << np.uint64(at % 64)
        self.bits = bits
        # what the signature does not tell: further characters of a bucket, and those past the word
        self.more = (np.maximum(count - _LEVELS, 0).sum(axis=1) + np.maximum(self.size - WORD, 0)).astype(np.int32)


def _ratios(left: list[str] | _Names, right: list[str] | _Names, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and ``token_sort_ratio`` of the pairs of two lists that reach ``least``: all of them."""
    a, b = (x if isinstance(x, _Names) else _Names(x) for x in (left, right))
    la, lb = a.size, b.size
    # characters in common, which are no fewer than those of the longest common subsequence, against those needed
    common = np.minimum(a.more[:, None], b.more[None, :])
    for w in range(a.bits.shape[1]):
        common += np.bitwise_count(a.bits[:, None, w] & b.bits[None, :, w])
    need = np.ceil(least * np.arange(la.max(initial=0) + lb.max(initial=0) + 1) / 2 - 1e-9).astype(np.int32)
    i, j = np.nonzero((common >= need[la[:, None] + lb[None, :]]) & a.given[:, None] & b.given[None, :])
    if not len(i):
        return i, j, np.zeros(0)
    chars, code = np.unique(a.points, return_inverse=True)
    code = code.reshape(a.points.shape)
    masks = np.zeros((len(chars) + 1, len(la)), np.uint64)  # the last row: characters that the left lacks
    for k in range(code.shape[1]):
        own = np.flatnonzero(la > k)
        masks[code[own, k], own] |= np.uint64(1 << k)
    text = np.searchsorted(chars, b.points)
    text[chars[np.minimum(text, len(chars) - 1)] != b.points] = len(chars)
    # longest common subsequences of all pairs at once: a bit of v that is 0 is a character matched
    if 8 * len(i) < common.size:
        order = np.argsort(-lb[j], kind="stable")
        i, j = i[order], j[order]
        v, size = np.full(len(i), ~np.uint64(0)), lb[j]
        for k in range(text.shape[1]):
            live = int(np.searchsorted(-size, -k, side="left"))  # names longer than k
            u = v[:live] & masks[text[j[:live], k], i[:live]]
            v[:live] = (v[:live] + u) | (v[:live] - u)
    else:
        order = np.argsort(-lb, kind="stable")
        grid = np.full((len(lb), len(la)), ~np.uint64(0))
        u, t = np.empty_like(grid), np.empty_like(grid)
        for k in range(text.shape[1]):
            live = int(np.searchsorted(-lb[order], -k, side="left"))
            g, x, y = grid[:live], u[:live], t[:live]
            np.take(masks, text[order[:live], k], axis=0, out=x)
            np.bitwise_and(g, x, out=x)
            np.add(g, x, out=y)
            np.subtract(g, x, out=g)
            np.bitwise_or(y, g, out=g)
        v = grid[np.argsort(order)[j], i]
    total = la[i] + lb[j]
    ratio = np.where(total == 0, 1.0, 2 * np.bitwise_count(~v).astype(int) / np.maximum(total, 1))
    for x in np.flatnonzero((la[i] > WORD) | (lb[j] > WORD)):
        ratio[x] = indel_ratio(a.text[i[x]], b.text[j[x]])
    found = ratio >= least
    return i[found], j[found], ratio[found]


def _pieces(rows: list) -> list[tuple[list, _Names]]:
    """Rows in pieces of names of alike length."""
    rows = sorted(rows, key=lambda x: len(x["name"]))
    pieces = [rows[c : c + NAMES_PER_BLOCK] for c in range(0, len(rows), NAMES_PER_BLOCK)]
    return [(p, _Names([x["name"] for x in p])) for p in pieces]


def _meet(left: DataFrame, right: DataFrame, least: float, emit, schema: str) -> DataFrame:  # noqa: ANN001
    """What ``emit(b, ls, rs, i, j, ratio)`` makes of all pairs of names of ``left(b, name, ...)`` and ``right(b, name, ...)``
    with equal ``b`` that reach ``least``; both have one row a name, ``i`` and ``j`` are places in the rows ``ls`` and ``rs``.

    Names are dealt by hash, blocks of the left to every block of the right, so no task holds more than two blocks at a
    time, whatever the share of one ``b``.
    """
    spark = left.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)

    def dealt(df: DataFrame, names: str, at: str, most: int) -> tuple[DataFrame, DataFrame]:
        n = F.count(F.lit(1))
        sizes = df.groupBy("b").agg(F.greatest(F.ceil(n / most), F.least(F.ceil(n / NAMES_PER_BLOCK), F.lit(parts))).alias("blocks"))
        df = df.join(sizes, "b").withColumn(at, F.pmod(F.xxhash64("name"), F.col("blocks")))
        return df.groupBy("b", at).agg(F.collect_list(F.struct(*[c for c in df.columns if c not in ("b", "blocks", at)])).alias(names)), sizes

    (ls, _), (rs, sizes) = dealt(left, "ls", "i", MOST_LEFT), dealt(right, "rs", "j", MOST_RIGHT)
    cells = ls.join(sizes, "b").withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = cells.repartition(parts, "b", "j").join(rs.repartition(parts, "b", "j"), ["b", "j"]).select("b", "ls", "rs")

    def run(batches):  # noqa: ANN001, ANN202
        last, rights = None, []
        for batch in batches:
            for k in range(batch.num_rows):  # one cell at a time becomes Python objects: a batch may hold a task's cells
                b, ls, rs = batch.slice(k, 1).to_pylist()[0].values()
                names = [x["name"] for x in rs]
                if names != last:  # blocks of the right come many times in a row
                    last, rights = names, _pieces(list(rs))
                for lp, ln in _pieces(list(ls)):
                    for rp, rn in rights:
                        low, high = sorted([(ln.size.min(), ln.size.max()), (rn.size.min(), rn.size.max())])
                        if 2 * low[1] >= least * (low[1] + high[0]) - 1e-9:  # lengths allow it
                            i, j, ratio = _ratios(ln, rn, least)
                            if len(i):
                                yield from (pa.RecordBatch.from_pandas(x, out, preserve_index=False) for x in emit(b, lp, rp, i, j, ratio))

    out = to_arrow_schema(T.StructType.fromDDL(schema))
    return cells.mapInArrow(run, schema)


def similar_names(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """``(b, l, r, similarity)``: all pairs of ``left(b, name)`` and ``right(b, name)`` with equal ``b`` whose
    ``token_sort_ratio`` is at least ``least`` (above 0), each once; see ``_meet``."""

    def emit(b, ls, rs, i, j, ratio):  # noqa: ANN001, ANN202
        ls, rs = np.array([x["name"] for x in ls], object), np.array([x["name"] for x in rs], object)
        yield pd.DataFrame({"b": str(b), "l": ls[i], "r": rs[j], "similarity": ratio})

    named = lambda df: df.select("b", "name").where("b is not null and name is not null").distinct()
    return _meet(named(left), named(right), least, emit, "b string, l string, r string, similarity double")


def exact_matches(mentions: DataFrame, entities: DataFrame, kind: str, value: str, mention: str = "mention_id", entity: str = "entity_id") -> DataFrame:
    """Mentions whose identifying value an entity of the kind has: confidence 1, tier by identifier."""
    m = mentions.select(mention, kind, value).where(F.col(value).isNotNull() & (F.col(value) != ""))
    e = entities.select(F.col(entity), kind, value).where(F.col(value).isNotNull())
    return m.join(e, [kind, value]).select(mention, entity, F.lit("exact_id").alias("tier"), F.lit(1.0).alias("confidence"))


def candidates(mentions: DataFrame, entities: DataFrame, block: str | None, name: str, mark: str, least: float = REVIEW, mention: str = "mention_id", entity: str = "entity_id") -> DataFrame:
    """``(mention, entity, similarity)``: all pairs of at least ``least``, of one block or, if that is None, of all.

    Entities with another identity number are never compared; without one (or an empty one) on either side they are.
    """
    def named(df: DataFrame, key: str, tag: str) -> DataFrame:
        b = F.lit("") if block is None else F.col(block).cast("string")
        return df.select(F.col(key).alias(f"{tag}_id"), b.alias("b"), F.col(name).alias("name"), F.nullif(F.col(mark), F.lit("")).alias(f"{tag}_mark")).where("b is not null and name is not null")

    m, e = named(mentions, mention, "m"), named(entities, entity, "e")
    def owned(df: DataFrame, tag: str) -> DataFrame:  # rows of a name travel with it: pairs are not joined with them again
        return df.where(F.col(f"{tag}_id").isNotNull()).groupBy("b", "name").agg(F.collect_list(F.struct(F.col(f"{tag}_id").alias("id"), F.col(f"{tag}_mark").alias("mark"))).alias("own"))

    def flat(names):  # noqa: ANN001, ANN202
        rows = [x for n in names for x in n["own"]]
        ids, marks = np.empty(len(rows), object), np.empty(len(rows), object)
        ids[:], marks[:] = [x["id"] for x in rows], [x["mark"] or "" for x in rows]
        size = np.array([len(n["own"]) for n in names], int)
        return ids, marks, size, np.cumsum(size) - size

    def emit(b, ls, rs, i, j, ratio):  # noqa: ANN001, ANN202
        (m_id, m_mark, m_size, m_at), (e_id, e_mark, e_size, e_at) = flat(ls), flat(rs)
        _, marks = np.unique(np.concatenate([[""], m_mark, e_mark]).astype(object), return_inverse=True)  # 0: none
        _, codes = np.unique(np.concatenate([m_id.astype(str), e_id.astype(str)]), return_inverse=True)
        m_mark, e_mark = marks[1 : 1 + len(m_id)], marks[1 + len(m_id) :]
        m_code, e_code = codes[: len(m_id)], codes[len(m_id) :]
        n = m_size[i] * e_size[j]
        for c in range(0, len(i), 65536):  # pairs of names as pairs of rows
            part = slice(c, c + 65536)
            nth = np.arange(n[part].sum()) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
            wide = np.repeat(e_size[j[part]], n[part])
            x, y = np.repeat(m_at[i[part]], n[part]) + nth // wide, np.repeat(e_at[j[part]], n[part]) + nth % wide
            ok = ((m_mark[x] == e_mark[y]) | (m_mark[x] == 0) | (e_mark[y] == 0)) & (m_code[x] != e_code[y])
            yield pd.DataFrame({"m_id": m_id[x[ok]], "e_id": e_id[y[ok]], "similarity": np.repeat(ratio[part], n[part])[ok]})

    keys = dict(m.dtypes)["m_id"], dict(e.dtypes)["e_id"]
    return _meet(owned(m, "m"), owned(e, "e"), least, emit, f"m_id {keys[0]}, e_id {keys[1]}, similarity double")


#: Entities that ``with_candidate`` tries first.
PROBES = 512


def with_candidate(mentions: DataFrame, entities: DataFrame, name: str, mark: str, least: float = REVIEW, mention: str = "mention_id", entity: str = "entity_id") -> DataFrame:
    """``(m_id)``: the mentions that have any candidate of at least ``least``, each once.

    A few entities without identity number are tried first; the mentions that none of those reaches are compared with
    all entities, so the answer is that of ``candidates``.
    """
    m = mentions.select(F.col(mention).alias("m_id"), F.col(name).alias("name"), F.col(mark).alias("mark")).where("m_id is not null and name is not null")
    free = entities.where(F.coalesce(F.col(mark), F.lit("")) == "").select(F.col(entity).alias("id"), F.col(name).alias("name")).where("id is not null and name is not null")
    probes = [(r["id"], r["name"]) for r in free.orderBy(F.xxhash64("name", "id"), "id").limit(PROBES).collect()]

    def reached(batches):  # noqa: ANN001, ANN202
        others = _Names([n for _, n in probes])
        for pdf in batches:
            for c in range(0, len(pdf), NAMES_PER_BLOCK):
                ids = pdf["m_id"].iloc[c : c + NAMES_PER_BLOCK].tolist()
                i, j, _ = _ratios(pdf["name"].iloc[c : c + NAMES_PER_BLOCK].tolist(), others, least)
                yield pd.DataFrame({"m_id": [*{ids[x] for x, y in zip(i.tolist(), j.tolist()) if ids[x] != probes[y][0]}]}, dtype=object)

    spark = mentions.sparkSession
    scratch = Scratch(spark, "reached")
    first = scratch.save(m.select("m_id", "name").repartition(4 * spark.sparkContext.defaultParallelism).mapInPandas(reached, f"m_id {dict(m.dtypes)['m_id']}").distinct(), "first")
    rest = m.join(first, "m_id", "left_anti")
    return first.unionByName(candidates(rest, entities.select(F.col(entity), F.col(name).alias("name"), F.col(mark).alias("mark")), None, "name", "mark", least, "m_id", entity).select("m_id").distinct())


def distinct_people(names: DataFrame, least: float = FLAG) -> DataFrame:
    """``(b, people)`` from ``names(b, name)``: how many people the spellings of each ``b`` name. In order, each joins
    the first group with a member of at least ``least``, as ``misc.distinct_names`` counts them.

    Near pairs are found over all workers; the names that they link, in any number of steps, are grouped together.
    """
    spark = names.sparkSession
    scratch = Scratch(spark, "people")
    units = names.select("b", "name").where("b is not null and name is not null").distinct()
    units = scratch.save(units.withColumn("id", F.concat(F.col("b").cast("string"), F.lit("|"), "name")), "units")
    near = similar_names(units, units, least).where("l < r")
    near = scratch.save(near.select(F.concat("b", F.lit("|"), "l").alias("l"), F.concat("b", F.lit("|"), "r").alias("r")), "near")
    earlier = near.groupBy(F.col("r").alias("id")).agg(F.collect_list("l").alias("earlier"))
    linked = connected_components(near, "l", "r").join(earlier, "id", "left").select("group_id", "id", "earlier")

    def openers(rows: list[tuple]) -> list[tuple]:
        at: dict[str, int] = {}
        n = 0
        for _, id_, before in rows:
            at[id_] = min((at[x] for x in before), default=n) if before is not None else n
            n += at[id_] == n
        return [(rows[0][1], n)]

    counted = map_groups(linked, "group_id", ["id"], openers, "id string, n int")
    grouped = units.select("id", "b").join(counted, "id").select("b", "n")
    alone = units.join(linked.select("id"), "id", "left_anti").select("b", F.lit(1).alias("n"))
    return grouped.unionByName(alone).groupBy("b").agg(F.sum("n").alias("people"))


def score(similarity: Column, structured: Column, shared_case: Column) -> Column:
    """Similarity with evidence, never certain."""
    return F.least(0.7 * similarity + 0.15 * structured.cast("double") + 0.15 * shared_case.cast("double"), F.lit(0.85))


def tier(similarity: Column, structured: Column, shared_case: Column) -> Column:
    """What becomes of a candidate; without an adjudicator the middle tier goes to review."""
    evidence = structured | shared_case
    return (
        F.when(similarity >= FLAG, "flagged_unverified")
        .when((similarity >= FLAG_WITH_EVIDENCE) & evidence, "flagged_unverified")
        .when(similarity >= ADJUDICATE, "llm_adjudicated")
        .when(similarity >= REVIEW, "human_review")
        .otherwise("new")
    )


def gate(best: DataFrame, corroborated: Column) -> DataFrame:
    """A person without identifier attaches only if the best candidate is corroborated; else it is someone new."""
    return best.withColumn("outcome", F.when(corroborated, "pending_match").otherwise("new_person"))


def rescore(pending: DataFrame, reinforced: Column, confidence: str = "confidence", created: str = "as_of", now: Column | None = None) -> DataFrame:
    """Priority with reinforcement, staleness after 14 days without it, and why."""
    now = now if now is not None else F.max(created).over(W.partitionBy())
    p = pending.withColumn("reinforced", reinforced)
    p = p.withColumn("priority", F.round(F.when(F.col("reinforced"), F.least(F.col(confidence) + 0.10, F.lit(0.95))).otherwise(F.col(confidence)), 6))
    return p.withColumn("stale", ~F.col("reinforced") & F.coalesce(now - F.col(created) > F.expr("interval 14 days"), F.lit(False))).withColumn(
        "why", F.concat_ws("; ", F.when(F.col("reinforced"), "seen again"), F.when(F.col("stale"), "not seen for 14 days"))
    )


def review_groups(pending: DataFrame, edge: str, *shared: str) -> DataFrame:
    """``(edge, group_id)``: open matches linked by any shared value; a group is named by its smallest edge."""
    links = None
    for c in shared:
        x = _by_first(pending, edge, c)
        links = x if links is None else links.unionByName(x)
    groups = connected_components(links)
    return groups.select(F.col("id").alias(edge), F.concat(F.lit("GROUP-SAME_AS-"), F.col("group_id").cast("string")).alias("group_id"))


def _by_first(pending: DataFrame, edge: str, column: str) -> DataFrame:
    """Every edge linked to the first edge with the same value: as many links as edges, whatever the value's share."""
    p = pending.select(F.col(edge).alias("dst"), F.col(column).alias("v")).where("v is not null")
    first = p.groupBy("v").agg(F.min("dst").alias("src"))
    return hot_join(p, first, "v").select("src", "dst")


def decide(edges: DataFrame, decisions: DataFrame, edge: str = "edge_id") -> DataFrame:
    """Decisions applied to open edges: new versions that supersede them; unknown or decided edges are refused.

    ``edges(edge_id, superseded_by, ...)``, ``decisions(edge_id, new_edge_id, verdict)``. The first decision on an
    edge counts (smallest new id); gives ``(edge_id, new_edge_id, verdict, status)``.
    """
    d = decisions.withColumn("n", F.row_number().over(W.partitionBy(edge).orderBy("new_edge_id")))
    e = edges.select(edge, "superseded_by", F.lit(True).alias("known"))
    j = d.join(e, edge, "left")
    status = F.when(F.col("known").isNull(), "unknown").when(F.col("superseded_by").isNotNull() | (F.col("n") > 1), "already_decided").otherwise("applied")
    return j.select(edge, "new_edge_id", "verdict", status.alias("status"))

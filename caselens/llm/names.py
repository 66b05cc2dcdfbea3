"""Problem 5: variant spellings of the names of one person or firm.

Names become weighted vectors of character n-grams with the first letter of another part (rare ones weigh more,
counted over all names; n-grams are hashed into ``BUCKETS`` dimensions, so the counts have a fixed size). Within a
block (the area in which a name can recur) a sparse join finds all pairs whose cosine reaches ``min_cosine``: every
vector is posted under its rarest n-grams until the rest of it is shorter than ``min_cosine``; products of common
n-grams are summed per pair, and a pair stays if the sum and the product of both rests can reach the threshold. Pairs
whose parts contradict are refused, and the rest is grouped by average linkage of the cosines.

Names are compared once per distinct form and block, so copies cost nothing; postings are keyed by (block, n-gram),
so a block with a third of all records is spread like any other. The number of neighbours of a name is not cut:
whatever reaches the threshold is kept.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselens.llm.linkage import cluster_links
from caselens.llm.namewords import BUCKETS, NameMatcher, name_features, parse_name, spelling_key
from caselens.operators.skew import hot_join
from caselens.session import Scratch, ship

#: A name part is established if at least one in so many of all parts is it (so there are at most so many) and it was
#: seen at least so often.
ESTABLISHED, SEEN = 5_000, 15


def _text(parsed: tuple[str, tuple[str, ...]]) -> str | None:
    return None if not parsed[1] else parsed[0] + "|" + " ".join(parsed[1])


def _parsed(text: str) -> tuple[str, tuple[str, ...]]:
    kind, _, tokens = text.partition("|")
    return kind, tuple(tokens.split(" "))


@F.pandas_udf(T.StringType())
def parsed_name(names: pd.Series) -> pd.Series:
    """The comparable form of a name: kind and parts; null where nothing is left."""
    return names.map(lambda v: _text(parse_name(v)), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _features(forms: pd.Series) -> pd.Series:
    return forms.map(lambda f: name_features(_parsed(f)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _part_keys(forms: pd.Series) -> pd.Series:
    return forms.map(lambda f: [spelling_key(t) for t in _parsed(f)[1] if len(t) > 1])


class Weights:
    """What a worker needs to compare names: weights of the n-grams and established parts."""

    def __init__(self, counts: np.ndarray, total: int, known: frozenset[str]):
        self.idf = np.log1p(max(total, 1) / np.maximum(counts, 1)).astype(np.float32)
        self.counts = counts
        self.matcher = NameMatcher(known)
        self._vectors: dict[str, dict[int, float]] = {}

    def vector(self, form: str) -> dict[int, float]:
        """Unit vector of a form."""
        v = self._vectors.get(form)
        if v is None:
            if len(self._vectors) > 20_000:
                self._vectors.clear()
            fs = name_features(_parsed(form))
            w = self.idf[fs].tolist()
            norm = math.sqrt(sum(x * x for x in w)) or 1.0
            v = self._vectors[form] = {f: x / norm for f, x in zip(fs, w)}
        return v

    def cosine(self, a: str, b: str) -> float:
        va, vb = self.vector(a), self.vector(b)
        if len(va) > len(vb):
            va, vb = vb, va
        return sum(x * vb[f] for f, x in va.items() if f in vb)

    def postings(self, block: np.ndarray, values: np.ndarray, sizes: np.ndarray, least: float) -> tuple[np.ndarray, ...]:
        """Row, key, weight and rest of every posting: the rarest n-grams of each row, as many as ``least`` asks for."""
        row = np.repeat(np.arange(len(sizes)), sizes)
        w = self.idf[values].astype(np.float64)
        w /= np.sqrt(np.bincount(row, w * w, len(sizes)))[row]
        order = np.lexsort((values, self.counts[values], row))
        row, values, w = row[order], values[order], w[order]
        done = np.cumsum(w * w)
        ends = np.cumsum(sizes)
        before = done - w * w - np.concatenate([[0.0], done[ends - 1]])[row]
        keep = 1.0 - before >= least * least - 1e-9
        rest = np.sqrt(np.maximum(1.0 - np.bincount(row[keep], w[keep] ** 2, len(sizes)), 0.0))
        row, values, w = row[keep], values[keep], w[keep]
        key = (block[row].view(np.uint64) ^ (values.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(31)
        return row, key.view(np.int64), w.astype(np.float32), rest[row].astype(np.float32)


def _weights(units: DataFrame) -> Weights:
    """Counts over all distinct forms; the driver gets at most BUCKETS + ESTABLISHED rows, whatever the input."""
    found = units.select(F.explode("fs").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts = np.zeros(BUCKETS, dtype=np.int64)
    counts[found["f"].to_numpy()] = found["n"].to_numpy()
    parts = units.select(F.explode(_part_keys("form")).alias("x"), "n").groupBy("x").agg(F.sum("n").alias("n"))
    total_parts = parts.agg(F.sum("n").alias("all"))
    known = parts.crossJoin(F.broadcast(total_parts)).where((F.col("n") * ESTABLISHED >= F.col("all")) & (F.col("n") >= SEEN))  # the total is one row
    return Weights(counts, units.count(), frozenset(r.x for r in known.select("x").collect()))


def link_names(
    records: DataFrame,
    record: str = "record",
    block: str = "beat_code",
    name: str = "name",
    mark: str | None = "cnic",
    min_cosine: float = 0.25,
    min_similarity: float = 0.65,
    linkage: float = 0.25,
    held: int = 200_000,
) -> DataFrame:
    """``(record, block, cluster)``: records of one block with the same cluster denote the same person or firm.

    Records without block, name, record key or comparable name are left out. Repeated rows count once. ``mark`` is an
    optional identity number of 13 digits, not all the same: equal ones link two names of a block, different ones keep
    them apart. A cluster is named by its smallest form id (64 bits of hash), so the result does not depend on the
    order of rows. Other columns are not read.
    """
    spark = records.sparkSession
    ship(spark)
    scratch = Scratch(spark, "names")
    digits = F.regexp_replace(F.col(mark).cast("string"), r"\D", "") if mark else F.lit(None).cast("string")
    rows = records.select(
        F.col(record).cast("string").alias("record"), F.col(block).cast("string").alias("block"), F.col(name).alias("name"), digits.alias("mark")
    ).where("record is not null and block is not null and name is not null")
    rows = rows.withColumn("mark", F.when((F.length("mark") == 13) & ~F.col("mark").rlike(r"^(.)\1*$"), F.col("mark")))
    rows = rows.groupBy("block", "name", "record").agg(F.min("mark").alias("mark")).withColumn("form", parsed_name("name"))
    rows = rows.where("form is not null").select("record", "block", "form", "mark", F.xxhash64("block", "form").alias("id"))
    rows = scratch.save(rows, "rows")
    units = rows.groupBy("id", "block", "form").agg(F.count(F.lit(1)).alias("n"), F.min("mark").alias("mark"))
    units = scratch.save(units.withColumn("fs", _features("form")), "units")

    w = _weights(units)
    sent = spark.sparkContext.broadcast(w)  # BUCKETS counts and weights, at most ESTABLISHED parts

    def posted(batches):  # noqa: ANN001, ANN202
        w = sent.value
        for b in batches:
            fs = b.column("fs")
            if not len(fs):
                continue
            sizes = np.diff(fs.offsets.to_numpy())
            at, key, weight, rest = w.postings(b.column("bh").to_numpy(), fs.flatten().to_numpy(), sizes, min_cosine)
            ids = b.column("id").to_numpy()[at]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, ids, weight, rest)], names=["k", "id", "w", "r"])

    posts = units.select("id", F.xxhash64("block").alias("bh"), "fs").mapInArrow(posted, "k long, id long, w float, r float")
    posts = scratch.save(posts, "posts")
    left = posts.select("k", F.col("id").alias("a"), F.col("w").alias("wa"), F.col("r").alias("ra"))
    right = posts.select("k", F.col("id").alias("b"), F.col("w").alias("wb"), F.col("r").alias("rb"))
    pairs = left.join(right, "k").where("a < b").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("s"), F.max(F.col("ra") * F.col("rb")).alias("q"))
    pairs = pairs.where(F.col("s") + F.col("q") >= min_cosine - 1e-4).select("a", "b")
    known = units.select("id", "form", "mark")
    pairs = pairs.withColumnRenamed("a", "id").join(known, "id").select(F.col("id").alias("a"), "b", F.col("form").alias("fa"), F.col("mark").alias("ma"))
    pairs = pairs.withColumnRenamed("b", "id").join(known, "id").select("a", F.col("id").alias("b"), "fa", "ma", F.col("form").alias("fb"), F.col("mark").alias("mb"))
    pairs = pairs.where("ma is null or mb is null or ma = mb")

    def verify(batches):  # noqa: ANN001, ANN202
        w = sent.value
        for pdf in batches:
            cos = np.array([w.cosine(x, y) for x, y in zip(pdf["fa"], pdf["fb"])], dtype=float)
            fits = [c >= min_cosine and (m is not None and m == n or w.matcher.name(_parsed(x), _parsed(y)) >= min_similarity) for c, m, n, x, y in zip(cos, pdf["ma"], pdf["mb"], pdf["fa"], pdf["fb"])]
            yield pdf.assign(s=cos).loc[fits, ["a", "b", "s"]]

    links = pairs.mapInPandas(verify, "a long, b long, s double")
    marked = units.where("mark is not null").select(F.xxhash64("block", "mark").alias("k"), "id")
    first = marked.groupBy("k").agg(F.min("id").alias("a"))
    same = hot_join(marked, first, "k").where("a <> id").select("a", F.col("id").alias("b"), F.lit(1.0).alias("s"))
    links = links.unionByName(same).groupBy("a", "b").agg(F.max("s").alias("s"))
    clusters = cluster_links(links, linkage, held=held)
    named = hot_join(rows, clusters, "id", "left")
    return named.select("record", "block", F.coalesce("cluster", "id").alias("cluster")).distinct()

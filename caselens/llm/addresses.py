"""Problem 6: address records that denote the same numbered premises.

Addresses are parsed into kind, number, street, block and words; records without a number are never linked, and the
number and its letter must be equal (a neighbour's number is one digit away). Within a block (the area in which
premises lie) candidates come from MinHash banding: the shingles of an address are its typed parts and the q-grams of
its words, bands are keyed by (area, premises number, band, hash), so areas of any size are spread over numbers and
hashes. As the key holds area and number already, one hash a band keeps the candidates few; it finds nearly all. Candidates are verified by affine-gap token alignment whose
substitution costs know abbreviations; linked forms are grouped by average linkage.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselens.llm.addresswords import PLACE_WORDS, Address, AddressMatcher, full, parse_address, skeleton
from caselens.llm.linkage import cluster_links
from caselens.operators.skew import hot_join
from caselens.session import Scratch, ship

#: Bands of one hash: addresses with Jaccard similarity J of their shingles meet with 1 - (1 - J) ** BANDS.
BANDS = 16


def _text(a: Address) -> str | None:
    return None if not a[1] else "|".join([*a[:4], " ".join(a[4])])


def _address(text: str) -> Address:
    kind, number, street, block, words = text.split("|")
    return kind, number, street, block, tuple(words.split(" ")) if words else ()


@F.pandas_udf(T.StringType())
def parsed_address(values: pd.Series) -> pd.Series:
    """The comparable form of an address; null where it has no premises number."""
    return values.map(lambda v: _text(parse_address(v)), na_action="ignore")


def shingles(a: Address, common: frozenset[str]) -> list[str]:
    """Typed parts and q-grams of an address without its number; words give the q-grams of their Latin consonants too."""
    _, _, street, block, words = a
    # repeated shingles weigh more in the band hashes: a street says more than a q-gram
    out = [f"s:{street}/{k}" for k in range(5 * bool(street))] + [f"b:{block}/{k}" for k in range(2 * bool(block))]
    for w in map(full, words):
        if w in common or w in PLACE_WORDS:
            continue
        out.append("c:" + skeleton(w))
        s = f"^{w}$"
        out += [s[i : i + 3] for i in range(len(s) - 2)]
    return out or ["-"]


_HASHES = (np.uint64(0x9E3779B97F4A7C15) + np.uint64(2) * np.arange(BANDS, dtype=np.uint64) + np.uint64(1))[:, None]
_BAND = np.arange(1, BANDS + 1, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _bands(a: Address, common: frozenset[str]) -> np.ndarray:
    """The key of an address in each band: the least hash of its shingles."""
    h = np.array([xxhash.xxh32_intdigest(x) for x in set(shingles(a, common))], dtype=np.uint64)[None, :]
    return _mix(_mix((h + np.uint64(1)) * _HASHES).min(axis=1) + _BAND)


def link_addresses(
    records: DataFrame,
    record: str = "record",
    block: str = "beat_code",
    address: str = "address",
    cities: list[str] | None = None,
    min_similarity: float = 0.5,
    linkage: float = 0.25,
    held: int = 200_000,
) -> DataFrame:
    """``(record, block, cluster)``: records of one area with the same cluster denote the same numbered premises.

    Records without area, key, address or premises number are left out; repeated rows count once; other columns are
    not read. ``cities`` are names that all addresses of an area share and that therefore say nothing (a bounded
    list). A cluster is named by its smallest form id (64 bits of hash), so the result does not depend on the order of
    rows.
    """
    spark = records.sparkSession
    ship(spark)
    scratch = Scratch(spark, "addresses")
    names = [parse_address("1 " + c)[4] for c in cities or []]
    common = frozenset(w for n in names for w in n) | frozenset("".join(n) for n in names if n)
    sent = spark.sparkContext.broadcast(AddressMatcher(common))

    rows = records.select(
        F.col(record).cast("string").alias("record"), F.col(block).cast("string").alias("block"), F.col(address).alias("address")
    ).where("record is not null and block is not null and address is not null")
    rows = rows.distinct().withColumn("form", parsed_address("address")).where("form is not null")
    rows = scratch.save(rows.select("record", "block", "form", F.xxhash64("block", "form").alias("id")), "rows")
    units = scratch.save(rows.select("id", "block", "form").distinct(), "units")

    def posted(batches):  # noqa: ANN001, ANN202
        common = sent.value.common
        for b in batches:
            forms = [_address(f) for f in b.column("form").to_pylist()]
            if not forms:
                continue
            keys = np.concatenate([_bands(a, common) for a in forms])
            out = _mix(keys + np.repeat(b.column("at").to_numpy().view(np.uint64), BANDS))
            yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64)), pa.array(np.repeat(b.column("id").to_numpy(), BANDS))], names=["k", "id"])

    # an address with nothing but its number shares no shingle with others: it could not be verified either
    number = F.split("form", r"\|")[1]
    posts = units.select("id", "form", F.xxhash64("block", number).alias("at")).mapInArrow(posted, "k long, id long")
    posts = scratch.save(posts, "posts")
    pairs = posts.withColumnRenamed("id", "a").join(posts.withColumnRenamed("id", "b"), "k").where("a < b").select("a", "b").distinct()
    known = units.select("id", "form")
    pairs = pairs.withColumnRenamed("a", "id").join(known, "id").select(F.col("id").alias("a"), "b", F.col("form").alias("fa"))
    pairs = pairs.withColumnRenamed("b", "id").join(known, "id").select("a", F.col("id").alias("b"), "fa", F.col("form").alias("fb"))

    def verify(batches):  # noqa: ANN001, ANN202
        m = sent.value
        for pdf in batches:
            s = np.array([m.similarity(_address(x), _address(y)) for x, y in zip(pdf["fa"], pdf["fb"])], dtype=float)
            yield pdf.assign(s=s).loc[s >= min_similarity, ["a", "b", "s"]]

    clusters = cluster_links(pairs.mapInPandas(verify, "a long, b long, s double"), linkage, held=held)
    named = hot_join(rows, clusters, "id", "left")
    return named.select("record", "block", F.coalesce("cluster", "id").alias("cluster")).distinct()

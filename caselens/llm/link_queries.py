"""Queries of the linking problems (2, 5 and 6) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.llm.addresses import link_addresses
from caselens.llm.components import connected_components
from caselens.llm.linkage import same_cluster_pairs
from caselens.llm.names import link_names
from caselens.tables import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entity of pending_matches with the smallest entity of its group."""
    links = table(spark, sf_dir, "pending_matches").select(
        F.col("mention.entity_id").alias("src"), F.col("candidate.entity_id").alias("dst")
    )
    return connected_components(links).select(F.col("id").alias("entity_id"), "group_id")


def p2_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many groups there are of each size."""
    sizes = p2_found(spark, sf_dir).groupBy("group_id").agg(F.count(F.lit(1)).alias("members"))
    return sizes.groupBy("members").agg(F.count(F.lit(1)).alias("n_groups"))


def name_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name with its record key, beat and identity number."""
    forms = table(spark, sf_dir, "structured_fields")
    parts = [
        forms.select(
            F.concat(F.lit(f"{who}:"), F.col("field_id").cast("string")).alias("record"),
            "beat_code",
            F.col(f"{who}_name").alias("name"),
            F.col(f"{who}_cnic").alias("cnic"),
        )
        for who in ("complainant", "witness")
    ]
    entities = table(spark, sf_dir, "entity_summaries").select(F.col("entity_id").alias("record"), "beat_code", F.col("canonical_name").alias("name"), "cnic")
    return parts[0].unionByName(parts[1]).unionByName(entities)


def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name record of a beat with its cluster."""
    return link_names(name_records(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of name records of one beat that denote the same person or firm."""
    return same_cluster_pairs(p5_clusters(spark, sf_dir))


def address_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every address with its record key and beat."""
    forms = table(spark, sf_dir, "structured_fields")
    parts = [
        forms.select(
            F.concat(F.lit(f"{who}:"), F.col("field_id").cast("string")).alias("record"), "beat_code", F.col(f"{who}_address").alias("address")
        )
        for who in ("complainant", "witness")
    ]
    cases = table(spark, sf_dir, "cases").select(
        F.concat(F.lit("case:"), "case_id").alias("record"), "beat_code", F.col("location").alias("address")
    )
    return parts[0].unionByName(parts[1]).unionByName(cases)


def p6_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every address record with a premises number and its cluster."""
    # stations is a fixed table of 64 rows
    cities = [r[0] for r in table(spark, sf_dir, "stations").select("district").where("district is not null").distinct().collect()]
    return link_addresses(address_records(spark, sf_dir), cities=cities)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of address records of one beat that denote the same numbered premises."""
    return same_cluster_pairs(p6_clusters(spark, sf_dir))


_P2 = """
WITH RECURSIVE e AS (
  SELECT DISTINCT mention.entity_id AS a, candidate.entity_id AS b FROM pending_matches
  WHERE mention.entity_id IS NOT NULL AND candidate.entity_id IS NOT NULL),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
ids AS (SELECT mention.entity_id AS id FROM pending_matches WHERE mention.entity_id IS NOT NULL
        UNION SELECT candidate.entity_id FROM pending_matches WHERE candidate.entity_id IS NOT NULL),
r(id, lab) AS (
  SELECT id, id FROM ids
  UNION
  SELECT w.b, r.lab FROM r JOIN both_ways w ON w.a = r.id WHERE r.lab < w.b),
g AS (SELECT id AS entity_id, min(lab) AS group_id FROM r GROUP BY id)
"""

QUERIES = {"p2_found": p2_found, "p2_group_sizes": p2_group_sizes, "p5_found": p5_found, "p5_clusters": p5_clusters, "p6_found": p6_found, "p6_clusters": p6_clusters}
SQL = {
    "p2_found": _P2 + "SELECT entity_id, group_id FROM g",
    "p2_group_sizes": _P2 + "SELECT members, count(*) AS n_groups FROM (SELECT group_id, count(*) AS members FROM g GROUP BY 1) GROUP BY 1",
}

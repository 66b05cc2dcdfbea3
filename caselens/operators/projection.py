"""Nested records into nodes and edges of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGE = "src string, label string, dst string, role string, source string"


def _edge(df: DataFrame, src, label: str, dst, role=None, source="fir") -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) or x is None else x
    return df.select(src.alias("src"), F.lit(label).alias("label"), dst.alias("dst"), lit(role).cast("string").alias("role"), F.lit(source).alias("source")).where("src is not null and dst is not null")


def project_reports(reports: DataFrame) -> DataFrame:
    """Edges of reports ``(case_id, station, district, officer, incident_date, people array<struct<name, role, cnic, address>>)``.

    One select per kind of edge; people without name are left out, ids are made of what identifies a thing, so a
    report projected again gives the same edges.
    """
    r = reports
    p = r.select("case_id", F.explode("people").alias("p")).where("p.name is not null")
    # an identity number names a person; without one a person is only known within the case
    digits = F.nullif(F.regexp_replace("p.cnic", r"\D", ""), F.lit(""))
    person = F.coalesce(F.concat(F.lit("PERSON-"), digits), F.concat(F.lit("PERSON-"), F.sha2(F.concat_ws("|", "case_id", "p.name"), 256)))
    case = F.concat(F.lit("CASE:"), "case_id")
    incident = F.concat(F.lit("INCIDENT-FIR-"), "case_id")
    parts = [
        _edge(r, incident, "BELONGS_TO_CASE", case),
        _edge(r, case, "FILED_AT", F.concat(F.lit("STATION:"), "station")),
        _edge(r.select("station", "district").distinct(), F.concat(F.lit("STATION:"), "station"), "PART_OF", F.concat(F.lit("DISTRICT:"), "district")),
        _edge(r, case, "ASSIGNED_TO", F.concat(F.lit("OFFICER:"), "officer")),
        _edge(r, incident, "OCCURRED_ON", F.concat(F.lit("DATE:"), F.col("incident_date").cast("string"))),
        _edge(p, person, "BELONGS_TO_CASE", case, F.col("p.role")),
        _edge(p, person, "INVOLVED_IN", incident, F.col("p.role")),
        _edge(p, person, "RESIDES_AT", F.concat(F.lit("ADDRESS:"), F.lower(F.trim("p.address")))),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.distinct()


def recovered_item(text, plates, phones):
    """What a recovered item is: a vehicle by its plate, a phone by its number, else a record."""
    return F.when(F.size(plates) > 0, F.struct(F.lit("Vehicle").alias("label"), F.try_element_at(plates, F.lit(1)).alias("key"))).when(
        F.size(phones) > 0, F.struct(F.lit("PhoneNumber").alias("label"), F.try_element_at(phones, F.lit(1)).alias("key"))
    ).otherwise(F.struct(F.lit("StructuredRecord").alias("label"), F.md5(text).alias("key")))


def cross_silo(records: DataFrame, people: DataFrame, key: str, source: str) -> DataFrame:
    """Edges between records of two sources that name the same person; both sides must exist."""
    a = records.select(F.col("record").alias("src"), F.col(key).alias("k")).where("k is not null")
    b = people.select(F.col("person").alias("dst"), F.col(key).alias("k")).where("k is not null")
    return a.join(b, "k").select("src", F.lit("RELATED_TO").alias("label"), "dst", F.lit(None).cast("string").alias("role"), F.lit(source).alias("source")).distinct()


def purge(edges: DataFrame, prefix: str) -> DataFrame:
    """Edges without those of a source prefix."""
    return edges.where(~F.coalesce(F.col("source").startswith(prefix), F.lit(False)))

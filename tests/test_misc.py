import datetime as dt

from pyspark.sql import functions as F

from caselens.functions import misc
from caselens.operators import projection as pj
from caselens.operators import retrieval as rt
from caselens.operators import timeseries as ts
from caselens.operators.clustering import map_groups


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_small_functions(spark):
    assert one(spark, misc.first_json, 'so: {bad {"a": [1, 2]} tail') == '{"a": [1, 2]}'
    assert one(spark, misc.first_json, "none") is None and one(spark, misc.first_json, None) is None
    assert one(spark, misc.date_only, "2025-02-30T01:02") is None and one(spark, misc.date_only, "2025-02-03T01:02") == dt.date(2025, 2, 3)
    assert one(spark, lambda c: misc.allowed_host(c, ["a.org"]), "https://x.a.org/p") and not one(spark, lambda c: misc.allowed_host(c, ["a.org"]), "https://xa.org")
    assert one(spark, lambda c: misc.allowed_host(c, ["a.org"]), None) is False
    assert tuple(one(spark, misc.registration, "old 2024-01-01, registered on 2025-01-01")) == (dt.date(2025, 1, 1), "labeled")
    assert one(spark, misc.registration, "") is None
    assert one(spark, lambda c: misc.pad_row(F.split(c, ","), 3), "a,b") == ["a", "b", ""]
    assert one(spark, lambda c: misc.reclassify(F.lit("error"), c), "HTTP 429") == "warning"
    assert misc.without_overlaps([(0, 5, 0.5), (3, 8, 0.9), (8, 9, 0.1), (3, 8, 0.9)]) == [1, 2]
    assert misc.distinct_names(["Ali Khan", "Khan Ali", "Omar"]) == 2 and misc.distinct_names([]) == 0


def test_groups_come_whole(spark):
    df = spark.createDataFrame([(f"k{i % 7}", i) for i in range(500)], "k string, v long").repartition(6)
    got = map_groups(df, "k", ["v"], lambda rows: [(rows[0][0], len(rows), [r[1] for r in rows] == sorted(r[1] for r in rows))], "k string, n long, ordered boolean").collect()
    assert len(got) == 7 and sum(r.n for r in got) == 500 and all(r.ordered for r in got)
    assert map_groups(df.limit(0), "k", ["v"], lambda rows: [], "k string, n long, ordered boolean").count() == 0


def test_rescue_puts_lost_hits_behind(spark):
    fused = spark.createDataFrame([("q", "a", 0.1, 1)], "query string, key string, rrf double, rank int")
    sem = spark.createDataFrame([("q", "a", 0.99), ("q", "b", 0.9), ("q", "c", 0.88), ("q", "d", 0.87), ("q", "e", 0.1), ("z", "y", 0.95)], "query string, key string, score double")
    assert sorted((r.query, r.key, r["rank"]) for r in rt.rescue(fused, sem).collect()) == [("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("z", "y", 1)]


def test_buckets_are_complete(spark):
    e = spark.createDataFrame([(dt.datetime(2025, 1, 10, 5), "rag", 10), (dt.datetime(2025, 1, 8, 5), None, 0), (dt.datetime(2024, 1, 1), "rag", 5)], "t timestamp_ntz, r string, v int")
    u = {r.bucket: (r.total, r.rag, r.unknown) for r in ts.usage(e, "t", "r", ["RAG", "UNKNOWN"], days=3).collect()}
    assert u == {"2025-01-07": (0, 0, 0), "2025-01-08": (1, 0, 1), "2025-01-09": (0, 0, 0), "2025-01-10": (1, 1, 0)}
    lat = {r.bucket: (r["count"], r.avg, r.p95) for r in ts.latency(e, "t", "v", days=3).collect()}
    assert lat["2025-01-08"] == (0, 0, 0) and lat["2025-01-10"] == (1, 10, 10)
    assert ts.usage(e.limit(0), "t", "r", ["RAG"]).count() == 0


def test_projection_is_idempotent_and_skips_what_is_missing(spark):
    schema = "case_id string, station string, district string, officer string, incident_date date, people array<struct<name:string,role:string,cnic:string,address:string>>"
    rows = [("c1", "s", None, None, None, [("Ali", "witness", "1-2", " A "), (None, "witness", None, None)]), ("c2", None, None, "o", dt.date(2025, 1, 1), None)]
    df = spark.createDataFrame(rows, schema)
    a = pj.project_reports(df)
    labels = sorted(r.label for r in a.collect())
    assert labels == ["ASSIGNED_TO", "BELONGS_TO_CASE", "BELONGS_TO_CASE", "BELONGS_TO_CASE", "FILED_AT", "INVOLVED_IN", "OCCURRED_ON", "RESIDES_AT"]
    assert pj.project_reports(df.union(df)).exceptAll(a).count() == 0
    assert pj.purge(a, "fir").count() == 0 and pj.purge(a, "x").count() == 8

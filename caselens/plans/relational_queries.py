"""Queries over cases, runs and documents: filters, joins and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from caselens import scope
from caselens.operators import aggregates as agg
from caselens.operators import relational as rel
from caselens.plans.registry import Registry
from caselens.tables import table

_R = Registry()
QUERIES, SQL, query = _R.QUERIES, _R.SQL, _R.query
CATEGORIES = ("THEFT", "FRAUD", "ASSAULT", "CYBER", "MISSING")


@query("flt_scope", "SELECT doc_id, case_id, source FROM documents WHERE (source = 'x' OR lang = 'en') AND case_id = 'CASE-00000000'")
def flt_scope(spark, d):
    docs = table(spark, d, "documents").withColumn("g", F.col("lang") == "en")
    return docs.where(scope.Scope(project_id="x", case_id="CASE-00000000").predicate(project="source", is_global="g")).select("doc_id", "case_id", "source")


@query("flt_scope_tool", "SELECT doc_id FROM documents WHERE lang = 'ur'")
def flt_scope_tool(spark, d):
    docs = table(spark, d, "documents").withColumn("g", F.col("lang") == "ur")
    return docs.where(scope.tool_scope(None, None, is_global="g")).select("doc_id")


@query("flt_rls", "SELECT doc_id FROM documents WHERE lang = 'ur' OR case_id = '' OR case_id IS NULL")
def flt_rls(spark, d):
    docs = table(spark, d, "documents")
    return docs.where(scope.row_policy(True, False, "", is_global=F.col("lang") == "ur")).select("doc_id")


@query("flt_status", "SELECT case_id, investigation_status FROM cases WHERE NOT contains(lower(coalesce(investigation_status, '')), 'closed') AND contains(lower(crime_category), 'fraud')")
def flt_status(spark, d):
    return rel.filter_cases(table(spark, d, "cases"), "list open fraud cases", categories=CATEGORIES).select("case_id", "investigation_status")


@query("flt_access", "SELECT DISTINCT c.case_id FROM cases c SEMI JOIN (SELECT case_id FROM structured_fields WHERE station_code = 'PS001' AND doc_kind = 'FIR') a USING (case_id)")
def flt_access(spark, d):
    a = table(spark, d, "structured_fields").select(
        "case_id", F.col("station_code").alias("user_id"), F.when(F.col("doc_kind") == "FIR", "station-admin").otherwise("investigator").alias("role")
    )
    return scope.accessible(table(spark, d, "cases"), a, "PS001", "investigator", "supervisor").select("case_id").distinct()


@query("flt_audit", "SELECT event_id, ts, event_type FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-10' ORDER BY ts DESC, event_id LIMIT 50 OFFSET 10")
def flt_audit(spark, d):
    return rel.log_page(table(spark, d, "events"), "ts", "event_id", since="2024-01-10", limit=50, offset=10, event_type="error").select("event_id", "ts", "event_type")


@query("flt_contaminated", """WITH p AS (SELECT canonical_name AS name, count(*) AS n FROM entity_summaries WHERE canonical_name IS NOT NULL GROUP BY 1),
 l AS (SELECT name, n, array_to_string(string_split(name, ' ')[:-2], ' ') AS prefix FROM p WHERE len(string_split(name, ' ')) >= 3)
 SELECT l.name, l.prefix FROM l JOIN p ON p.name = l.prefix WHERE p.n > l.n""")
def flt_contaminated(spark, d):
    return agg.prefix_contaminated(table(spark, d, "entity_summaries"), "canonical_name")


@query("src_sql_ref", "SELECT station_code, station_name FROM stations WHERE station_name ILIKE '%west%' AND district ILIKE '%a%'")
def src_sql_ref(spark, d):
    return rel.reference_lookup(table(spark, d, "stations"), station_name="west", district="a").select("station_code", "station_name")


@query("st_refsql", "SELECT station_code FROM stations")
def st_refsql(spark, d):
    return rel.reference_lookup(table(spark, d, "stations"), empty_means_all=True).select("station_code")


@query("page", "SELECT query_id, created_at FROM (SELECT DISTINCT query_id, created_at FROM queries) ORDER BY created_at DESC, query_id LIMIT 20 OFFSET 40")
def page(spark, d):
    return rel.log_page(table(spark, d, "queries").select("query_id", "created_at").distinct(), "created_at", "query_id", limit=20, offset=40)


@query("sink_docs", "SELECT query_id, max(loaded_at) AS loaded_at FROM queries GROUP BY 1")
def sink_docs(spark, d):
    return rel.latest_per_key(table(spark, d, "queries"), "query_id", "loaded_at").select("query_id", "loaded_at")


@query("sink_delete_src", "SELECT doc_id FROM documents WHERE coalesce(source, '') NOT LIKE 'a%'")
def sink_delete_src(spark, d):
    docs = table(spark, d, "documents")
    gone = docs.where(F.col("source").startswith("a")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select("doc_id")


@query("scan_by_ids", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (1, 5, 9, 77777777)")
def scan_by_ids(spark, d):
    ids = spark.createDataFrame([(1,), (5,), (9,), (77777777,)], "doc_id bigint")
    return table(spark, d, "documents").join(F.broadcast(ids), "doc_id").select("doc_id", "n_chars")  # ids of one request


@query("prj_case_record", """SELECT case_id, concat_ws(chr(10), CASE WHEN trim(fir_number) <> '' THEN 'FIR: ' || fir_number END,
 CASE WHEN trim(police_station) <> '' THEN 'Station: ' || police_station END, CASE WHEN incident_date IS NOT NULL THEN 'Date: ' || CAST(incident_date AS VARCHAR) END) AS text FROM cases""")
def prj_case_record(spark, d):
    text = rel.case_record_text({"fir_number": "FIR", "police_station": "Station", "incident_date": "Date"})
    return table(spark, d, "cases").select("case_id", text.alias("text"))


@query("prj_clean_csv", "SELECT case_id, CASE WHEN trim(investigation_officer) NOT IN ('', '-', '—') THEN trim(investigation_officer) END AS officer FROM cases")
def prj_clean_csv(spark, d):
    return table(spark, d, "cases").select("case_id", rel.clean_cell(F.col("investigation_officer")).alias("officer"))


@query("prj_render_docs", """SELECT doc_id, '[Document ' || row_number() OVER (ORDER BY n_chars DESC, doc_id) || '] ' || coalesce(doc_type, '-') || CASE WHEN case_id IS NOT NULL THEN ' (case ' || case_id || ')' ELSE '' END AS header
 FROM documents WHERE case_id = 'CASE-00000001'""")
def prj_render_docs(spark, d):
    docs = table(spark, d, "documents").where(F.col("case_id") == "CASE-00000001")
    n = F.row_number().over(W.orderBy(F.desc("n_chars"), "doc_id"))  # the documents of one answer
    case = F.when(F.col("case_id").isNotNull(), F.concat(F.lit(" (case "), "case_id", F.lit(")"))).otherwise("")
    return docs.select("doc_id", F.concat(F.lit("[Document "), n.cast("string"), F.lit("] "), F.coalesce("doc_type", F.lit("-")), case).alias("header"))


@query("join_case_assign", """SELECT DISTINCT c.case_id, c.created_at FROM cases c JOIN (SELECT DISTINCT case_id FROM structured_fields WHERE station_code = 'PS001') a USING (case_id)""")
def join_case_assign(spark, d):
    a = table(spark, d, "structured_fields").where(F.col("station_code") == "PS001").select("case_id").distinct()
    return table(spark, d, "cases").join(a, "case_id").select("case_id", "created_at").distinct()


@query("join_session_q", """SELECT s.session_id, coalesce(q.n, 0) AS n, coalesce(q.avg_ms, -1) AS avg_ms FROM (SELECT DISTINCT session_id FROM messages) s
 LEFT JOIN (SELECT session_id, count(DISTINCT query_id) AS n, CAST(trunc(avg(total_duration_ms)) AS BIGINT) AS avg_ms FROM queries GROUP BY 1) q USING (session_id)""")
def join_session_q(spark, d):
    q = table(spark, d, "queries").groupBy("session_id").agg(F.countDistinct("query_id").alias("n"), F.avg("total_duration_ms").cast("long").alias("avg_ms"))
    return table(spark, d, "messages").select("session_id").distinct().join(q, "session_id", "left").select("session_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("avg_ms", F.lit(-1)).alias("avg_ms"))


@query("join_kb", """SELECT d.source, d.n, s.first_doc FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 500) d
 LEFT JOIN (SELECT source, min(doc_id) AS first_doc FROM documents WHERE source IS NOT NULL GROUP BY 1) s USING (source)""")
def join_kb(spark, d):
    docs = table(spark, d, "documents")
    per = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("source")).limit(500)
    return per.join(docs.where("source is not null").groupBy("source").agg(F.min("doc_id").alias("first_doc")), "source", "left")


@query("join_cnic", """SELECT DISTINCT f.field_id, e.entity_id FROM structured_fields f JOIN entity_summaries e ON regexp_replace(f.complainant_cnic, '[^0-9]', '', 'g') = regexp_replace(e.cnic, '[^0-9]', '', 'g')
 WHERE f.complainant_cnic IS NOT NULL AND e.cnic IS NOT NULL AND regexp_replace(f.complainant_cnic, '[^0-9]', '', 'g') <> ''""")
def join_cnic(spark, d):
    key = lambda c: F.nullif(F.regexp_replace(c, "[^0-9]", ""), F.lit(""))
    f = table(spark, d, "structured_fields").select("field_id", key("complainant_cnic").alias("k")).where("k is not null")
    e = table(spark, d, "entity_summaries").select("entity_id", key("cnic").alias("k")).where("k is not null")
    return f.join(e, "k").select("field_id", "entity_id").distinct()


@query("join_display", """SELECT m.match_id, c.case_id FROM (SELECT DISTINCT match_id, normalized FROM field_matches WHERE field_type = 'fir_number') m
 JOIN (SELECT DISTINCT fir_number, case_id FROM cases) c ON c.fir_number = m.normalized""")
def join_display(spark, d):
    m = table(spark, d, "field_matches").where("field_type = 'fir_number'").select("match_id", F.col("normalized").alias("fir_number")).distinct()
    return m.join(table(spark, d, "cases").select("fir_number", "case_id").distinct(), "fir_number").select("match_id", "case_id")


@query("join_recur", """WITH m AS (SELECT DISTINCT s.l_suppkey AS e, s.l_orderkey AS g FROM lineitem s)
 SELECT a.e AS a, b.e AS b, count(*) AS n FROM m a JOIN m b ON a.g = b.g AND a.e < b.e GROUP BY 1, 2 HAVING count(*) >= 3""")
def join_recur(spark, d):
    return agg.shared_groups(table(spark, d, "lineitem"), "l_suppkey", "l_orderkey").where("n >= 3")


@query("join_seed", "SELECT entity_id, n AS needle FROM entity_summaries, (VALUES ('turb'), ('kar motors')) t(n) WHERE contains(lower(canonical_name), n)")
def join_seed(spark, d):
    wanted = spark.createDataFrame([("turb",), ("kar motors",)], "needle string")
    return rel.contains_join(table(spark, d, "entity_summaries").select("entity_id", "canonical_name"), wanted, "canonical_name", "needle").select("entity_id", "needle")


@query("join_station", "SELECT station_code FROM stations WHERE contains(lower(station_name), 'gulnar') OR contains(lower(station_code), 'gulnar') ORDER BY station_code LIMIT 1")
def join_station(spark, d):
    s = table(spark, d, "stations")
    hit = F.lower("station_name").contains("gulnar") | F.lower("station_code").contains("gulnar")
    return s.where(hit).orderBy("station_code").limit(1).select("station_code")


@query("join_juris", """SELECT DISTINCT c.case_id FROM cases c JOIN stations s ON s.station_code = c.police_station WHERE s.district = 'Meranpur' ORDER BY 1 LIMIT 200""")
def join_juris(spark, d):
    s = table(spark, d, "stations").where("district = 'Meranpur'").select(F.col("station_code").alias("police_station"))
    return table(spark, d, "cases").join(s, "police_station").select("case_id").distinct().orderBy("case_id").limit(200)


@query("join_prov", """SELECT e.entity_id, max(d.doc_id) AS doc_id FROM (SELECT mention.entity_id AS entity_id, source_doc_id FROM pending_matches) e JOIN documents d ON d.doc_id = e.source_doc_id WHERE e.entity_id IS NOT NULL GROUP BY 1""")
def join_prov(spark, d):
    e = table(spark, d, "pending_matches").select(F.col("mention.entity_id").alias("entity_id"), F.col("source_doc_id").alias("doc_id")).where("entity_id is not null")
    return e.join(table(spark, d, "documents").select("doc_id"), "doc_id").groupBy("entity_id").agg(F.max("doc_id").alias("doc_id"))


@query("anti_orphan", "SELECT DISTINCT source_doc_id FROM pending_matches WHERE source_doc_id IS NOT NULL AND source_doc_id NOT IN (SELECT doc_id FROM documents)")
def anti_orphan(spark, d):
    p = table(spark, d, "pending_matches").select("source_doc_id").where("source_doc_id is not null").distinct()
    return p.join(table(spark, d, "documents").select(F.col("doc_id").alias("source_doc_id")), "source_doc_id", "left_anti")


@query("anti_collision", """SELECT fir_number FROM cases WHERE fir_number IS NOT NULL GROUP BY 1
 HAVING count(DISTINCT coalesce(police_station, '<null>')) > 1""")
def anti_collision(spark, d):
    c = table(spark, d, "cases").where("fir_number is not null")
    return c.groupBy("fir_number").agg(F.countDistinct(F.coalesce("police_station", F.lit("<null>"))).alias("n")).where("n > 1").select("fir_number")


@query("semi_rls", "SELECT DISTINCT query_id FROM queries q WHERE EXISTS (SELECT 1 FROM messages m WHERE m.session_id = q.session_id AND m.role = 'ai')")
def semi_rls(spark, d):
    m = table(spark, d, "messages").where("role = 'ai'").select("session_id")
    return table(spark, d, "queries").join(m, "session_id", "left_semi").select("query_id").distinct()


@query("as_of", """SELECT l.query_id, (SELECT max_by(m.message_id, (m.created_at, m.message_id)) FROM (SELECT DISTINCT message_id, session_id, created_at FROM messages) m WHERE m.session_id = l.session_id AND m.created_at <= l.created_at) AS message_id_as_of
 FROM (SELECT DISTINCT query_id, session_id, created_at FROM queries) l""")
def as_of(spark, d):
    left = table(spark, d, "queries").select("query_id", "session_id", "created_at").distinct()
    right = table(spark, d, "messages").select("session_id", "created_at", "message_id").distinct()
    right = right.groupBy("session_id", "created_at").agg(F.max("message_id").alias("message_id"))
    return rel.as_of_join(left, right, "session_id", "created_at", "message_id").select("query_id", "message_id_as_of")


@query("agg_recurring", """SELECT entity, n_cases, case_ids FROM (SELECT complainant_name AS entity, count(DISTINCT case_id) AS n_cases, list_sort(list(DISTINCT case_id)) AS case_ids FROM structured_fields
 WHERE complainant_name IS NOT NULL AND case_id IS NOT NULL GROUP BY 1 ORDER BY n_cases DESC, entity LIMIT 10) WHERE n_cases > 1""")
def agg_recurring(spark, d):
    return agg.recurring(table(spark, d, "structured_fields"), "complainant_name", "case_id")


@query("agg_recurring_seed", """SELECT l_suppkey AS entity, count(DISTINCT l_orderkey) AS n_cases FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
 JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1 GROUP BY 1 ORDER BY n_cases DESC, entity LIMIT 50""")
def agg_recurring_seed(spark, d):
    n = table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    c = table(spark, d, "customer").join(n, "c_nationkey").select(F.col("c_custkey").alias("o_custkey"))
    o = table(spark, d, "orders").join(c, "o_custkey").select(F.col("o_orderkey").alias("l_orderkey"))
    return agg.recurring(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(o, "l_orderkey"), "l_suppkey", "l_orderkey", 50, 1).select("entity", "n_cases")


@query("agg_group_counts", """SELECT coalesce(nullif(police_station, ''), 'unknown') AS value, count(*) AS n, (SELECT count(*) FROM cases) AS total FROM cases GROUP BY 1 ORDER BY n DESC, value LIMIT 15""")
def agg_group_counts(spark, d):
    return agg.group_counts(table(spark, d, "cases"), "police_station")


@query("agg_total", "SELECT count(*) AS n FROM cases WHERE contains(lower(coalesce(investigation_status, '')), 'closed')")
def agg_total(spark, d):
    return rel.filter_cases(table(spark, d, "cases"), "how many closed cases").agg(F.count(F.lit(1)).alias("n"))


@query("agg_listing", "SELECT case_id, fir_number, crime_category, police_station, investigation_status FROM cases WHERE NOT contains(lower(coalesce(investigation_status, '')), 'closed')")
def agg_listing(spark, d):
    return rel.filter_cases(table(spark, d, "cases"), "open cases").select("case_id", "fir_number", "crime_category", "police_station", "investigation_status")


@query("agg_sysmetrics", """SELECT 'cases' AS name, count(*) AS n FROM cases UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'queries', count(DISTINCT query_id) FROM queries
 UNION ALL SELECT 'avg_ms', CAST(trunc(avg(total_duration_ms)) AS BIGINT) FROM queries UNION ALL SELECT 'chars', CAST(sum(n_chars) AS BIGINT) FROM documents""")
def agg_sysmetrics(spark, d):
    one = lambda name, t, e: table(spark, d, t).agg(e.cast("long").alias("n")).select(F.lit(name).alias("name"), "n")
    parts = [("cases", "cases", F.count(F.lit(1))), ("documents", "documents", F.count(F.lit(1))), ("queries", "queries", F.countDistinct("query_id")), ("avg_ms", "queries", F.avg("total_duration_ms")), ("chars", "documents", F.sum("n_chars"))]
    out = one(*parts[0])
    for p in parts[1:]:
        out = out.unionByName(one(*p))
    return out


_PCT = """count(*) AS count, CAST(trunc(avg(v)) AS BIGINT) AS avg, CAST(trunc(median(v)) AS BIGINT) AS p50,
 CAST(list_sort(list(v))[greatest(1, least(count(*), CAST(round_even(0.95 * count(*), 0) AS BIGINT)))] AS BIGINT) AS p95, CAST(max(v) AS BIGINT) AS max"""


@query("agg_percentiles", f"SELECT {_PCT} FROM (SELECT total_duration_ms AS v FROM queries WHERE total_duration_ms >= 0)")
def agg_percentiles(spark, d):
    return agg.percentiles_distributed(table(spark, d, "queries").withColumn("k", F.lit(1)), ["k"], "total_duration_ms").drop("k")


@query("agg_step_latency", f"SELECT event_type AS step, {_PCT} FROM (SELECT event_type, CAST(trunc(value * 10) AS BIGINT) AS v FROM events) WHERE v > 0 GROUP BY 1")
def agg_step_latency(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("step"), (F.col("value") * 10).cast("long").alias("v")).where("v > 0")
    return agg.percentiles_distributed(e, ["step"], "v")


@query("agg_latency", f"SELECT {_PCT} FROM (SELECT total_duration_ms AS v FROM queries WHERE total_duration_ms > 0)")
def agg_latency(spark, d):
    return agg.percentiles_distributed(table(spark, d, "queries").where("total_duration_ms > 0").withColumn("k", F.lit(1)), ["k"], "total_duration_ms").drop("k")


@query("agg_routing", """WITH r AS (SELECT upper(coalesce(nullif(response_type, ''), 'UNKNOWN')) AS route, response_type AS o, CASE WHEN total_duration_ms <> 0 THEN total_duration_ms END AS d FROM queries)
 SELECT route, count(*) AS count, round_even(count(*) / (SELECT count(*) FROM r) * 100, 1) AS share_pct, round_even(count(*) FILTER (coalesce(o <> '' AND o <> 'safe', false)) / count(*) * 100, 1) AS success_pct,
 coalesce(CAST(trunc(avg(d)) AS BIGINT), 0) AS avg_ms, coalesce(list_sort(list(d) FILTER (d >= 0))[greatest(1, least(count(d), CAST(round_even(0.95 * count(d), 0) AS BIGINT)))], 0) AS p95_ms FROM r GROUP BY 1""")
def agg_routing(spark, d):
    return agg.routing(table(spark, d, "queries"), "response_type", "response_type", "total_duration_ms")


@query("agg_verifier", """SELECT count(*) AS gated, count(*) FILTER (verifier_passed <> 0) AS passed, count(*) FILTER (coalesce(verifier_regenerated, 0) <> 0) AS regenerated,
 round_even(count(*) FILTER (verifier_passed <> 0) / count(*) * 100, 1) AS pass_pct, round_even(count(*) FILTER (coalesce(verifier_regenerated, 0) <> 0) / count(*) * 100, 1) AS regen_pct FROM queries WHERE verifier_passed IS NOT NULL""")
def agg_verifier(spark, d):
    return agg.verifier_stats(table(spark, d, "queries"), "verifier_passed", "verifier_regenerated")


@query("agg_error_facets", "SELECT list_sort(list(DISTINCT event_type)) AS types FROM events WHERE event_type <> ''")
def agg_error_facets(spark, d):
    return table(spark, d, "events").where("event_type <> ''").agg(F.sort_array(F.collect_set("event_type")).alias("types"))


@query("agg_kb", "SELECT source, count(*) AS n FROM documents GROUP BY 1")
def agg_kb(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("agg_ingested", "SELECT source, doc_type, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, min(ingested_at) AS first_at, max(ingested_at) AS last_at FROM documents GROUP BY 1, 2")
def agg_ingested(spark, d):
    return table(spark, d, "documents").groupBy("source", "doc_type").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.min("ingested_at").alias("first_at"), F.max("ingested_at").alias("last_at"))


@query("agg_session_stats", "SELECT session_id, count(*) AS n, round(coalesce(avg(total_duration_ms), -1), 6) AS avg_ms, CAST(coalesce(sum(needs_rag), 0) AS BIGINT) AS rag FROM queries GROUP BY 1")
def agg_session_stats(spark, d):
    return table(spark, d, "queries").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.avg("total_duration_ms"), F.lit(-1.0)), 6).alias("avg_ms"), F.coalesce(F.sum("needs_rag"), F.lit(0)).alias("rag"))


@query("agg_review_stats", "SELECT tier, count(*) AS n, count(*) FILTER (as_of IS NULL) AS undated FROM pending_matches GROUP BY 1")
def agg_review_stats(spark, d):
    return table(spark, d, "pending_matches").groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("as_of").isNull()).alias("undated"))


@query("agg_queue_groups", """SELECT coalesce(candidate.entity_id, 'UNGROUPED-' || edge_id) AS group_id, count(*) AS member_count, round(max(confidence), 6) AS top_score, min(edge_id) AS first_edge FROM pending_matches GROUP BY 1""")
def agg_queue_groups(spark, d):
    p = table(spark, d, "pending_matches")
    key = F.coalesce("candidate.entity_id", F.concat(F.lit("UNGROUPED-"), F.col("edge_id").cast("string")))
    return p.groupBy(key.alias("group_id")).agg(F.count(F.lit(1)).alias("member_count"), F.round(F.max("confidence"), 6).alias("top_score"), F.min("edge_id").alias("first_edge"))


@query("agg_members", "SELECT beat_code, count(*) AS n FROM entity_summaries WHERE beat_code IS NOT NULL GROUP BY 1 HAVING count(*) >= 5")
def agg_members(spark, d):
    return table(spark, d, "entity_summaries").where("beat_code is not null").groupBy("beat_code").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")


@query("agg_edge_weight", """WITH p AS (SELECT mention.entity_id AS a, candidate.entity_id AS b, confidence FROM pending_matches WHERE mention.entity_id IS NOT NULL AND candidate.entity_id IS NOT NULL)
 SELECT least(a, b) AS a, greatest(a, b) AS b, round(sum(coalesce(confidence, 1) * 3.0), 6) AS weight FROM p WHERE a <> b GROUP BY 1, 2""")
def agg_edge_weight(spark, d):
    p = table(spark, d, "pending_matches").select(F.col("mention.entity_id").alias("a"), F.col("candidate.entity_id").alias("b"), "confidence").where("a is not null and b is not null")
    return agg.edge_weights(p, p.select("a", "b", F.lit(0).alias("n")).limit(0))


@query("agg_case_sets", "SELECT beat_code, list_sort(list(DISTINCT case_id)) AS case_ids FROM structured_fields WHERE case_id IS NOT NULL AND beat_code IS NOT NULL GROUP BY 1")
def agg_case_sets(spark, d):
    f = table(spark, d, "structured_fields").where("case_id is not null and beat_code is not null")
    return f.groupBy("beat_code").agg(F.sort_array(F.collect_set("case_id")).alias("case_ids"))


@query("agg_dq", """SELECT 'documents' AS metric, count(*) AS n, CASE WHEN count(*) > 0 THEN 'READY' ELSE 'EMPTY' END AS readiness FROM documents WHERE case_id = 'CASE-00000000'
 UNION ALL SELECT 'forms', count(DISTINCT field_id), CASE WHEN count(*) > 0 THEN 'READY' ELSE 'EMPTY' END FROM structured_fields WHERE case_id = 'CASE-00000000'
 UNION ALL SELECT 'dated', count(*), CASE WHEN count(*) > 0 THEN 'READY' ELSE 'EMPTY' END FROM cases WHERE case_id = 'CASE-00000000' AND incident_date IS NOT NULL""")
def agg_dq(spark, d):
    def metric(name, rows, n):
        return rows.where("case_id = 'CASE-00000000'").agg(n.alias("n"), F.count(F.lit(1)).alias("c")).select(F.lit(name).alias("metric"), "n", F.when(F.col("c") > 0, "READY").otherwise("EMPTY").alias("readiness"))

    one = F.count(F.lit(1))
    return (
        metric("documents", table(spark, d, "documents"), one)
        .unionByName(metric("forms", table(spark, d, "structured_fields"), F.countDistinct("field_id")))
        .unionByName(metric("dated", table(spark, d, "cases").where("incident_date is not null"), one))
    )


@query("agg_counts_graph", "SELECT entity_type, count(*) AS n FROM entity_summaries GROUP BY 1")
def agg_counts_graph(spark, d):
    return table(spark, d, "entity_summaries").groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


@query("agg_distinct_sections", "SELECT normalized, min(match_id) AS first_match FROM field_matches WHERE field_type = 'section' AND normalized IS NOT NULL GROUP BY 1")
def agg_distinct_sections(spark, d):
    return table(spark, d, "field_matches").where("field_type = 'section' and normalized is not null").groupBy("normalized").agg(F.min("match_id").alias("first_match"))


@query("agg_crime_category", """SELECT doc_id, string_agg(act, ', ' ORDER BY act) AS acts FROM (SELECT DISTINCT doc_id, regexp_extract(normalized, '([A-Za-z]+)$', 1) AS act FROM field_matches WHERE field_type = 'section' AND normalized IS NOT NULL) GROUP BY 1""")
def agg_crime_category(spark, d):
    m = table(spark, d, "field_matches").where("field_type = 'section' and normalized is not null")
    return m.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set(F.regexp_extract("normalized", r"([A-Za-z]+)$", 1))), ", ").alias("acts"))


@query("agg_eval_slice", """SELECT response_type AS category, count(*) AS total, count(verifier_passed) AS scored, round(avg(CASE WHEN verifier_passed <> 0 THEN 1.0 WHEN verifier_passed = 0 THEN 0.0 END), 3) AS accuracy FROM queries GROUP BY 1""")
def agg_eval_slice(spark, d):
    ok = F.when(F.col("verifier_passed") != 0, 1.0).when(F.col("verifier_passed") == 0, 0.0)
    return table(spark, d, "queries").groupBy(F.col("response_type").alias("category")).agg(F.count(F.lit(1)).alias("total"), F.count("verifier_passed").alias("scored"), F.round(F.avg(ok), 3).alias("accuracy"))


@query("agg_confusable", """SELECT name, m[1] AS first, m[2] AS second FROM (SELECT canonical_name AS name, list_sort(list(DISTINCT cnic)) AS m FROM entity_summaries WHERE canonical_name IS NOT NULL AND cnic IS NOT NULL GROUP BY 1) WHERE len(m) > 1""")
def agg_confusable(spark, d):
    return agg.confusable(table(spark, d, "entity_summaries"), "canonical_name", "cnic")


@query("set_intersect", """SELECT DISTINCT a.case_id FROM (SELECT case_id FROM structured_fields WHERE station_code = 'PS001') a JOIN (SELECT case_id FROM documents WHERE lang = 'ur') b USING (case_id)""")
def set_intersect(spark, d):
    a = table(spark, d, "structured_fields").where("station_code = 'PS001' and case_id is not null").select("case_id")
    return a.intersect(table(spark, d, "documents").where("lang = 'ur'").select("case_id"))


@query("set_diff", "SELECT case_id FROM cases EXCEPT SELECT case_id FROM documents")
def set_diff(spark, d):
    return table(spark, d, "cases").select("case_id").subtract(table(spark, d, "documents").select("case_id"))


@query("limit_analytics", "SELECT query_id, created_at FROM (SELECT DISTINCT query_id, created_at FROM queries) ORDER BY created_at DESC, query_id LIMIT 50000")
def limit_analytics(spark, d):
    return rel.log_page(table(spark, d, "queries").select("query_id", "created_at").distinct(), "created_at", "query_id", limit=50_000)

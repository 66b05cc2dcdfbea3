"""Further operators: sources and sinks, joins, extraction, graph upkeep, composites."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from caselens import scope
from caselens.functions import extract as ex
from caselens.functions import misc
from caselens.functions import text as tx
from caselens.operators import aggregates as agg
from caselens.operators import graph as gr
from caselens.operators import relational as rel
from caselens.operators import resolution as er
from caselens.operators import retrieval as rt
from caselens.operators import timeseries as ts
from caselens.operators import verification as vf
from caselens.operators import windows as win
from caselens.plans.registry import Registry
from caselens.session import Scratch
from caselens.sources import files
from caselens.streaming import events as st
from caselens.tables import table

_R = Registry()
QUERIES, SQL, query = _R.QUERIES, _R.SQL, _R.query


@query("src_mcp_sql", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def src_mcp_sql(spark, d):
    return spark.sql("SELECT lang, count(*) AS n FROM {docs} GROUP BY 1", docs=table(spark, d, "documents"))


@query("src_meta", "SELECT doc_id, concat_ws(';', 'lang=' || lang, 'type=' || doc_type, 'case=' || case_id) AS meta FROM documents")
def prj_meta(spark, d):
    kv = [F.concat(F.lit(f"{k}="), F.col(c)) for k, c in (("lang", "lang"), ("type", "doc_type"), ("case", "case_id"))]
    return table(spark, d, "documents").select("doc_id", F.concat_ws(";", *kv).alias("meta"))


@query("sink_chunks", "SELECT message_id, max(loaded_at) AS loaded_at FROM messages GROUP BY 1")
def sink_chunks(spark, d):
    return rel.latest_per_key(table(spark, d, "messages"), "message_id", "loaded_at").select("message_id", "loaded_at")


@query("sink_files", "SELECT case_id, CASE WHEN regexp_matches(investigation_officer, '^[=+\\-@\\t\\r]') THEN '''' || investigation_officer ELSE investigation_officer END AS cell FROM cases")
def sink_files(spark, d):
    return table(spark, d, "cases").select("case_id", files.safe_cell(F.col("investigation_officer")).alias("cell"))


@query("sink_export")
def sink_export(spark, d):
    m = table(spark, d, "messages").select("session_id", "created_at", "message_id", "role", "content").distinct()
    return files.export_session(m)


@query("scan_all_scoped", "SELECT doc_id FROM documents WHERE case_id = 'CASE-00000000' AND lang = 'en'")
def scan_all_scoped(spark, d):
    return table(spark, d, "documents").where(scope.Scope(case_id="CASE-00000000", source="en").predicate(source="lang")).select("doc_id")


@query("flt_case_guard", "SELECT doc_id FROM documents WHERE case_id = 'CASE-00000001'")
def flt_case_guard(spark, d):
    return table(spark, d, "documents").where(F.col("case_id") == scope.require_case("CASE-00000001")).select("doc_id")


@query("flt_role_gate", "SELECT 'cross_case_query' AS event, 'supervisor' AS role UNION ALL SELECT 'authorization_violation', 'investigator'")
def flt_role_gate(spark, d):
    audit: list[dict] = []
    for role in ("supervisor", "investigator"):
        try:
            scope.require_cross_case(role, audit)
        except scope.AccessDenied:
            pass
    return spark.createDataFrame([(a["event"], a["role"]) for a in audit], "event string, role string")


@query("flt_err", "SELECT event_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 25")
def flt_err(spark, d):
    return rel.log_page(table(spark, d, "events"), "ts", "event_id", limit=25, event_type="error").select("event_id")


@query("flt_runs", "SELECT query_id FROM (SELECT DISTINCT query_id, created_at FROM queries WHERE response_type = 'rag' AND created_at >= TIMESTAMP '2025-06-01') ORDER BY created_at DESC, query_id LIMIT 100")
def flt_runs(spark, d):
    q = table(spark, d, "queries").select("query_id", "created_at", "response_type").distinct()
    return rel.log_page(q, "created_at", "query_id", since="2025-06-01", limit=100, response_type="rag").select("query_id")


@query("flt_script", "SELECT DISTINCT query_id FROM queries WHERE rewritten_query IS NOT NULL AND regexp_matches(rewritten_query, '[\\x{0600}-\\x{06FF}]') = regexp_matches(user_message, '[\\x{0600}-\\x{06FF}]')")
def flt_script(spark, d):
    q = table(spark, d, "queries").where("rewritten_query is not null and user_message is not null")
    return q.where((tx.script(F.col("rewritten_query")) == tx.script(F.col("user_message"))) & ~F.col("rewritten_query").rlike(r"[\x{0900}-\x{097F}]")).select("query_id").distinct()


@query("flt_current", "SELECT l_partkey, l_suppkey, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS n FROM lineitem) WHERE n = 1")
def flt_current(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate")
    chain = win.supersede_chain(rows, ["l_partkey", "l_suppkey"], [F.col("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")], "l_orderkey")
    return gr.current(chain).select("l_partkey", "l_suppkey", "l_orderkey")


@query("flt_domains", """SELECT DISTINCT query_id FROM (SELECT query_id, lower(regexp_extract(user_message, '@([^/\\s:]+)', 1)) AS h FROM queries) WHERE h = 'kestrow.example.net' OR h LIKE '%.test' OR h = 'test'""")
def flt_domains(spark, d):
    q = table(spark, d, "queries")
    return q.where(misc.allowed_host(F.col("user_message"), ["kestrow.example.net", "test"])).select("query_id").distinct()


@query("prj_case", """SELECT case_id, crime_category, investigation_status, investigation_officer, incident_date FROM cases""")
def prj_case(spark, d):
    c = table(spark, d, "cases")
    fir = F.struct(
        F.lit(None).cast("string").alias("case_id"),
        F.col("case_id").alias("id"),
        F.col("incident_date").cast("string").alias("incident_at"),
        F.when(F.col("crime_category").isNotNull(), F.array(F.struct(F.col("crime_category").alias("act")))).alias("sections"),
        F.array(F.struct(F.col("investigation_status").alias("position"), F.lit("2025-01-01").alias("status_date"))).alias("statuses"),
        F.array(F.struct(F.col("investigation_officer").alias("name"), F.lit(None).cast("string").alias("assigned_to"))).alias("officers"),
    )
    out = c.select(fir.alias("fir")).select(*rel.case_fields())
    return out.withColumn("crime_category", F.nullif("crime_category", F.lit("")))


@query("prj_render_fir", """SELECT case_id, 'Location' AS label, location AS text FROM cases WHERE trim(location) <> '' UNION ALL SELECT case_id, 'Description', description FROM cases WHERE trim(description) <> ''""")
def prj_render_fir(spark, d):
    c = table(spark, d, "cases")
    parts = F.array(F.struct(F.lit("Location").alias("label"), F.col("location").alias("text")), F.struct(F.lit("Description").alias("label"), F.col("description").alias("text")))
    return c.select("case_id", F.explode(parts).alias("p")).where(F.trim("p.text") != "").select("case_id", "p.label", "p.text")


@query("join_assign_user", "SELECT DISTINCT f.field_id, s.desk_phone FROM structured_fields f JOIN stations s USING (station_code) WHERE s.desk_phone IS NOT NULL")
def join_assign_user(spark, d):
    s = table(spark, d, "stations").where("desk_phone is not null").select("station_code", "desk_phone")
    return table(spark, d, "structured_fields").join(s, "station_code").select("field_id", "desk_phone").distinct()


@query("join_mcp_run", "SELECT DISTINCT q.query_id, m.message_id FROM queries q LEFT JOIN (SELECT DISTINCT session_id, message_id, created_at FROM messages WHERE role = 'user') m ON m.session_id = q.session_id AND m.created_at = q.created_at")
def join_mcp_run(spark, d):
    m = table(spark, d, "messages").where("role = 'user'").select("session_id", "message_id", "created_at").distinct()
    return table(spark, d, "queries").select("query_id", "session_id", "created_at").join(m, ["session_id", "created_at"], "left").select("query_id", "message_id").distinct()


@query("join_etag", "SELECT m.match_id, c.case_id FROM (SELECT DISTINCT match_id, normalized FROM field_matches WHERE field_type = 'fir_number') m LEFT JOIN (SELECT fir_number, min(case_id) AS case_id FROM cases WHERE fir_number IS NOT NULL GROUP BY 1) c ON c.fir_number = m.normalized")
def join_etag(spark, d):
    c = table(spark, d, "cases").where("fir_number is not null").groupBy(F.col("fir_number").alias("normalized")).agg(F.min("case_id").alias("case_id"))
    return table(spark, d, "field_matches").where("field_type = 'fir_number'").select("match_id", "normalized").distinct().join(c, "normalized", "left").select("match_id", "case_id")


@query("join_name_infir", """SELECT DISTINCT w.case_id, w.witness_name AS name FROM structured_fields w JOIN structured_fields c ON c.case_id = w.case_id AND c.complainant_name = w.witness_name""")
def join_name_infir(spark, d):
    f = table(spark, d, "structured_fields")
    w = f.select("case_id", F.explode(tx.name_list(F.col("witness_name"))).alias("name"))
    c = f.select("case_id", F.col("complainant_name").alias("name")).where("name is not null").distinct()
    return w.join(c, ["case_id", "name"], "left_semi").distinct()


@query("join_conflict_case", """SELECT e AS entity_id, round(min(confidence), 6) AS weakest, string_agg(DISTINCT basis, '; ' ORDER BY basis) AS basis FROM (SELECT mention.entity_id AS e, confidence, basis FROM pending_matches UNION ALL SELECT candidate.entity_id, confidence, basis FROM pending_matches) WHERE e LIKE 'ORG-%' GROUP BY 1""")
def join_conflict_case(spark, d):
    p = table(spark, d, "pending_matches").select(F.explode(F.array("mention.entity_id", "candidate.entity_id")).alias("entity_id"), "confidence", "basis").where("entity_id like 'ORG-%'")
    return p.groupBy("entity_id").agg(F.round(F.min("confidence"), 6).alias("weakest"), F.array_join(F.sort_array(F.collect_set("basis")), "; ").alias("basis"))


@query("join_dated", "SELECT DISTINCT d.doc_id, m.normalized AS day, d.case_id FROM documents d JOIN field_matches m USING (doc_id) WHERE m.field_type = 'date' AND d.case_id IS NOT NULL")
def join_dated(spark, d):
    m = table(spark, d, "field_matches").where("field_type = 'date'").select("doc_id", F.col("normalized").alias("day"))
    return table(spark, d, "documents").where("case_id is not null").select("doc_id", "case_id").join(m, "doc_id").distinct()


@query("join_optional_date", "SELECT d.doc_id, min(m.normalized) AS day FROM documents d LEFT JOIN (SELECT doc_id, normalized FROM field_matches WHERE field_type = 'date') m USING (doc_id) WHERE d.doc_type = 'FIR' GROUP BY 1")
def join_optional_date(spark, d):
    m = table(spark, d, "field_matches").where("field_type = 'date'").groupBy("doc_id").agg(F.min("normalized").alias("day"))
    return table(spark, d, "documents").where("doc_type = 'FIR'").select("doc_id").join(m, "doc_id", "left")


@query("join_review", """SELECT DISTINCT p.edge_id, a.beat_code AS beat_a, b.beat_code AS beat_b FROM pending_matches p LEFT JOIN (SELECT DISTINCT entity_id, beat_code FROM entity_summaries) a ON a.entity_id = p.mention.entity_id LEFT JOIN (SELECT DISTINCT entity_id, beat_code FROM entity_summaries) b ON b.entity_id = p.candidate.entity_id""")
def join_review(spark, d):
    e = table(spark, d, "entity_summaries").select("entity_id", "beat_code").distinct()
    p = table(spark, d, "pending_matches").select("edge_id", F.col("mention.entity_id").alias("a"), F.col("candidate.entity_id").alias("b"))
    p = p.join(e.select(F.col("entity_id").alias("a"), F.col("beat_code").alias("beat_a")), "a", "left")
    return p.join(e.select(F.col("entity_id").alias("b"), F.col("beat_code").alias("beat_b")), "b", "left").select("edge_id", "beat_a", "beat_b").distinct()


@query("join_blocking", """SELECT DISTINCT a.entity_id AS a, b.entity_id AS b FROM entity_summaries a JOIN entity_summaries b ON a.beat_code = b.beat_code AND lower(a.canonical_name) = lower(b.canonical_name) AND a.entity_id < b.entity_id WHERE coalesce(a.cnic = b.cnic, true)""")
def join_blocking(spark, d):
    e = table(spark, d, "entity_summaries").select("entity_id", "beat_code", F.lower("canonical_name").alias("n"), "cnic").distinct()
    a, b = (e.select(F.col("entity_id").alias(x), "beat_code", "n", F.col("cnic").alias(f"c{x}")) for x in "ab")
    return a.join(b, ["beat_code", "n"]).where((F.col("a") < F.col("b")) & F.coalesce(F.col("ca") == F.col("cb"), F.lit(True))).select("a", "b").distinct()


@query("join_filename_case", "SELECT DISTINCT d.doc_id, c.case_id FROM documents d JOIN cases c ON c.case_id = d.case_id")
def join_filename_case(spark, d):
    # a case lists its files; the last part of each path names the document
    linked = table(spark, d, "documents").where("case_id is not null").select("case_id", F.concat(F.lit("in/x/"), F.col("doc_id").cast("string"), F.lit(";")).alias("paths"))
    linked = linked.join(table(spark, d, "cases").select("case_id"), "case_id", "left_semi")
    each = linked.select("case_id", F.explode(F.split("paths", ";")).alias("p")).where("p <> ''")
    return each.select(F.substring_index("p", "/", -1).cast("long").alias("doc_id"), "case_id").distinct()


@query("agg_dispatch", "SELECT count(*) AS n FROM cases")
def agg_dispatch(spark, d):
    return dispatch("how many cases are there in total", table(spark, d, "cases"))


def dispatch(question: str, cases):
    """A cross-case question answered by its words: grouped counts, a total or a listing."""
    q = question.lower()
    if "station" in q or "category" in q:
        return agg.group_counts(cases, "police_station" if "station" in q else "crime_category")
    if "how many" in q or "total" in q:
        return cases.agg(F.count(F.lit(1)).alias("n"))
    return cases.select("case_id", "fir_number", "crime_category", "police_station", "investigation_status")


@query("topk_comm", "SELECT beat_code, n FROM (SELECT beat_code, count(*) AS n FROM entity_summaries WHERE beat_code IS NOT NULL GROUP BY 1 ORDER BY n DESC, beat_code LIMIT 10) WHERE beat_code IN (SELECT beat_code FROM structured_fields WHERE case_id IS NOT NULL)")
def topk_comm(spark, d):
    c = table(spark, d, "entity_summaries").where("beat_code is not null").groupBy("beat_code").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "beat_code").limit(10)
    return c.join(table(spark, d, "structured_fields").where("case_id is not null").select("beat_code"), "beat_code", "left_semi")


@query("limit_pool", "SELECT doc_id FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 2000")
def limit_pool(spark, d):
    return table(spark, d, "documents").where("lang = 'en'").orderBy("doc_id").limit(2000).select("doc_id")


@query("set_multi_list", "SELECT doc_id, 'en' AS list FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 'fir' FROM documents WHERE doc_type = 'FIR'")
def set_multi_list(spark, d):
    docs = table(spark, d, "documents")
    return docs.where("lang = 'en'").select("doc_id", F.lit("en").alias("list")).unionByName(docs.where("doc_type = 'FIR'").select("doc_id", F.lit("fir").alias("list")))


@query("set_dedupe_overlap")
def set_dedupe_overlap(spark, d):
    m = table(spark, d, "field_matches").select("doc_id", "start_pos", "end_pos", "match_id").distinct().withColumn("sure", F.length(F.col("match_id").cast("string")) / 10.0)
    g = m.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_pos", "end_pos", "sure"))).alias("s"))
    return g.select("doc_id", F.size(misc.kept_spans("s.start_pos", "s.end_pos", "s.sure")).alias("kept"), F.size("s").alias("found"))


@query("ts_parse", "SELECT match_id, TRY_CAST(normalized AS TIMESTAMP) AS at FROM (SELECT DISTINCT match_id, normalized FROM field_matches WHERE field_type = 'date' AND regexp_full_match(normalized, '[0-9]{4}-[0-9]{2}-[0-9]{2}'))")
def ts_parse(spark, d):
    m = table(spark, d, "field_matches").where(r"field_type = 'date' and normalized rlike '^[0-9]{4}-[0-9]{2}-[0-9]{2}$'").select("match_id", "normalized").distinct()
    return m.select("match_id", ts.parse_ts(F.col("normalized")).cast("timestamp_ntz").alias("at"))


@query("ts_spine", "SELECT strftime(unnest(generate_series(date_trunc('hour', max(ts)) - INTERVAL 2 DAY, date_trunc('hour', max(ts)), INTERVAL 1 HOUR)), '%Y-%m-%dT%H:00') AS bucket FROM events")
def ts_spine(spark, d):
    return ts.spine(table(spark, d, "events"), "ts", 2, "hour")


@query("inc_index")
def inc_index(spark, d):
    """Postings kept up to date by a stream of documents."""
    docs = st.read(spark, d, "documents.parquet").select("doc_id", "text").where("text is not null")
    terms = docs.select("doc_id", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term"))
    return st.drain(terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "index")


@query("txt_boundary")
def txt_boundary(spark, d):
    ends = F.transform(tx.sentences("text"), lambda s: F.length(s))
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", misc.boundary_before(ends, F.lit(512), F.lit(64)).alias("cut"))


@query("txt_skeleton")
def txt_skeleton(spark, d):
    return table(spark, d, "entity_summaries").where("canonical_name is not null").select("entity_id", misc.consonants("canonical_name").alias("skeleton")).distinct()


@query("txt_namesim")
def txt_namesim(spark, d):
    p = table(spark, d, "pending_matches").select("edge_id", F.col("mention.canonical_name").alias("a"), F.col("candidate.canonical_name").alias("b")).distinct()
    return p.select("edge_id", F.round(er.name_ratio("a", "b"), 6).alias("similarity"))


@query("txt_cell", "SELECT case_id, concat_ws(' | ', fir_number, crime_category, police_station) AS line FROM cases")
def txt_cell(spark, d):
    return table(spark, d, "cases").select("case_id", F.concat_ws(" | ", "fir_number", "crime_category", "police_station").alias("line"))


@query("txt_json_extract", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events WHERE event_type = 'error'")
def txt_json_extract(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'")
    return e.select("event_id", F.get_json_object(misc.first_json(F.concat(F.lit("Sure: {oops "), "props", F.lit(" done"))), "$.k").cast("int").alias("k"))


@query("dt_date_only", "SELECT query_id, CAST(created_at AS DATE) AS day FROM (SELECT DISTINCT query_id, created_at FROM queries)")
def dt_date_only(spark, d):
    return table(spark, d, "queries").select("query_id", "created_at").distinct().select("query_id", misc.date_only(F.col("created_at").cast("string")).alias("day"))


@query("dt_registration")
def dt_registration(spark, d):
    r = table(spark, d, "documents").select("doc_id", misc.registration(F.col("text")).alias("r"))
    return r.select("doc_id", "r.day", "r.how")


@query("dt_validity", "SELECT DISTINCT regexp_extract(normalized, '(20[0-9]{2})', 1) AS y, make_date(CAST(regexp_extract(normalized, '(20[0-9]{2})', 1) AS INT), 7, 1) AS effective_from FROM field_matches WHERE field_type = 'fir_number' AND regexp_matches(normalized, '20[0-9]{2}')")
def dt_validity(spark, d):
    m = table(spark, d, "field_matches").where("field_type = 'fir_number' and normalized rlike '20[0-9]{2}'")
    return m.select(F.regexp_extract("normalized", "(20[0-9]{2})", 1).alias("y"), files.effective_range(F.col("normalized"))[0]).distinct()


@query("m_priority", "SELECT DISTINCT edge_id, round(least(confidence + 0.1, 0.95), 6) AS p FROM pending_matches WHERE confidence IS NOT NULL")
def m_priority(spark, d):
    return table(spark, d, "pending_matches").where("confidence is not null").select("edge_id", F.round(F.least(F.col("confidence") + 0.1, F.lit(0.95)), 6).alias("p")).distinct()


@query("m_safe_pct", "SELECT police_station, CASE WHEN count(*) > 0 THEN round_even(count(incident_date) / count(*) * 100, 1) ELSE 0 END AS dated_pct FROM cases GROUP BY 1")
def m_safe_pct(spark, d):
    return table(spark, d, "cases").groupBy("police_station").agg(agg.safe_pct(F.count("incident_date"), F.count(F.lit(1))).alias("dated_pct"))


@query("ar_service", "SELECT DISTINCT entity_id, CASE WHEN cnic IS NOT NULL THEN 'cnic' WHEN plate IS NOT NULL THEN 'plate' END AS kind, coalesce(cnic, plate) AS value FROM entity_summaries")
def ar_service(spark, d):
    e = table(spark, d, "entity_summaries").select("entity_id", misc.tagged_service({"cnic": F.col("cnic"), "plate": F.col("plate")}).alias("s"))
    return e.select("entity_id", "s.kind", "s.value").distinct()


@query("ar_children", "SELECT case_id, count(DISTINCT field_id) AS n FROM cases LEFT JOIN structured_fields USING (case_id) GROUP BY 1")
def ar_children(spark, d):
    f = table(spark, d, "structured_fields").groupBy("case_id").agg(F.countDistinct("field_id").alias("k"))
    return table(spark, d, "cases").select("case_id").distinct().join(f, "case_id", "left").select("case_id", F.coalesce("k", F.lit(0)).alias("n"))


@query("js_agtype", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events WHERE event_type = 'view'")
def js_agtype(spark, d):
    e = table(spark, d, "events").where("event_type = 'view'")
    return e.select("event_id", F.get_json_object(misc.strip_graph_suffix(F.concat("props", F.lit("::vertex"))), "$.k").cast("int").alias("k"))


@query("js_reclass", "SELECT event_id, CASE WHEN value <= 90 AND event_id % 2 = 0 THEN 'warning' WHEN value > 90 THEN 'critical' ELSE 'error' END AS severity FROM events WHERE event_type = 'error'")
def js_reclass(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'")
    message = F.when(F.col("event_id") % 2 == 0, "HTTP 429: Too many requests").otherwise("broken")
    return e.select("event_id", misc.reclassify(F.when(F.col("value") > 90, "critical").otherwise("error"), message).alias("severity"))


@query("ex_display")
def ex_display(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(ex.DISPLAY), F.lit(1)))).alias("display"))


@query("ex_sections", "SELECT DISTINCT match_id, unnest(string_split_regex(normalized, '\\s*,\\s*')) AS section FROM field_matches WHERE field_type = 'section' AND normalized IS NOT NULL")
def ex_sections(spark, d):
    m = table(spark, d, "field_matches").where("field_type = 'section' and normalized is not null")
    return m.select("match_id", F.explode(F.split("normalized", r"\s*,\s*")).alias("section")).distinct()


@query("ex_ner_degrade")
def ex_ner_degrade(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.size(ex.entities(F.col("text"), 0.6)).alias("sure"), F.size(ex.entities(F.col("text"), 0.5)).alias("kept"))


@query("ex_unresolved", "SELECT DISTINCT match_id, 'NEW-' || match_id AS node FROM field_matches WHERE normalized IS NULL")
def ex_unresolved(spark, d):
    return table(spark, d, "field_matches").where("normalized is null").select("match_id", F.concat(F.lit("NEW-"), F.col("match_id").cast("string")).alias("node")).distinct()


@query("er_shared_id", "SELECT DISTINCT edge_id, coalesce(mention.cnic <> '' AND mention.cnic = candidate.cnic, false) OR coalesce(mention.plate <> '' AND mention.plate = candidate.plate, false) AS shared FROM pending_matches")
def er_shared_id(spark, d):
    eq = lambda k: F.coalesce((F.col(f"mention.{k}") != "") & (F.col(f"mention.{k}") == F.col(f"candidate.{k}")), F.lit(False))
    return table(spark, d, "pending_matches").select("edge_id", (eq("cnic") | eq("plate")).alias("shared")).distinct()


@query("er_shared_case", """SELECT DISTINCT edge_id FROM pending_matches p SEMI JOIN (SELECT a.source_doc_id, a.mention.entity_id AS e FROM pending_matches a) x ON x.source_doc_id = p.source_doc_id AND x.e = p.candidate.entity_id""")
def er_shared_case(spark, d):
    p = table(spark, d, "pending_matches")
    here = p.select("source_doc_id", F.col("mention.entity_id").alias("e"))
    return p.select("edge_id", "source_doc_id", F.col("candidate.entity_id").alias("e")).join(here, ["source_doc_id", "e"], "left_semi").select("edge_id").distinct()


@query("er_write", """SELECT label, count(*) AS n FROM (SELECT DISTINCT mention.entity_id AS src, 'APPEARS_IN' AS label, source_chunk_id AS dst FROM pending_matches WHERE mention.entity_id IS NOT NULL AND source_chunk_id IS NOT NULL
 UNION ALL SELECT DISTINCT mention.entity_id, 'SAME_AS', candidate.entity_id FROM pending_matches WHERE mention.entity_id IS NOT NULL AND candidate.entity_id IS NOT NULL) GROUP BY 1""")
def er_write(spark, d):
    p = table(spark, d, "pending_matches")
    a = p.select(F.col("mention.entity_id").alias("src"), F.lit("APPEARS_IN").alias("label"), F.col("source_chunk_id").alias("dst"))
    b = p.select(F.col("mention.entity_id").alias("src"), F.lit("SAME_AS").alias("label"), F.col("candidate.entity_id").alias("dst"))
    return a.unionByName(b).where("src is not null and dst is not null").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("er_distinct_names")
def er_distinct_names(spark, d):
    f = table(spark, d, "structured_fields").select(F.col("beat_code").alias("b"), F.col("complainant_name").alias("name"))
    return er.distinct_people(f).select(F.col("b").alias("beat_code"), "people")


@query("gv_node", "SELECT entity_id, max(first_seen_at) AS seen FROM entity_summaries GROUP BY 1")
def gv_node(spark, d):
    return rel.latest_per_key(table(spark, d, "entity_summaries"), "entity_id", "first_seen_at").select("entity_id", F.col("first_seen_at").alias("seen"))


@query("gv_lock", "SELECT DISTINCT edge_id, edge_id % 2 = 0 AS locked FROM pending_matches")
def gv_lock(spark, d):
    return table(spark, d, "pending_matches").select("edge_id", (F.col("edge_id") % 2 == 0).alias("locked")).distinct()


@query("gt_seed", "SELECT DISTINCT query_id, unnest(regexp_extract_all(user_message, 'FIR-\\d{4}-[A-Z]+-\\d{3,4}')) AS seed FROM queries")
def gt_seed(spark, d):
    return table(spark, d, "queries").select("query_id", F.explode(ex.fir_numbers(F.col("user_message"))).alias("seed")).distinct()


@query("gt_enum", "SELECT DISTINCT p.mention.entity_id AS entity_id FROM pending_matches p SEMI JOIN (SELECT doc_id FROM documents WHERE case_id = 'CASE-00000000') d ON d.doc_id = p.source_doc_id WHERE p.mention.entity_id IS NOT NULL")
def gt_enum(spark, d):
    docs = table(spark, d, "documents").where("case_id = 'CASE-00000000'").select(F.col("doc_id").alias("source_doc_id"))
    return table(spark, d, "pending_matches").join(docs, "source_doc_id", "left_semi").select(F.col("mention.entity_id").alias("entity_id")).where("entity_id is not null").distinct()


@query("gt_seed_nodes", "SELECT DISTINCT entity_id FROM entity_summaries WHERE contains(lower(canonical_name), 'turbwal') OR contains(lower(plate), 'abc')")
def gt_seed_nodes(spark, d):
    hit = F.lower("canonical_name").contains("turbwal") | F.lower("plate").contains("abc")
    return table(spark, d, "entity_summaries").where(hit).select("entity_id").distinct()


@query("gc_context", """SELECT DISTINCT p.edge_id FROM pending_matches p JOIN entity_summaries a ON a.entity_id = p.mention.entity_id JOIN entity_summaries b ON b.entity_id = p.candidate.entity_id WHERE a.beat_code = b.beat_code""")
def gc_context(spark, d):
    e = table(spark, d, "entity_summaries").where("beat_code is not null").select("entity_id", "beat_code").distinct()
    p = table(spark, d, "pending_matches").select("edge_id", F.col("mention.entity_id").alias("a"), F.col("candidate.entity_id").alias("b"))
    p = p.join(e.select(F.col("entity_id").alias("a"), "beat_code"), "a")
    return p.join(e.select(F.col("entity_id").alias("b"), "beat_code"), ["b", "beat_code"], "left_semi").select("edge_id").distinct()


@query("gc_summ", "SELECT beat_code, count(DISTINCT entity_id) || ' members, ' || count(DISTINCT canonical_name) || ' names' AS summary FROM entity_summaries WHERE beat_code IS NOT NULL GROUP BY 1 HAVING count(DISTINCT canonical_name) >= 2")
def gc_summ(spark, d):
    g = table(spark, d, "entity_summaries").where("beat_code is not null").groupBy("beat_code").agg(F.countDistinct("entity_id").alias("m"), F.countDistinct("canonical_name").alias("n")).where("n >= 2")
    return g.select("beat_code", F.format_string("%d members, %d names", "m", "n").alias("summary"))


@query("gc_reads", "SELECT DISTINCT lower(trim(station_name)) AS station FROM stations")
def gc_reads(spark, d):
    return table(spark, d, "stations").select(F.lower(F.trim("station_name")).alias("station")).distinct()


@query("gc_latest", "SELECT max(created_at) AS newest FROM queries")
def gc_latest(spark, d):
    return table(spark, d, "queries").agg(F.max("created_at").alias("newest"))


@query("gx_conflict_ground", "SELECT m.match_id FROM (SELECT DISTINCT match_id, doc_id, raw_text FROM field_matches WHERE raw_text <> '') m JOIN documents d USING (doc_id) WHERE contains(d.text, m.raw_text)")
def gx_conflict_ground(spark, d):
    m = table(spark, d, "field_matches").where("raw_text <> ''").select("match_id", "doc_id", "raw_text").distinct()
    return m.join(table(spark, d, "documents").select("doc_id", "text"), "doc_id").where(F.contains("text", "raw_text")).select("match_id")


@query("gp_officers", """SELECT police_station, case_id, coalesce(lead(case_id) OVER (PARTITION BY police_station ORDER BY created_at NULLS LAST, case_id), '') AS superseded_by FROM (SELECT DISTINCT police_station, case_id, created_at FROM cases WHERE investigation_officer IS NOT NULL)""")
def gp_officers(spark, d):
    c = table(spark, d, "cases").where("investigation_officer is not null").select("police_station", "case_id", "created_at").distinct()
    out = win.supersede_chain(c, ["police_station"], [F.col("created_at").asc_nulls_last(), F.col("case_id")], "case_id")
    return out.select("police_station", "case_id", F.coalesce("superseded_by", F.lit("")).alias("superseded_by"))


@query("gp_ids", "SELECT case_id, 'INCIDENT-FIR-' || case_id AS incident FROM cases")
def gp_ids(spark, d):
    return table(spark, d, "cases").select("case_id", F.concat(F.lit("INCIDENT-FIR-"), "case_id").alias("incident"))


@query("gp_station_key", "SELECT case_id, coalesce(police_station, beat_code, 'unknown') AS station_key FROM cases")
def gp_station_key(spark, d):
    return table(spark, d, "cases").select("case_id", F.coalesce("police_station", "beat_code", F.lit("unknown")).alias("station_key"))


@query("gp_mentions", "SELECT DISTINCT field_id, nullif(trim(complainant_name), '') AS name, nullif(regexp_replace(complainant_cnic, '[^0-9]', '', 'g'), '') AS cnic FROM structured_fields")
def gp_mentions(spark, d):
    f = table(spark, d, "structured_fields")
    return f.select("field_id", F.nullif(F.trim("complainant_name"), F.lit("")).alias("name"), F.nullif(F.regexp_replace("complainant_cnic", "[^0-9]", ""), F.lit("")).alias("cnic")).distinct()


@query("gp_new_person", "SELECT DISTINCT 'PERSON-' || sha256(concat_ws('|', case_id, complainant_name)) AS person FROM structured_fields WHERE complainant_name IS NOT NULL AND case_id IS NOT NULL AND complainant_cnic IS NULL")
def gp_new_person(spark, d):
    f = table(spark, d, "structured_fields").where("complainant_name is not null and case_id is not null and complainant_cnic is null")
    return f.select(F.concat(F.lit("PERSON-"), F.sha2(F.concat_ws("|", "case_id", "complainant_name"), 256)).alias("person")).distinct()


@query("gp_criminal", "SELECT DISTINCT e.entity_id, f.field_id FROM entity_summaries e JOIN structured_fields f ON f.complainant_cnic = e.cnic WHERE e.entity_type = 'Person' AND f.doc_kind = 'FIR'")
def gp_criminal(spark, d):
    e = table(spark, d, "entity_summaries").where("entity_type = 'Person' and cnic is not null").select("entity_id", "cnic")
    f = table(spark, d, "structured_fields").where("doc_kind = 'FIR' and complainant_cnic is not null").select("field_id", F.col("complainant_cnic").alias("cnic"))
    return e.join(f, "cnic").select("entity_id", "field_id").distinct()


@query("gp_cms", "SELECT DISTINCT f.field_id, 'STATION:' || f.station_code AS station, 'CASE:' || f.case_id AS related FROM structured_fields f WHERE f.station_code IS NOT NULL AND f.case_id IS NOT NULL AND f.doc_kind <> 'FIR'")
def gp_cms(spark, d):
    f = table(spark, d, "structured_fields").where("station_code is not null and case_id is not null and doc_kind <> 'FIR'")
    return f.select("field_id", F.concat(F.lit("STATION:"), "station_code").alias("station"), F.concat(F.lit("CASE:"), "case_id").alias("related")).distinct()


@query("gp_pkm", "SELECT DISTINCT w.field_id AS a, c.field_id AS b FROM structured_fields w JOIN structured_fields c ON c.complainant_cnic = w.witness_cnic AND c.field_id <> w.field_id")
def gp_pkm(spark, d):
    f = table(spark, d, "structured_fields")
    w = f.where("witness_cnic is not null").select(F.col("field_id").alias("a"), F.col("witness_cnic").alias("k"))
    c = f.where("complainant_cnic is not null").select(F.col("field_id").alias("b"), F.col("complainant_cnic").alias("k"))
    return w.join(c, "k").where("a <> b").select("a", "b").distinct()


@query("rt_embed")
def rt_embed(spark, d):
    return rt.hashed_embedding(table(spark, d, "documents"), "doc_id", "text").select("key", F.size("embedding").alias("dimensions"))


@query("rt_rerank", "SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE case_id = 'CASE-00000000' QUALIFY rank <= 10")
def rt_rerank(spark, d):
    docs = table(spark, d, "documents").where("case_id = 'CASE-00000000'").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(10)
    return docs.select("doc_id", F.row_number().over(W.orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))  # ten rows


@query("rt_subagent", """SELECT query_id, CASE WHEN contains(lower(q), 'timeline') THEN 'timeline' WHEN contains(lower(q), 'summar') THEN 'summary' WHEN contains(lower(q), 'how many') THEN 'aggregate' WHEN contains(lower(q), 'other case') THEN 'linkage' ELSE 'search' END AS agent FROM (SELECT DISTINCT query_id, user_message AS q FROM queries WHERE user_message IS NOT NULL)""")
def rt_subagent(spark, d):
    q = table(spark, d, "queries").where("user_message is not null").select("query_id", F.lower("user_message").alias("q")).distinct()
    rules = [("timeline", "timeline"), ("summar", "summary"), ("how many", "aggregate"), ("other case", "linkage")]
    agent = F.lit("search")
    for word, name in reversed(rules):
        agent = F.when(F.col("q").contains(word), name).otherwise(agent)
    return q.select("query_id", agent.alias("agent"))


@query("vf_leak", """WITH c AS (SELECT query_id, CAST(unnest(regexp_extract_all(final_response, '[\\[(]Document (\\d+)[\\])]', 1)) AS INT) AS n FROM queries) SELECT query_id, min(n) AS number FROM c WHERE n > 7 GROUP BY 1""")
def vf_leak(spark, d):
    a = table(spark, d, "queries").select(F.col("query_id").alias("answer_id"), F.col("final_response").alias("text")).distinct()
    numbers = F.explode(F.sequence(F.lit(1), F.lit(9)))
    p = a.select("answer_id").distinct().select("answer_id", numbers.alias("number")).withColumn("case_id", F.when(F.col("number") > 7, "other").otherwise("own"))
    ok = a.select("answer_id", F.lit("own").alias("case_id")).distinct()
    return vf.leaks(a, p, ok).select(F.col("answer_id").alias("query_id"), "number")


@query("rq_maintain", "SELECT edge_id, round(max(confidence), 6) AS priority FROM pending_matches GROUP BY 1")
def rq_maintain(spark, d):
    return table(spark, d, "pending_matches").groupBy("edge_id").agg(F.round(F.max("confidence"), 6).alias("priority"))


@query("rq_lookup", "SELECT p.mention.entity_id AS entity_id, string_agg(DISTINCT d.case_id, ',' ORDER BY d.case_id) AS cases FROM pending_matches p JOIN documents d ON d.doc_id = p.source_doc_id WHERE p.mention.entity_id IS NOT NULL AND d.case_id IS NOT NULL GROUP BY 1")
def rq_lookup(spark, d):
    p = table(spark, d, "pending_matches").select(F.col("mention.entity_id").alias("entity_id"), F.col("source_doc_id").alias("doc_id")).where("entity_id is not null")
    j = p.join(table(spark, d, "documents").where("case_id is not null").select("doc_id", "case_id"), "doc_id")
    return j.groupBy("entity_id").agg(F.array_join(F.sort_array(F.collect_set("case_id")), ",").alias("cases"))


@query("vs_misc", "SELECT count(*) AS chunks, count(case_id) AS with_case FROM documents")
def vs_misc(spark, d):
    return table(spark, d, "documents").agg(F.count(F.lit(1)).alias("chunks"), F.count("case_id").alias("with_case"))


@query("vl_map", "SELECT DISTINCT query_id, CASE WHEN verifier_passed IS NULL THEN 'NOT_RUN' WHEN NOT regexp_matches(coalesce(final_response, ''), '[\\[(]Document \\d+[\\])]') THEN 'SKIPPED' WHEN verifier_passed <> 0 THEN 'SUPPORTED' ELSE 'UNSUPPORTED' END AS verdict FROM queries")
def vl_map(spark, d):
    v = F.col("verifier_passed")
    out = F.when(v.isNull(), "NOT_RUN").when(F.size(vf.citations(F.coalesce("final_response", F.lit("")))) == 0, "SKIPPED").when(v != 0, "SUPPORTED").otherwise("UNSUPPORTED")
    return table(spark, d, "queries").select("query_id", out.alias("verdict")).distinct()


@query("vl_caveats", "SELECT DISTINCT query_id, 'Not supported: answer ' || query_id AS caveat FROM queries WHERE verifier_passed = 0")
def vl_caveats(spark, d):
    return table(spark, d, "queries").where("verifier_passed = 0").select("query_id", F.concat(F.lit("Not supported: answer "), F.col("query_id").cast("string")).alias("caveat")).distinct()


@query("vf_format", "SELECT doc_id, 'Document ' || doc_id || ' | ' || coalesce(case_id, 'no case') || ' | ' || coalesce(n_chars, 0) || ' characters' AS header FROM documents")
def vf_format(spark, d):
    return table(spark, d, "documents").select("doc_id", F.format_string("Document %d | %s | %d characters", "doc_id", F.coalesce("case_id", F.lit("no case")), F.coalesce("n_chars", F.lit(0))).alias("header"))


@query("lk_links", """SELECT DISTINCT edge_id, CASE WHEN confidence >= 0.9 THEN 'Linked: ' || mention.entity_id || ' and ' || candidate.entity_id ELSE 'Unconfirmed: ' || mention.entity_id || ' and ' || candidate.entity_id END AS link FROM pending_matches WHERE mention.entity_id IS NOT NULL AND candidate.entity_id IS NOT NULL AND confidence IS NOT NULL""")
def lk_links(spark, d):
    p = table(spark, d, "pending_matches").where("mention.entity_id is not null and candidate.entity_id is not null and confidence is not null")
    head = F.when(F.col("confidence") >= 0.9, "Linked: ").otherwise("Unconfirmed: ")
    return p.select("edge_id", F.concat(head, "mention.entity_id", F.lit(" and "), "candidate.entity_id").alias("link")).distinct()


@query("tl_tools", "SELECT DISTINCT session_id, CASE WHEN n = 0 THEN 'EMPTY' ELSE 'OK' END AS status FROM (SELECT s.session_id, count(q.query_id) AS n FROM (SELECT DISTINCT session_id FROM messages) s LEFT JOIN queries q USING (session_id) GROUP BY 1)")
def tl_tools(spark, d):
    q = table(spark, d, "queries").select("session_id").distinct().withColumn("hit", F.lit(1))
    return table(spark, d, "messages").select("session_id").distinct().join(q, "session_id", "left").select("session_id", F.when(F.col("hit").isNull(), "EMPTY").otherwise("OK").alias("status"))


@query("tl_text", "SELECT police_station, count(*) || ' events, ' || count(*) FILTER (conflicts_checked_at IS NOT NULL) || ' checked' AS sentence FROM cases GROUP BY 1")
def tl_text(spark, d):
    g = table(spark, d, "cases").groupBy("police_station").agg(F.count(F.lit(1)).alias("n"), F.count("conflicts_checked_at").alias("c"))
    return g.select("police_station", F.format_string("%d events, %d checked", "n", "c").alias("sentence"))


@query("st_table", "SELECT case_id, concat_ws('|', coalesce(s[1], ''), coalesce(s[2], ''), coalesce(s[3], '')) AS line FROM (SELECT case_id, string_split(location, ',') AS s FROM cases WHERE location IS NOT NULL)")
def st_table(spark, d):
    c = table(spark, d, "cases").where("location is not null")
    return c.select("case_id", F.array_join(misc.pad_row(F.split("location", ","), 3), "|").alias("line"))


@query("st_station", "SELECT case_id FROM cases WHERE coalesce(police_station = 'PS001', true)")
def st_station(spark, d):
    return table(spark, d, "cases").where(F.coalesce(F.col("police_station") == "PS001", F.lit(True))).select("case_id")


@query("lg_log", "SELECT session_id, count(DISTINCT message_id) AS rows_written FROM messages GROUP BY 1")
def lg_log(spark, d):
    """The trace of messages appended to a table and read back."""
    m = table(spark, d, "messages").select("session_id", "message_id").distinct()
    return Scratch(spark, "log").save(m, "trace").groupBy("session_id").agg(F.count(F.lit(1)).alias("rows_written"))


@query("mh_hist", "SELECT session_id, message_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, message_id DESC) AS n FROM (SELECT DISTINCT session_id, message_id, created_at FROM messages)) WHERE n <= 10")
def mh_hist(spark, d):
    m = table(spark, d, "messages").select("session_id", "message_id", "created_at").distinct()
    n = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("message_id")))
    return m.withColumn("n", n).where("n <= 10").select("session_id", "message_id")


@query("gx_bg", "SELECT case_id, incident_date IS NULL AS needs_check FROM cases WHERE conflicts_checked_at IS NULL")
def gx_bg(spark, d):
    return table(spark, d, "cases").where("conflicts_checked_at is null").select("case_id", F.col("incident_date").isNull().alias("needs_check"))


@query("cv_clear", "SELECT beat_code FROM entity_summaries WHERE beat_code IS NOT NULL EXCEPT SELECT beat_code FROM structured_fields")
def cv_clear(spark, d):
    return table(spark, d, "entity_summaries").where("beat_code is not null").select("beat_code").subtract(table(spark, d, "structured_fields").select("beat_code"))


@query("gt_fold", "SELECT DISTINCT candidate.entity_id AS entity_id FROM pending_matches WHERE confidence >= 0.9 AND mention.entity_id LIKE 'ORG-%' AND candidate.entity_id IS NOT NULL UNION SELECT mention.entity_id FROM pending_matches WHERE confidence >= 0.9 AND candidate.entity_id LIKE 'ORG-%' AND mention.entity_id IS NOT NULL")
def gt_fold(spark, d):
    p = table(spark, d, "pending_matches").where("confidence >= 0.9").select(F.col("mention.entity_id").alias("a"), F.col("candidate.entity_id").alias("b"))
    return p.where("a like 'ORG-%' and b is not null").select(F.col("b").alias("entity_id")).union(p.where("b like 'ORG-%' and a is not null").select("a")).distinct()


@query("sa_timeline", "SELECT d.case_id, m.normalized AS day, count(DISTINCT m.match_id) AS mentions FROM documents d JOIN field_matches m USING (doc_id) WHERE m.field_type = 'date' AND d.case_id IS NOT NULL AND m.normalized IS NOT NULL GROUP BY 1, 2")
def sa_timeline(spark, d):
    m = table(spark, d, "field_matches").where("field_type = 'date' and normalized is not null").select("doc_id", "match_id", F.col("normalized").alias("day"))
    docs = table(spark, d, "documents").where("case_id is not null").select("doc_id", "case_id")
    return docs.join(m, "doc_id").groupBy("case_id", "day").agg(F.countDistinct("match_id").alias("mentions"))


@query("sa_linkage", """SELECT DISTINCT least(a.case_id, b.case_id) AS a, greatest(a.case_id, b.case_id) AS b, a.complainant_cnic AS via FROM structured_fields a JOIN structured_fields b ON a.complainant_cnic = b.complainant_cnic AND a.case_id < b.case_id""")
def sa_linkage(spark, d):
    f = table(spark, d, "structured_fields").where("complainant_cnic is not null and case_id is not null").select("case_id", F.col("complainant_cnic").alias("via")).distinct()
    a, b = f.withColumnRenamed("case_id", "a"), f.withColumnRenamed("case_id", "b")
    return a.join(b, "via").where("a < b").select("a", "b", "via")

"""Queries over windows, time buckets, text and dates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from caselens.functions import text as tx
from caselens.operators import timeseries as ts
from caselens.operators import windows as win
from caselens.plans.registry import Registry
from caselens.session import spread
from caselens.tables import table

_R = Registry()
QUERIES, SQL, query = _R.QUERIES, _R.SQL, _R.query


@query("win_case_cap", """SELECT doc_id, case_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 5 ORDER BY n_chars DESC, doc_id LIMIT 15""")
def win_case_cap(spark, d):
    return win.case_cap(table(spark, d, "documents").select("doc_id", "case_id", "n_chars"), "case_id", "n_chars", "doc_id")


@query("win_latest_pos", "SELECT case_id, max_by(field_id, (recorded_at, field_id)) AS field_id FROM structured_fields WHERE case_id IS NOT NULL AND recorded_at IS NOT NULL GROUP BY 1")
def win_latest_pos(spark, d):
    f = table(spark, d, "structured_fields").where("case_id is not null and recorded_at is not null")
    return f.groupBy("case_id").agg(F.max_by("field_id", F.struct("recorded_at", "field_id")).alias("field_id"))


@query("win_current_io", "SELECT police_station, max_by(investigation_officer, (created_at, case_id)) AS officer FROM cases WHERE police_station IS NOT NULL AND investigation_officer IS NOT NULL AND created_at IS NOT NULL GROUP BY 1")
def win_current_io(spark, d):
    c = table(spark, d, "cases").where("police_station is not null and investigation_officer is not null and created_at is not null")
    return c.groupBy("police_station").agg(F.max_by("investigation_officer", F.struct("created_at", "case_id")).alias("officer"))


@query("win_supersede_chain", """SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, coalesce(lead(l_orderkey) OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber), -1) AS superseded_by FROM lineitem""")
def win_supersede_chain(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate")
    out = win.supersede_chain(rows, ["l_partkey", "l_suppkey"], [F.col("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")], "l_orderkey")
    return out.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", F.coalesce("superseded_by", F.lit(-1)).alias("superseded_by"))


@query("win_best_candidate", """SELECT mention, candidate, round(confidence, 6) AS confidence FROM (SELECT mention.entity_id AS mention, candidate.entity_id AS candidate, confidence,
 row_number() OVER (PARTITION BY mention.entity_id ORDER BY confidence DESC, candidate.entity_id) AS n FROM (SELECT DISTINCT mention, candidate, confidence FROM pending_matches WHERE mention.entity_id IS NOT NULL AND candidate.entity_id IS NOT NULL AND confidence IS NOT NULL)) WHERE n = 1""")
def win_best_candidate(spark, d):
    p = table(spark, d, "pending_matches").select(F.col("mention.entity_id").alias("mention"), F.col("candidate.entity_id").alias("candidate"), F.round("confidence", 6).alias("confidence"))
    return win.best_candidate(p.dropna().distinct(), "mention", "confidence", "candidate")


@query("win_adjacent", """SELECT doc_id, match_id, coalesce(lag(match_id) OVER (PARTITION BY doc_id ORDER BY start_pos, match_id), -1) AS previous FROM (SELECT DISTINCT doc_id, match_id, start_pos FROM field_matches)""")
def win_adjacent(spark, d):
    m = table(spark, d, "field_matches").select("doc_id", "match_id", "start_pos").distinct()
    return m.select("doc_id", "match_id", F.coalesce(F.lag("match_id").over(W.partitionBy("doc_id").orderBy("start_pos", "match_id")), F.lit(-1)).alias("previous"))


@query("win_budget", """WITH m AS (SELECT DISTINCT session_id, message_id, created_at, coalesce(content, '') AS content FROM messages),
 r AS (SELECT *, sum(length(content)) OVER (PARTITION BY session_id ORDER BY created_at DESC, message_id DESC ROWS UNBOUNDED PRECEDING) AS rest,
  row_number() OVER (PARTITION BY session_id ORDER BY created_at, message_id) - 1 AS k0, count(*) OVER (PARTITION BY session_id) AS n FROM m),
 c AS (SELECT *, min(CASE WHEN k0 % 2 = 0 AND (rest // 4 <= 200 OR n - k0 <= 2) THEN k0 END) OVER (PARTITION BY session_id) AS cut FROM r)
 SELECT session_id, message_id FROM c WHERE k0 >= coalesce(cut, 0)""")
def win_budget(spark, d):
    m = table(spark, d, "messages").select("session_id", "message_id", "created_at", F.coalesce("content", F.lit("")).alias("content")).distinct()
    return win.message_budget(m, "session_id", ["created_at", "message_id"], "content", budget=200).select("session_id", "message_id")


@query("win_char_budget", """WITH r AS (SELECT case_id, doc_id, text, 24000 - coalesce(sum(length(text)) OVER (PARTITION BY case_id ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM documents WHERE case_id IS NOT NULL AND text IS NOT NULL)
 SELECT case_id, doc_id, CAST(least(length(text), rest) AS BIGINT) AS kept FROM r WHERE rest > 0""")
def win_char_budget(spark, d):
    docs = table(spark, d, "documents").where("case_id is not null and text is not null").select("case_id", "doc_id", "text")
    return win.char_budget(docs, "case_id", "doc_id", "text").select("case_id", "doc_id", F.length("text").cast("long").alias("kept"))


@query("win_turn_prefix")
def win_turn_prefix(spark, d):
    m = table(spark, d, "messages").select("session_id", "message_id", "created_at", "role", "content").distinct()
    return win.echoes(m, "session_id", ["created_at", "message_id"], "role", "content").select("session_id", "message_id")


@query("win_rank_log", "SELECT case_id, doc_id, row_number() OVER (PARTITION BY case_id ORDER BY n_chars DESC, doc_id) AS rank_position FROM documents WHERE case_id IS NOT NULL")
def win_rank_log(spark, d):
    return table(spark, d, "documents").where("case_id is not null").select("case_id", "doc_id", F.row_number().over(W.partitionBy("case_id").orderBy(F.desc("n_chars"), "doc_id")).alias("rank_position"))


@query("sort_queue", "SELECT DISTINCT edge_id, confidence FROM (SELECT DISTINCT edge_id, round(confidence, 6) AS confidence, as_of FROM pending_matches ORDER BY as_of IS NULL, confidence DESC, as_of DESC, edge_id LIMIT 100)")
def sort_queue(spark, d):
    p = table(spark, d, "pending_matches").select("edge_id", F.round("confidence", 6).alias("confidence"), "as_of").distinct()
    return p.orderBy(F.col("as_of").isNull(), F.desc_nulls_last("confidence"), F.desc_nulls_last("as_of"), "edge_id").limit(100).select("edge_id", "confidence")


@query("sort_timeline", """SELECT match_id, row_number() OVER (PARTITION BY doc_id ORDER BY try_cast(normalized AS TIMESTAMP) IS NULL, try_cast(normalized AS TIMESTAMP), coalesce(normalized, ''), match_id) AS n
 FROM (SELECT DISTINCT doc_id, match_id, normalized FROM field_matches WHERE field_type = 'date' AND regexp_full_match(coalesce(normalized, ''), '([0-9]{4}-[0-9]{2}-[0-9]{2})?'))""")
def sort_timeline(spark, d):
    m = table(spark, d, "field_matches").where("field_type = 'date'").select("doc_id", "match_id", "normalized").distinct().where(F.coalesce("normalized", F.lit("")).rlike(r"^(\d{4}-\d{2}-\d{2})?$"))
    return m.select("match_id", F.row_number().over(W.partitionBy("doc_id").orderBy(*win.timeline_order(F.col("normalized")), "match_id")).alias("n"))


@query("set_union_dedup", "SELECT doc_id, min(list) AS list FROM (SELECT doc_id, 1 AS list FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 2 FROM documents WHERE doc_type = 'FIR') GROUP BY 1")
def set_union_dedup(spark, d):
    docs = table(spark, d, "documents")
    both = docs.where("lang = 'en'").select("doc_id", F.lit(1).alias("list")).unionByName(docs.where("doc_type = 'FIR'").select("doc_id", F.lit(2).alias("list")))
    return win.union_first(both, "doc_id", "list")


_SPINE = "SELECT strftime(unnest(generate_series(date_trunc('day', max({t})) - INTERVAL 7 DAY, date_trunc('day', max({t})), INTERVAL 1 DAY)), '%Y-%m-%d') AS bucket FROM {s}"


@query("ts_usage", f"""WITH s AS ({_SPINE.format(t='ts', s='events')}), p AS (SELECT strftime(ts, '%Y-%m-%d') AS bucket, count(*) AS total, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1)
 SELECT bucket, coalesce(total, 0) AS total, coalesce(click, 0) AS click, coalesce(view, 0) AS view FROM s LEFT JOIN p USING (bucket)""")
def ts_usage(spark, d):
    return ts.usage(table(spark, d, "events"), "ts", "event_type", ["CLICK", "VIEW"])


@query("ts_latency", f"""WITH s AS ({_SPINE.format(t='created_at', s='queries')}), p AS (SELECT strftime(created_at, '%Y-%m-%d') AS bucket, count(*) AS count, CAST(trunc(avg(total_duration_ms)) AS BIGINT) AS avg,
 list_sort(list(total_duration_ms))[greatest(1, least(count(*), CAST(round_even(0.95 * count(*), 0) AS BIGINT)))] AS p95 FROM queries WHERE total_duration_ms > 0 GROUP BY 1)
 SELECT bucket, coalesce(count, 0) AS count, coalesce(avg, 0) AS avg, coalesce(p95, 0) AS p95 FROM s LEFT JOIN p USING (bucket)""")
def ts_latency(spark, d):
    return ts.latency(table(spark, d, "queries"), "created_at", "total_duration_ms")


@query("ts_errors", f"""WITH s AS ({_SPINE.format(t='ts', s='events')}), p AS (SELECT strftime(ts, '%Y-%m-%d') AS bucket, count(*) AS total, count(*) FILTER (value < 5) AS warning, count(*) FILTER (value BETWEEN 5 AND 50) AS error, count(*) FILTER (value > 50) AS critical FROM events WHERE event_type = 'error' GROUP BY 1)
 SELECT bucket, coalesce(total, 0) AS total, coalesce(warning, 0) AS warning, coalesce(error, 0) AS error, coalesce(critical, 0) AS critical FROM s LEFT JOIN p USING (bucket)""")
def ts_errors(spark, d):
    e = table(spark, d, "events")
    sev = F.when(F.col("value") < 5, "warning").when(F.col("value") > 50, "critical")
    return ts.errors(e.where("event_type = 'error'"), "ts", sev, period=e)


@query("ts_bucket", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:00') AS bucket, count(*) AS n FROM events GROUP BY 1")
def ts_bucket(spark, d):
    return table(spark, d, "events").groupBy(ts.bucket(F.col("ts").cast("timestamp"), "hour").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("ts_since", "SELECT count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 3 DAY")
def ts_since(spark, d):
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    last = e.agg((F.max("ts") - F.expr("interval 3 days")).alias("c"))
    return e.crossJoin(F.broadcast(last)).where("ts >= c").agg(F.count(F.lit(1)).alias("n"))  # one row


@query("ts_drift", """WITH c AS (SELECT entity_type, count(*) AS cur FROM entity_summaries GROUP BY 1), p AS (SELECT entity_type, count(*) AS old FROM entity_summaries WHERE first_seen_at < TIMESTAMP '2025-12-01' GROUP BY 1)
 SELECT entity_type, round(abs(coalesce(cur, 0) - coalesce(old, 0)) / greatest(coalesce(old, 0), 1), 6) AS drift, old IS NULL OR abs(coalesce(cur, 0) - coalesce(old, 0)) / greatest(coalesce(old, 0), 1) >= 0.1 AS stale FROM c FULL JOIN p USING (entity_type)""")
def ts_drift(spark, d):
    e = table(spark, d, "entity_summaries")
    per = lambda x: x.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))
    return ts.drift(per(e), per(e.where("first_seen_at < timestamp_ntz'2025-12-01'")), "entity_type", "n")


@query("ts_validity", "SELECT case_id, CASE WHEN incident_date > DATE '2025-06-01' THEN 'not_yet' WHEN incident_date + 90 < DATE '2025-06-01' THEN 'expired' ELSE 'valid' END AS state FROM cases")
def ts_validity(spark, d):
    c = F.col("incident_date")
    return table(spark, d, "cases").select("case_id", ts.validity(F.lit("2025-06-01").cast("date"), c, F.date_add(c, 90)).alias("state"))


@query("ts_stale_candidate", "SELECT DISTINCT edge_id FROM pending_matches WHERE as_of IS NOT NULL AND (SELECT max(loaded_at) FROM pending_matches) - as_of > INTERVAL 14 DAY AND confidence < 0.55")
def ts_stale_candidate(spark, d):
    p = table(spark, d, "pending_matches").select("edge_id", "as_of", "confidence", "loaded_at")
    now = p.agg((F.max("loaded_at") - F.expr("interval 14 days")).alias("c"))
    return p.crossJoin(F.broadcast(now)).where("as_of < c and confidence < 0.55").select("edge_id").distinct()  # one row


@query("txt_ws", "SELECT doc_id, md5(regexp_replace(text, '[ \\t]{3,}', ' ', 'g')) AS h FROM documents WHERE text IS NOT NULL")
def txt_ws(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(tx.squeeze(F.col("text"))).alias("h"))


@query("txt_norm")
def txt_norm(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.normalize(F.col("text"))).alias("h"))


@query("txt_tokens", """SELECT query_id, CAST(sum(len(w) + CASE WHEN regexp_matches(w, '[-/_.]') THEN len(regexp_replace(w, '[-/_.]', '', 'g')) ELSE 0 END) AS BIGINT) AS chars FROM
 (SELECT query_id, unnest(regexp_extract_all(lower(user_message), '[\\pL\\pN]+([-/_.][\\pL\\pN]+)*')) AS w FROM (SELECT DISTINCT query_id, user_message FROM queries)) GROUP BY 1""")
def txt_tokens(spark, d):
    q = table(spark, d, "queries").select("query_id", "user_message").distinct()
    return q.select("query_id", F.explode(tx.tokens(F.col("user_message"))).alias("w")).groupBy("query_id").agg(F.sum(F.length("w")).alias("chars"))


@query("txt_sentences")
def txt_sentences(spark, d):
    return spread(table(spark, d, "documents")).select("doc_id", F.coalesce(F.size(tx.sentences("text")), F.lit(0)).alias("n"))


@query("txt_chunk")
def txt_chunk(spark, d):
    c = spread(table(spark, d, "documents")).select("doc_id", F.posexplode(tx.chunks("text")).alias("i", "chunk"))
    return c.select(F.concat(F.col("doc_id").cast("string"), F.lit("_c"), F.col("i").cast("string")).alias("chunk_id"), "doc_id", F.col("i").alias("chunk_index"), F.length("chunk").alias("n"))


@query("txt_docid", """SELECT doc_id, regexp_replace(source, '[^A-Za-z0-9_.-]', '_', 'g') || '_' || substr(md5(concat_ws('::', source, coalesce(case_id, 'global'), '0', substr(text, 1, 200))), 1, 8) AS id FROM documents WHERE source IS NOT NULL AND text IS NOT NULL""")
def txt_docid(spark, d):
    docs = table(spark, d, "documents").where("source is not null and text is not null")
    return docs.select("doc_id", tx.doc_id(F.col("source"), F.coalesce("case_id", F.lit("global")), F.lit("0"), F.col("text")).alias("id"))


@query("txt_roman")
def txt_roman(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.is_roman_urdu(F.col("text")).alias("roman"))


@query("txt_script", "SELECT query_id, CASE WHEN regexp_matches(user_message, '[\\x{0600}-\\x{06FF}]') THEN 'urdu' ELSE 'latin' END AS script FROM (SELECT DISTINCT query_id, user_message FROM queries)")
def txt_script(spark, d):
    return table(spark, d, "queries").select("query_id", "user_message").distinct().select("query_id", tx.script(F.col("user_message")).alias("script"))


@query("txt_excerpt", "SELECT query_id, CASE WHEN length(f) <= 60 THEN f ELSE rtrim(substr(f, 1, 59)) || '…' END AS excerpt FROM (SELECT DISTINCT query_id, final_response AS f FROM queries WHERE final_response IS NOT NULL)")
def txt_excerpt(spark, d):
    return table(spark, d, "queries").select("query_id", "final_response").distinct().where("final_response is not null").select("query_id", tx.excerpt(F.col("final_response"), 60).alias("excerpt"))


@query("txt_namelist", "SELECT case_id, len(list_filter(list_transform(string_split_regex(location, '[,،]'), lambda x: trim(x)), lambda x: x <> '')) AS n FROM cases WHERE location IS NOT NULL")
def txt_namelist(spark, d):
    return table(spark, d, "cases").where("location is not null").select("case_id", F.size(tx.name_list(F.col("location"))).alias("n"))


@query("txt_history", """SELECT session_id, string_agg(upper(role[1:1]) || role[2:] || ': ' || coalesce(content, ''), chr(10) ORDER BY created_at, message_id) AS history
 FROM (SELECT DISTINCT session_id, message_id, created_at, role, content FROM messages WHERE role IN ('user', 'assistant')) GROUP BY 1""")
def txt_history(spark, d):
    m = table(spark, d, "messages").where("role in ('user', 'assistant')").select("session_id", "message_id", "created_at", "role", "content").distinct()
    line = F.concat(F.initcap("role"), F.lit(": "), F.coalesce("content", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("created_at", "message_id", line.alias("line"))))
    return m.groupBy("session_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("history"))


@query("txt_denial")
def txt_denial(spark, d):
    return table(spark, d, "queries").select("query_id", tx.denies(F.col("final_response")).alias("denies")).distinct()


@query("dt_valid_iso", "SELECT match_id, TRY_CAST(normalized AS DATE) AS day FROM (SELECT DISTINCT match_id, normalized FROM field_matches WHERE field_type = 'date' AND regexp_full_match(normalized, '[0-9]{4}-[0-9]{2}-[0-9]{2}'))")
def dt_valid_iso(spark, d):
    m = table(spark, d, "field_matches").where(r"field_type = 'date' and normalized rlike '^[0-9]{4}-[0-9]{2}-[0-9]{2}$'")
    return m.select("match_id", F.try_to_date("normalized").alias("day")).distinct()


@query("m_year_boost", "SELECT match_id, round(greatest(0, (coalesce(TRY_CAST(regexp_extract(normalized, '\\b(20[0-9][0-9])\\b', 1) AS INT), 2020) - 2020) * 0.0005), 6) AS boost FROM (SELECT DISTINCT match_id, normalized FROM field_matches WHERE normalized IS NOT NULL)")
def m_year_boost(spark, d):
    return table(spark, d, "field_matches").select("match_id", "normalized").distinct().where("normalized is not null").select("match_id", F.round(tx.year_boost(F.col("normalized")), 6).alias("boost"))


@query("m_cosine", """SELECT a.vec_id, round(greatest(0, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 5) AS s FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b""")
def m_cosine(spark, d):
    e = table(spark, d, "embeddings")
    one = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(one)).select("vec_id", F.round(tx.cosine(F.col("embedding"), F.col("q")), 5).alias("s"))  # one query vector


@query("m_er_score", "SELECT DISTINCT edge_id, round(least(0.7 * confidence + 0.15 * CAST(contains(basis, 'shared_case') AS INT) + 0.15 * CAST(contains(basis, 'structured') AS INT), 0.85), 6) AS score FROM pending_matches WHERE confidence IS NOT NULL AND basis IS NOT NULL")
def m_er_score(spark, d):
    p = table(spark, d, "pending_matches").where("confidence is not null and basis is not null")
    s = F.least(0.7 * F.col("confidence") + 0.15 * F.col("basis").contains("shared_case").cast("int") + 0.15 * F.col("basis").contains("structured").cast("int"), F.lit(0.85))
    return p.select("edge_id", F.round(s, 6).alias("score")).distinct()


@query("m_compound", "SELECT candidate.entity_id AS entity_id, round(least(1, product(confidence)), 6) AS p FROM pending_matches WHERE confidence IS NOT NULL AND candidate.entity_id IS NOT NULL GROUP BY 1")
def m_compound(spark, d):
    p = table(spark, d, "pending_matches").where("confidence is not null and candidate.entity_id is not null")
    g = p.groupBy(F.col("candidate.entity_id").alias("entity_id")).agg(F.product("confidence").alias("p"))
    return g.select("entity_id", F.round(F.least(F.lit(1.0), "p"), 6).alias("p"))


@query("js_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def js_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("ar_first_nonnull", "SELECT field_id, coalesce(complainant_name, witness_name) AS name FROM (SELECT DISTINCT field_id, complainant_name, witness_name FROM structured_fields)")
def ar_first_nonnull(spark, d):
    return table(spark, d, "structured_fields").select("field_id", F.coalesce("complainant_name", "witness_name").alias("name")).distinct()

"""Queries over resolution, the graph, projections and verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselens.functions import extract as ex
from caselens.operators import aggregates as agg
from caselens.operators import graph as gr
from caselens.operators import projection as pj
from caselens.operators import resolution as er
from caselens.operators import verification as vf
from caselens.plans.registry import Registry
from caselens.tables import table

_R = Registry()
QUERIES, SQL, query = _R.QUERIES, _R.SQL, _R.query


def _pending(spark, d):
    return table(spark, d, "pending_matches").select("edge_id", "tier", "confidence", "basis", "as_of", F.col("mention.entity_id").alias("a"), F.col("candidate.entity_id").alias("b"), "loaded_at")


@query("er_exact", """SELECT DISTINCT f.field_id AS mention_id, e.entity_id FROM structured_fields f JOIN entity_summaries e ON e.cnic = f.complainant_cnic WHERE f.complainant_cnic <> '' AND e.entity_type = 'Person'""")
def er_exact(spark, d):
    m = table(spark, d, "structured_fields").select(F.col("field_id").alias("mention_id"), F.lit("Person").alias("entity_type"), F.col("complainant_cnic").alias("cnic"))
    return er.exact_matches(m, table(spark, d, "entity_summaries"), "entity_type", "cnic").select("mention_id", "entity_id").distinct()


def _people(spark, d):
    m = table(spark, d, "structured_fields").select(F.col("field_id").alias("mention_id"), F.col("complainant_name").alias("name"), F.col("complainant_cnic").alias("cnic")).distinct()
    e = table(spark, d, "entity_summaries").where("entity_type = 'Person'").select("entity_id", F.col("canonical_name").alias("name"), "cnic").distinct()
    return m.withColumn("mention_id", F.col("mention_id").cast("string")), e


@query("er_candidates")
def er_candidates(spark, d):
    return er.candidates(*_people(spark, d), None, "name", "cnic").select(F.col("m_id").alias("mention_id"), F.col("e_id").alias("entity_id"), F.round("similarity", 6).alias("similarity"))


@query("er_tier", """SELECT edge_id, CASE WHEN confidence >= 0.9 THEN 'flagged_unverified' WHEN confidence >= 0.75 AND contains(coalesce(basis, ''), 'shared_case') THEN 'flagged_unverified'
 WHEN confidence >= 0.55 THEN 'llm_adjudicated' WHEN confidence >= 0.4 THEN 'human_review' ELSE 'new' END AS t FROM (SELECT DISTINCT edge_id, confidence, basis FROM pending_matches)""")
def er_tier(spark, d):
    p = table(spark, d, "pending_matches").select("edge_id", "confidence", "basis").distinct()
    case = F.coalesce("basis", F.lit("")).contains("shared_case")
    return p.select("edge_id", er.tier(F.col("confidence"), F.lit(False), case).alias("t"))


@query("er_gate")
def er_gate(spark, d):
    m, e = _people(spark, d)
    # whether a best candidate is corroborated shows among the pairs of 0.9 and more; of a weaker one only that it is there counts
    best = er.candidates(m, e, None, "name", "cnic", 0.9).groupBy("m_id").agg(F.max_by("e_id", F.struct("similarity", "e_id")).alias("e_id"), F.max("similarity").alias("s"))
    best = er.with_candidate(m, e, "name", "cnic").join(best, "m_id", "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    return er.gate(best, F.col("s") >= 0.9).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("rq_rescore", """WITH p AS (SELECT DISTINCT edge_id, confidence, basis, as_of FROM pending_matches WHERE confidence IS NOT NULL), r AS (SELECT *, contains(coalesce(basis, ''), 'shared_case') AS re FROM p)
 SELECT edge_id, round(CASE WHEN re THEN least(confidence + 0.1, 0.95) ELSE confidence END, 6) AS priority, NOT re AND coalesce((SELECT max(as_of) FROM pending_matches) - as_of > INTERVAL 14 DAY, false) AS stale FROM r""")
def rq_rescore(spark, d):
    p = _pending(spark, d).select("edge_id", "confidence", "basis", "as_of").where("confidence is not null").distinct()
    now = table(spark, d, "pending_matches").agg(F.max("as_of").alias("now"))
    out = er.rescore(p.crossJoin(F.broadcast(now)), F.coalesce("basis", F.lit("")).contains("shared_case"), now=F.col("now"))  # one row
    return out.select("edge_id", "priority", "stale")


@query("rq_group", """WITH RECURSIVE p AS (SELECT DISTINCT edge_id, mention.entity_id AS a, candidate.entity_id AS b FROM pending_matches),
 l AS (SELECT edge_id AS e, min(edge_id) OVER (PARTITION BY a) AS f FROM p WHERE a IS NOT NULL UNION SELECT edge_id, min(edge_id) OVER (PARTITION BY b) FROM p WHERE b IS NOT NULL),
 w AS (SELECT e AS x, f AS y FROM l UNION SELECT f, e FROM l), r(id, lab) AS (SELECT DISTINCT x, x FROM w UNION SELECT w.y, r.lab FROM r JOIN w ON w.x = r.id WHERE r.lab < w.y)
 SELECT id AS edge_id, 'GROUP-SAME_AS-' || min(lab) AS group_id FROM r GROUP BY id""")
def rq_group(spark, d):
    return er.review_groups(_pending(spark, d).select("edge_id", "a", "b").distinct(), "edge_id", "a", "b")


@query("rq_decide", """WITH p AS (SELECT DISTINCT edge_id FROM pending_matches), dd AS (SELECT edge_id, edge_id + 1000000 AS new_edge_id FROM p WHERE edge_id % 7 = 0 UNION ALL SELECT edge_id, edge_id + 2000000 FROM p WHERE edge_id % 14 = 0)
 SELECT edge_id, new_edge_id, CASE WHEN row_number() OVER (PARTITION BY edge_id ORDER BY new_edge_id) = 1 THEN 'applied' ELSE 'already_decided' END AS status FROM dd""")
def rq_decide(spark, d):
    p = _pending(spark, d).select("edge_id").distinct()
    one = p.where("edge_id % 7 = 0").select("edge_id", (F.col("edge_id") + 1_000_000).alias("new_edge_id"), F.lit("confirmed").alias("verdict"))
    two = p.where("edge_id % 14 = 0").select("edge_id", (F.col("edge_id") + 2_000_000).alias("new_edge_id"), F.lit("rejected").alias("verdict"))
    return er.decide(p.withColumn("superseded_by", F.lit(None).cast("bigint")), one.unionByName(two)).select("edge_id", "new_edge_id", "status")


@query("rq_case", "SELECT DISTINCT edge_id FROM pending_matches WHERE source_doc_id IN (SELECT doc_id FROM documents WHERE case_id = 'CASE-00000000')")
def rq_case(spark, d):
    docs = table(spark, d, "documents").where("case_id = 'CASE-00000000'").select(F.col("doc_id").alias("source_doc_id"))
    return table(spark, d, "pending_matches").join(docs, "source_doc_id", "left_semi").select("edge_id").distinct()


@query("gc_canon", """WITH RECURSIVE e AS (SELECT DISTINCT mention.entity_id AS a, candidate.entity_id AS b FROM pending_matches WHERE confidence >= 0.9 AND mention.entity_id IS NOT NULL AND candidate.entity_id IS NOT NULL),
 w AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(id, lab) AS (SELECT DISTINCT a, a FROM w UNION SELECT w.b, r.lab FROM r JOIN w ON w.a = r.id WHERE r.lab < w.b) SELECT id, min(lab) AS canonical FROM r GROUP BY id""")
def gc_canon(spark, d):
    return gr.canonical(_pending(spark, d).where("confidence >= 0.9 and a is not null and b is not null").select("a", "b"))


@query("gc_louvain")
def gc_louvain(spark, d):
    p = _pending(spark, d).where("a is not null and b is not null")
    return gr.communities(agg.edge_weights(p, p.select("a", "b", F.lit(0).alias("n")).limit(0)))


@query("gc_casemeta", "SELECT case_id, crime_category, police_station FROM cases WHERE case_id IN (SELECT DISTINCT case_id FROM documents WHERE lang = 'ur')")
def gc_casemeta(spark, d):
    want = table(spark, d, "documents").where("lang = 'ur'").select("case_id")
    return table(spark, d, "cases").join(want, "case_id", "left_semi").select("case_id", "crime_category", "police_station")


@query("gv_current", "SELECT edge_id FROM (SELECT DISTINCT edge_id FROM pending_matches) p WHERE edge_id + 1 NOT IN (SELECT edge_id FROM pending_matches) OR edge_id % 3 <> 0")
def gv_current(spark, d):
    return gr.current(_versions(spark, d)).select("edge_id")


def _versions(spark, d):
    """Edges in which every third is superseded by the next id where that exists."""
    p = _pending(spark, d).select("edge_id").distinct()
    nxt = p.select((F.col("edge_id") - 1).alias("edge_id"), F.col("edge_id").alias("superseded_by")).where("edge_id % 3 = 0")
    return p.join(nxt, "edge_id", "left")


@query("gv_history", """WITH p AS (SELECT DISTINCT edge_id FROM pending_matches), v AS (SELECT p.edge_id, n.edge_id AS nxt FROM p LEFT JOIN p n ON n.edge_id = p.edge_id + 1 AND p.edge_id % 3 = 0)
 SELECT edge_id, coalesce(nxt, edge_id) AS newest, CASE WHEN nxt IS NULL THEN 1 ELSE 2 END AS versions FROM v""")
def gv_history(spark, d):
    return gr.history(_versions(spark, d))


@query("gv_edge")
def gv_edge(spark, d):
    p = _pending(spark, d)
    nodes = table(spark, d, "entity_summaries").select(F.col("entity_id").alias("node"))
    new = p.select((F.col("edge_id") + 10_000_000).alias("edge_id"), F.col("a").alias("src"), F.col("b").alias("dst"), F.when(F.col("edge_id") % 5 == 0, F.col("edge_id")).alias("supersedes")).distinct()
    old = p.select("edge_id", F.lit(None).cast("bigint").alias("superseded_by"), (F.col("edge_id") % 10 == 0).alias("locked")).distinct()
    return gr.append_edges(old, new, nodes).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


_TRAV = """WITH RECURSIVE e AS (SELECT mention.entity_id AS a, candidate.entity_id AS b, max(coalesce(confidence, 1)) AS c FROM pending_matches WHERE mention.entity_id <> candidate.entity_id GROUP BY 1, 2),
 w0 AS (SELECT a, b, c FROM e UNION ALL SELECT b, a, c FROM e), w AS (SELECT a, b, max(c) AS c FROM w0 GROUP BY 1, 2), s0 AS (SELECT DISTINCT mention.entity_id AS node FROM pending_matches WHERE source_doc_id = 1),
 h1 AS (SELECT w.b AS node, max(w.c) AS c FROM s0 JOIN w ON w.a = s0.node WHERE w.b NOT IN (SELECT node FROM s0 WHERE node IS NOT NULL) GROUP BY 1),
 h2 AS (SELECT w.b AS node, max(h1.c * w.c) AS c FROM h1 JOIN w ON w.a = h1.node WHERE w.b NOT IN (SELECT node FROM s0 WHERE node IS NOT NULL) AND w.b NOT IN (SELECT node FROM h1) GROUP BY 1)
 SELECT node, 0 AS hop, 1.0::DOUBLE AS confidence FROM s0 WHERE node IS NOT NULL UNION ALL SELECT node, 1, round(c, 6) FROM h1 UNION ALL SELECT node, 2, round(c, 6) FROM h2"""


@query("gt_traverse", _TRAV)
def gt_traverse(spark, d):
    p = table(spark, d, "pending_matches")
    seeds = p.where("source_doc_id = 1").select(F.col("mention.entity_id").alias("node")).where("node is not null")
    edges = _pending(spark, d).select("a", "b", F.lit("associated").alias("kind"), "confidence")
    return gr.traverse(seeds, edges, 2)


@query("gt_unconfirmed", """SELECT DISTINCT least(mention.entity_id, candidate.entity_id) AS a, greatest(mention.entity_id, candidate.entity_id) AS b FROM pending_matches
 WHERE mention.entity_id <> candidate.entity_id AND (mention.entity_id LIKE 'ORG-%' OR candidate.entity_id LIKE 'ORG-%')""")
def gt_unconfirmed(spark, d):
    orgs = table(spark, d, "pending_matches").select(F.explode(F.array("mention.entity_id", "candidate.entity_id")).alias("node")).where("node like 'ORG-%'")
    return gr.unconfirmed(_pending(spark, d), orgs)


@query("gt_juris", "SELECT DISTINCT d.doc_id FROM documents d JOIN stations s USING (station_code) WHERE s.district = 'Meranpur'")
def gt_juris(spark, d):
    s = table(spark, d, "stations").where("district = 'Meranpur'").select("station_code")
    return table(spark, d, "documents").join(s, "station_code", "left_semi").select("doc_id")


@query("gt_display", "SELECT DISTINCT entity_id, coalesce(nullif(canonical_name, ''), nullif(plate, ''), entity_id) AS display FROM entity_summaries")
def gt_display(spark, d):
    e = table(spark, d, "entity_summaries")
    return e.select("entity_id", gr.display(F.col("canonical_name"), F.col("plate"), F.col("entity_id")).alias("display")).distinct()


@query("gx_conflict_dates", """WITH i AS (SELECT case_id, doc_kind AS incident, CAST(recorded_at AS DATE) AS day FROM structured_fields WHERE case_id IS NOT NULL AND doc_kind IS NOT NULL)
 SELECT case_id, incident, string_agg(DISTINCT CAST(day AS VARCHAR), ',' ORDER BY CAST(day AS VARCHAR)) AS dates FROM i WHERE case_id IN (SELECT case_id FROM i GROUP BY 1 HAVING count(*) >= 2) GROUP BY 1, 2 HAVING count(DISTINCT day) > 1""")
def gx_conflict_dates(spark, d):
    i = table(spark, d, "structured_fields").select("case_id", "doc_kind", F.to_date("recorded_at").cast("string").alias("day"))
    out = gr.date_conflicts(i, "case_id", "doc_kind", "day")
    return out.select("case_id", "incident", F.array_join("dates", ",").alias("dates"))


@query("gx_timeline", """SELECT case_id, CASE WHEN incident_date > CAST(created_at AS DATE) THEN 'CONFLICT' WHEN conflicts_checked_at IS NOT NULL THEN 'NONE' ELSE 'UNKNOWN' END AS state FROM cases""")
def gx_timeline(spark, d):
    bad = F.coalesce(F.col("incident_date") > F.to_date("created_at"), F.lit(False))
    return table(spark, d, "cases").select("case_id", gr.conflict_state(bad, F.col("conflicts_checked_at")).alias("state"))


def _reports(spark, d):
    """Reports with their people, nested as a feed would give them."""
    f = table(spark, d, "structured_fields").where("case_id is not null")
    people = f.select("case_id", F.explode(F.array(*[F.struct(F.col(f"{w}_name").alias("name"), F.lit(w).alias("role"), F.col(f"{w}_cnic").alias("cnic"), F.col(f"{w}_address").alias("address")) for w in ("complainant", "witness")])).alias("p"))
    # a case of any size comes in parts of at most some hundred people
    people = people.where("p.name is not null").groupBy("case_id", F.pmod(F.xxhash64("p.name"), F.lit(64)).alias("part")).agg(F.collect_set("p").alias("people"))
    c = table(spark, d, "cases").join(table(spark, d, "stations").select(F.col("station_code").alias("police_station"), "district"), "police_station", "left")
    c = c.select("case_id", F.col("police_station").alias("station"), "district", F.col("investigation_officer").alias("officer"), "incident_date")
    return c.join(people, "case_id", "left")


@query("gp_fir", """WITH c AS (SELECT case_id, police_station AS station, district, investigation_officer AS officer, incident_date FROM cases LEFT JOIN stations ON station_code = police_station),
 p AS (SELECT case_id, complainant_name AS name, 'complainant' AS role, complainant_cnic AS cnic, complainant_address AS address FROM structured_fields UNION SELECT case_id, witness_name, 'witness', witness_cnic, witness_address FROM structured_fields),
 q AS (SELECT p.*, coalesce('PERSON-' || nullif(regexp_replace(cnic, '[^0-9]', '', 'g'), ''), 'PERSON-' || sha256(concat_ws('|', case_id, name))) AS person FROM p SEMI JOIN c USING (case_id) WHERE name IS NOT NULL),
 e AS (SELECT 'INCIDENT-FIR-' || case_id AS src, 'BELONGS_TO_CASE' AS label, 'CASE:' || case_id AS dst, NULL AS role FROM c UNION SELECT 'CASE:' || case_id, 'FILED_AT', 'STATION:' || station, NULL FROM c WHERE station IS NOT NULL
 UNION SELECT 'STATION:' || station, 'PART_OF', 'DISTRICT:' || district, NULL FROM c WHERE district IS NOT NULL UNION SELECT 'CASE:' || case_id, 'ASSIGNED_TO', 'OFFICER:' || officer, NULL FROM c WHERE officer IS NOT NULL
 UNION SELECT 'INCIDENT-FIR-' || case_id, 'OCCURRED_ON', 'DATE:' || incident_date, NULL FROM c WHERE incident_date IS NOT NULL UNION SELECT person, 'BELONGS_TO_CASE', 'CASE:' || case_id, role FROM q UNION SELECT person, 'INVOLVED_IN', 'INCIDENT-FIR-' || case_id, role FROM q
 UNION SELECT person, 'RESIDES_AT', 'ADDRESS:' || lower(trim(address)), NULL FROM q WHERE address IS NOT NULL)
 SELECT label, count(*) AS n, count(role) AS with_role FROM e GROUP BY 1""")
def gp_fir(spark, d):
    return pj.project_reports(_reports(spark, d)).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count("role").alias("with_role"))


@query("gp_malkhana")
def gp_malkhana(spark, d):
    m = table(spark, d, "field_matches").select("match_id", F.col("raw_text").alias("t")).distinct()
    return m.select("match_id", pj.recovered_item(F.col("t"), ex.plates(F.col("t")), ex.phones(F.col("t")))["label"].alias("label"))


@query("gp_cross", "SELECT DISTINCT f.field_id AS src, e.entity_id AS dst FROM structured_fields f JOIN entity_summaries e ON e.cnic = f.witness_cnic WHERE f.witness_cnic IS NOT NULL")
def gp_cross(spark, d):
    r = table(spark, d, "structured_fields").select(F.col("field_id").alias("record"), F.col("witness_cnic").alias("cnic"))
    return pj.cross_silo(r, table(spark, d, "entity_summaries").select(F.col("entity_id").alias("person"), "cnic"), "cnic", "forms").select("src", "dst")


@query("gp_purge", "SELECT doc_id, source FROM documents WHERE coalesce(NOT starts_with(source, 'f'), true)")
def gp_purge(spark, d):
    return pj.purge(table(spark, d, "documents").select("doc_id", "source"), "f")


@query("gp_backfill", "SELECT source_chunk_id, count(DISTINCT mention.entity_id) AS people FROM pending_matches WHERE source_chunk_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT mention.entity_id) >= 2")
def gp_backfill(spark, d):
    p = table(spark, d, "pending_matches").where("source_chunk_id is not null")
    return p.groupBy("source_chunk_id").agg(F.countDistinct("mention.entity_id").alias("people")).where("people >= 2")


def _answers(spark, d):
    return table(spark, d, "queries").select("query_id", F.col("final_response").alias("a")).distinct()


@query("vf_citation_range", """SELECT query_id, list_sort(list(DISTINCT n)) AS bad FROM (SELECT query_id, CAST(unnest(regexp_extract_all(final_response, '[\\[(]Document (\\d+)[\\])]', 1)) AS INT) AS n FROM queries) WHERE n > 6 GROUP BY 1""")
def vf_citation_range(spark, d):
    return _answers(spark, d).select("query_id", vf.invalid_citations(F.col("a"), F.lit(6)).alias("bad")).where(F.size("bad") > 0)


@query("vf_refusal")
def vf_refusal(spark, d):
    return _answers(spark, d).where(vf.refuses(F.col("a"))).select("query_id")


@query("vf_nocite", """SELECT DISTINCT query_id FROM queries WHERE final_response IS NOT NULL AND NOT regexp_matches(final_response, '[\\[(]Document (\\d+)[\\])]')
 AND (length(final_response) >= 150 OR len(regexp_extract_all(final_response, '(?m)^\\s*(?:[-*•]|\\d+\\.)\\s')) >= 2)""")
def vf_nocite(spark, d):
    return _answers(spark, d).where(vf.uncited(F.col("a"))).select("query_id")


_VF = r"""WITH q AS (SELECT DISTINCT query_id, final_response AS a FROM queries WHERE query_id IS NOT NULL AND final_response IS NOT NULL),
 s AS (SELECT query_id, n, c FROM (SELECT query_id, unnest(l) AS c, generate_subscripts(l, 1) AS n FROM
   (SELECT query_id, regexp_split_to_array(regexp_replace(a, '([.!?۔])\s+', '\1' || chr(10), 'g'), '\n+') AS l FROM q)) WHERE regexp_matches(c, '[\[(]Document (\d+)[\])]')),
 f AS (SELECT DISTINCT query_id, n, unnest(regexp_extract_all(regexp_replace(c, '[\[(]Document (\d+)[\])]', '', 'g'), '[A-Za-z]*\d[\w\-/]*')) AS fact FROM s),
 t AS (SELECT DISTINCT query_id, n, unnest(regexp_extract_all(c, '[\[(]Document (\d+)[\])]', 1)) AS number FROM s),
 h AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS number, unnest(regexp_extract_all(text, '[A-Za-z]*\d[\w\-/]*')) AS fact FROM documents),
 m AS (SELECT query_id, count(*) AS k FROM f WHERE NOT EXISTS (SELECT 1 FROM t JOIN h USING (number) WHERE t.query_id = f.query_id AND t.n = f.n AND h.fact = f.fact) GROUP BY 1)
 SELECT s.query_id, coalesce(max(k), 0) AS missing FROM s LEFT JOIN m USING (query_id) GROUP BY 1"""


@query("vf_structural", _VF)
def vf_structural(spark, d):
    """Citing sentences checked against the documents of the cited numbers."""
    passages = table(spark, d, "documents").select(F.col("doc_id").alias("number"), "text")
    return vf.unsupported_claims(_answers(spark, d), passages, "query_id", "a")


@query("vf_merge")
def vf_merge(spark, d):
    a = F.col("a")
    return _answers(spark, d).select("query_id", vf.verdict(F.size(vf.invalid_citations(a, F.lit(9))) > 0, vf.refuses(a), vf.uncited(a)).alias("verdict"))


@query("vf_hedge")
def vf_hedge(spark, d):
    a = _answers(spark, d).select("query_id", "a", F.array(F.lit(1), F.lit(2)).alias("low"))
    return a.select("query_id", F.size(vf.unhedged("a", "low")).alias("bare")).where("bare > 0")


@query("rt_route", """SELECT query_id, CASE WHEN regexp_matches(q, '(?i)\\b(?:section|bailable|fine|offence)\\b') THEN 'SQL' WHEN regexp_matches(q, '(?i)FIR-\\d{4}-[A-Z]+-\\d+') THEN 'RAG' WHEN regexp_matches(q, '(?i)\\b(?:network|community|ring|gang)\\b') THEN 'XNETWORK'
 WHEN regexp_matches(q, '(?i)\\b(?:how many|count|total|list every|number of cases)\\b') THEN 'XAGG' WHEN regexp_matches(q, '(?i)\\b(?:any other case|linked|connected|other cases)\\b') THEN 'XGRAPH' ELSE 'DIRECT' END AS route
 FROM (SELECT DISTINCT query_id, user_message AS q FROM queries)""")
def rt_route(spark, d):
    return table(spark, d, "queries").select("query_id", "user_message").distinct().select("query_id", vf.route(F.col("user_message")).alias("route"))


@query("ix_identity", """SELECT cnic, max_by(entity_id, (first_seen_at, entity_id)) AS entity_id FROM entity_summaries WHERE cnic IS NOT NULL AND first_seen_at IS NOT NULL GROUP BY 1""")
def ix_identity(spark, d):
    e = table(spark, d, "entity_summaries").where("cnic is not null and first_seen_at is not null")
    return e.groupBy("cnic").agg(F.max_by("entity_id", F.struct("first_seen_at", "entity_id")).alias("entity_id"))


@query("sa_case_report", """SELECT c.case_id, (SELECT count(*) FROM documents d WHERE d.case_id = c.case_id) AS documents, (SELECT count(DISTINCT field_id) FROM structured_fields f WHERE f.case_id = c.case_id) AS forms FROM cases c""")
def sa_case_report(spark, d):
    docs = table(spark, d, "documents").groupBy("case_id").agg(F.count(F.lit(1)).alias("documents"))
    forms = table(spark, d, "structured_fields").groupBy("case_id").agg(F.countDistinct("field_id").alias("forms"))
    return table(spark, d, "cases").select("case_id").join(docs, "case_id", "left").join(forms, "case_id", "left").fillna(0)

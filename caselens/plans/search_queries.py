"""Queries over extraction, retrieval and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselens.functions import extract as ex
from caselens.functions.text import tokens
from caselens.operators import aggregates as agg
from caselens.operators import retrieval as rt
from caselens.plans.registry import Registry
from caselens.session import spread
from caselens.streaming import events as st
from caselens.tables import table

_R = Registry()
QUERIES, SQL, query = _R.QUERIES, _R.SQL, _R.query


def _text(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text").where("text is not null"))


def _found(column, f):
    def run(spark, d):
        return _text(spark, d).select("doc_id", F.explode(f(F.col("text"))).alias(column))

    return run


_EX = "SELECT DISTINCT doc_id, {e} AS {c} FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{p}')) AS m FROM documents WHERE text IS NOT NULL)"
query("ex_fir", _EX.format(e="m", c="fir", p=r"FIR-\d{4}-[A-Z]+-\d{3,4}"))(_found("fir", ex.fir_numbers))
query("ex_sections_text", _EX.format(e="m", c="section", p=r"\d{1,3}(?:-[A-Z])?(?:\(\d\))? (?:PPC|CrPC|PECA|CNSA)"))(_found("section", ex.sections))
query("ex_cnic")(_found("cnic", ex.cnics))
query("ex_phone")(_found("phone", ex.phones))
query("ex_plate")(_found("plate", ex.plates))
query("dt_extract")(_found("day", ex.dates))


@query("ex_all")
def ex_all(spark, d):
    e = _text(spark, d).select("doc_id", ex.everything(F.col("text")).alias("e"))
    return e.select("doc_id", *[F.size(f"e.{k}").alias(k) for k in ("cnics", "phones", "plates", "fir_numbers", "sections", "dates")])


@query("ex_ner")
def ex_ner(spark, d):
    return _text(spark, d).select("doc_id", F.explode(ex.entities(F.col("text"))).alias("e")).groupBy("e.kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("ex_cites", """WITH m AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, 'FIR-\\d{4}-[A-Z]+-\\d{3,4}')) AS fir FROM documents WHERE text IS NOT NULL)
 SELECT DISTINCT m.doc_id, m.fir FROM m SEMI JOIN cases c ON c.fir_number = m.fir""")
def ex_cites(spark, d):
    m = _text(spark, d).select("doc_id", F.explode(ex.fir_numbers(F.col("text"))).alias("fir"))
    return m.join(table(spark, d, "cases").select(F.col("fir_number").alias("fir")), "fir", "left_semi").select("doc_id", "fir")


@query("ex_attach_id", """SELECT doc_id, min(normalized) AS cnic FROM (SELECT DISTINCT doc_id, normalized FROM field_matches WHERE field_type = 'cnic' AND normalized IS NOT NULL) GROUP BY 1 HAVING count(*) = 1""")
def ex_attach_id(spark, d):
    m = table(spark, d, "field_matches").where("field_type = 'cnic' and normalized is not null").select("doc_id", "normalized").distinct()
    return m.groupBy("doc_id").agg(F.min("normalized").alias("cnic"), F.count(F.lit(1)).alias("n")).where("n = 1").select("doc_id", "cnic")


@query("ex_rel_write", """SELECT DISTINCT source_doc_id, least(mention.entity_id, candidate.entity_id) AS a, greatest(mention.entity_id, candidate.entity_id) AS b FROM pending_matches
 WHERE source_doc_id IS NOT NULL AND mention.entity_id <> candidate.entity_id""")
def ex_rel_write(spark, d):
    p = table(spark, d, "pending_matches").where("source_doc_id is not null and mention.entity_id <> candidate.entity_id")
    return p.select("source_doc_id", F.least("mention.entity_id", "candidate.entity_id").alias("a"), F.greatest("mention.entity_id", "candidate.entity_id").alias("b")).distinct()


@query("flt_plausible")
def flt_plausible(spark, d):
    return table(spark, d, "entity_summaries").select("entity_id", ex.plausible_person(F.col("canonical_name")).alias("plausible")).distinct()


def _query_terms(spark, d):
    """Every question by terms."""
    q = table(spark, d, "queries").select(F.col("query_id").alias("query"), "user_message").distinct()
    return q.select("query", F.explode(tokens(F.col("user_message"))).alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("n"))


def _bm25(spark, d, k=10):
    return rt.bm25_texts(_query_terms(spark, d), _text(spark, d), "doc_id", "text", k)


_TOK = """SELECT {k}, CASE WHEN x = 0 THEN w ELSE string_split_regex(w, '[-/_.]')[x] END AS term FROM (SELECT {k}, w, unnest(CASE WHEN regexp_matches(w, '[-/_.]') THEN range(0, len(string_split_regex(w, '[-/_.]')) + 1) ELSE [0] END) AS x
 FROM (SELECT {k}, unnest(regexp_extract_all(lower({t}), '[\\pL\\pN]+([-/_.][\\pL\\pN]+)*')) AS w FROM {f}))"""
_BM25 = f"""WITH dt AS ({_TOK.format(k='doc_id', t='text', f="documents WHERE text IS NOT NULL")}), qt AS ({_TOK.format(k='query_id', t='user_message', f="(SELECT DISTINCT query_id, user_message FROM queries)")}),
 post AS (SELECT doc_id AS key, term, count(*) AS tf, sum(count(*)) OVER (PARTITION BY doc_id) AS dl FROM dt GROUP BY 1, 2), q AS (SELECT query_id AS query, term, count(*) AS n FROM qt GROUP BY 1, 2),
 st AS (SELECT count(*) AS ndoc, avg(dl) AS avgdl FROM (SELECT DISTINCT key, dl FROM post)), df0 AS (SELECT term, ln(ndoc - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM post, st GROUP BY term, ndoc),
 df AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM df0) ELSE idf END AS idf FROM df0),
 sc AS (SELECT query, key, round(sum(n * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN df USING (term) JOIN post USING (term), st GROUP BY 1, 2),
 bm AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM sc)"""


@query("topk_bm25", _BM25 + " SELECT query, key, rank FROM bm WHERE rank <= 3 AND score > 0")
def topk_bm25(spark, d):
    return _bm25(spark, d, 3).select("query", "key", "rank")


@query("rt_bm25", _BM25 + " SELECT query, key, rank FROM bm WHERE rank <= 10 AND score > 0")
def rt_bm25(spark, d):
    return _bm25(spark, d).select("query", "key", "rank")


@query("ix_postings", f"SELECT term, count(DISTINCT doc_id) AS df FROM ({_TOK.format(k='doc_id', t='text', f='documents WHERE text IS NOT NULL')}) GROUP BY 1")
def ix_postings(spark, d):
    return rt.postings(_text(spark, d), "doc_id", "text").groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query("rt_pool", """SELECT DISTINCT doc_id AS key FROM documents WHERE regexp_matches(lower(text), '(^|[^\\pL\\pN])(parcel|generator)([^\\pL\\pN]|$)')""")
def rt_pool(spark, d):
    return rt.candidate_pool(rt.postings(_text(spark, d), "doc_id", "text"), ["parcel", "generator"])


def _vectors(spark, d, k=10):
    e = table(spark, d, "embeddings")
    return rt.vector_top_k(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", k)


_VEC = """WITH s AS (SELECT q.vec_id AS query, r.vec_id AS key, greatest(0, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[]))) AS score FROM embeddings q, embeddings r WHERE q.vec_id % 20 = 0),
 v AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, key) AS rank FROM s)"""


@query("topk_vector", _VEC + " SELECT query, key, rank, round(score, 4) AS score FROM v WHERE rank <= 10")
def topk_vector(spark, d):
    return _vectors(spark, d).select("query", "key", "rank", F.round("score", 4).alias("score"))


@query("rt_rrf", _VEC + """, l AS (SELECT query, key, rank FROM v WHERE rank <= 10 UNION ALL SELECT v.query, v.key, row_number() OVER (PARTITION BY v.query ORDER BY abs(v.key - v.query), v.key) AS rank FROM v WHERE abs(v.key - v.query) <= 3),
 f AS (SELECT query, key, round(sum(1 / (60 + rank)), 6) AS rrf FROM l GROUP BY 1, 2) SELECT query, key, rrf, row_number() OVER (PARTITION BY query ORDER BY rrf DESC, key) AS rank FROM f""")
def rt_rrf(spark, d):
    from pyspark.sql import Window as W

    e = table(spark, d, "embeddings").select("vec_id")
    near = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.explode(F.sequence(F.col("vec_id") - 3, F.col("vec_id") + 3)).alias("vec_id")).join(e, "vec_id")
    near = near.select("query", F.col("vec_id").alias("key"), F.row_number().over(W.partitionBy("query").orderBy(F.abs(F.col("vec_id") - F.col("query")), "vec_id")).alias("rank"))
    return rt.fuse(_vectors(spark, d).select("query", "key", "rank").unionByName(near))


@query("rt_floor", _VEC + """ SELECT query, key, rank FROM v WHERE rank <= 3 UNION ALL SELECT query, key, rank FROM v WHERE rank IN (4, 5) AND score >= 0.2""")
def rt_floor(spark, d):
    v = _vectors(spark, d)
    fused = v.where("rank <= 3").select("query", "key", (1 / (60 + F.col("rank"))).alias("rrf"), "rank")
    return rt.rescue(fused, v.select("query", "key", "score"), floor=0.2).select("query", "key", "rank")


@query("rt_hybrid")
def rt_hybrid(spark, d):
    q = table(spark, d, "queries").select("query_id", "user_message").distinct()
    docs = _text(spark, d)
    lexical = _bm25(spark, d)
    qv = rt.hashed_embedding(q, "query_id", "user_message").select(F.col("key"), "embedding")
    dv = rt.hashed_embedding(docs, "doc_id", "text").select(F.col("key"), "embedding")
    semantic = rt.vector_top_k(qv, dv, "key", "embedding", 10, query_block=512, once=True)
    return rt.fuse(lexical.select("query", "key", "rank").unionByName(semantic.select("query", "key", "rank")), top=10)


@query("agg_recall_mrr", _VEC + """, e AS (SELECT q.vec_id AS query, r.vec_id AS item FROM embeddings q JOIN embeddings r ON q.label = r.label AND q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0),
 h AS (SELECT e.query, min(v.rank) AS first FROM e JOIN v ON v.query = e.query AND v.key = e.item AND v.rank <= 20 GROUP BY 1), a AS (SELECT DISTINCT query FROM e)
 SELECT count(*) AS n, round(avg(CASE WHEN first <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(coalesce(1 / first, 0)), 6) AS mrr FROM a LEFT JOIN h USING (query)""")
def agg_recall_mrr(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "label")
    # expectations are looked up for the ranked items only, not written out for all rows of a label
    ranked = _vectors(spark, d, 20).select("query", F.col("key").alias("item"), "rank").where("query <> item")
    same = ranked.join(q, "query").join(e.select(F.col("vec_id").alias("item"), F.col("label").alias("l2")), "item").where("label = l2").select("query", "item")
    sizes = e.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    asked = q.join(sizes.where("n > 1"), "label").select("query", F.lit(-1).cast("bigint").alias("item"))
    return agg.recall_mrr(ranked, same.unionByName(asked))


@query("stream_usage", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, upper(event_type) AS route, count(*) AS n FROM events GROUP BY 1, 2")
def stream_usage(spark, d):
    return st.drain(st.usage(st.read(spark, d, "events.parquet"), "ts", "event_type"), "usage")


@query("stream_sessions")
def stream_sessions(spark, d):
    return st.drain(st.sessions(st.read(spark, d, "events.parquet"), "ts", "user_id"), "sessions")


@query("inc_sync", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def inc_sync(spark, d):
    e = st.read(spark, d, "events.parquet").select("user_id", "event_id")
    return st.upsert(e, "user_id", "event_id", "sync").select("user_id", "event_id")

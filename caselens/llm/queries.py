"""Queries of the text problems and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.llm import bpe
from caselens.llm import conversations as conv
from caselens.llm import link_queries, lookalike, packing, pii, spans
from caselens.llm import pairs as pair_defects
from caselens.session import spread
from caselens.tables import table


def p1_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value with its plain form."""
    parts = []
    for name, key, column in (("entity_summaries", "entity_id", "canonical_name"), ("field_matches", "match_id", "normalized")):
        rows = lookalike.plain_rows(table(spark, sf_dir, name), key, column)
        parts.append(rows.select(F.lit(name).alias("table_name"), "row_key", "value", "plain"))
    return parts[0].unionByName(parts[1])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose value differs from its plain form."""
    return p1_plain(spark, sf_dir).where("value <> plain").select("table_name", "row_key").distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions to be dropped, with the first fault that holds."""
    return conv.session_faults(table(spark, sf_dir, "messages"), table(spark, sf_dir, "queries"))


def p3_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of the sessions kept, by conversation and turn."""
    return conv.conversations(table(spark, sf_dir, "messages"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective question-answer pairs with their defect."""
    rows = table(spark, sf_dir, "queries")
    model = pair_defects.fitted(rows, "user_message", "final_response")
    return pair_defects.defects(spread(rows), "query_id", "user_message", "final_response", model).select(F.col("pair_key").alias("query_id"), "defect").distinct()


def p4_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs per defect."""
    return p4_found(spark, sf_dir).groupBy("defect").agg(F.count(F.lit(1)).alias("pairs"))


def _pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, asked = table(spark, sf_dir, "entity_summaries"), table(spark, sf_dir, "queries")
    model = pii.fitted(
        known.where("entity_type = 'Person'").select("canonical_name"),
        table(spark, sf_dir, "structured_fields").select("complainant_address"),
        known.where("entity_type = 'Organization'").select("canonical_name"),
        table(spark, sf_dir, "stations").select("station_name"),
        table(spark, sf_dir, "cases").select("description").unionAll(asked.select("user_message")).unionAll(asked.select("final_response")),
    )
    parts = []
    for name, key, column in (("cases", "case_id", "description"), ("queries", "query_id", "user_message"), ("queries", "query_id", "final_response")):
        found = pii.detect(spread(table(spark, sf_dir, name)), key, column, model)
        parts.append(found.select(F.lit(name).alias("table_name"), "row_key", F.lit(column).alias("field_name"), "text", "redacted", "spans"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per span of personal information."""
    each = _pii(spark, sf_dir).select("table_name", "row_key", "field_name", F.explode("spans").alias("s"))
    return each.select("table_name", "row_key", "field_name", F.col("s.kind").alias("pii_kind"), "s.span_no").distinct()


def p7_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with typed placeholders."""
    return _pii(spark, sf_dir).select("table_name", "row_key", "field_name", "redacted")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    return bpe.encode(spread(table(spark, sf_dir, "documents")))


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text does not come back from its ids; there should be none."""
    ids = bpe.encode(spread(table(spark, sf_dir, "documents")))
    back = ids.select("doc_id", bpe.decode(ids).alias("back"))
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.join(back, "doc_id").where("text <> back").select("doc_id")


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in a container of each window."""
    caps = packing.windows(table(spark, sf_dir, "token_windows"))
    return packing.pack(bpe.token_counts(spread(table(spark, sf_dir, "documents"))), caps)


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers and used share per window."""
    caps = packing.windows(table(spark, sf_dir, "token_windows"))
    return packing.fill(p9_containers(spark, sf_dir), caps)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of each document that stand elsewhere in spans of 400 or more."""
    return spans.shared_chars(spread(table(spark, sf_dir, "documents")))


def p10_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shared passages of each document."""
    return spans.shared_spans(spread(table(spark, sf_dir, "documents")))


_P3 = r"""
WITH m AS (
  SELECT DISTINCT lower(regexp_extract(lower(session_id), '[0-9a-f]{8}-[0-9a-f-]{27}')) AS session_id, message_id, created_at,
    CASE WHEN lower(trim(role)) IN ('user', 'human') THEN 'user' WHEN lower(trim(role)) IN ('assistant', 'ai', 'bot') THEN 'assistant' END AS role
  FROM messages WHERE regexp_matches(content, '[^\pZ\pC\s\x{034F}\x{FE0F}]')),
o AS (SELECT *, row_number() OVER w AS k, lead(role) OVER w AS nxt, lead(message_id) OVER w AS nid FROM m
      WINDOW w AS (PARTITION BY session_id ORDER BY created_at, message_id)),
f AS (SELECT session_id, CASE WHEN bool_or(role IS NULL OR (k = 1 AND role = 'assistant')) THEN 'broken'
        WHEN bool_or(role = 'user' AND (nid IS NULL OR coalesce(nxt = 'user', false))) THEN 'missing_reply' ELSE 'none' END AS fault
      FROM o GROUP BY session_id),
s AS (SELECT regexp_extract(lower(session_id), '[0-9a-f]{8}-[0-9a-f-]{27}') AS session_id FROM messages
      UNION SELECT regexp_extract(lower(session_id), '[0-9a-f]{8}-[0-9a-f-]{27}') FROM queries)
SELECT s.session_id, coalesce(f.fault, 'empty') AS fault FROM s LEFT JOIN f USING (session_id) WHERE coalesce(f.fault, 'empty') <> 'none'
"""

_P10 = """
WITH w AS (SELECT doc_id, i, hash(substr(text, i, 400)) AS h
           FROM (SELECT doc_id, text, unnest(range(1, length(text) - 398)) AS i FROM documents WHERE length(text) >= 400)),
s AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT doc_id, i FROM w SEMI JOIN s USING (h))
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_plain": p1_plain,
    "p3_found": p3_found,
    "p3_conversations": p3_conversations,
    "p4_found": p4_found,
    "p4_summary": p4_summary,
    "p7_found": p7_found,
    "p7_redacted": p7_redacted,
    "p8_ids": p8_ids,
    "p8_round_trip": p8_round_trip,
    "p9_containers": p9_containers,
    "p9_fill": p9_fill,
    "p10_found": p10_found,
    "p10_spans": p10_spans,
    **link_queries.QUERIES,
}
SQL = {
    **link_queries.SQL,
    "p3_found": _P3,
    "p10_found": _P10
    + """SELECT doc_id, CAST(sum(least(400, coalesce(nxt - i, 400))) AS BIGINT) AS shared_chars
         FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM m) GROUP BY 1""",
    "p10_spans": _P10
    + """SELECT doc_id, CAST(min(i) - 1 AS INT) AS start, CAST(max(i) + 399 AS INT) AS end
         FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS g
               FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS n FROM m)) GROUP BY doc_id, g""",
}

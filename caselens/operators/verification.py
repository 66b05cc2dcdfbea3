"""Checks of answers against the passages they cite."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FACT = r"[A-Za-z]*\d[\w\-/]*"
CITE = r"[\[(]Document (\d+)[\])]"
_STRONG = r"(?i)\b(?:i cannot|i can't|i am unable|unable to assist|not permitted|i have to decline)\b"
_WEAK = r"(?i)\b(?:no information|not available|do not contain|could not find)\b"
# Phrases that show an answer is not sure, in English and Urdu.
HEDGES = (
    "unconfirmed", "possible", "pending", "not yet verified", "under review", "flagged", "uncertain", "may be",
    "غیر تصدیق شدہ", "ممکنہ", "ممکن ہے", "زیر التواء", "زیر التوا", "تصدیق نہیں ہوئی", "زیر جائزہ", "زیر غور", "نشان زد",
    "غیر یقینی", "ہو سکتا ہے",
)


def citations(answer: Column) -> Column:
    """Numbers of the documents an answer cites, distinct and sorted."""
    n = F.transform(F.regexp_extract_all(answer, F.lit(CITE), F.lit(1)), lambda x: x.cast("int"))
    return F.array_sort(F.array_distinct(n))


def invalid_citations(answer: Column, n_documents: Column) -> Column:
    """Cited numbers that no document of the answer has."""
    return F.filter(citations(answer), lambda n: (n < 1) | (n > n_documents))


def refuses(answer: Column) -> Column:
    """A strong phrase always refuses, a weak one only without citations."""
    return F.coalesce(answer.rlike(_STRONG) | (answer.rlike(_WEAK) & (F.size(citations(answer)) == 0)), F.lit(False))


def uncited(answer: Column) -> Column:
    """A substantial answer, by length or as a list, without a citation."""
    items = F.regexp_count(answer, F.lit(r"(?m)^\s*(?:[-*•]|\d+\.)\s"))
    return F.coalesce(((F.length(answer) >= 150) | (items >= 2)) & (F.size(citations(answer)) == 0), F.lit(False))


def leaks(answers: DataFrame, passages: DataFrame, allowed: DataFrame, answer: str = "answer_id") -> DataFrame:
    """The first cited passage of each answer whose case the answer may not show.

    ``answers(answer_id, text)``, ``passages(answer_id, number, case_id)``, ``allowed(answer_id, case_id)``.
    """
    cited = answers.select(answer, F.explode(citations(F.col("text"))).alias("number"))
    hit = cited.join(passages, [answer, "number"]).where("case_id is not null")
    return hit.join(allowed, [answer, "case_id"], "left_anti").groupBy(answer).agg(F.min("number").alias("number"))


def _bare(text: str, low: list[int] | None) -> list[int]:
    out = []
    for m in re.finditer(CITE, text or ""):
        n = int(m[1])
        if low is not None and n in low and n not in out:
            around = text[max(0, m.start() - 250) : m.end() + 250].lower()
            if not any(h in around for h in HEDGES):
                out.append(n)
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def unhedged(text: pd.Series, low: pd.Series) -> pd.Series:
    """Cited numbers of unsure passages without a hedge within 250 characters."""
    return pd.Series([_bare(t, None if x is None else list(x)) for t, x in zip(text, low)])


def claims(answer: Column) -> Column:
    """Sentences of an answer that cite something."""
    return F.filter(F.split(answer, r"(?<=[.!?۔])\s+|\n+"), lambda s: s.rlike(CITE))


def unsupported_numbers(claim: Column, passage: Column) -> Column:
    """Numbers and identifiers of a claim that its passage does not hold."""
    pattern = F.lit(_FACT)
    bare = F.regexp_replace(claim, CITE, "")
    return F.array_except(F.array_distinct(F.regexp_extract_all(bare, pattern, F.lit(0))), F.regexp_extract_all(passage, pattern, F.lit(0)))


def unsupported_claims(answers: DataFrame, passages: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, missing)``: how many numbers and identifiers the citing sentences of each answer state that none of the
    passages they cite holds. ``passages(number, text)``; answers without a citing sentence give no row."""
    c = answers.select(F.col(key).alias("key"), F.posexplode(claims(F.col(text))).alias("n", "claim"))
    c = c.select("key", "n", citations(F.col("claim")).alias("cited"), F.array_distinct(F.regexp_extract_all(F.regexp_replace("claim", CITE, ""), F.lit(_FACT), F.lit(0))).alias("facts"))
    facts = c.select("key", "n", "cited", F.explode("facts").alias("fact"))
    told = facts.select("key", "n", "fact", F.explode("cited").alias("number"))
    p = passages.select(F.col("number").cast("int").alias("number"), "text").join(told.select("number").distinct(), "number", "left_semi")
    held = p.select("number", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_FACT), F.lit(0)))).alias("fact"))
    held = told.join(held, ["number", "fact"], "left_semi").select("key", "n", "fact").distinct()
    bare = facts.join(held, ["key", "n", "fact"], "left_anti").groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    return c.select("key").distinct().join(bare, "key", "left").select(F.col("key").alias(key), F.coalesce("m", F.lit(0).cast("long")).alias("missing"))


def verdict(*failed: Column) -> Column:
    """FAIL if any check failed or could not be made; PASS only if all were made and held."""
    bad = F.lit(False)
    for f in failed:
        bad = bad | F.coalesce(f, F.lit(True))
    return F.when(bad, "FAIL").otherwise("PASS")


# What sends a question to which route, first match wins.
ROUTES = [
    ("SQL", r"(?i)\b(?:section|bailable|fine|offence)\b"),
    ("RAG", r"(?i)FIR-\d{4}-[A-Z]+-\d+"),
    ("XNETWORK", r"(?i)\b(?:network|community|ring|gang)\b"),
    ("XAGG", r"(?i)\b(?:how many|count|total|list every|number of cases)\b"),
    ("XGRAPH", r"(?i)\b(?:any other case|linked|connected|other cases)\b"),
]


def route(question: Column) -> Column:
    """The route a question takes by its words; DIRECT without any."""
    out = F.lit("DIRECT")
    for name, pattern in reversed(ROUTES):
        out = F.when(question.rlike(pattern), name).otherwise(out)
    return out

"""Scalar text functions; all but normalization and sentences are expressions."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Grammar words that mark Urdu in Latin letters.
ROMAN_MARKERS = "hai hain ka ki ke ko se mein ne aur par tha thi the kya nahi raha rahi gaya gayi kar karna liye wala jab keh hua hui".split()
# Abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = frozenset("mr mrs ms dr st no vs etc rs sr jr prof art sec fig vol ch".split())
# Silent characters and vowel marks that are left out.
_MARKS = re.compile("[​‎‏‪-‮⁠-⁩﻿ـً-ٰٟ]")


def squeeze(c: Column) -> Column:
    """Three and more blanks or tabs become one blank; lines stay."""
    return F.regexp_replace(c, r"[ \t]{3,}", " ")


def _normalize(text: str) -> str:
    s = _MARKS.sub("", unicodedata.normalize("NFKC", text))
    s = s.replace("ي", "ی").replace("ى", "ی").replace("ك", "ک").replace("ة", "ہ").replace("ه", "ہ")
    return "".join(str(unicodedata.digit(ch)) if unicodedata.category(ch) == "Nd" else ch for ch in s)


@F.pandas_udf(T.StringType())
def _normalize_udf(texts: pd.Series) -> pd.Series:
    return texts.map(_normalize, na_action="ignore")


def normalize(c: Column) -> Column:
    """One form of letters and digits without marks; ASCII text never leaves the JVM."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), _normalize_udf(c)).otherwise(c)


def tokens(c: Column) -> Column:
    """Lower-case words; an identifier such as FIR-2025-3 gives itself and its parts."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+(?:[-/_.][\p{L}\p{N}]+)*"), F.lit(0))
    return F.flatten(F.transform(words, lambda w: F.when(w.rlike("[-/_.]"), F.concat(F.array(w), F.split(w, "[-/_.]"))).otherwise(F.array(w))))


def doc_id(source: Column, scope: Column, page: Column, text: Column) -> Column:
    """A stable id of a passage: its source made safe and a hash of where and what it is."""
    safe = F.regexp_replace(source, r"[^A-Za-z0-9_.-]", "_")
    return F.concat(safe, F.lit("_"), F.substring(F.md5(F.concat_ws("::", source, scope, page, F.substring(text, 1, 200)).cast("binary")), 1, 8))


def is_roman_urdu(c: Column) -> Column:
    """Urdu in Latin letters: twelve Latin words, little Arabic script, three distinct markers that make up 4 %."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"[a-z]+"), F.lit(0))
    marks = F.filter(words, lambda w: w.isin(ROMAN_MARKERS))
    arabic = F.length(F.regexp_replace(c, r"[^\x{0600}-\x{06FF}]", ""))
    latin = F.length(F.regexp_replace(c, r"[^A-Za-z]", ""))
    return F.coalesce(
        (F.size(words) >= 12) & (arabic <= latin * 0.2) & (F.size(F.array_distinct(marks)) >= 3) & (F.size(marks) >= F.size(words) * 0.04), F.lit(False)
    )


def script(c: Column) -> Column:
    return F.when(c.rlike(r"[\x{0600}-\x{06FF}]"), "urdu").otherwise("latin")


def excerpt(c: Column, most: int = 200) -> Column:
    """At most ``most`` characters, the last an ellipsis where something was cut."""
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, most - 1)), F.lit("…")))


def name_list(c: Column) -> Column:
    """Names of a list parted by Latin or Urdu commas."""
    return F.filter(F.transform(F.split(c, "[,،]"), lambda x: F.trim(x)), lambda x: x != "")


def denies(c: Column) -> Column:
    """Whether an answer states that it knows nothing."""
    return F.coalesce(F.lower(c).rlike(r"no (?:information|record)|not (?:found|available|mentioned)|cannot (?:find|determine)|do(?:es)? not contain"), F.lit(False))


def sentence_ends(text: str) -> list[int]:
    """Places where sentences end: after end marks before a blank, unless an abbreviation, an initial, a list number at
    the start of a line or a decimal stands before; and at line breaks."""
    out = []
    for m in re.finditer(r"[۔؟!?.]+[\"'”’)\]]*(?=\s|$)|\n+", text):
        if m[0][0] != "\n" and m[0].startswith("."):
            word = (text[max(0, m.start() - 40) : m.start()].rsplit(None, 1) or [""])[-1].lstrip("([\"'")
            if text[m.start() - 1 : m.start()].isspace():
                word = ""
            line = text.rfind("\n", 0, m.start()) + 1
            if word.lower() in ABBREVIATIONS or (len(word) == 1 and word.isalpha()) or (word.isdigit() and text[line : m.start()].strip() == word):
                continue
        out.append(m.end())
    if text.strip() and (not out or out[-1] < len(text)):
        out.append(len(text))
    return out


def chunk_text(text: str | None, size: int = 512, overlap: int = 64) -> list[str]:
    """Windows of ``size`` characters: blocks between blank lines, cut after the last sentence that fits, else after
    the last blank, else at the size; the next window starts ``overlap`` characters earlier, and at least a quarter on."""
    out: list[str] = []
    for block in re.split(r"\n\s*\n", text or ""):
        block = block.strip()
        if not block:
            continue
        ends, at = sentence_ends(block), 0
        while at < len(block):
            if len(block) - at <= size:
                out.append(block[at:].strip())
                break
            limit, floor = at + size, at + size // 4
            k = bisect_right(ends, limit)
            cut = (ends[k - 1] if k and ends[k - 1] > floor else 0) or max(block.rfind(" ", floor, limit), 0) or limit
            out.append(block[at:cut].strip())
            at = max(cut - overlap, at + size // 4)
    return [c for c in out if c]


@F.pandas_udf(T.ArrayType(T.StringType()))
def sentences(texts: pd.Series) -> pd.Series:
    """Sentences of a text, stripped; null for null."""

    def each(t: str) -> list[str]:
        ends = sentence_ends(t)
        return [s for a, b in zip([0, *ends], ends) if (s := t[a:b].strip())]

    return texts.map(each, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def chunks(texts: pd.Series) -> pd.Series:
    """Windows of a text, see ``chunk_text``; null for null."""
    return texts.map(chunk_text, na_action="ignore")


def year_boost(c: Column) -> Column:
    """A small bonus for recent years named in a text."""
    year = F.regexp_extract(c, r"\b(20\d\d)\b", 1).try_cast("int")
    return F.greatest(F.lit(0.0), (F.coalesce(year, F.lit(2020)) - 2020) * 0.0005)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two vectors, not below 0; 0 for a vector without length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    n = norm(a) * norm(b)
    return F.when(n > 0, F.greatest(F.lit(0.0), dot / n)).otherwise(0.0)

"""Fields found in text by pattern, as array expressions, and rule-based entities."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The patterns of the field kinds.
CNIC = r"(?<!\d)(\d{5})[-. ]?(\d{7})[-. ]?(\d)(?!\d)"
PHONE = r"(?<!\d)(03\d{2})[- ]?(\d{7})(?!\d)"
PLATE = r"(?<![A-Za-z])([A-Za-z]{2,4})[-–]([A-Za-z]{1,2})[- –](\d{2,4})(?!\d)"
FIR = r"(FIR-\d{4}-[A-Z]+-\d{3,4})"
ISO_DATE = r"(?<!\d)(\d{4})-(\d{2})-(\d{2})(?!\d)"
DMY_DATE = r"(?<!\d)(\d{2})[-/](\d{2})[-/](\d{4})(?!\d)"
SECTION = r"(\d{1,3}(?:-[A-Z])?(?:\(\d\))? (?:PPC|CrPC|PECA|CNSA))"
DISPLAY = r"(?<![\d/])(\d{1,4}/\d{2})(?![\d/])"


# Digits of other scripts and dashes, and what they are folded to before a pattern is tried.
_FROM, _TO = "۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩‐‑‒–—―−", "0123456789" * 2 + "-" * 7


def folded(c: Column) -> Column:
    """Text with ASCII digits and hyphens; its length stays."""
    return F.translate(c, _FROM, _TO)


def _joined(c: Column, pattern: str, groups: int, sep: str = "-") -> Column:
    """All matches of a pattern with its groups joined, in order of appearance."""
    parts = [F.regexp_extract_all(c, F.lit(pattern), F.lit(g)) for g in range(1, groups + 1)]
    if groups == 1:
        return parts[0]
    return F.transform(F.arrays_zip(*[p.alias(f"g{i}") for i, p in enumerate(parts)]), lambda m: F.concat_ws(sep, *[m[f"g{i}"] for i in range(groups)]))


def cnics(c: Column) -> Column:
    return F.array_distinct(_joined(folded(c), CNIC, 3))


def phones(c: Column) -> Column:
    return F.array_distinct(_joined(folded(c), PHONE, 2))


def plates(c: Column) -> Column:
    return F.array_distinct(F.transform(_joined(folded(c), PLATE, 3), F.upper))


def fir_numbers(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(FIR), F.lit(1)))


def sections(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(SECTION), F.lit(1)))


def dates(c: Column) -> Column:
    """Valid calendar days in either order of writing, earliest first."""
    c = folded(c)
    iso = F.transform(F.regexp_extract_all(c, F.lit(ISO_DATE), F.lit(0)), lambda x: F.try_to_date(x, "yyyy-MM-dd"))
    dmy = F.transform(F.regexp_extract_all(c, F.lit(DMY_DATE), F.lit(0)), lambda x: F.try_to_date(F.translate(x, "/", "-"), "dd-MM-yyyy"))
    return F.array_sort(F.array_distinct(F.filter(F.concat(iso, dmy), lambda x: x.isNotNull())))


def everything(c: Column) -> Column:
    """All kinds at once: a struct of arrays."""
    return F.struct(cnics(c).alias("cnics"), phones(c).alias("phones"), plates(c).alias("plates"), fir_numbers(c).alias("fir_numbers"), sections(c).alias("sections"), dates(c).alias("dates"))


# Words before a name and how sure they make it.
_CUES = [
    (re.compile(r"\b(?:s/o|d/o|w/o|son of|daughter of|wife of)\s+((?:[A-Z][a-z]+\s?){1,4})"), "PERSON", 0.85),
    (re.compile(r"\b(?:SI|ASI|Inspector|Constable|DSP|SHO|Advocate|Dr\.?|Mr\.?|Mst\.?)\s+((?:[A-Z][a-z]+\s?){1,4})"), "PERSON", 0.75),
    (re.compile(r"\b(?:I am|my name is|mera naam)\s+((?:[A-Z][a-z]+\s?){1,4})"), "PERSON", 0.55),
    (re.compile(r"\b(PS (?:[A-Z][a-z]+\s?){1,3})"), "STATION", 0.85),
    (re.compile(r"\b((?:[A-Z][a-z]+\s){1,3}(?:Traders|Motors|Bank|School|Company|Society|Centre|Agency|Works|Mills))\b"), "ORGANIZATION", 0.70),
    (re.compile(r"\b((?:[A-Z][a-z]+\s){1,2}(?:Town|Colony|Nagar|Bazar|Mohalla|Park|Road|Chowk))\b"), "LOCATION", 0.70),
    (re.compile(r"\b([A-Z][a-z]{2,}(?:\s[A-Z][a-z]{2,}){1,3})\b"), "PERSON", 0.45),
]


def _entities(text: str, least: float) -> list[dict]:
    found = []
    for pattern, kind, sure in _CUES:
        for m in pattern.finditer(text):
            value = m[1].strip()
            if value and sure >= least:
                found.append((sure, m.start(1), m.start(1) + len(value), kind, value))
    kept: list[tuple] = []
    # of overlapping spans the surer stays, then the earlier
    for f in sorted(found, key=lambda x: (-x[0], x[1], -x[2])):
        if all(f[2] <= k[1] or f[1] >= k[2] for k in kept):
            kept.append(f)
    return [{"start": s, "end": e, "kind": k, "value": v, "confidence": c} for c, s, e, k, v in sorted(kept, key=lambda x: x[1])]


ENTITY = T.StructType(
    [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType()), T.StructField("confidence", T.DoubleType())]
)


def entities(c: Column, least: float = 0.5) -> Column:
    """Persons, stations, firms and places by rule, those with at least a confidence; overlaps are resolved."""

    @F.pandas_udf(T.ArrayType(ENTITY))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _entities(t, least), na_action="ignore")

    return run(c)


# Names of persons never contain these.
_NOT_A_NAME = r"(?i)police station|\b(?:road|highway|market|bazar|bazaar|street|colony|town|chowk)\b"


def plausible_person(c: Column, stations: Column | None = None) -> Column:
    """Whether a string can be a person's name: two words or more, at most 45 characters, no place, no list marks."""
    ok = (F.trim(c) != "") & F.trim(c).contains(" ") & (F.length(c) <= 45) & ~c.rlike(r"[\n\r|()]") & ~c.rlike(_NOT_A_NAME)
    if stations is not None:
        ok = ok & ~F.array_contains(stations, F.lower(F.trim(c)))
    return F.coalesce(ok, F.lit(False))

"""Small scalar and array functions over records, JSON and spans."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselens.functions.script import skeleton


def date_only(c: Column) -> Column:
    """The day of an ISO time; null where it is none."""
    return F.try_to_date(F.substring(c, 1, 10))


def host(url: Column) -> Column:
    """Host of a web or mail address, lower case."""
    return F.lower(F.regexp_extract(url, r"(?:^[a-z]+://|@)([^/\s:]+)", 1))


def allowed_host(url: Column, domains: list[str]) -> Column:
    """Whether an address lies in one of the domains or below."""
    h = host(url)
    out = F.lit(False)
    for d in domains:
        out = out | (h == d) | h.endswith("." + d)
    return F.coalesce(out, F.lit(False))


def tagged_service(kinds: dict[str, Column]) -> Column:
    """The first part that is there, tagged with its kind."""
    return F.coalesce(*[F.when(c.isNotNull(), F.struct(F.lit(k).alias("kind"), c.cast("string").alias("value"))) for k, c in kinds.items()])


def children(c: Column, kind: str) -> Column:
    """A child array, empty where there is none."""
    return F.coalesce(c, F.array().cast(kind))


def strip_graph_suffix(c: Column) -> Column:
    """Graph values without their type suffix, as JSON text."""
    return F.regexp_replace(c, r"::(?:vertex|edge|path)\b", "")


def reclassify(severity: Column, message: Column) -> Column:
    """Messages on rate limits are warnings unless critical."""
    return F.when((severity != "critical") & F.lower(message).rlike(r"rate.?limit|too many requests|\b429\b"), "warning").otherwise(severity)


def _first_json(text: str) -> str | None:
    for m in re.finditer(r"[\[{]", text):
        try:
            _, end = json.JSONDecoder().raw_decode(text, m.start())
            return text[m.start() : end]
        except ValueError:
            continue
    return None


@F.pandas_udf(T.StringType())
def first_json(texts: pd.Series) -> pd.Series:
    """The first complete JSON object or array in a text."""
    return texts.map(_first_json, na_action="ignore")


@F.pandas_udf(T.StringType())
def consonants(texts: pd.Series) -> pd.Series:
    """Consonants of a name, word by word, the same for Latin and Urdu letters."""
    return texts.map(lambda t: " ".join(skeleton(w) for w in t.lower().split()), na_action="ignore")


def boundary_before(ends: Column, limit: Column, floor: Column) -> Column:
    """The largest place in ``ends`` up to ``limit`` and beyond ``floor``; null without one."""
    return F.array_max(F.filter(ends, lambda e: (e <= limit) & (e > floor)))


def registration(text: Column) -> Column:
    """The first date after a date label, else the first date, and which of the two it is."""
    label = F.regexp_extract(text, r"(?i)(?:dated?|registered on|on)\s+(\d{4}-\d{2}-\d{2})", 1)
    any_ = F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1)
    return F.when(label != "", F.struct(F.try_to_date(label).alias("day"), F.lit("labeled").alias("how"))).when(any_ != "", F.struct(F.try_to_date(any_).alias("day"), F.lit("unlabeled_fallback").alias("how")))


def pad_row(cells: Column, width: int) -> Column:
    """A ragged row brought to ``width`` cells."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.get(cells, i), F.lit("")))


def without_overlaps(spans: list[tuple[int, int, float]]) -> list[int]:
    """Numbers of the spans kept: the surer of two that overlap, then the earlier; in order of their start."""
    kept: list[int] = []
    for i in sorted(range(len(spans)), key=lambda k: (-spans[k][2], spans[k][0], spans[k][1], k)):
        if all(spans[i][1] <= spans[j][0] or spans[i][0] >= spans[j][1] for j in kept):
            kept.append(i)
    return sorted(kept, key=lambda k: (spans[k][0], k))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def kept_spans(starts: pd.Series, ends: pd.Series, sure: pd.Series) -> pd.Series:
    return pd.Series([without_overlaps(list(zip(a, b, c))) for a, b, c in zip(starts, ends, sure)])


def distinct_names(names: list[str], least: float = 0.90) -> int:
    """How many people a list of spellings names: each joins the first group with a member near enough."""
    from caselens.operators.resolution import token_sort_ratio

    groups: list[list[str]] = []
    for n in sorted(set(names)):
        for g in groups:
            if any(token_sort_ratio(n, x) >= least for x in g):
                g.append(n)
                break
        else:
            groups.append([n])
    return len(groups)

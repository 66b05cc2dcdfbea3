"""Filters, projections and joins over cases, runs, documents and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def is_closed(status: Column) -> Column:
    """Closed means the status names it; anything else, no status included, is open."""
    return F.lower(F.coalesce(status, F.lit(""))).contains("closed")


def filter_cases(cases: DataFrame, question: str, status: str = "investigation_status", category: str = "crime_category", categories: tuple[str, ...] = ()) -> DataFrame:
    """Cases a question asks for: closed words win over open words; then the first category named in the question."""
    q = question.lower()
    if any(w in q for w in ("closed", "disposed", "completed")):
        cases = cases.where(is_closed(F.col(status)))
    elif any(w in q for w in ("open", "pending", "active", "ongoing")):
        cases = cases.where(~is_closed(F.col(status)))
    for c in categories:
        if c.lower() in q:
            return cases.where(F.lower(F.col(category)).contains(c.lower()))
    return cases


def reference_lookup(rows: DataFrame, empty_means_all: bool = False, **like: str | None) -> DataFrame:
    """Rows whose columns contain the given texts, case-insensitively and all together; without texts none (or all)."""
    given = {k: v for k, v in like.items() if v}
    if not given and not empty_means_all:
        return rows.limit(0)
    for column, text in given.items():
        escaped = text.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")
        rows = rows.where(F.col(column).ilike(f"%{escaped}%"))
    return rows


def log_page(rows: DataFrame, ts: str, tie: str, since: object = None, limit: int | None = None, offset: int = 0, **equal: object) -> DataFrame:
    """Rows matching the equality filters since a time, newest first, one page of them."""
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if since is not None:
        rows = rows.where(F.col(ts) >= F.lit(since))
    rows = rows.orderBy(F.col(ts).desc(), F.col(tie))
    if offset:
        rows = rows.offset(offset)
    return rows if limit is None else rows.limit(limit)


def latest_per_key(rows: DataFrame, key: str, *newest: str) -> DataFrame:
    """The last delivery of each key: an upsert's outcome. Ties are settled by all columns, so the result is stable."""
    order = [F.col(c).desc_nulls_last() for c in newest] + [F.xxhash64(*[F.col(c).cast("string") for c in rows.columns])]
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def case_record_text(labels: dict[str, str]) -> Column:
    """A case row as lines ``Label: value``; blank values are left out."""
    lines = [F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(f"{label}: "), F.col(c).cast("string"))) for c, label in labels.items()]
    return F.concat_ws("\n", *lines)


def clean_cell(c: Column) -> Column:
    """Dashes and blanks are no value."""
    t = F.trim(c)
    return F.when(~t.isin("", "-", "—"), t)


def case_fields(bundle: str = "fir") -> list[Column]:
    """Case columns of a nested report: first non-null of old and new field names, latest position, categories."""
    b = lambda p: F.col(f"{bundle}.{p}")
    acts = F.array_distinct(F.transform(F.coalesce(b("sections"), F.array()), lambda s: s["act"]))
    last = F.try_element_at(F.coalesce(b("statuses"), F.array()), F.lit(-1))
    dated = F.filter(F.coalesce(b("statuses"), F.array()), lambda s: s["position"].isNotNull() & s["status_date"].isNotNull())
    newest = F.try_element_at(F.array_sort(F.transform(dated, lambda s: F.struct(s["status_date"].alias("d"), s["position"].alias("p")))), F.lit(-1))
    current = F.filter(F.coalesce(b("officers"), F.array()), lambda o: o["assigned_to"].isNull())
    return [
        F.coalesce(b("case_id"), b("id")).alias("case_id"),
        F.array_join(acts, ", ").alias("crime_category"),
        F.coalesce(newest["p"], last["position"]).alias("investigation_status"),
        F.coalesce(F.get(current, F.lit(0))["name"], F.try_element_at(F.coalesce(b("officers"), F.array()), F.lit(-1))["name"]).alias("investigation_officer"),
        F.try_to_date(F.substring(b("incident_at"), 1, 10)).alias("incident_date"),
    ]


def contains_join(entities: DataFrame, wanted: DataFrame, text: str, needle: str, most: int = 1000) -> DataFrame:
    """Entities whose text contains a wanted string, ignoring case. ``wanted`` holds the few strings of one question:
    more than ``most`` are refused, so the broadcast side has a bound."""
    rows = [r[0] for r in wanted.select(needle).where(F.col(needle).isNotNull()).distinct().limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} search strings")
    if not rows:
        return entities.withColumn(needle, F.lit(None).cast("string")).limit(0)
    each = F.filter(F.array(*[F.lit(r) for r in rows]), lambda n: (n != "") & F.lower(F.col(text)).contains(F.lower(n)))
    return entities.withColumn(needle, F.explode(each))


def as_of_join(left: DataFrame, right: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """The last ``value`` of ``right`` at or before each row of ``left`` with the same key: one sort, no pairs."""
    marks = right.select(F.col(key), F.col(ts), F.struct(F.col(value).alias("v")).alias("_v"), F.lit(0).alias("_side"))
    rows = left.withColumn("_v", F.lit(None).cast(marks.schema["_v"].dataType)).withColumn("_side", F.lit(1))
    over = W.partitionBy(key).orderBy(ts, "_side").rowsBetween(W.unboundedPreceding, 0)
    both = rows.unionByName(marks, allowMissingColumns=True)
    return both.withColumn(f"{value}_as_of", F.last("_v", ignorenulls=True).over(over)["v"]).where("_side = 1").drop("_v", "_side")

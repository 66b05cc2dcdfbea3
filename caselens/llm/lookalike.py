"""Problem 1: values that look alike but consist of other characters.

Letters of distinct values are mapped to the look-alike letters of the word's own script; the mapped values are
grouped in SQL under the accent-sensitive Unicode collation, which takes values as equal that differ only in
composition or in characters without weight (zero-width, directional and other format characters). Each class takes
the least of its members' composed and cleaned forms as its canonical one, and the form is joined back to the values.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselens.llm.unicode import plain_form

#: A value without any of these is printable ASCII with single inner spaces: its own plain form.
SUSPECT = r"[^\x20-\x7E]|^ | $|  "


@F.pandas_udf(T.StructType([T.StructField("mapped", T.StringType()), T.StructField("form", T.StringType())]))
def _mapped(values: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"mapped": [plain_form(v, composed=False) for v in values], "form": [plain_form(v) for v in values]})


def classes(values: DataFrame, column: str) -> DataFrame:
    """``(value, mapped, plain)`` for every distinct non-null value of ``column``: what its letters look like, and the
    canonical member of the class of values that are equal under the collation."""
    spark = values.sparkSession
    distinct = values.select(F.col(column).alias("value")).where(F.col("value").isNotNull()).distinct()
    odd = F.col("value").rlike(SUSPECT)
    # Python sees only the values that can change; the others are their own form
    mapped = distinct.where(odd).withColumn("m", _mapped("value")).select("value", "m.mapped", "m.form").unionByName(
        distinct.where(~odd).select("value", F.col("value").alias("mapped"), F.col("value").alias("form"))
    )
    return spark.sql(
        """
        WITH m AS (SELECT value, mapped, form, collate(mapped, 'UNICODE') AS k FROM {mapped}),
        classes AS (SELECT k, min(form) AS plain FROM m GROUP BY k)
        SELECT m.value, m.mapped, classes.plain FROM m JOIN classes ON m.k = classes.k
        """,
        mapped=mapped,
    )


def canonical_values(values: DataFrame, column: str) -> DataFrame:
    """``(value, plain)`` for every distinct non-null value of ``column``.

    Null values give no row; an empty or invisible value has the empty string as its form. Repeated rows count once;
    other columns are ignored, whatever their names.
    """
    return classes(values, column).select("value", "plain")


def plain_rows(rows: DataFrame, key: str, column: str) -> DataFrame:
    """``(row_key, value, plain)``, one row per distinct key and value of ``rows``; null values are left out."""
    picked = rows.select(F.col(key).cast("string").alias("row_key"), F.col(column).alias("value")).where(F.col("value").isNotNull()).distinct()
    return picked.join(canonical_values(picked, "value"), "value").select("row_key", "value", "plain")

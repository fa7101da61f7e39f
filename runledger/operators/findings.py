"""Findings: a sentence about a result, and the row that proves it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.hashing import hashable
from ..functions.text import row_json


def top_finding(df: DataFrame, label: str, metric: str, unit: str, evidence: bool = False) -> DataFrame:
    """One row ``(title, detail, label, metric, unit, rows)`` about a whole result, in one pass.

    If every row has a label, a number and the same unit, it names the row with the largest
    metric (of equal ones the smallest label); otherwise it says nothing about the values. With
    ``evidence`` that row follows as JSON; rows that tie in label and metric go by a hash of all columns.
    """
    proof = [F.lit(None).cast("string").alias("evidence")] if evidence else []
    rows = F.count("*").alias("rows")
    neutral_title = F.when(F.col("rows") == 0, "The result has no rows").otherwise("The result is ready")
    neutral_detail = F.when(F.col("rows") == 0, "Check filters and source coverage.").otherwise(
        F.format_string("%,d rows; look at the data before drawing conclusions.", "rows")
    )
    columns_there = {label, metric, unit} <= set(df.columns)
    if not columns_there or not isinstance(df.schema[metric].dataType, T.NumericType):
        return df.agg(rows).select(
            neutral_title.alias("title"),
            neutral_detail.alias("detail"),
            F.lit(None).cast("string").alias("label"),
            F.lit(None).cast("string").alias("metric"),
            F.lit(None).cast("string").alias("unit"),
            "rows",
            *proof,
        )
    value = F.col(metric)
    if isinstance(df.schema[metric].dataType, T.IntegralType):
        value = value.cast("decimal(38,0)")
    # The smallest (-metric, label) is the largest metric with the smallest label.
    order = [(-value).alias("negated"), F.col(label).alias("label"), F.col(metric).alias("value")]
    held = []
    if evidence:
        code = F.xxhash64(*[hashable(f) for f in df.schema])
        held = [F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(*order, code)).alias("row")]
    totals = df.agg(
        rows,
        F.count_if(F.col(label).isNotNull() & F.col(metric).isNotNull() & F.col(unit).isNotNull()).alias("whole"),
        F.min(unit).alias("unit"),
        F.max(unit).alias("last_unit"),
        F.min(F.struct(*order)).alias("best"),
        *held,
    )
    telling = (F.col("rows") > 0) & (F.col("whole") == F.col("rows")) & (F.col("unit") == F.col("last_unit"))
    words = metric.replace("_", " ")
    title = F.format_string(f"%s has the highest {words}", F.col("best.label").cast("string"))
    detail = F.format_string(
        "%s %s, the maximum of all %,d rows.",
        F.col("unit").cast("string"),
        F.format_number(F.col("best.value"), 2),
        "rows",
    )
    return totals.select(
        F.when(telling, title).otherwise(neutral_title).alias("title"),
        F.when(telling, detail).otherwise(neutral_detail).alias("detail"),
        F.when(telling, F.col("best.label").cast("string")).alias("label"),
        F.when(telling, F.col("best.value").cast("string")).alias("metric"),
        F.when(telling, F.col("unit").cast("string")).alias("unit"),
        "rows",
        *([F.when(telling, row_json(df.schema, within="row")).alias("evidence")] if evidence else []),
    )


def evidence_row(df: DataFrame, key: dict) -> DataFrame:
    """The rows with the given key values; a null value finds null."""
    for column, value in key.items():
        df = df.where(F.col(column).eqNullSafe(F.lit(value)))
    return df

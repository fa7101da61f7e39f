"""Mergeable summaries of columns: approximate distinct counts and quantiles without the rows.

A version's sketches are stored beside it, one row a column, as binary states. Merging the states of
several versions gives what one pass over all their rows would give, and reads no row of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.hashing import hashable

#: log2 of the registers of a distinct sketch, and size of a quantile sketch.
DISTINCT_BITS = 12
QUANTILE_SIZE = 400
#: Three standard errors of a distinct count, and the error of a rank that 99 of 100 answers keep.
DISTINCT_ERROR = 3 * 1.04 / 2 ** (DISTINCT_BITS / 2)
RANK_ERROR = 0.01
SKETCH_FIELDS = "column string, rows bigint, missing bigint, distinct_state binary, quantile_state binary, least double, greatest double"


def _countable(field: T.StructField) -> Column:
    """A value that the distinct sketch takes: a long or a text."""
    value, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, T.IntegralType):
        return value.cast("long")
    if isinstance(kind, T.StringType):
        return value
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.when(value.isNotNull(), hashable(field))
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        # Both zeros are one value.
        return (value.cast("double") + F.lit(0.0)).cast("string")
    return F.hex(value) if isinstance(kind, T.BinaryType) else value.cast("string")


def _measure(field: T.StructField) -> Column | None:
    """A column's place on an axis, if it has one."""
    value, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value.cast("double"))
    if isinstance(kind, T.NumericType):
        return value.cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value) / F.lit(1e6)
    return None


def column_sketches(df: DataFrame) -> DataFrame:
    """One row a column, in one pass: rows, nulls, and the states of its sketches.

    Numbers, dates (days) and timestamps (seconds) have a quantile state; NaN and infinite numbers are
    left out of it. A column without values has null states.
    """
    parts, cells = [F.count("*").alias("rows")], []
    for i, field in enumerate(df.schema):
        measure = _measure(field)
        parts += [F.count_if(F.col(f"`{field.name}`").isNull()).alias(f"m{i}"), F.hll_sketch_agg(_countable(field), DISTINCT_BITS).alias(f"d{i}")]
        numbers = [F.lit(None).cast("binary"), F.lit(None).cast("double"), F.lit(None).cast("double")]
        if measure is not None:
            parts += [F.kll_sketch_agg_double(measure, QUANTILE_SIZE).alias(f"q{i}"), F.min(measure).alias(f"l{i}"), F.max(measure).alias(f"g{i}")]
            numbers = [F.when(F.col(f"l{i}").isNotNull(), F.col(f"q{i}")), F.col(f"l{i}"), F.col(f"g{i}")]
        held = F.when(F.col(f"m{i}") < F.col("rows"), F.col(f"d{i}"))
        names = ("column", "rows", "missing", "distinct_state", "quantile_state", "least", "greatest")
        values = (F.lit(field.name), F.col("rows"), F.col(f"m{i}"), held, *numbers)
        cells.append(F.struct(*[v.alias(n) for v, n in zip(values, names)]))
    return df.agg(*parts).select(F.inline(F.array(*cells)))


def merged_sketches(states: DataFrame, by: Sequence[str] = ("column",)) -> DataFrame:
    """The sketches of the union of all rows that went into ``states``, for each group of them."""
    return states.groupBy(*by).agg(
        F.sum("rows").alias("rows"),
        F.sum("missing").alias("missing"),
        F.hll_union_agg("distinct_state").alias("distinct_state"),
        F.when(F.count("quantile_state") > 0, F.kll_merge_agg_double("quantile_state")).alias("quantile_state"),
        F.min("least").alias("least"),
        F.max("greatest").alias("greatest"),
    )


def sketch_answers(states: DataFrame, shares: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``states`` read out: ``distinct`` within ``DISTINCT_ERROR`` of the count, and for each share a
    value whose rank differs from it by ``RANK_ERROR`` of the values at most."""
    asked = F.array(*[F.lit(float(s)) for s in shares])
    values = F.when(F.col("quantile_state").isNotNull(), F.kll_sketch_get_quantile_double("quantile_state", asked))
    known = F.when(F.col("distinct_state").isNotNull(), F.hll_sketch_estimate("distinct_state"))
    rest = [c for c in states.columns if c not in ("distinct_state", "quantile_state")]
    return states.select(*rest, F.coalesce(known, F.lit(0)).cast("long").alias("distinct"), values.alias("quantiles"))

"""Data-quality checks: each gives the rows that violate it.

Row rules are also available as predicates, so that many rules over one table can be
counted in a single pass with ``count_violations``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import scratch_path
from ..sources.tables import materialize


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows ``(keys…, copies)``; counted before the shuffle, so a hot key stays small."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies"))


def unique_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that do not occur exactly once."""
    return key_counts(df, keys).where("copies <> 1")


def duplicate_rows(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Keys, or whole rows, that occur more than once."""
    return key_counts(df, keys or df.columns).where("copies > 1")


def not_accepted(column: str, values: Sequence, required: Sequence[str] = ()) -> Column:
    """True where a value is not one of ``values`` (null is not) or a required column is null."""
    accepted = F.coalesce(F.col(column).isin(list(values)), F.lit(False))
    return ~accepted | any_null(required) if required else ~accepted


def any_null(columns: Sequence[str]) -> Column:
    """True where at least one of the columns is null."""
    bad = F.col(columns[0]).isNull()
    for column in columns[1:]:
        bad = bad | F.col(column).isNull()
    return bad


def out_of_range(column: str, minimum=None, maximum=None, strict: bool = False) -> Column:
    """True where a value is null or outside its bounds; ``strict`` excludes the bounds."""
    value = F.col(column)
    bad = value.isNull()
    if minimum is not None:
        bad = bad | (value <= minimum if strict else value < minimum)
    if maximum is not None:
        bad = bad | (value >= maximum if strict else value > maximum)
    return bad


def accepted_values(
    df: DataFrame, column: str, values: Sequence, required: Sequence[str] = ()
) -> DataFrame:
    """Rows with a value that is not accepted, or without a required value."""
    return df.where(not_accepted(column, values, required))


def not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows where one of the columns is null."""
    return df.where(any_null(columns))


def value_range(df: DataFrame, column: str, minimum=None, maximum=None, strict=False) -> DataFrame:
    """Rows with a null or out-of-range value."""
    return df.where(out_of_range(column, minimum, maximum, strict))


def missing_lookup(df: DataFrame, column: str) -> DataFrame:
    """Rows that found no match in an earlier left join."""
    return df.where(F.col(column).isNull())


def defaulted_category(df: DataFrame, column: str, default: str) -> DataFrame:
    """Rows that fell to the default category."""
    return df.where(F.col(column) == default)


def grain(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """One row ``(actual, expected)`` if the one-row counts ``(n)`` differ, else none."""
    left = actual.select(F.col("n").alias("actual"), F.lit(1).alias("_one"))
    right = expected.select(F.col("n").alias("expected"), F.lit(1).alias("_one"))
    return left.join(right, "_one").where("actual <> expected").select("actual", "expected")


def join_grain(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Would a left join change the number of rows? Counts per key decide; no pair is built."""
    keys = list(on)
    lefts = left.groupBy(*keys).agg(F.count("*").alias("_left"))
    rights = right.na.drop(subset=keys).groupBy(*keys).agg(F.count("*").alias("_right"))
    pairs = F.col("_left") * F.coalesce("_right", F.lit(1))
    totals = lefts.join(rights, keys, "left").agg(
        F.coalesce(F.sum(pairs), F.lit(0)).alias("actual"),
        F.coalesce(F.sum("_left"), F.lit(0)).alias("expected"),
    )
    return totals.where("actual <> expected")


def _reduced(reference: DataFrame) -> DataFrame:
    """The reference with one row per key, written, as one side of a join.

    Reducing it first keeps a key that is frequent there from weighing on one task. Reading it
    back gives the join two plain shuffles, which Spark can split where ``df`` has a hot key,
    and a known size, by which it decides whether to broadcast.
    """
    return materialize(reference, scratch_path(reference.sparkSession, "reference"))


def orphans(df: DataFrame, reference: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key, null included, has no match in the reference."""
    keys = _reduced(reference.select(*on).distinct())
    return df.join(keys, list(on), "left_anti").select(df.columns)


def late_rows(
    df: DataFrame, reference: DataFrame, on: Sequence[str], event: str, start: str, days: int
) -> DataFrame:
    """Rows dated more than ``days`` after the first date of their key in the reference.

    The reference has one row per key then, so rows are never multiplied.
    """
    starts = _reduced(reference.groupBy(*on).agg(F.min(F.col(start).cast("date")).alias("_start")))
    late = F.col(event).cast("date") > F.date_add(F.col("_start"), days)
    return df.join(starts, list(on)).where(late).select(df.columns)


def count_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows ``(check, violations)``: all row rules of one table in one pass."""
    counts = [F.count_if(rule).alias(f"n{i}") for i, rule in enumerate(rules.values())]
    cells = [
        F.struct(F.lit(name).alias("check"), F.col(f"n{i}").alias("violations"))
        for i, name in enumerate(rules)
    ]
    return df.agg(*counts).select(F.inline(F.array(*cells)))

"""Comparison of two runs: inputs, definitions and outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Digits of the decimals that a comparison works with, where all values fit.
DIGITS = 37
#: A numeric text: digits before the point, behind it, and an exponent.
_NUMBER = r"^\s*[+-]?0*([0-9]*)[.]?([0-9]*?)0*(?:[eE]([+-]?[0-9]+))?[dDfF]?\s*$"


class ComparisonError(ValueError):
    """Two outputs that cannot be compared row by row."""


def changed_rows(before: DataFrame, after: DataFrame, on: list[str]) -> DataFrame:
    """Full outer join of two keyed tables with the same columns, keeping rows that differ.

    Keys must be unique per side. Columns come back as ``before_…`` and ``after_…``.
    """
    facts = [c for c in before.columns if c not in on]
    a = before.select(*on, F.lit(True).alias("_a"), *[F.col(c).alias(f"before_{c}") for c in facts])
    b = after.select(*on, F.lit(True).alias("_b"), *[F.col(c).alias(f"after_{c}") for c in facts])
    same = F.col("_a").eqNullSafe(F.col("_b"))
    for c in facts:
        same = same & F.col(f"before_{c}").eqNullSafe(F.col(f"after_{c}"))
    return a.join(b, on, "full").where(~same).drop("_a", "_b")


def input_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Sources bound to different versions.

    Both sides hold ``(source, version_id, digest, schema_json)``, one row per bound input.
    """
    facts = ["version_id", "digest", "schema_json"]
    a = before.select("source", *[F.col(c).alias(f"before_{c}") for c in facts])
    b = after.select("source", *[F.col(c).alias(f"after_{c}") for c in facts])
    return (
        a.join(b, "source", "full")
        .where("before_version_id is distinct from after_version_id")
        .select(
            "source",
            "before_version_id",
            "after_version_id",
            F.expr("before_digest is distinct from after_digest").alias("content_changed"),
            F.expr("before_schema_json is distinct from after_schema_json").alias("schema_changed"),
        )
        .orderBy("source")
    )


def pipeline_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Parts of a definition, ``(kind, name, value)``, that were added, removed or changed."""
    change = (
        F.when(F.col("before_value").isNull(), "added")
        .when(F.col("after_value").isNull(), "removed")
        .otherwise("changed")
    )
    return (
        changed_rows(before.select("kind", "name", "value"), after.select("kind", "name", "value"), ["kind", "name"])
        .withColumn("change", change)
        .orderBy("kind", "name")
    )


def _is_number(df: DataFrame, metric: str) -> Column:
    """Whether the metric is a number: present, finite, and if it is text, one that reads as such."""
    value, kind = df[metric], df.schema[metric].dataType
    if isinstance(kind, (T.IntegralType, T.DecimalType)):
        return value.isNotNull()
    read = value if isinstance(kind, T.FractionalType) else value.cast("string").try_cast("double")
    return F.coalesce(~F.isnan(read) & (F.abs(read) < float("inf")), F.lit(False))


def _digits(df: DataFrame, metric: str) -> tuple[Column, Column]:
    """Digits before and behind the point that a number needs to be kept as it is; null for none."""
    value, kind = df[metric], df.schema[metric].dataType
    if isinstance(kind, T.IntegralType):
        return F.when(value.isNotNull(), F.length(F.abs(value.cast("decimal(38,0)")).cast("string"))), F.lit(0)
    if isinstance(kind, T.DecimalType):
        whole = F.length(F.abs(F.floor(F.abs(value))).cast("string"))
        return F.when(value.isNotNull(), whole), F.lit(kind.scale)
    text = value.cast("string")
    part = [F.regexp_extract(text, _NUMBER, k) for k in (1, 2, 3)]
    power = F.coalesce(part[2].try_cast("int"), F.lit(0))
    # Without digits before the point an exponent only fills zeros behind it first.
    before = F.greatest(F.length(part[0]) + power, F.lit(1))
    behind = F.greatest(F.length(part[1]) - power, F.lit(0))
    good = _is_number(df, metric)
    return F.when(good, before), F.when(good, behind)


def _number(df: DataFrame, metric: str, kind: str) -> Column:
    """The metric in the type of the comparison."""
    value = df[metric]
    if isinstance(df.schema[metric].dataType, T.StringType):
        value = F.regexp_replace(F.trim(value), "[dDfF]$", "")
    if isinstance(df.schema[metric].dataType, (T.FloatType, T.DoubleType)) and kind != "double":
        value = value.cast("string")
    return value.try_cast(kind)


def _require(before: DataFrame, after: DataFrame, key: str, metric: str) -> None:
    for df in (before, after):
        if key not in df.columns or metric not in df.columns:
            raise ComparisonError("Both outputs need the key and the metric among their columns")
    texts = [isinstance(df.schema[key].dataType, T.StringType) for df in (before, after)]
    if texts[0] != texts[1]:
        raise ComparisonError("The key is text on one side and not on the other")


def key_guard(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once on a side: ``(side, key, copies)``."""
    sides = before.select(F.lit("before").alias("side"), F.col(key).alias("key")).union(
        after.select(F.lit("after").alias("side"), F.col(key).alias("key"))
    )
    return sides.groupBy("side", "key").agg(F.count("*").alias("copies")).where("copies > 1")


def _per_key(before: DataFrame, after: DataFrame, key: str, unit: str, metric: str | None = None) -> DataFrame:
    """Copies and unit of every key and side, metrics that are no numbers, and digits that the others need, as one aggregate.

    Aggregated per key, not joined, so that repeated keys cannot multiply.
    """
    sides = []
    for side, df in (("before", before), ("after", after)):
        value = F.col(unit).cast("string") if unit in df.columns else F.lit(None).cast("string")
        good = _is_number(df, metric) if metric else F.lit(True)
        whole, places = _digits(df, metric) if metric else (F.lit(0), F.lit(0))
        sides.append(
            df.select(
                F.lit(side).alias("side"), F.col(key).alias("key"), value.alias("unit"),
                (~good).alias("bad"), whole.alias("whole"), places.alias("places"),
            )
        )
    is_before, is_after = F.col("side") == "before", F.col("side") == "after"
    return sides[0].union(sides[1]).groupBy("key").agg(
        F.count_if(is_before).alias("before_copies"),
        F.count_if(is_after).alias("after_copies"),
        F.max(F.when(is_before, F.col("unit"))).alias("before_unit"),
        F.max(F.when(is_after, F.col("unit"))).alias("after_unit"),
        F.count_if("bad").alias("bad"),
        F.max("whole").alias("whole"),
        F.max("places").alias("places"),
    )


MIXED_UNITS = "before_copies > 0 AND after_copies > 0 AND before_unit IS DISTINCT FROM after_unit"


def unit_guard(before: DataFrame, after: DataFrame, key: str, unit: str = "currency") -> DataFrame:
    """Keys on both sides whose units differ: ``(key, before_unit, after_unit)``."""
    mixed = _per_key(before, after, key, unit).where(MIXED_UNITS)
    return mixed.select("key", "before_unit", "after_unit")


def numeric_guard(before: DataFrame, after: DataFrame, key: str, metric: str) -> DataFrame:
    """Rows whose metric is null or not a number: ``(side, key, value)``."""
    parts = []
    for side, df in (("before", before), ("after", after)):
        bad = df.where(~_is_number(df, metric))
        parts.append(
            bad.select(
                F.lit(side).alias("side"), F.col(key).alias("key"), F.col(metric).cast("string").alias("value")
            )
        )
    return parts[0].union(parts[1])


def guard_outputs(before: DataFrame, after: DataFrame, key: str, metric: str, unit: str) -> str:
    """The type to compare in; an error unless keys are unique, units agree and metrics are numbers.

    One pass over key, unit and metric, with one row as its answer. The type is a decimal that holds
    every value of both sides and their difference as they are, or double where none does.
    """
    _require(before, after, key, metric)
    found = (
        _per_key(before, after, key, unit, metric)
        .agg(
            F.count_if(F.expr("before_copies > 1 OR after_copies > 1")).alias("repeated"),
            F.count_if(F.expr(MIXED_UNITS)).alias("mixed"),
            F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"),
            F.coalesce(F.max("whole"), F.lit(1)).alias("whole"),
            F.coalesce(F.max("places"), F.lit(0)).alias("places"),
        )
        .first()
    )
    if found["repeated"]:
        raise ComparisonError("A key occurs twice on one side: bring the output to one row for each key")
    if found["mixed"]:
        raise ComparisonError(f"Outputs with different {unit} cannot be compared")
    if found["bad"]:
        raise ComparisonError("Some values of the metric are not numbers")
    fits = found["whole"] + found["places"] <= DIGITS
    return f"decimal({DIGITS},{found['places']})" if fits else "double"


def compare_outputs(
    before: DataFrame,
    after: DataFrame,
    key: str,
    metric: str,
    unit: str = "currency",
) -> DataFrame:
    """Rows ``(key, before, after, delta, before_row, after_row)``, one per key of either side.

    An absent side counts as 0; a null key is a key. Numbers are exact decimals with as many places
    as the values have, found when the outputs are checked. Where the values of both sides together
    need more than 37 digits, all are doubles, each the nearest to its value or difference.
    """
    kind = guard_outputs(before, after, key, metric, unit)
    a = before.select(
        F.col(key).alias("_ka"), _number(before, metric, kind).alias("_a"), F.struct("*").alias("before_row")
    )
    b = after.select(
        F.col(key).alias("_kb"), _number(after, metric, kind).alias("_b"), F.struct("*").alias("after_row")
    )
    zero = F.lit(0).cast(kind)
    old = F.when(F.col("before_row").isNull(), zero).otherwise(F.col("_a"))
    new = F.when(F.col("after_row").isNull(), zero).otherwise(F.col("_b"))
    return a.join(b, F.col("_ka").eqNullSafe(F.col("_kb")), "full").select(
        F.coalesce("_ka", "_kb").alias("key"),
        old.alias("before"),
        new.alias("after"),
        (new - old).alias("delta"),
        "before_row",
        "after_row",
    )


def by_key_text(compared: DataFrame) -> DataFrame:
    """The comparison in the order of its keys as text."""
    return compared.orderBy(F.col("key").cast("string"))

"""Column profiles, samples and bounded previews."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.hashing import EXACT_JSON, hashable, plain
from ..functions.text import bounded, row_json
from ..session import small_frame

SAMPLE_ROWS = 20  # served at most
KEPT_ROWS = 30  # kept with a profile
LONG_TEXT = 64  # bytes; the length of a SHA-256 text
PROFILE_FIELDS = (
    "position: int, column: string, type: string, nullable: boolean, rows: bigint, missing: bigint, "
    "nans: bigint, distinct: bigint, min: string, max: string, mean: double"
)


_JSON_OPTIONS = ", ".join(f'"{k}", "{v}"' for k, v in EXACT_JSON.items())


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _comparable(field: T.StructField) -> tuple[str, str]:
    """A type to count values in, and an expression that keeps different values different."""
    value, kind = _quoted(field.name), field.dataType
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return "bigint", f"cast({value} as bigint)"
    if isinstance(kind, T.DateType):
        return "bigint", f"cast(unix_date({value}) as bigint)"
    if isinstance(kind, T.TimestampType):
        return "bigint", f"unix_micros({value})"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "double", f"cast({value} as double)"
    if isinstance(kind, T.BinaryType):
        text = f"hex({value})"
    elif isinstance(kind, (T.StructType, T.ArrayType)):
        text = f"to_json({value}, map({_JSON_OPTIONS}))"
    else:
        text = f"cast({value} as string)"
    # A long text is counted by its SHA-256, longer by its mark than any text counted as it is.
    if isinstance(kind, (T.StringType, T.BinaryType, T.StructType, T.ArrayType)):
        text = f"if(octet_length({text}) > {LONG_TEXT}, concat('#', sha2({text}, 256)), {text})"
    return "string", text


def value_counts(df: DataFrame) -> DataFrame:
    """Rows ``(position, rows, missing, distinct)``, exact, for all columns.

    Columns of one kind are turned to (position, value) in one scan, counted per value, then
    per column. Both aggregates combine before they shuffle, so neither a frequent value nor
    a long column ends up whole in one task.
    """
    # Maps in the order of their keys, at every depth.
    nested = {f.name: plain(F.col(_quoted(f.name)), f.dataType) for f in df.schema if isinstance(f.dataType, (T.MapType, T.StructType, T.ArrayType))}
    df = df.select([nested.get(c, F.col(_quoted(c))).alias(c) for c in df.columns])
    kinds: dict[str, list[str]] = {}
    for i, field in enumerate(df.schema):
        kind, value = _comparable(field)
        kinds.setdefault(kind, []).append(f"{i}, {value}")
    counted = []
    for cells in kinds.values():
        long = df.selectExpr(f"stack({len(cells)}, {', '.join(cells)}) AS (position, value)")
        per_value = long.groupBy("position", "value").agg(F.count("*").alias("n"))
        counted.append(
            per_value.groupBy("position").agg(
                F.sum("n").alias("rows"),
                F.expr("coalesce(sum(n) FILTER (WHERE value IS NULL), 0)").alias("missing"),
                F.count("value").alias("distinct"),
            )
        )
    return functools.reduce(DataFrame.unionAll, counted)


def numeric_stats(df: DataFrame) -> DataFrame:
    """Rows ``(position, nans, min, max, mean)`` in one pass without a shuffle of rows.

    Only true numbers have ``min``, ``max`` and ``mean``; NaN is counted, not averaged.
    """
    aggregates, cells = ["count(*) AS n"], []
    for i, field in enumerate(df.schema):
        value = _quoted(field.name)
        if not isinstance(field.dataType, T.NumericType):
            cells.append(f"{i}, 0L, cast(null as string), cast(null as string), cast(null as double)")
            continue
        nans = "0L"
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            aggregates.append(f"count_if(isnan({value})) AS nans{i}")
            nans, value = f"nans{i}", f"CASE WHEN NOT isnan({value}) THEN {value} END"
        aggregates += [f"{f}({value}) AS {f}{i}" for f in ("min", "max", "avg")]
        cells.append(f"{i}, {nans}, cast(min{i} as string), cast(max{i} as string), cast(avg{i} as double)")
    rows = f"stack({len(cells)}, {', '.join(cells)}) AS (position, nans, min, max, mean)"
    return df.selectExpr(*aggregates).selectExpr(rows)


def profile(df: DataFrame) -> DataFrame:
    """One row per column: type, rows, missing, exact non-null distinct, numeric min/max/mean."""
    names = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema)]
    columns = small_frame(df.sparkSession, names, "position int, column string, type string, nullable boolean")
    none = ["coalesce(rows, 0L) AS rows", "coalesce(missing, 0L) AS missing", "nans", "coalesce(`distinct`, 0L) AS `distinct`"]
    return (
        columns.join(numeric_stats(df), "position")
        .join(value_counts(df), "position", "left")
        .selectExpr("position", "column", "type", "nullable", *none, "min", "max", "mean")
    )


def sample_rows(df: DataFrame, order_key: str | list[str], n: int = 10) -> DataFrame:
    """The first 1 to 20 rows in the order of a key."""
    if not 1 <= n <= SAMPLE_ROWS:
        raise ValueError(f"n must be between 1 and {SAMPLE_ROWS}")
    keys = [order_key] if isinstance(order_key, str) else list(order_key)
    return df.orderBy(*keys).limit(n)


def kept_rows(df: DataFrame) -> list[str]:
    """30 rows of a written table as previewed JSON texts, to keep with its profile.

    The first in the order of a hash of their values, so that the same rows give the same sample. Only
    these are turned to JSON.
    """
    code = F.xxhash64(*[hashable(f) for f in df.schema])
    first = df.select(F.struct("*").alias("row"), code.alias("code")).orderBy("code").limit(KEPT_ROWS).select("row.*")
    return sorted(r["row"] for r in json_rows(first).collect())


def preview(df: DataFrame) -> DataFrame:
    """Every row, with long texts and long lists cut at every depth."""
    return df.select([bounded(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def json_rows(df: DataFrame) -> DataFrame:
    """Previewed rows as JSON texts that keep every decimal digit."""
    return df.select(row_json(df.schema, preview=True).alias("row"))

"""Joins by time ranges, as equi-joins on time buckets.

The axis is cut into buckets as wide as the range asked for. Each row of ``left`` lies in one
bucket; each row of ``right`` is repeated for the buckets from which it can be reached, two at most.
So no pair is found twice, and since keys and buckets join as plain equalities, Spark may split a
hot one.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

_MICROS = 1_000_000


def _axis(df: DataFrame, column: str) -> Column:
    """A date, timestamp or integer as a number: days, microseconds, or itself."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(column))
    if isinstance(kind, T.TimestampNTZType):
        # Read in one fixed zone, in which no hour is missing or repeated.
        return F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(column)).cast("timestamp"))
    if isinstance(kind, T.IntegralType):
        return F.col(column).cast("long")
    raise ValueError(f"{column} is neither a time nor an integer")


def span(df: DataFrame, column: str, days: int = 0, seconds: int = 0) -> int:
    """A length of time in the unit of a column of times."""
    if isinstance(df.schema[column].dataType, T.DateType):
        if seconds % 86_400:
            raise ValueError("Dates differ by whole days")
        return days + seconds // 86_400
    return (days * 86_400 + seconds) * _MICROS


def _bucket(value: Column, width: int) -> Column:
    """The number of the bucket of a value, also of a negative one."""
    return F.call_function("div", value - F.pmod(value, F.lit(width)), F.lit(width))


def _keyed(df: DataFrame, on: Sequence[str], name: str, **more: Column) -> DataFrame:
    return df.select(*[F.col(c).alias(f"_{name}{i}") for i, c in enumerate(on)], *[c.alias(n) for n, c in more.items()], F.struct("*").alias(name))


def _condition(on: Sequence[str], extra: Column) -> Column:
    return functools.reduce(Column.__and__, [F.col(f"_left{i}") == F.col(f"_right{i}") for i in range(len(on))], extra)


def range_join(left: DataFrame, right: DataFrame, on: Sequence[str], time: tuple[str, str], before: int, after: int, how: str = "inner") -> DataFrame:
    """Pairs with equal keys where right's time lies in ``[left - before, left + after]``.

    ``before`` and ``after`` are in the unit of the times (see ``span``); one may be negative. Pairs
    are structs ``left`` and ``right``. With ``how`` = ``left`` a row without a partner comes once, with a
    null ``right``; ``left_semi`` and ``left_anti`` give rows of ``left``. Null keys or times have no
    partner. Without keys the buckets alone are joined on.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"Not a way to join: {how!r}")
    width = before + after + 1
    if width < 1:
        raise ValueError("The range ends before it begins")
    a = _keyed(left, on, "left", _at=_axis(left, time[0]))
    a = a.withColumn("_bucket", _bucket(F.col("_at"), width))
    b = _keyed(right, on, "right", _there=_axis(right, time[1]))
    reach = F.sequence(_bucket(F.col("_there") - after, width), _bucket(F.col("_there") + before, width))
    b = b.where("_there IS NOT NULL").withColumn("_reached", F.explode(reach))
    near = F.col("_there").between(F.col("_at") - before, F.col("_at") + after)
    joined = a.join(b, _condition(on, (F.col("_bucket") == F.col("_reached")) & near), how)
    return joined.select("left.*") if how in ("left_semi", "left_anti") else joined.select("left", "right")


def overlap_join(left: DataFrame, right: DataFrame, on: Sequence[str], ranges: tuple[tuple[str, str], tuple[str, str]], width: int) -> DataFrame:
    """Pairs ``left``, ``right`` with equal keys whose ranges (first, last), both included, share a point.

    Both sides are repeated for each bucket of ``width`` that a range touches, so choose it about as
    wide as most ranges are; a pair counts in the bucket where the later of the two begins. A range
    with a null end, or one that ends before it begins, has no partner.
    """
    sides = []
    for name, df, (first, last) in (("left", left, ranges[0]), ("right", right, ranges[1])):
        own = _keyed(df, on, name, **{f"_{name}_a": _axis(df, first), f"_{name}_b": _axis(df, last)})
        own = own.where(f"_{name}_a <= _{name}_b")
        touched = F.sequence(_bucket(F.col(f"_{name}_a"), width), _bucket(F.col(f"_{name}_b"), width))
        sides.append(own.withColumn(f"_{name}_bucket", F.explode(touched)))
    shared = F.expr("_left_a <= _right_b AND _right_a <= _left_b")
    counted = F.col("_left_bucket") == _bucket(F.greatest("_left_a", "_right_a"), width)
    joined = sides[0].join(sides[1], _condition(on, (F.col("_left_bucket") == F.col("_right_bucket")) & shared & counted))
    return joined.select("left", "right")


def top_matches(left: DataFrame, right: DataFrame, on: Sequence[str], order: Sequence[Column], k: int, into: str = "match", rank: str = "rank") -> DataFrame:
    """Each row of ``left`` with the first ``k`` rows of ``right`` of its keys: a lateral join with a limit.

    Only ``k`` rows a key leave a task, whatever a key has. One row a match, a struct of the columns of
    ``right``, and its rank from 1; a row of ``left`` without a match comes once with nulls. Rows that tie
    in ``order`` are taken by their other columns, so that the result is the same in every run.
    """
    rest = [F.col(f"`{f.name}`") for f in right.schema if not isinstance(f.dataType, T.MapType)]
    best = Window.partitionBy(*on).orderBy(*order, *rest)
    known = right.where(functools.reduce(Column.__and__, [right[c].isNotNull() for c in on]))
    # A rank that is filtered by a constant is also cut before the shuffle.
    kept = known.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= k)
    b = kept.select(*[F.col(c).alias(f"_right{i}") for i, c in enumerate(on)], F.col("_rank").alias(rank), F.struct(*[F.col(f"`{c}`") for c in right.columns]).alias(into))
    a = _keyed(left, on, "left")
    return a.join(b, _condition(on, F.lit(True)), "left").select("left.*", rank, into)

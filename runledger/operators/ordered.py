"""Operators along an order within keys: as-of join, running totals, exact percentiles.

All three write their rows once in ranges of (key, order), so that a hot key spans many ranges and
none of them is larger than another by much. Each range is worked on alone, as a window within
(range, key); what a range must know of the earlier ranges of its key is one row a range and key.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import scratch_path
from ..sources.tables import materialize

RANGE = "_range"


def ranged(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` written in ranges of an order, numbered by ``_range``.

    Rows that tie in the whole order may lie on both sides of a border: a random number cuts them.
    """
    spread = df.withColumn("_spread", F.rand(7))
    cut = spread.repartitionByRange(*order, "_spread").drop("_spread").withColumn(RANGE, F.spark_partition_id())
    return materialize(cut, scratch_path(df.sparkSession, "ranged"))


def _same(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> Column:
    return functools.reduce(Column.__and__, [a[c].eqNullSafe(b[c]) for c in columns])


def _before(parts: DataFrame, keys: Sequence[str]):
    """Window over the earlier ranges of a key. ``parts`` holds one row a range and key."""
    return Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)


def as_of_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    time: tuple[str, str],
    *,
    ties: Sequence[str] | None = None,
    strict: bool = False,
    within: Column | None = None,
    into: str = "match",
) -> DataFrame:
    """Each row of ``left`` with the newest row of ``right`` that has its keys and is not later.

    ``time`` names the time of either side, of one type. The match is a struct of the columns of
    ``right`` in ``into``, null where there is none. Of several with one time the greatest by
    ``ties`` counts, by default by all columns. ``strict`` asks for an earlier time, ``within`` for
    one no longer ago than an interval. Null keys and times match nothing; every row of ``left``,
    repeated ones too, comes back once.
    """
    if into in left.columns:
        raise ValueError(f"{into} is a column of the left side")
    keys = [f"_k{i}" for i in range(len(on))]
    own, other = time
    known = right.where(functools.reduce(Column.__and__, [right[c].isNotNull() for c in (*on, other)]))
    row = F.struct(*[F.col(f"`{c}`") for c in right.columns])
    best = F.struct(*[F.col(f"`{c}`") for c in (ties or right.columns)])
    steps = known.groupBy(*[F.col(c).alias(k) for c, k in zip(on, keys)], F.col(other).alias("_t")).agg(F.max_by(row, best).alias("_right"))
    # Of equal times what is known comes first, unless it must be earlier.
    steps = steps.select(*keys, "_t", F.lit(1 if strict else 0).alias("_side"), F.lit(None).cast(left.schema).alias("_left"), "_right")
    asked = left.select(
        *[F.col(c).alias(k) for c, k in zip(on, keys)],
        F.col(own).alias("_t"),
        F.lit(0 if strict else 1).alias("_side"),
        F.struct("*").alias("_left"),
        F.lit(None).cast(steps.schema["_right"].dataType).alias("_right"),
    )
    rows = ranged(steps.unionByName(asked), [*keys, "_t", "_side"])
    here = Window.partitionBy(RANGE, *keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumn("_found", F.last("_right", ignorenulls=True).over(here)).where("_left IS NOT NULL")
    # The last known row of each range and key, handed on to the later ranges of that key.
    ends = rows.groupBy(RANGE, *keys).agg(F.max_by("_right", F.when(F.col("_right").isNotNull(), F.col("_t"))).alias("_end"))
    carried = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(_before(ends, keys))).where("_carried IS NOT NULL")
    joined = filled.join(carried.drop("_end"), [RANGE, *keys], "left")
    match = F.coalesce("_found", "_carried")
    good = F.col("_t").isNotNull()
    if within is not None:
        good = good & (match[other] + within >= F.col("_t"))
    return joined.select("_left.*", F.when(good, match).alias(into))


def running_totals(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, into: str = "running") -> DataFrame:
    """``df`` with the sum of ``value`` up to each row in the order within its keys.

    Nulls add nothing; null keys are a key. Sums are exact for integers and decimals. ``order``
    should tell all rows of a key apart: rows that tie in it come in any order, each with a total
    of its own, the last of them the same in every run.
    """
    rows = ranged(df, [*by, *order])
    here = Window.partitionBy(RANGE, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_local", F.sum(value).over(here))
    parts = rows.groupBy(RANGE, *by).agg(F.sum(value).alias("_part"))
    earlier = parts.select(RANGE, *by, F.sum("_part").over(_before(parts, by)).alias("_earlier")).where("_earlier IS NOT NULL")
    total = F.when(F.col("_local").isNull(), earlier["_earlier"]).otherwise(F.col("_local") + F.coalesce(earlier["_earlier"], F.lit(0)))
    joined = local.join(earlier, _same(local, earlier, [RANGE, *by]), "left")
    return joined.select(*[local[c] for c in df.columns], total.cast(local.schema["_local"].dataType).alias(into))


def _one_type(df: DataFrame, columns: Sequence[str]) -> str:
    """A type that holds the values of all columns."""
    kinds = [df.schema[c].dataType for c in columns]
    if any(isinstance(k, (T.FloatType, T.DoubleType)) for k in kinds):
        return "double"
    if any(isinstance(k, T.DecimalType) for k in kinds):
        return f"decimal(38,{max(k.scale for k in kinds if isinstance(k, T.DecimalType))})"
    return "bigint" if all(isinstance(k, T.IntegralType) for k in kinds) else kinds[0].simpleString()


def exact_percentiles(df: DataFrame, by: Sequence[str], columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """Rows ``(*by, column, share, n, value)``: the least value that this share of a group does not exceed.

    ``n`` counts the values. Nulls do not count; a group without values gives no row. Values are
    counted before they move, ranges of (group, value) are counted, and only the ranges that hold a
    value asked for are looked into. NaN is the greatest number. ``columns`` are brought to one type.
    """
    kind = _one_type(df, columns)
    cells = ", ".join(f"'{c}', cast(`{c}` AS {kind})" for c in columns)
    long = df.select(*by, F.expr(f"stack({len(columns)}, {cells}) AS (column, value)")).where("value IS NOT NULL")
    group = [*by, "column"]
    counted = long.groupBy(*group, "value").agg(F.count("*").alias("_n"))
    rows = ranged(counted, [*group, "value"])
    parts = rows.groupBy(RANGE, *group).agg(F.sum("_n").alias("_size"))
    whole = Window.partitionBy(*group)
    parts = parts.withColumn("_start", F.coalesce(F.sum("_size").over(_before(parts, group)), F.lit(0))).withColumn("n", F.sum("_size").over(whole))
    wanted = F.explode(F.array(*[F.lit(str(s)).cast("decimal(20,18)") for s in shares])).alias("share")
    asked = parts.select("*", wanted).withColumn("_rank", F.greatest(F.ceil(F.col("share") * F.col("n")), F.lit(1)) - F.col("_start"))
    asked = asked.where("_rank BETWEEN 1 AND _size").drop("_size", "_start")
    hit = asked.select(RANGE, *group).distinct()
    inside = rows.join(hit, _same(rows, hit, [RANGE, *group]), "left_semi")
    upto = Window.partitionBy(RANGE, *group).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_upto", F.sum("_n").over(upto))
    found = inside.join(asked, _same(inside, asked, [RANGE, *group]) & F.expr("_rank > _upto - _n AND _rank <= _upto"))
    return found.select(*[inside[c] for c in group], F.col("share").cast("double").alias("share"), "n", "value")

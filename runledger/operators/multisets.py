"""Outputs without a key: multiset difference, and totals over grouping sets."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.hashing import hashable
from ..functions.text import row_json
from ..session import scratch_path
from ..sources.tables import materialize


def multiset_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that one side has more often: ``(side, copies, row)``, the row as JSON.

    ``copies`` is how often it is missing on the other side, as in EXCEPT ALL both ways. Nulls are
    equal, nested values and maps are compared by their contents. Both sides need the same columns,
    in any order. What moves is two 64-bit hashes a row, counted before the shuffle; only rows that
    differ are read again.
    """
    if dict(before.dtypes) != dict(after.dtypes):
        raise ValueError("The sides differ in their columns; compare their schemas first")
    after = after.select(before.columns)
    # The union's types: a column may be null on one side only.
    either = before.unionByName(after).schema
    values = [hashable(f) for f in before.schema]
    nulls = [F.col(f"`{f.name}`").isNull() for f in either]
    codes = [F.xxhash64(F.lit(salt), *values, *nulls).alias(f"_h{salt}") for salt in (0, 1)]
    sides = [df.select(*codes, F.lit(step).cast("long").alias("_n")) for df, step in ((before, 1), (after, -1))]
    counted = sides[0].union(sides[1]).groupBy("_h0", "_h1").agg(F.sum("_n").alias("_n")).where("_n <> 0")
    counted = materialize(counted, scratch_path(before.sparkSession, "differing"))
    shown = []
    for name, df, more in (("before", before, "_n > 0"), ("after", after, "_n < 0")):
        wanted = counted.where(more)
        rows = df.select(*codes, row_json(df.schema).alias("row")).join(wanted, ["_h0", "_h1"], "left_semi")
        one = rows.groupBy("_h0", "_h1").agg(F.min("row").alias("row"))
        shown.append(one.join(wanted, ["_h0", "_h1"]).select(F.lit(name).alias("side"), F.abs("_n").alias("copies"), "row"))
    return shown[0].unionAll(shown[1])


def grouping_totals(df: DataFrame, by: Sequence[str], sets: Sequence[Sequence[str]], sums: Sequence[str] = (), distinct: str | None = None) -> DataFrame:
    """Rows, sums and exact distinct values for several sets of groups at once.

    Columns: ``by``, of which those outside a row's set are null; ``grouping``, in which the bit of such a
    column is set, the last of ``by`` being the lowest, so that subtotals differ from nulls; ``rows``;
    ``sum_…`` of each of ``sums``; ``distinct_…``, without nulls. Rows are brought to one a (group, value)
    first, and only these are repeated for each set, so no set counts the table's values anew.
    """
    unknown = {c for s in sets for c in s} - set(by)
    if unknown:
        raise ValueError(f"Not among the columns of the groups: {sorted(unknown)}")
    value = [F.col(distinct).alias("_value")] if distinct else []
    adds = [F.count("*").alias("rows"), *[F.sum(c).alias(f"sum_{c}") for c in sums]]
    fine = df.select(*by, *value, *[F.col(c) for c in sums if c not in by]).groupBy(*by, *(["_value"] if distinct else [])).agg(*adds)
    # Bits and kept columns of every set, as an array that each fine row is multiplied with.
    every = []
    for chosen in dict.fromkeys(tuple(c for c in by if c in s) for s in sets):
        bits = sum(1 << (len(by) - 1 - i) for i, c in enumerate(by) if c not in chosen)
        kept = [(F.col(c) if c in chosen else F.lit(None).cast(df.schema[c].dataType)).alias(c) for c in by]
        every.append(F.struct(F.lit(bits).cast("long").alias("grouping"), *kept))
    totals = ["rows", *[f"sum_{c}" for c in sums]]
    spread = fine.select(F.explode(F.array(*every)).alias("_g"), *(["_value"] if distinct else []), *totals).select("_g.*", *(["_value"] if distinct else []), *totals)
    again = [F.sum(t).alias(t) for t in totals]
    if not distinct:
        return spread.groupBy("grouping", *by).agg(*again)
    per_value = spread.groupBy("grouping", *by, "_value").agg(*again)
    return per_value.groupBy("grouping", *by).agg(*again, F.count("_value").alias(f"distinct_{distinct}"))


def all_subsets(by: Sequence[str]) -> list[tuple[str, ...]]:
    """The sets of a cube, the whole first."""
    return functools.reduce(lambda sets, c: [s + (c,) for s in sets] + sets, by, [()])


def prefixes(by: Sequence[str]) -> list[tuple[str, ...]]:
    """The sets of a rollup, the whole first."""
    return [tuple(by[:n]) for n in range(len(by), -1, -1)]



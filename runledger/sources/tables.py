"""Written tables: materialised results, append-only metadata, pages and exports."""

from __future__ import annotations

import functools

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

from ..functions.hashing import hashable
from ..session import small_frame

PAGE_LIMIT = 100
ROWS_PER_RANGE = 100_000
#: Borders that cut a table at once, and rows of the sample that they come from.
BORDERS, BORDER_SAMPLE = 32, 2_000


def materialize(df: DataFrame, path: str, session: SparkSession | None = None) -> DataFrame:
    """Write once, then read back: cuts the lineage and survives lost executors."""
    untyped = {f.name for f in df.schema if isinstance(f.dataType, T.NullType)}
    if untyped:
        df = df.select(
            [F.col(f"`{c}`").cast("string").alias(c) if c in untyped else f"`{c}`" for c in df.columns]
        )
    df.write.mode("errorifexists").parquet(path)
    return (session or df.sparkSession).read.schema(df.schema).parquet(path)


def append_rows(spark: SparkSession, rows: DataFrame | list, schema: str, folder: str) -> None:
    """Append metadata rows to a folder that belongs to one writer, such as one run.

    Writers that could meet, such as two that register versions, each use a new folder.
    """
    if isinstance(rows, list):
        rows = small_frame(spark, rows, schema)
    rows.write.mode("append").parquet(folder)


def read_rows(spark: SparkSession, schema: str, table: str, part: str = "") -> DataFrame:
    """Rows of a metadata table, or of one part such as ``run_id=…``; none if there is no such folder.

    ``schema`` ends with the columns that the folder names hold.
    """
    reader = spark.read.schema(schema).option("basePath", table)
    try:
        return reader.parquet(f"{table}/{part}" if part else table)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return small_frame(spark, [], schema)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _beyond(keys: list[str], bound: Row, df: DataFrame) -> Column:
    """Whether a row comes after a key."""
    value = F.struct(*[F.lit(bound[k]).cast(df.schema[k].dataType).alias(k) for k in keys])
    return F.struct(*keys) > value


def _borders(df: DataFrame, keys: list[str], rows: int) -> list[Row]:
    """Some keys of a sample that cut the rows in about equal parts."""
    sample = df.select(*keys).sample(min(1.0, BORDER_SAMPLE / rows), seed=5).orderBy(*keys).limit(2 * BORDER_SAMPLE).collect()
    step = max(1, len(sample) // BORDERS)
    return list(dict.fromkeys(sample[step::step]))


def page(df: DataFrame, order_key: str | list[str], offset: int = 0, limit: int = 50) -> DataFrame:
    """Rows ``offset`` .. ``offset + limit`` in the order of a key; rows with one key go by a hash of all columns.

    Nothing is written. While more than ``ROWS_PER_RANGE`` rows are in question, borders from a small
    sample cut them in ranges, whose rows are counted in one pass, and only the ranges that overlap the
    page stay; so only these are sorted, at any depth.
    """
    if offset < 0:
        raise ValueError("offset must be at least 0")
    if not 1 <= limit <= PAGE_LIMIT:
        raise ValueError(f"limit must be between 1 and {PAGE_LIMIT}")
    keys = [order_key] if isinstance(order_key, str) else list(order_key)
    code = "_code"
    within = df.withColumn(code, F.xxhash64(*[hashable(f) for f in df.schema]))
    order, rows = [*keys, code], within.count()
    while rows > ROWS_PER_RANGE:
        borders = _borders(within, order, rows)
        part = functools.reduce(Column.__add__, [_beyond(order, b, within).cast("int") for b in borders], F.lit(0))
        sizes = dict(within.groupBy(part.alias("part")).count().collect())  # one row a range
        start, hit = 0, []
        for number in sorted(sizes):
            if start < offset + limit and start + sizes[number] > offset:
                hit.append((number, start))
            start += sizes[number]
        left = sum(sizes[n] for n, _ in hit)
        if not hit or left == rows:
            break  # beyond the end, or rows that are all the same
        first, last = hit[0][0], hit[-1][0]
        if first:
            within = within.where(_beyond(order, borders[first - 1], within))
        if last < len(borders):
            within = within.where(~_beyond(order, borders[last], within))
        offset, rows = offset - hit[0][1], left
    return within.orderBy(*order).offset(offset).limit(limit).drop(code)


def export(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Write a table for others, as Parquet or as CSV with a header."""
    if format == "parquet":
        df.write.mode("errorifexists").parquet(path)
    elif format == "csv":
        df.write.mode("errorifexists").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    else:
        raise ValueError(f"The format is csv or parquet, not {format!r}")

"""Content hashes that do not depend on row order or partitioning.

Each row is hashed on its own and the hashes are summed, so that every task sends one row
to the final aggregate however large the table is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

EXACT = "decimal(38,0)"
#: Nested values as JSON that keeps nulls and every microsecond, whatever the session's time zone.
EXACT_JSON = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "timeZone": "UTC",
}


def plain(value: Column, data_type: T.DataType) -> Column:
    """The value with the entries of every map in the order of their keys."""
    if isinstance(data_type, T.MapType):
        entries = F.transform(
            F.map_entries(value),
            lambda e: F.struct(
                plain(e["key"], data_type.keyType).alias("key"), plain(e["value"], data_type.valueType).alias("value")
            ),
        )
        return F.array_sort(entries)
    if isinstance(data_type, T.ArrayType):
        return F.transform(value, lambda item: plain(item, data_type.elementType))
    if isinstance(data_type, T.StructType):
        fields = [plain(value.getField(f.name), f.dataType).alias(f.name) for f in data_type]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def hashable(field: T.StructField) -> Column:
    """Nested values as JSON, in which boundaries and nulls stay apart; others as they are."""
    value = F.col(f"`{field.name}`")
    if not isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
        return value
    return F.to_json(F.struct(plain(value, field.dataType).alias("v")), EXACT_JSON)


def row_states(df: DataFrame) -> DataFrame:
    """One row ``(rows, first, second)``: what a fingerprint is made of. It adds up over parts of a table.

    Two independent 64-bit hashes are taken of every row. Nulls take part through flags of
    their own because the row hash skips them.
    """
    values = [hashable(f) for f in df.schema]
    nulls = [F.col(f"`{f.name}`").isNull() for f in df.schema if f.nullable]
    halves = [F.xxhash64(F.lit(salt), *values, *nulls).cast(EXACT) for salt in (0, 1)]
    sums = [F.coalesce(F.sum(half), F.lit(0).cast(EXACT)) for half in halves]
    return df.agg(F.count("*").alias("rows"), sums[0].alias("first"), sums[1].alias("second"))


def digest_of(schema: T.StructType) -> Column:
    """The fingerprint of a table of this schema, of columns ``rows``, ``first`` and ``second``."""
    text = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in schema)
    return F.sha2(F.concat_ws("|", F.lit(text), "rows", "first", "second"), 256)


def fingerprint(df: DataFrame) -> DataFrame:
    """One row ``(rows, fingerprint)``: equal for tables with the same schema and rows."""
    return row_states(df).select("rows", digest_of(df.schema).alias("fingerprint"))


def md5_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row ``(rows, hash_sum)`` that any SQL engine with ``md5`` can repeat.

    For integer and string columns, whose text is the same everywhere. Each value is led by
    its length, and a null is a dash, so that no two rows read the same.
    """
    texts = [F.col(c).cast("string") for c in columns]
    row = F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])
    part = F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast(EXACT)
    return df.agg(F.count("*").alias("rows"), F.sum(part).cast("string").alias("hash_sum"))

"""Schema contracts and schema comparison, on columns as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import small_frame

COLUMN_PATTERN = "[A-Za-z_][A-Za-z0-9_]{0,99}"
COLUMN_SCHEMA = "source string, position int, column string, type string, nullable boolean"


def column_rows(spark: SparkSession, tables: dict[str, DataFrame | T.StructType]) -> DataFrame:
    """The columns of several tables as rows ``(source, position, column, type, nullable)``."""
    rows = []
    for source, table in tables.items():
        schema = table if isinstance(table, T.StructType) else table.schema
        rows += [
            (source, i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(schema)
        ]
    return small_frame(spark, rows, COLUMN_SCHEMA)


def bad_columns(columns: DataFrame) -> DataFrame:
    """Columns that are no identifiers or not unique ignoring case, with the problem."""
    names = columns.groupBy("source", F.lower("column").alias("_name")).agg(
        F.count("*").alias("_copies"), F.min("column").alias("column")
    )
    problem = F.when(~F.col("column").rlike(f"^{COLUMN_PATTERN}$"), "not an identifier").when(
        F.col("_copies") > 1, "not unique"
    )
    return names.select("source", "column", problem.alias("problem")).where("problem is not null")


def contract_rows(spark: SparkSession, contracts: dict[str, dict[str, str]]) -> DataFrame:
    """Contracts ``{source: {column: type}}`` as rows ``(source, column, expected)``."""
    rows = [(s, c, t) for s, columns in contracts.items() for c, t in columns.items()]
    return small_frame(spark, rows, "source string, column string, expected string")


def check_contract(contract: DataFrame, columns: DataFrame) -> DataFrame:
    """Required columns that are absent or of another type; extra columns are allowed."""
    actual = columns.select("source", "column", F.col("type").alias("actual"))
    return (
        contract.join(actual, ["source", "column"], "left")
        .where("actual is distinct from expected")
        .select("source", "column", "expected", "actual")
        .orderBy("source", "column")
    )


def capture_contract(tables: dict[str, DataFrame | T.StructType]) -> dict[str, dict[str, str]]:
    """The contract that the given tables fulfil."""
    return {
        source: {
            f.name: f.dataType.simpleString()
            for f in (table if isinstance(table, T.StructType) else table.schema)
        }
        for source, table in tables.items()
    }


def schema_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Columns that were added, removed, retyped, moved or changed nullability."""
    facts = ["position", "type", "nullable"]
    a = before.select("source", "column", *[F.col(c).alias(f"before_{c}") for c in facts])
    b = after.select("source", "column", *[F.col(c).alias(f"after_{c}") for c in facts])
    change = (
        F.when(F.col("before_type").isNull(), "added")
        .when(F.col("after_type").isNull(), "removed")
        .when(F.col("before_type") != F.col("after_type"), "retyped")
        .when(F.col("before_position") != F.col("after_position"), "moved")
        .when(F.col("before_nullable") != F.col("after_nullable"), "nullability")
    )
    both = a.join(b, ["source", "column"], "full")
    return both.withColumn("change", change).where("change is not null").orderBy("source", "column")

"""Sources: delimited text with a header, and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

SUFFIXES = ("csv", "parquet")


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    *,
    schema: T.StructType | str | None = None,
    sep: str = ",",
    multi_line: bool = False,
) -> DataFrame:
    """Delimited text with a header line; types are inferred from every row.

    Whole numbers are always ``bigint``. A row of the wrong shape is an error, never dropped, and so
    is a file whose header differs from the schema or from the other files. Pass ``schema`` to save
    the inference pass. Quoted line breaks need ``multi_line`` (a file is then read by one task);
    without it a text scan refuses them.
    """
    if not multi_line:
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        if not spark.read.text(path).where(quotes % 2 == 1).isEmpty():
            raise ValueError(f"Quoted text in {path} holds line breaks: read it with multi_line=True")
    reader = (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("mode", "FAILFAST")
        .option("enforceSchema", False)
    )
    if schema is not None:
        return reader.schema(schema).csv(path)
    df = reader.option("inferSchema", True).option("samplingRatio", 1.0).csv(path)
    if not df.columns:
        raise ValueError(f"No data in {path}")
    narrow = (T.ByteType, T.ShortType, T.IntegerType)
    return df.select(
        [
            F.col(f"`{f.name}`").cast("bigint").alias(f.name)
            if isinstance(f.dataType, narrow)
            else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Parquet; the schema comes from the file."""
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


def suffix_of(path: str) -> str:
    """``csv`` or ``parquet``, from a file name or a folder named like one."""
    suffix = path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()
    if suffix not in SUFFIXES:
        raise ValueError(f"Neither a .csv nor a .parquet name: {path}")
    return suffix


def read_source(spark: SparkSession, path: str, **csv_options) -> DataFrame:
    """Read by the suffix of the path."""
    if suffix_of(path) == "csv":
        return read_csv(spark, path, **csv_options)
    return read_parquet(spark, path)

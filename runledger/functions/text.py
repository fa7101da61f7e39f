"""Column functions on text and nested values: bounded previews, redaction, row JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F, types as T

from .hashing import EXACT_JSON

# The bounds of a preview and the shape of a provider secret.
PREVIEW_CHARS = 2000
PREVIEW_ITEMS = 50
TRUNCATION_MARKER = "… [preview truncated]"
REDACTED = "[redacted]"
SECRET_PATTERN = "sk-[A-Za-z0-9_-]+"


def bounded(value: Column, data_type: T.DataType) -> Column:
    """Cut long strings and long lists, at every depth of a nested value."""
    if isinstance(data_type, T.StringType):
        cut = F.concat(F.substring(value, 1, PREVIEW_CHARS), F.lit(TRUNCATION_MARKER))
        return F.when(F.length(value) > PREVIEW_CHARS, cut).otherwise(value)
    if isinstance(data_type, T.ArrayType):
        head = F.slice(value, 1, PREVIEW_ITEMS)
        return F.transform(head, lambda item: bounded(item, data_type.elementType))
    if isinstance(data_type, T.StructType):
        fields = [bounded(value.getField(f.name), f.dataType).alias(f.name) for f in data_type]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(data_type, T.MapType):
        head = F.slice(F.map_entries(value), 1, PREVIEW_ITEMS)
        return F.map_from_entries(
            F.transform(head, lambda e: F.struct(e["key"].alias("key"), bounded(e["value"], data_type.valueType).alias("value")))
        )
    return value


def lossless(value: Column, data_type: T.DataType) -> Column:
    """Decimals as strings at every depth, so that a JSON reader cannot round them."""
    if isinstance(data_type, T.DecimalType):
        return value.cast("string")
    if isinstance(data_type, T.ArrayType):
        return F.transform(value, lambda item: lossless(item, data_type.elementType))
    if isinstance(data_type, T.StructType):
        fields = [lossless(value.getField(f.name), f.dataType).alias(f.name) for f in data_type]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(data_type, T.MapType):
        return F.transform_values(value, lambda _, item: lossless(item, data_type.valueType))
    return value


def row_json(schema: T.StructType, preview: bool = False, within: str | None = None) -> Column:
    """The whole row, or a struct of this schema, as one JSON object, optionally bounded like a preview."""
    values = []
    for field in schema:
        value = F.col(within)[field.name] if within else F.col(f"`{field.name}`")
        if preview:
            value = bounded(value, field.dataType)
        values.append(lossless(value, field.dataType).alias(field.name))
    return F.to_json(F.struct(*values), EXACT_JSON)


def redact(
    text: Column | str,
    *,
    patterns: Sequence[str] = (SECRET_PATTERN,),
    secrets: Sequence[str] = (),
    limit: int | None = None,
) -> Column:
    """Replace known secret values, however short, and every match of ``patterns``.

    Texts stay whole unless a ``limit`` is given, for messages; it cuts what is already redacted.
    """
    value = F.col(text) if isinstance(text, str) else text
    for secret in sorted(filter(None, secrets), key=len, reverse=True):
        value = F.replace(value, F.lit(secret), F.lit(REDACTED))
    for pattern in patterns:
        value = F.regexp_replace(value, pattern, REDACTED)
    return value if limit is None else F.substring(value, 1, limit)

"""Exact duplicates by content-defined chunk recipes, in DataFrame functions only.

Method: a text is cut where its own bytes say so, each chunk gets an identifier, and the ordered
list of identifiers is the text's recipe. Texts are equal when their recipes are.

* **Cuts** follow ``LEAST - 3`` bytes or more, after the first three bytes that belong to three
  classes (residues modulo 8), or after ``MOST`` bytes. So they depend on bytes near them only,
  and equal passages of different texts fall into equal chunks once the first cut has been found.
* **Identifiers** are the first 128 bits of a SHA-256 of salt and chunk. They are verified: every
  distinct chunk is brought together with the others of its identifier, and if two differ the
  whole is done again with another salt. No result rests on a digest being free of collisions.
* **Movement**: that verification moves the texts, once, as chunks, and only one copy of a chunk
  from each task: common chunks are merged before the shuffle. All else moves recipes, which hold
  32 characters a chunk. Groups are counted before their shuffle, and looked up by a join of plain
  shuffles whose hot partitions Spark splits, so a group of a third of all rows is no hot spot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch

LEAST = 256
MOST = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ID_CHARS = 32


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, nothing else changed; null as the empty text."""
    return F.coalesce(F.translate(text, UPPER, LOWER), F.lit(""))


def _class(residue: int) -> str:
    return "[" + "".join(f"\\x{b:02x}" for b in range(residue, 256, 8)) + "]"


def chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The chunks of a text in order, as strings of one character a byte; none of the empty text."""
    data = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    cut = f"(?s).{{{least - 3},{most - 3}}}?{_class(5)}{_class(0)}{_class(4)}|.{{1,{most}}}"
    return F.regexp_extract_all(data, F.lit(cut), F.lit(0))


def identifier(chunk: Column, salt: str) -> Column:
    return F.left(F.sha2(F.concat(F.lit(salt), chunk), 256), F.lit(_ID_CHARS))


def _verified(texts: DataFrame, named: Callable[[Column], Column]) -> bool:
    """Whether no two different chunks of all texts have one identifier."""
    each = texts.select(F.explode(chunks(F.col("text"))).alias("chunk")).select(named(F.col("chunk")).alias("id"), "chunk")
    unclear = each.groupBy("id").agg(F.count_distinct("chunk").alias("n")).where("n > 1")
    return not unclear.limit(1).count()


def recipes(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text_sha256, recipe)`` of each row, by verified identifiers."""
    texts = docs.select(F.col(id_col).alias("id"), lower_ascii(F.col(text_col)).alias("text"))
    attempt = 0
    while not _verified(texts, lambda c: identifier(c, f"{attempt}:")):
        attempt += 1
    listed = F.transform(chunks(F.col("text")), lambda c: identifier(c, f"{attempt}:"))
    found = texts.select("id", F.sha2("text", 256).alias("text_sha256"), F.array_join(listed, "").alias("recipe"))
    return scratch.keep(found, "recipes")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, keep_id, group_size, kept, text_sha256)`` for each row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; a null is the empty text, and empty
    texts are equal. Of equal texts the row with the largest id stays. A null id stays only where
    no row of its group has an id. Rows that repeat both id and text cannot be told apart: each
    counts in ``group_size``, and each stays or goes like the others. Texts may be of any length.
    No rows give no rows; other columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "recipes")
    rows = recipes(docs, scratch, id_col, text_col)
    # Written, so that the join below has two plain shuffles, of which Spark splits a hot partition.
    groups = rows.groupBy("recipe").agg(F.max("id").alias("keep"), F.count("*").alias("size")).where("size > 1")
    groups = scratch.keep(groups, "groups")
    found = rows.join(groups, "recipe", "left")
    keep = F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep"))
    return found.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns; rows that repeat an id must repeat its text."""
    gone = exact_duplicates(docs, id_col, text_col).where("not kept and keep_id is not null").select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(gone["__gone"]), "left_anti")

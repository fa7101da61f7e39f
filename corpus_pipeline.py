"""A corpus pipeline over ``documents``: each stage reads what the one before kept.

``STAGES`` lists (name, function); each function takes (spark, docs, folder of the tables) and
returns a frame. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from runledger.llm import disclosure, language, leakage, piece_sampling, shingle_join
from runledger.llm.common import Scratch, table, without
from runledger.llm.queries import importable

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
LEAST_SURE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keep documents whose language is recognised: a letter in the text, and no close second.

    The model learns from the labelled rows that are not held out. Labels are not changed.
    """
    importable(spark)
    rows = docs.select(F.col("doc_id"), "text", "lang")
    model = language.train(rows.where(~language.held_out(F.col("doc_id"))), Scratch(spark, "language"))
    found = language.predict(docs, model, keep=tuple(c for c in docs.columns if c not in ("doc_id", "text")) + ("text",))
    sure = (F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_SURE)
    return found.where(sure).select(docs.columns)


def shingle_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keep one document of each group of near copies: the one with the smallest id.

    Five words a shingle, similarity 0.8 or more. Documents without words are all kept.
    """
    importable(spark)
    groups = shingle_join.jaccard_components(docs, 5, (4, 5))
    others = Scratch(spark, "copies").keep(groups.where("doc_id <> component_id").select("doc_id").distinct(), "others")
    return without(docs, others, "doc_id")


def decontaminate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop documents that hold an item of ``benchmark``."""
    importable(spark)
    leaks = leakage.find_leaks(docs, table(spark, folder, "benchmark"))
    return without(docs, Scratch(spark, "leaked").keep(leaks.select("doc_id").distinct(), "leaked"), "doc_id")


def personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Replace personal data, and words that give it away; ``n_chars`` follows the new text."""
    importable(spark)
    clean = disclosure.sanitise(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return clean.select(docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Sampled SentencePiece pieces of each text; decoding gives the text back."""
    importable(spark)
    return piece_sampling.encode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("shingle_dedup", shingle_dedup),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("pieces", pieces),
]

#: No SQL can express naive Bayes scoring or sampled segmentations; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

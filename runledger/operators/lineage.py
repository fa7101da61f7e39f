"""What follows from what: transitive closure of a graph of any depth, cycles included."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import scratch_path
from ..sources.tables import discard, materialize


def reachable(edges: DataFrame, start: DataFrame | None = None, source: str = "source", target: str = "target") -> DataFrame:
    """Pairs ``(source, target, steps)``: all that can be reached, by how few edges.

    From the nodes of ``start`` (one column), or from all. A node on a cycle reaches itself. Semi-naive:
    a round joins only the pairs found in the last one with the edges, and keeps those that are new, so
    a cycle ends it; there is no limit of rounds. Each round's new pairs are written, which cuts the
    lineage. Both joins are by plain keys, of which Spark may split a hot one. Null ends lead nowhere.
    """
    spark = edges.sparkSession
    folder = scratch_path(spark, "reachable")
    known_edges = edges.select(F.col(source).alias("_from"), F.col(target).alias("_to")).where("_from IS NOT NULL AND _to IS NOT NULL").distinct()
    known_edges = materialize(known_edges, f"{folder}/edges")
    first = known_edges
    if start is not None:
        first = first.join(start.select(F.col(start.columns[0]).alias("_from")).distinct(), "_from", "left_semi")
    pairs = first.select(F.col("_from").alias("source"), F.col("_to").alias("target"), F.lit(1).alias("steps"))
    fresh = materialize(pairs, f"{folder}/pairs/round=1")
    steps = 1
    while not fresh.isEmpty():
        steps += 1
        known = spark.read.schema(pairs.schema).parquet(f"{folder}/pairs/*")
        reached = fresh.join(known_edges, F.col("target") == F.col("_from")).select("source", F.col("_to").alias("target")).distinct()
        new = reached.join(known.select("source", "target"), ["source", "target"], "left_anti").withColumn("steps", F.lit(steps))
        fresh = materialize(new, f"{folder}/pairs/round={steps}")
    discard(spark, f"{folder}/edges")
    return spark.read.schema(pairs.schema).parquet(f"{folder}/pairs/*")


def on_cycles(pairs: DataFrame) -> DataFrame:
    """``(node, group)`` of the nodes that reach themselves; ``group`` is the least node of their cycle."""
    back = pairs.select(F.col("source").alias("target"), F.col("target").alias("source"))
    both = pairs.join(back, ["source", "target"], "left_semi")
    return both.groupBy(F.col("source").alias("node")).agg(F.min("target").alias("group"))

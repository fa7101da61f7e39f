"""Run and step states derived from check results and state events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

CONTRACT_STEP = "__inputs__"


def run_status(steps: DataFrame, checks: DataFrame) -> DataFrame:
    """State of every step, ``(run_id, position, step, status, run_status)``.

    ``steps`` has ``(run_id, position, step)``; ``checks`` has ``(run_id, step, severity,
    status)``, where contract results carry the step ``__inputs__``. A step fails on a failed
    blocking check or on any check error; all later steps are skipped, and all steps if a
    contract failed. Results are reduced to one row per step before the window, whose
    partition is the step list of one run.
    """
    blocking = (F.col("status") == "error") | (
        (F.col("status") == "failed") & (F.col("severity") == "blocking")
    )
    failures = checks.groupBy("run_id", "step").agg(F.max(F.when(blocking, 1).otherwise(0)).alias("bad"))
    contract = failures.where(F.col("step") == CONTRACT_STEP).select(
        "run_id", F.lit(-1).cast("int").alias("position"), "step", "bad"
    )
    own = steps.select("run_id", F.col("position").cast("int").alias("position"), "step").join(
        failures, ["run_id", "step"], "left"
    )
    own = own.select("run_id", "position", "step", F.coalesce("bad", F.lit(0)).alias("bad"))
    in_order = Window.partitionBy("run_id").orderBy("position")
    earlier = F.max("bad").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    overall = F.max("bad").over(Window.partitionBy("run_id"))
    return (
        own.unionByName(contract)
        .withColumn("earlier", F.coalesce(earlier, F.lit(0)))
        .withColumn("run_status", F.when(overall == 1, "failed").otherwise("successful"))
        .where(F.col("step") != CONTRACT_STEP)
        .select(
            "run_id",
            "position",
            "step",
            F.when(F.col("earlier") == 1, "skipped")
            .when(F.col("bad") == 1, "failed")
            .otherwise("successful")
            .alias("status"),
            "run_status",
        )
    )


def current_states(events: DataFrame) -> DataFrame:
    """The last state of every run and step from its events ``(run_id, step, state, error, seq)``."""
    return events.groupBy("run_id", "step").agg(
        F.max_by("state", "seq").alias("status"),
        F.max_by("error", "seq").alias("error"),
        F.max("at").alias("at"),
    )

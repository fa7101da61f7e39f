"""Running one step: declared inputs only, parameters, checks."""

from __future__ import annotations

import contextlib
import functools
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.text import PREVIEW_CHARS, REDACTED, SECRET_PATTERN, row_json
from ..operators.checks import count_violations, grain, key_counts
from ..session import isolated_session, small_frame
from ..sources.tables import materialize
from .definition import Check, Frames, Step

SAMPLE_ROWS = 20
Written = tuple[str, T.StructType]  # the path and schema of a written table


def open_frames(spark: SparkSession, tables: dict[str, Written]) -> tuple[SparkSession, Frames]:
    """A fresh session in which the given written tables, and no other views, have names.

    Tables are read again through the new session from the files they were written to.
    """
    session = isolated_session(spark)
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    frames = {}
    for name, table in tables.items():
        add_frame(session, frames, name, table)
    return session, frames


def add_frame(session: SparkSession, frames: Frames, name: str, table: Written) -> None:
    path, schema = table
    frames[name] = session.read.schema(schema).parquet(path)
    frames[name].createOrReplaceTempView(name)


def run_query(session: SparkSession, sql: str, parameters: dict | None = None) -> DataFrame:
    """One query over the views of a session; anything but a query does not parse."""
    return session.sql(f"SELECT * FROM (\n{sql}\n)", args=parameters or {})


def sql_step(sql: str, inputs: Frames, parameters: dict | None = None) -> DataFrame:
    """One query over exactly the given tables, which must come from an isolated session.

    Names exist only while the query is analysed, so a query sees no table it does not declare.
    """
    session = next(iter(inputs.values())).sparkSession
    try:
        for name, frame in inputs.items():
            frame.createOrReplaceTempView(name)
        return run_query(session, sql, parameters)
    finally:
        for name in inputs:
            session.catalog.dropTempView(name)


def build_step(session: SparkSession, step: Step, frames: Frames, parameters: dict) -> DataFrame:
    if step.sql is not None:
        return run_query(session, step.sql, parameters)
    return step.build(frames)


def safe_error(error: BaseException) -> str:
    return re.sub(SECRET_PATTERN, REDACTED, str(error))[:PREVIEW_CHARS]


def reads_inputs_only(check: Check, step: str) -> bool:
    """Whether a check needs only tables that are there before the step, as its definition tells."""
    return check.table not in (None, step) and check.same_rows_as is None and (check.where is not None or bool(check.keys))


def count_fused(session: SparkSession, checks: dict[int, Check], parameters: dict) -> dict[int, int]:
    """Violations of all row checks of a table in one pass, of all key checks per key in one.

    Checks and counts go by position. One query for all, so that tables are scanned side by side.
    """
    groups: dict[tuple, list[int]] = {}
    for i, check in checks.items():
        groups.setdefault((check.table, check.keys), []).append(i)
    parts = []
    for (table, keys), group in groups.items():
        source = table
        if keys:
            source = f"(SELECT count(*) AS copies FROM {table} GROUP BY {', '.join(keys)})"
        conditions = {i: f"copies {checks[i].copies}" if keys else checks[i].where for i in group}
        columns = ", ".join(f"count_if({c}) AS n{i}" for i, c in conditions.items())
        cells = ", ".join(f"{i}, n{i}" for i in group)
        parts.append(f"SELECT stack({len(group)}, {cells}) AS (i, n) FROM (SELECT {columns} FROM {source})")
    if not parts:
        return {}
    rows = session.sql(" UNION ALL ".join(parts), args=parameters).collect()
    return {r["i"]: r["n"] for r in rows}


def run_checks(
    session: SparkSession,
    checks: tuple[Check, ...],
    frames: Frames,
    row_counts: dict[str, int],
    parameters: dict,
    quarantine: str,
) -> list[dict]:
    """Evaluate every check; keep all violating rows of those that fail, and 20 as a sample.

    Checks on one table are counted together. Only the failing ones, and those that are
    queries of their own, write rows. A check that cannot run is an ``error``.
    """
    fused = {i: c for i, c in enumerate(checks) if c.where is not None or c.keys}
    counted: dict[int, int] = {}
    try:
        counted = count_fused(session, fused, parameters)
    except Exception:
        # One of them cannot run: each table and key is counted by itself, so that the others need not write rows.
        for i, check in fused.items():
            with contextlib.suppress(Exception):  # which one it was shows below, with its error
                counted |= count_fused(session, {i: check}, parameters)
    results = []
    for i, check in enumerate(checks):
        result = {"name": check.name, "severity": check.severity, "text": check.text}
        result |= {"violations": None, "sample": [], "error": None, "quarantine": None}
        try:
            number = counted.get(i)
            if check.same_rows_as is not None:
                number = int(row_counts[check.table] != row_counts[check.same_rows_as])
            if number != 0:
                if check.sql is not None:
                    rows = run_query(session, check.sql, parameters)
                else:
                    rows = check.build(frames)
                path = f"{quarantine}/check={i}"
                rows = materialize(rows, path, session)
                if number is None:
                    number = rows.count()
                result["quarantine"] = path
                result["sample"] = sample_of(rows) if number else []
            result |= {"violations": number, "status": "failed" if number else "passed"}
        except Exception as error:
            result |= {"status": "error", "error": safe_error(error)}
        results.append(result)
    return results


def sample_of(rows: DataFrame) -> list[str]:
    """Up to 20 rows as JSON texts, the same ones every time."""
    texts = rows.select(row_json(rows.schema, preview=True).alias("row"))
    return [r["row"] for r in texts.orderBy("row").limit(SAMPLE_ROWS).collect()]


def check_summary(checks: dict[str, tuple[Check, ...]], frames: Frames) -> DataFrame:
    """Rows ``(step, check, severity, violations, status)`` for the checks of several steps.

    A lazy plan over frames that hold every table by name: row checks of a table share one
    scan, key checks of a table and key share one aggregate.
    """
    listed = [(step, c) for step, group in checks.items() for c in group]
    parts: list[DataFrame] = []
    rules: dict[tuple, dict[str, Column]] = {}
    for step, check in listed:
        label = f"{step}/{check.name}"
        if check.where is not None:
            rules.setdefault((check.table, ()), {})[label] = F.expr(check.where)
        elif check.keys:
            rules.setdefault((check.table, check.keys), {})[label] = F.expr(f"copies {check.copies}")
        else:
            if check.same_rows_as is not None:
                counts = [frames[t].agg(F.count("*").alias("n")) for t in (check.table, check.same_rows_as)]
                bad = grain(*counts)
            else:
                bad = check.build(frames) if check.build else sql_step(check.sql, frames)
            parts.append(bad.agg(F.lit(label).alias("check"), F.count("*").alias("violations")))
    for (table, keys), group in rules.items():
        source = key_counts(frames[table], keys) if keys else frames[table]
        parts.append(count_violations(source, group))
    counted = functools.reduce(DataFrame.unionAll, parts)
    names = small_frame(
        counted.sparkSession,
        [(f"{step}/{c.name}", step, c.name, c.severity) for step, c in listed],
        "label string, step string, name string, severity string",
    )
    status = F.when(F.col("violations") == 0, "passed").otherwise("failed")
    return names.join(counted, names["label"] == counted["check"]).select(
        "step", F.col("name").alias("check"), "severity", "violations", status.alias("status")
    )


def is_blocking(result: dict) -> bool:
    return result["status"] == "error" or (
        result["status"] == "failed" and result["severity"] == "blocking"
    )

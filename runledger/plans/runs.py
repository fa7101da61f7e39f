"""Runs: a pipeline over chosen source versions, every result kept."""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, functions as F, types as T

from ..functions.hashing import fingerprint
from ..functions.text import row_json
from ..operators.compare import by_key_text, compare_outputs, input_diff, pipeline_diff
from ..operators.contracts import check_contract, column_rows, contract_rows
from ..operators.findings import evidence_row, top_finding
from ..operators.profile import kept_rows, preview
from ..operators.status import CONTRACT_STEP, current_states
from ..sources.tables import append_rows, materialize, read_rows
from ..sources.versions import PROFILE_TYPE, Workspace, latest_versions, profile_rows, resolve_inputs
from .definition import Pipeline, Step
from .steps import add_frame, build_step, is_blocking, open_frames, reads_inputs_only, run_checks, run_query, safe_error

# Columns of the result tables; each run owns one folder ``run_id=…`` in every table.
FACTS = {
    "runs": (
        "pipeline string, definition string, output string, parameters string, settings string, "
        "created_at timestamp, workspace_id string"
    ),
    "inputs": (
        "source string, version_id string, digest string, path string, rows bigint, schema_json string"
    ),
    "definitions": "kind string, name string, position int, value string",
    "events": "step string, state string, error string, seq bigint, at timestamp",
    "checks": (
        "step string, position int, name string, severity string, status string, violations bigint, "
        "text string, sample array<string>, error string, quarantine string"
    ),
    "artifacts": (
        "step string, artifact_id string, path string, rows bigint, fingerprint string, "
        f"schema_json string, profile {PROFILE_TYPE}, sample array<string>"
    ),
    "findings": "step string, finding_id string, title string, detail string, evidence string",
}


class StepFailed(Exception):
    pass


def _append(ws: Workspace, run_id: str, table: str, rows: list[tuple]) -> None:
    append_rows(ws.spark, rows, FACTS[table], f"{ws.table(table)}/run_id={run_id}")


def run_table(ws: Workspace, table: str, run_id: str) -> DataFrame:
    """Rows of one result table, if the run belongs to this workspace."""

    def rows(name: str) -> DataFrame:
        schema = f"{FACTS[name]}, run_id string"
        return read_rows(ws.spark, schema, ws.table(name), f"run_id={run_id}")

    mine = rows("runs").where(F.col("workspace_id") == ws.workspace_id)
    if table == "runs":
        return mine
    return rows(table).join(mine.select("run_id"), "run_id", "left_semi")


class _Recorder:
    """Appends state events and check results of one run, in the order they happen."""

    def __init__(self, ws: Workspace, run_id: str):
        self.ws, self.run_id, self.seq = ws, run_id, 0
        self.waiting: list[tuple] = []

    def note(self, step: str | None, state: str, error: str | None = None) -> None:
        """An event that may be written together with the next one."""
        self.seq += 1
        self.waiting.append((step, state, error, self.seq, datetime.now(timezone.utc)))

    def event(self, step: str | None, state: str, error: str | None = None) -> None:
        self.note(step, state, error)
        _append(self.ws, self.run_id, "events", self.waiting)
        self.waiting = []

    def checks(self, step: str, results: list[dict]) -> None:
        columns = ["name", "severity", "status", "violations", "text", "sample", "error", "quarantine"]
        rows = [(step, i, *[r[c] for c in columns]) for i, r in enumerate(results)]
        if rows:
            _append(self.ws, self.run_id, "checks", rows)


def run_pipeline(
    ws: Workspace,
    pipeline: Pipeline,
    inputs: dict[str, str],
    parameters: dict | None = None,
    profile_artifacts: bool = True,
) -> str:
    """Run a pipeline over one version per source and return the id of the run.

    A wrong mapping or an unknown parameter raises; what fails later is recorded with the run.
    Contracts come first. A step's blocking checks of its inputs run before it is written; then it
    is fingerprinted and profiled, and its other checks run. The first step with a blocking failure
    ends the run.
    """
    unknown = set(parameters or {}) - set(pipeline.parameters)
    if unknown:
        raise ValueError(f"The pipeline declares no such values: {sorted(unknown)}")
    values = pipeline.parameters | (parameters or {})
    bound = resolve_inputs(ws, list(pipeline.sources), inputs)
    run_id = uuid.uuid4().hex
    _record_start(ws, pipeline, run_id, bound, values)
    record = _Recorder(ws, run_id)
    tables = {n: (r["path"], T.StructType.fromJson(json.loads(r["schema_json"]))) for n, r in bound.items()}
    counts = {n: r["rows"] for n, r in bound.items()}
    waiting = [s.name for s in pipeline.steps]
    for name in waiting:
        record.note(name, "queued")
    record.event(None, "running")
    current = None
    try:
        _check_contracts(ws, pipeline, tables, record)
        for step in pipeline.steps:
            current = waiting.pop(0)
            _run_step(ws, step, run_id, tables, counts, values, record, profile_artifacts)
        _store_finding(ws, pipeline, run_id, tables[pipeline.output])
    except Exception as error:
        message = safe_error(error)
        if current:
            record.note(current, "failed", message)
        for name in waiting:
            record.note(name, "skipped")
        record.event(None, "failed", message)
    else:
        record.event(None, "successful")
    return run_id


def _record_start(ws: Workspace, pipeline: Pipeline, run_id: str, bound: dict[str, Row], values: dict) -> None:
    settings = json.dumps({"spark": ws.spark.version})
    now = datetime.now(timezone.utc)
    definition = pipeline.digest()
    effective = json.dumps(values, sort_keys=True)
    run = (pipeline.name, definition, pipeline.output, effective, settings, now, ws.workspace_id)
    _append(ws, run_id, "runs", [run])
    facts = ["version_id", "digest", "path", "rows", "schema_json"]
    _append(ws, run_id, "inputs", [(n, *[r[f] for f in facts]) for n, r in bound.items()])
    _append(ws, run_id, "definitions", pipeline.rows())


def _check_contracts(ws: Workspace, pipeline: Pipeline, tables: dict, record: _Recorder) -> None:
    """All contracts in one query; each source gets a check result before any fails the run."""
    schemas = {name: schema for name, (_, schema) in tables.items()}
    wrong = check_contract(
        contract_rows(ws.spark, pipeline.sources), column_rows(ws.spark, schemas)
    ).collect()
    results = []
    for source in pipeline.sources:
        rows = [r.asDict() for r in wrong if r["source"] == source]
        results.append(
            {
                "name": f"Source contract: {source}",
                "severity": "blocking",
                "status": "failed" if rows else "passed",
                "violations": len(rows),
                "text": json.dumps(pipeline.sources[source], sort_keys=True),
                "sample": [json.dumps(r) for r in rows],
                "error": None,
                "quarantine": None,
            }
        )
    record.checks(CONTRACT_STEP, results)
    if wrong:
        texts = [f"{r['source']}.{r['column']}: expected {r['expected']}, found {r['actual']}" for r in wrong]
        raise StepFailed(f"Source contract failed: {'; '.join(texts)}")


def _run_step(
    ws: Workspace,
    step: Step,
    run_id: str,
    tables: dict,
    counts: dict[str, int],
    values: dict,
    record: _Recorder,
    profile_artifacts: bool,
) -> None:
    session, frames = open_frames(ws.spark, {n: tables[n] for n in step.depends_on})
    record.event(step.name, "running")
    quarantine = ws.data(f"run={run_id}", f"violations={step.name}")
    # What a step must not start with is checked before it writes anything: a repeated key could multiply its rows.
    early = {i: c for i, c in enumerate(step.checks) if reads_inputs_only(c, step.name) and c.severity == "blocking"}
    before = dict(zip(early, run_checks(session, tuple(early.values()), frames, counts, values, f"{quarantine}/inputs")))
    if any(is_blocking(r) for r in before.values()):
        record.checks(step.name, list(before.values()))
        _fail(step, list(before.values()))
    path = ws.data(f"run={run_id}", f"step={step.name}")
    table = materialize(build_step(session, step, frames, values), path)
    tables[step.name] = (path, table.schema)
    add_frame(session, frames, step.name, tables[step.name])
    late = {i: c for i, c in enumerate(step.checks) if i not in early}
    # The output is hashed, sampled and profiled side by side, and put on record while its checks run.
    with ThreadPoolExecutor(max_workers=4) as pool:
        content = pool.submit(lambda: fingerprint(table).first())
        sample = pool.submit(kept_rows, table)
        columns = pool.submit(profile_rows, table) if profile_artifacts else None
        counts[step.name] = content.result()["rows"]
        saved = pool.submit(
            lambda: _save_artifact(ws, run_id, step.name, path, table, content.result(), columns and columns.result(), sample.result())
        )
        after = dict(zip(late, run_checks(session, tuple(late.values()), frames, counts, values, quarantine)))
        saved.result()
    results = [(before | after)[i] for i in range(len(step.checks))]
    record.checks(step.name, results)
    _fail(step, results)
    record.note(step.name, "successful")


def _fail(step: Step, results: list[dict]) -> None:
    """End the step if a check could not run, or a blocking one found something."""
    errors = [r["name"] + ": " + r["error"] for r in results if r["status"] == "error"]
    if errors:
        raise StepFailed(f"Checks of {step.name} could not run: {'; '.join(errors)}")
    failed = [r["name"] for r in results if is_blocking(r)]
    if failed:
        raise StepFailed(f"Blocking checks of {step.name} failed: {', '.join(failed)}")


def _save_artifact(
    ws: Workspace, run_id: str, step: str, path: str, table: DataFrame, content: Row, columns: list[dict] | None, sample: list[str]
) -> None:
    facts = (content["rows"], content["fingerprint"], table.schema.json(), columns, sample)
    _append(ws, run_id, "artifacts", [(step, uuid.uuid4().hex, path, *facts)])


def _store_finding(ws: Workspace, pipeline: Pipeline, run_id: str, output: tuple) -> None:
    path, schema = output
    table = ws.spark.read.schema(schema).parquet(path)
    label, metric, unit = pipeline.finding or ("", "", "")
    found = top_finding(table, label, metric, unit, evidence=True).first()
    row = (pipeline.output, uuid.uuid4().hex, found["title"], found["detail"], found["evidence"])
    _append(ws, run_id, "findings", [row])


def record_evidence(ws: Workspace, run_id: str, step: str, key: dict) -> str:
    """Store as a finding the one row of a successful run's artifact that has the given key."""
    state = current_states(run_table(ws, "events", run_id)).where("step is null").first()
    if state is None or state["status"] != "successful":
        raise ValueError("Evidence is only taken from a run that succeeded")
    found = evidence_row(artifact(ws, run_id, step), key)
    rows = found.select(row_json(found.schema).alias("row")).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("The key must select exactly one row")
    finding_id = uuid.uuid4().hex
    text = rows[0]["row"]
    _append(ws, run_id, "findings", [(step, finding_id, "Selected evidence row", text, text)])
    return finding_id


def artifact(ws: Workspace, run_id: str, step: str) -> DataFrame:
    """The saved output of a step."""
    row = run_table(ws, "artifacts", run_id).where(F.col("step") == step).first()
    if row is None:
        raise ValueError(f"No artifact of {step} in this run")
    return ws.spark.read.schema(T.StructType.fromJson(json.loads(row["schema_json"]))).parquet(row["path"])


def step_report(ws: Workspace, run_id: str) -> DataFrame:
    """One row per step in order: state, rows, fingerprint and numbers of check results."""
    steps = run_table(ws, "definitions", run_id).where("kind = 'step'").select("position", F.col("name").alias("step"))
    states = current_states(run_table(ws, "events", run_id)).select("step", "status", "error")
    saved = run_table(ws, "artifacts", run_id).select("step", "artifact_id", "rows", "fingerprint")
    failed = F.col("status") == "failed"
    checks = (
        run_table(ws, "checks", run_id)
        .groupBy("step")
        .agg(
            F.count("*").alias("checks"),
            F.count_if(failed & (F.col("severity") == "blocking")).alias("blocking_failed"),
            F.count_if(failed & (F.col("severity") == "warning")).alias("warnings_failed"),
            F.count_if(F.col("status") == "error").alias("check_errors"),
        )
    )
    joined = steps.join(states, "step", "left").join(saved, "step", "left").join(checks, "step", "left")
    return joined.orderBy("position")


def run_report(ws: Workspace, run_id: str) -> DataFrame:
    """One row: the run with its inputs, steps in order, checks, artifacts, findings, and all
    of it as JSON in ``manifest``. The lists are as long as the definition, not as the data."""

    def nested(rows: DataFrame, name: str) -> DataFrame:
        columns = [c for c in rows.columns if c != "run_id"]
        items = F.sort_array(F.collect_list(F.struct(*columns))).alias(name)
        return rows.groupBy("run_id").agg(items)

    run = run_table(ws, "runs", run_id)
    state = current_states(run_table(ws, "events", run_id)).where("step is null")
    run = run.join(state.select("run_id", "status", "error"), "run_id", "left")
    steps = step_report(ws, run_id).select(F.lit(run_id).alias("run_id"), "position", "step", "status", "error", "rows")
    parts = {
        "steps": steps,
        "checks": run_table(ws, "checks", run_id).drop("quarantine"),
        "artifacts": run_table(ws, "artifacts", run_id),
        "findings": run_table(ws, "findings", run_id),
        "bound_versions": run_table(ws, "inputs", run_id),
        "definition_rows": run_table(ws, "definitions", run_id),
    }
    for name, rows in parts.items():
        run = run.join(nested(rows, name), "run_id", "left")
    return run.withColumn("manifest", F.to_json(F.struct("*")))


def artifact_profile(ws: Workspace, run_id: str, step: str) -> DataFrame:
    """The stored column profile of a step's output, one row per column."""
    saved = run_table(ws, "artifacts", run_id).where(F.col("step") == step)
    return saved.select(F.inline("profile")).orderBy("position")


def explore(ws: Workspace, sql: str) -> DataFrame:
    """One query over the newest version of every source: all its rows, as a preview."""
    newest = latest_versions(ws).select("source", "path", "schema_json").collect()
    tables = {r["source"]: (r["path"], T.StructType.fromJson(json.loads(r["schema_json"]))) for r in newest}
    session, _ = open_frames(ws.spark, tables)
    return preview(run_query(session, sql))


@dataclass(frozen=True)
class RunComparison:
    """What differs between two runs. ``outputs`` is absent unless both succeeded."""

    inputs: DataFrame
    definition: DataFrame
    logic_changed: bool
    parameters_changed: bool
    settings_changed: bool
    outputs: DataFrame | None
    message: str | None


def compare_runs(
    ws: Workspace, before: str, after: str, key: str, metric: str, unit: str = "currency"
) -> RunComparison:
    """Compare inputs, definitions and, if both runs succeeded, outputs per key."""
    a, b = (run_table(ws, "runs", run).first() for run in (before, after))
    if a is None or b is None:
        raise ValueError("One of the runs is not of this workspace")
    states = [current_states(run_table(ws, "events", run)).where("step is null").first() for run in (before, after)]
    outputs, message = None, None
    if all(s["status"] == "successful" for s in states):
        saved = artifact(ws, before, a["output"]), artifact(ws, after, b["output"])
        outputs = by_key_text(compare_outputs(*saved, key, metric, unit))
    else:
        message = "Outputs are compared only if both runs succeeded."
    return RunComparison(
        inputs=input_diff(run_table(ws, "inputs", before), run_table(ws, "inputs", after)),
        definition=pipeline_diff(run_table(ws, "definitions", before), run_table(ws, "definitions", after)),
        logic_changed=a["definition"] != b["definition"],
        parameters_changed=a["parameters"] != b["parameters"],
        settings_changed=a["settings"] != b["settings"],
        outputs=outputs,
        message=message,
    )

"""What must hold for runs of the worked analysis over the two example batches."""

import json
import tempfile
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql.types import StructType

from batches import csv_text, expected_profit, tables
from runledger.operators.contracts import capture_contract
from runledger.plans.commerce import commerce_pipeline, revised_pipeline
from runledger.plans.runs import (
    artifact,
    artifact_profile,
    compare_runs,
    record_evidence,
    run_pipeline,
    run_report,
    run_table,
    step_report,
)
from runledger.sources.versions import Workspace, append_version


class Story:
    """Uploaded batches, both pipelines, and runs by name, each made when first asked for."""

    def __init__(self, spark):
        self.ws = Workspace(spark, tempfile.mkdtemp(prefix="run-", dir="/tmp"), "analysis")
        self.files = Path(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        self.given = {batch: {n: self.upload(n, *content) for n, content in tables(batch).items()} for batch in (1, 2)}
        contracts = {
            batch: capture_contract({n: StructType.fromJson(json.loads(r["schema_json"])) for n, r in rows.items()})
            for batch, rows in self.given.items()
        }
        self.plain = commerce_pipeline(contracts[1])
        self.repaired = revised_pipeline(self.plain, contracts[2])
        self.made = {}

    def upload(self, name, header, rows):
        path = self.files / f"{name}{len(list(self.files.iterdir()))}.csv"
        path.write_text(csv_text(header, rows))
        return append_version(self.ws, name, str(path))

    def run(self, pipeline, batch, **other):
        """The run of a pipeline over a batch in which some sources are replaced."""
        key = (pipeline.digest(), batch, *sorted((n, r["version_id"]) for n, r in other.items()))
        if key not in self.made:
            rows = self.given[batch] | other
            self.made[key] = run_pipeline(self.ws, pipeline, {n: r["version_id"] for n, r in rows.items()})
        return self.made[key]

    def report(self, run):
        return run_report(self.ws, run).first()

    def check(self, run, name):
        return next(c for c in self.report(run)["checks"] if c["name"] == name)


@pytest.fixture(scope="module")
def story(spark):
    return Story(spark)


@pytest.mark.parametrize("batch", [1, 2])
def test_profit_is_that_of_the_rows(story, batch):
    run = story.run(story.plain if batch == 1 else story.repaired, batch)
    assert story.report(run)["status"] == "successful"
    got = {r["channel"]: r["contribution_profit"] for r in artifact(story.ws, run, "channel_profit").collect()}
    assert got == expected_profit(batch)
    best = max(got, key=got.get)
    found = story.report(run)["findings"][0]
    assert best in found["title"] and json.loads(found["evidence"])["channel"] == best
    assert artifact_profile(story.ws, run, "channel_profit").first()["distinct"] == len(got)


def test_a_changed_schema_stops_a_run_before_its_first_step(story):
    run = story.run(story.plain, 2)
    report = story.report(run)
    assert report["status"] == "failed" and {s["status"] for s in report["steps"]} == {"skipped"}
    assert [c["name"] for c in report["checks"] if c["status"] == "failed"] == ["Source contract: ad_spend"]
    against = compare_runs(story.ws, story.run(story.plain, 1), run, "channel", "contribution_profit")
    assert against.outputs is None and not against.logic_changed
    assert {r["source"] for r in against.inputs.where("schema_changed").collect()} == {"ad_spend"}


def test_a_repeated_order_blocks_but_its_step_is_kept(story):
    run = story.run(story.plain, 2, ad_spend=story.given[1]["ad_spend"])
    states = [s["status"] for s in story.report(run)["steps"]]
    assert states[0] == "failed" and set(states[1:]) == {"skipped"} and not story.report(run)["findings"]
    found = story.check(run, "clean_orders repeats no order_id")
    assert found["violations"] == 1 and json.loads(found["sample"][0])["copies"] == 2
    assert artifact(story.ws, run, "clean_orders").count() == len(tables(2)["orders"][1])


def test_the_repair_leaves_only_warnings(story):
    run = story.run(story.repaired, 2)
    failed = {c["name"]: c["violations"] for c in story.report(run)["checks"] if c["status"] == "failed"}
    assert failed == {
        "orders repeats some order_id": 1,
        "attributed_orders without a channel": 2,
        "refunds whose order_id is not in clean_orders": 1,
        "refunds dated after the due date": 3,
    }


def test_deltas_are_the_differences_of_both_outputs(story):
    against = compare_runs(story.ws, story.run(story.plain, 1), story.run(story.repaired, 2), "channel", "contribution_profit")
    before, after = expected_profit(1), expected_profit(2)
    want = {c: after.get(c, Decimal(0)) - before.get(c, Decimal(0)) for c in before | after}
    assert {r["key"]: r["delta"] for r in against.outputs.collect()} == want
    steps = against.definition.where("kind = 'step'").select("name").collect()
    assert against.logic_changed and {r["name"] for r in steps} == {"clean_orders", "channel_profit"}


def test_a_replay_has_the_same_fingerprints(story):
    first = story.run(story.repaired, 2)
    again = run_pipeline(
        story.ws, story.repaired, {n: r["version_id"] for n, r in story.given[2].items()}, profile_artifacts=False
    )
    prints = [{r["step"]: r["fingerprint"] for r in step_report(story.ws, run).collect()} for run in (first, again)]
    assert prints[0] == prints[1]


def test_only_successful_runs_take_evidence(story):
    run = story.run(story.repaired, 2)
    record_evidence(story.ws, run, "channel_profit", {"channel": "Paid social"})
    told = run_table(story.ws, "findings", run).where("title = 'Selected evidence row'").first()["evidence"]
    assert json.loads(told)["contribution_profit"] == "51.00"
    with pytest.raises(ValueError):
        record_evidence(story.ws, story.run(story.plain, 2), "clean_orders", {"order_id": "O002"})


@pytest.mark.parametrize(
    ("source", "change", "check"),
    [
        ("product_costs", lambda rows: rows + rows[:1], "product_costs repeats no product_id"),
        ("orders", lambda rows: [(*rows[0][:3], "EUR"), *rows[1:]], "clean_orders has ids and USD"),
    ],
)
def test_one_bad_row_blocks(story, source, change, check):
    header, rows = tables(1)[source]
    run = story.run(story.plain, 1, **{source: story.upload(source, header, change(rows))})
    assert story.report(run)["status"] == "failed" and story.check(run, check)["violations"] == 1

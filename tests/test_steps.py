"""Small SQL pipelines: isolation, parameters, check errors, exploration."""

import functools

import pytest
from pyspark.errors import AnalysisException, ParseException

from runledger.plans.definition import Check, Pipeline, Step, grain_check, key_check, row_check
from runledger.plans.runs import artifact, compare_runs, explore, run_pipeline, run_report
from runledger.plans.steps import check_summary, sql_step
from runledger.session import isolated_session
from runledger.sources.versions import Workspace, append_version

TOTALS = "SELECT id, sum(amount) AS amount FROM orders GROUP BY id"


def pipeline(sql=TOTALS, checks=(), more=(), **options):
    options = {"sources": {"orders": {"id": "bigint", "amount": "bigint"}}} | options
    steps = (Step("totals", "Totals", ("orders",), sql=sql, checks=tuple(checks)), *more)
    return Pipeline("p", "Totals", steps=steps, output="totals", **options)


@pytest.fixture
def orders(workspace, csv_file):
    return append_version(workspace, "orders", csv_file("id,amount\n1,10\n1,10\n2,20\n"))["version_id"]


def run(workspace, plan, orders, parameters=None):
    run_id = run_pipeline(workspace, plan, {"orders": orders}, parameters, profile_artifacts=False)
    return run_id, run_report(workspace, run_id).first()


def test_parameters(workspace, orders):
    plan = pipeline("SELECT id, amount * :factor AS total FROM orders", parameters={"factor": 2, "unused": None})
    a, report = run(workspace, plan, orders)
    assert report["status"] == "successful", report["error"]
    b, _ = run(workspace, plan, orders, {"factor": 3})
    totals = [sorted(r["total"] for r in artifact(workspace, x, "totals").collect()) for x in (a, b)]
    assert totals == [[20, 20, 40], [30, 30, 60]]
    with pytest.raises(ValueError):
        run(workspace, plan, orders, {"unknown": 1})
    _, failed = run(workspace, pipeline("SELECT :nothing AS x FROM orders"), orders)
    assert failed["status"] == "failed"


def test_parameter_changes_are_seen(workspace, orders):
    plan = pipeline("SELECT id, sum(amount * :factor) AS total FROM orders GROUP BY id", parameters={"factor": 2})
    a, _ = run(workspace, plan, orders)
    b, _ = run(workspace, plan, orders, {"factor": 3})
    compared = compare_runs(workspace, a, b, "id", "total")
    assert compared.parameters_changed and not compared.logic_changed and compared.inputs.isEmpty()
    assert {r["key"]: int(r["delta"]) for r in compared.outputs.collect()} == {1: 20, 2: 20}
    c, _ = run(workspace, pipeline(plan.steps[0].sql, parameters={"factor": 2}, description="new words"), orders)
    renamed = compare_runs(workspace, a, c, "id", "total")
    assert renamed.logic_changed and renamed.definition.where("kind = 'step'").isEmpty()


def test_blocking_duplicates_keep_the_artifact(workspace, orders):
    run_id, report = run(workspace, pipeline("SELECT * FROM orders", [key_check("Unique", "totals", ["id"])]), orders)
    assert report["status"] == "failed" and not report["findings"]
    assert report["checks"][1]["violations"] == 1 and artifact(workspace, run_id, "totals").count() == 3


def test_warnings_do_not_stop(workspace, orders):
    checks = [row_check("Small", "totals", "amount < 1000", severity="warning")]
    _, report = run(workspace, pipeline(checks=checks), orders)
    assert report["status"] == "successful" and report["checks"][1]["status"] == "failed"
    assert report["checks"][1]["violations"] == 2 and len(report["checks"][1]["sample"]) == 2


def test_a_check_that_cannot_run_fails_the_run(workspace, orders):
    checks = [
        row_check("Fine", "totals", "amount IS NULL"),
        Check("Bad column", "SELECT nonexistent FROM totals", severity="warning"),
        row_check("Bad rule", "totals", "missing_column > 1", severity="warning"),
    ]
    _, report = run(workspace, pipeline(checks=checks), orders)
    by_name = {k["name"]: k for k in report["checks"]}
    assert report["status"] == "failed"
    assert [by_name[n]["status"] for n in ("Fine", "Bad column", "Bad rule")] == ["passed", "error", "error"]
    assert "nonexistent" in by_name["Bad column"]["error"] and by_name["Bad column"]["violations"] is None


def test_no_finding_from_a_run_that_fails_later(workspace, orders):
    later = Step("later", "Later", ("totals",), sql="SELECT missing FROM totals")
    _, report = run(workspace, pipeline(more=(later,)), orders)
    assert report["status"] == "failed" and not report["findings"]
    assert [s["status"] for s in report["steps"]] == ["successful", "failed"]


def test_type_contract(workspace, orders):
    _, report = run(workspace, pipeline(sources={"orders": {"id": "bigint", "amount": "string"}}), orders)
    assert report["status"] == "failed" and "expected string, found bigint" in report["error"]
    assert report["checks"][0]["step"] == "__inputs__" and not report["artifacts"]


def test_empty_result(workspace, orders):
    _, report = run(workspace, pipeline("SELECT * FROM orders WHERE id > 100"), orders)
    assert report["findings"][0]["title"] == "The result has no rows"
    elsewhere = Workspace(workspace.spark, workspace.root, "w2")
    assert run_report(elsewhere, report["run_id"]).isEmpty()
    with pytest.raises(ValueError):
        artifact(elsewhere, report["run_id"], "totals")


@pytest.mark.parametrize(
    "sql",
    [
        "DELETE FROM orders",
        "SET spark.sql.ansi.enabled=false",
        "SELECT 1; SELECT 2",
        "CREATE TABLE t AS SELECT 1",
        "SELECT * FROM csv.`/etc/passwd`",
        "SELECT * FROM undeclared",
    ],
)
def test_only_queries_over_declared_tables(workspace, orders, sql):
    _, report = run(workspace, pipeline(sql), orders)
    assert report["status"] == "failed" and not report["artifacts"]


def test_sql_step_sees_declared_names_only(spark):
    session = isolated_session(spark)
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    one, two = session.range(3), session.range(5)
    assert sql_step("SELECT count(*) AS n FROM one", {"one": one}).first()["n"] == 3
    joined = sql_step("SELECT one.id FROM one JOIN two USING (id) WHERE id >= :least", {"one": one, "two": two}, {"least": 1})
    assert joined.count() == 2
    with pytest.raises(AnalysisException):
        sql_step("SELECT * FROM two", {"one": one})
    with pytest.raises(ParseException):
        sql_step("DROP VIEW one", {"one": one})
    spark.range(1).createOrReplaceTempView("outside")
    with pytest.raises(AnalysisException):
        sql_step("SELECT * FROM outside", {"one": one})


def test_recursive_query(spark):
    frames = {"one": isolated_session(spark).range(4)}
    sql = "WITH RECURSIVE t(n) AS (SELECT max(id) FROM one UNION ALL SELECT n - 1 FROM t WHERE n > 0) SELECT sum(n) AS n FROM t"
    assert sql_step(sql, frames).first()["n"] == 6


def test_explore_reads_the_newest_versions(workspace, csv_file, orders):
    text = "id,amount\n" + "".join(f"{i},1\n" for i in range(150))
    append_version(workspace, "orders", csv_file(text))
    append_version(workspace, "notes", csv_file("id,note\n1," + "n" * 3000 + "\n"))
    assert explore(workspace, "SELECT * FROM orders").count() == 150
    assert explore(workspace, "SELECT count(*) AS n FROM orders").first()["n"] == 150
    assert explore(workspace, "SELECT note FROM notes JOIN orders USING (id)").first()["note"].endswith("truncated]")
    with pytest.raises(AnalysisException):
        explore(workspace, "SELECT * FROM nothing")


def test_check_summary_fuses_but_counts_the_same(spark):
    session = isolated_session(spark)
    frames = {"t": session.createDataFrame([(1, 5), (1, -5), (2, None)], "k int, n int"), "s": session.range(2)}
    checks = (
        key_check("Unique", "t", ["k"]),
        key_check("Copies", "t", ["k"], "> 1", severity="warning"),
        row_check("Positive", "t", "n IS NULL OR n <= 0"),
        row_check("Known", "t", "k IS NULL"),
        grain_check("Grain", "t", "s"),
        Check("Query", "SELECT * FROM t WHERE n = 5"),
    )
    rows = {r["check"]: (r["violations"], r["status"]) for r in check_summary({"step": checks}, frames).collect()}
    assert rows == {
        "Unique": (1, "failed"), "Copies": (1, "failed"), "Positive": (2, "failed"),
        "Known": (0, "passed"), "Grain": (1, "failed"), "Query": (1, "failed"),
    }


def test_helpers_and_constants_are_part_of_a_definition():
    def helper(df):
        return df

    def build(frames):
        return helper(frames["orders"])

    def pipeline(uses):
        step = Step("s", "S", ("orders",), build=build, uses=uses)
        return Pipeline("p", "P", {"orders": {}}, (step,), "s")

    assert len({pipeline(u).digest() for u in ((), (helper,), (helper, 14), (helper, 15))}) == 4
    with pytest.raises(ValueError, match="by name"):
        Step("s", "S", ("orders",), build=functools.partial(build, {})).text


def test_checks_of_a_step_have_names_of_their_own():
    with pytest.raises(ValueError, match="names of their own"):
        Step("s", "S", (), sql="SELECT 1", checks=(row_check("a", "s", "x < 0"), row_check("a", "s", "x > 0")))

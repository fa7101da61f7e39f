import json
import math
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import Row, functions as F, types as T

from runledger.functions.hashing import fingerprint, md5_fingerprint
from runledger.functions.text import redact
from runledger.operators import checks as c
from runledger.operators.compare import (
    ComparisonError,
    by_key_text,
    compare_outputs,
    key_guard,
    numeric_guard,
    pipeline_diff,
    unit_guard,
)
from runledger.operators.contracts import (
    bad_columns,
    capture_contract,
    check_contract,
    column_rows,
    contract_rows,
    schema_diff,
)
from runledger.operators.findings import evidence_row, top_finding
from runledger.operators.profile import json_rows, preview, profile, sample_rows
from runledger.operators.status import current_states, run_status


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# --- profiles and previews --------------------------------------------------------------


def test_profile_of_every_type(spark):
    schema = (
        "i int, l bigint, x double, f float, d decimal(18,2), s string, b boolean, day date, at timestamp, "
        "bin binary, list array<int>, st struct<a:int>, m map<string,int>"
    )
    rows = [
        (1, 5, 0.0, 1.5, Decimal("1.10"), "a", True, date(2026, 1, 1), None, b"a", [1, 2], Row(a=1), {"p": 1, "q": 2}),
        (1, None, -0.0, 1.5, Decimal("1.10"), "a", False, date(2026, 1, 2), None, b"b", [1, 2], Row(a=1), {"q": 2, "p": 1}),
        (3, 7, math.nan, None, None, None, True, None, None, b"a", [2, 1], Row(a=None), None),
        (None, 7, None, math.nan, Decimal("-3.00"), "", None, None, None, None, None, None, {}),
    ]
    got = {r["column"]: r for r in profile(frame(spark, rows, schema)).collect()}
    assert all(r["rows"] == 4 for r in got.values()) and len(got) == 13
    assert {n: (r["missing"], r["distinct"]) for n, r in got.items()} == {
        "i": (1, 2), "l": (1, 2), "x": (1, 2), "f": (1, 2), "d": (1, 2), "s": (1, 2), "b": (1, 2),
        "day": (2, 2), "at": (4, 0), "bin": (1, 2), "list": (1, 2), "st": (1, 2), "m": (1, 2),
    }
    assert (got["l"]["min"], got["l"]["max"], round(got["l"]["mean"], 4)) == ("5", "7", 6.3333)
    assert (got["d"]["min"], got["d"]["max"]) == ("-3.00", "1.10")
    assert (got["x"]["nans"], float(got["x"]["max"]), got["x"]["mean"]) == (1, 0.0, 0.0)
    assert (got["f"]["nans"], got["f"]["max"]) == (1, "1.5")
    assert got["s"]["min"] is None and got["list"]["mean"] is None and got["day"]["max"] is None
    assert [r["position"] for r in sorted(got.values(), key=lambda r: r["position"])] == list(range(13))


def test_long_texts_are_told_apart(spark):
    texts = ["x" * 64, "x" * 65, "x" * 66, "#" + "a" * 64, "x" * 66, None]
    got = profile(frame(spark, [(t, [t]) for t in texts], "s string, l array<string>")).collect()
    assert {r["column"]: (r["missing"], r["distinct"]) for r in got} == {"s": (1, 4), "l": (0, 5)}


def test_profile_of_no_rows(spark):
    got = profile(frame(spark, [], "a int, s string")).orderBy("position").collect()
    assert [(r["rows"], r["missing"], r["distinct"], r["min"]) for r in got] == [(0, 0, 0, None)] * 2


def test_sample_is_bounded_and_ordered(spark):
    df = spark.range(100).withColumn("k", 99 - F.col("id"))
    assert [r["k"] for r in sample_rows(df, "k", 3).collect()] == [0, 1, 2]
    assert sample_rows(df, "k").count() == 10
    for n in (0, 21):
        with pytest.raises(ValueError):
            sample_rows(df, "k", n)


def test_preview_cuts_at_every_depth(spark):
    long = "ä" * 2001
    schema = "s string, l array<string>, st struct<t:string, n:array<int>>, none struct<t:string>"
    df = frame(spark, [(long, [long] * 60, (long, list(range(70))), None), ("x" * 2000, None, None, None)], schema)
    first, second = preview(df).collect()
    cut = "ä" * 2000 + "… [preview truncated]"
    assert first["s"] == cut and len(first["l"]) == 50 and first["l"][0] == cut
    assert first["st"]["t"] == cut and first["st"]["n"] == list(range(50)) and first["none"] is None
    assert second["s"] == "x" * 2000 and second["st"] is None


def test_decimal_previews_keep_cents(spark):
    df = frame(spark, [(Decimal("12345678901234.56"), [Decimal("0.10")])], "balance decimal(18,2), list array<decimal(3,2)>")
    assert json.loads(json_rows(df).first()["row"]) == {"balance": "12345678901234.56", "list": ["0.10"]}


def test_redaction_sees_the_whole_text(spark):
    text = "a" * 1995 + "sk-abc_123-x tail"
    df = frame(spark, [(text, "key sk-1 and hunter22 and sk- b")], "t string, u string")
    row = df.select(
        redact("t").alias("whole"), redact("t", limit=2000).alias("t"), redact("u", secrets=["hunter22", "key"]).alias("u")
    ).first()
    assert row["whole"] == "a" * 1995 + "[redacted] tail" and row["t"] == "a" * 1995 + "[reda"
    assert row["u"] == "[redacted] [redacted] and [redacted] and sk- b"


def test_previewed_maps_are_bounded_inside(spark):
    cut = preview(spark.sql("SELECT map('k', repeat('x', 3000)) AS m")).first()["m"]["k"]
    assert cut == "x" * 2000 + "… [preview truncated]"


# --- hashes -----------------------------------------------------------------------------


def test_fingerprint_ignores_order_only(spark):
    def digest(rows, schema="a int, b string, m map<string,int>"):
        return fingerprint(frame(spark, rows, schema)).first()["fingerprint"]

    rows = [(1, None, {"x": 1, "y": 2}), (2, "b", None)]
    assert digest(rows) == digest([(2, "b", None), (1, None, {"y": 2, "x": 1})])
    others = [rows + rows[:1], rows[:1], [(1, "", {"x": 1, "y": 2}), rows[1]], []]
    assert len({digest(r) for r in others} | {digest(rows)}) == 5
    assert digest([(None, "1", None)]) != digest([(1, None, None)])
    assert digest(rows) != digest(rows, "a int, c string, m map<string,int>")
    assert md5_fingerprint(frame(spark, rows, "a int, b string, m map<string,int>"), ["a", "b"]).first()["rows"] == 2


# --- contracts --------------------------------------------------------------------------


def test_contract_lists_every_source(spark):
    a = frame(spark, [], "id bigint, amount bigint, extra string")
    b = frame(spark, [], "x int")
    wanted = {"a": {"id": "bigint", "amount": "string"}, "b": {"x": "int", "y": "date"}}
    rows = check_contract(contract_rows(spark, wanted), column_rows(spark, {"a": a, "b": b})).collect()
    assert [tuple(r) for r in rows] == [("a", "amount", "string", "bigint"), ("b", "y", "date", None)]
    captured = contract_rows(spark, capture_contract({"a": a, "b": b}))
    assert check_contract(captured, column_rows(spark, {"a": a, "b": b})).isEmpty()


def test_bad_columns(spark):
    names = frame(spark, [("t", n) for n in ["ok", "Id", "ID", "my col", "1st", "x" * 101]], "source string, column string")
    got = {r["column"]: r["problem"] for r in bad_columns(names).collect()}
    assert got == {"ID": "not unique", "my col": "not an identifier", "1st": "not an identifier", "x" * 101: "not an identifier"}


def test_schema_diff(spark):
    before = T.StructType.fromDDL("a int, b string, c date, d int NOT NULL")
    after = T.StructType.fromDDL("b string, a bigint, e int, d int")
    rows = schema_diff(column_rows(spark, {"t": before}), column_rows(spark, {"t": after})).collect()
    assert {r["column"]: r["change"] for r in rows} == {
        "a": "retyped", "b": "moved", "c": "removed", "d": "nullability", "e": "added",
    }


# --- checks -----------------------------------------------------------------------------


def test_keys_and_copies(spark):
    df = frame(spark, [(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, "c"), (2, "d")], "k int, v string")
    assert {(r["k"], r["copies"]) for r in c.unique_key(df, ["k"]).collect()} == {(1, 3), (None, 2)}
    assert {(r["k"], r["v"]) for r in c.duplicate_rows(df).collect()} == {(1, "a"), (None, "c")}


def test_row_rules_and_nulls(spark):
    df = frame(spark, [("USD", 1, 5), ("EUR", 1, 0), (None, 1, -1), ("USD", None, None)], "currency string, k int, n int")
    assert c.accepted_values(df, "currency", ["USD"]).count() == 2
    assert c.accepted_values(df, "currency", ["USD"], required=["k"]).count() == 3
    assert c.not_null(df, ["k", "n"]).count() == 1
    assert c.value_range(df, "n", minimum=0).count() == 2
    assert c.value_range(df, "n", minimum=0, strict=True).count() == 3
    assert c.value_range(df, "n", minimum=-1, maximum=1).count() == 2
    assert c.missing_lookup(df, "k").count() == 1 and c.defaulted_category(df, "currency", "EUR").count() == 1
    rules = {"usd": c.not_accepted("currency", ["USD"]), "range": c.out_of_range("n", 0)}
    assert {r["check"]: r["violations"] for r in c.count_violations(df, rules).collect()} == {"usd": 2, "range": 2}


def test_join_grain_counts_without_joining(spark):
    left = frame(spark, [(1,), (1,), (2,), (None,)], "k int")
    right = frame(spark, [(1,), (1,), (1,), (None,), (None,)], "k int")
    row = c.join_grain(left, right, ["k"]).first()
    assert (row["actual"], row["expected"]) == (left.join(right, "k", "left").count(), 4) == (8, 4)
    assert c.join_grain(left, right.distinct(), ["k"]).isEmpty()


def test_join_grain_of_a_hot_key(spark):
    hot = spark.range(30_000).select(F.when(F.col("id") < 10_000, 0).otherwise(F.col("id")).alias("k"))
    row = c.join_grain(hot, hot, ["k"]).first()
    assert (row["actual"], row["expected"]) == (10_000**2 + 20_000, 30_000)


def test_orphans_keep_null_keys_and_copies(spark):
    df = frame(spark, [(1, "a"), (2, "b"), (2, "b"), (None, "c")], "k int, v string")
    found = c.orphans(df, frame(spark, [(1,), (1,), (None,)], "k int"), ["k"]).collect()
    assert sorted(r["v"] for r in found) == ["b", "b", "c"]


def test_late_is_strictly_after(spark):
    orders = frame(spark, [(1, "2026-08-01"), (1, "2026-08-20"), (2, "2026-08-01")], "k int, d string")
    refunds = frame(spark, [(1, "2026-08-15"), (1, "2026-08-16"), (2, "2026-09-01"), (3, "2030-01-01")], "k int, r string")
    late = c.late_rows(refunds, orders, ["k"], "r", "d", 14).collect()
    assert sorted((r["k"], r["r"]) for r in late) == [(1, "2026-08-16"), (2, "2026-09-01")]


def test_grain(spark):
    def n(value):
        return frame(spark, [(value,)], "n bigint")

    assert c.grain(n(3), n(3)).isEmpty() and tuple(c.grain(n(4), n(3)).first()) == (4, 3)


# --- comparison -------------------------------------------------------------------------


def test_outputs_match_on_typed_and_null_keys(spark):
    rows = [("x", Decimal("10.25"), "USD"), (None, Decimal("1.00"), "USD"), ("gone", Decimal("5.00"), "USD")]
    a = frame(spark, rows, "k string, m decimal(18,2), currency string")
    b = frame(spark, [("x", 10, "USD"), (None, 3, "USD"), ("new", 7, "EUR")], "k string, m int, currency string")
    rows = by_key_text(compare_outputs(a, b, "k", "m")).collect()
    assert [(r["key"], r["before"], r["after"], r["delta"]) for r in rows] == [
        (None, Decimal("1.00"), Decimal(3), Decimal("2.00")),
        ("gone", Decimal("5.00"), Decimal(0), Decimal("-5.00")),
        ("new", Decimal(0), Decimal(7), Decimal(7)),
        ("x", Decimal("10.25"), Decimal(10), Decimal("-0.25")),
    ]
    assert rows[2]["before_row"] is None and rows[2]["after_row"]["currency"] == "EUR"


def test_numeric_text_and_doubles_compare_exactly(spark):
    a = frame(spark, [(1, "0.1")], "k int, m string")
    b = frame(spark, [(1, 0.3)], "k int, m double")
    assert compare_outputs(a, b, "k", "m").first()["delta"] == Decimal("0.2")


def test_comparison_guards(spark):
    schema = "k int, m string, currency string"
    good = frame(spark, [(1, "1", "USD"), (2, "2", "USD")], schema)
    twice = frame(spark, [(1, "1", "USD"), (1, "2", "USD")], schema)
    moved = frame(spark, [(1, "1", "EUR"), (3, "2", "EUR")], schema)
    texts = frame(spark, [(1, "one", "USD"), (2, None, "USD")], schema)
    other_key = good.withColumn("k", F.col("k").cast("string"))
    for bad in (twice, moved, texts, good.drop("currency"), good.drop("m"), other_key):
        with pytest.raises(ComparisonError):
            compare_outputs(good, bad, "k", "m")
    assert [tuple(r) for r in key_guard(good, twice, "k").collect()] == [("after", 1, 2)]
    assert [tuple(r) for r in unit_guard(good, moved, "k").collect()] == [(1, "USD", "EUR")]
    assert {tuple(r) for r in numeric_guard(good, texts, "k", "m").collect()} == {("after", 1, "one"), ("after", 2, None)}


def test_pipeline_diff(spark):
    schema = "kind string, name string, position int, value string"
    a = frame(spark, [("step", "s1", 0, "x"), ("step", "s2", 1, "y"), ("parameter", "p", 0, None)], schema)
    b = frame(spark, [("step", "s1", 0, "x2"), ("step", "s3", 1, "y"), ("parameter", "p", 0, None)], schema)
    got = {r["name"]: (r["change"], r["before_value"], r["after_value"]) for r in pipeline_diff(a, b).collect()}
    assert got == {"s1": ("changed", "x", "x2"), "s2": ("removed", "y", None), "s3": ("added", None, "y")}


# --- findings and states ----------------------------------------------------------------


def test_finding_names_the_largest_with_the_smallest_label(spark):
    schema = "channel string, profit decimal(18,2), currency string"
    rows = [("b", Decimal("1234.50"), "USD"), ("a", Decimal("1234.50"), "USD"), ("z", Decimal("-4.00"), "USD")]
    found = top_finding(frame(spark, rows, schema), "channel", "profit", "currency").first()
    assert found["title"] == "a has the highest profit"
    assert found["detail"] == "USD 1,234.50, the maximum of all 3 rows."
    assert (found["label"], found["metric"], found["unit"], found["rows"]) == ("a", "1234.50", "USD", 3)


def test_finding_stays_neutral(spark):
    schema = "channel string, profit double, currency string"
    mixed = [("a", 1.0, "USD"), ("b", 2.0, "EUR")]
    unknown = [("a", None, "USD"), ("b", 2.0, "USD")]
    for rows in (mixed, unknown, [(None, 1.0, "USD")]):
        found = top_finding(frame(spark, rows, schema), "channel", "profit", "currency").first()
        assert found["title"] == "The result is ready" and found["label"] is None
    none = top_finding(frame(spark, [], schema), "channel", "profit", "currency").first()
    assert none["title"] == "The result has no rows" and none["rows"] == 0
    other = top_finding(spark.range(2000), "channel", "profit", "currency").first()
    assert other["detail"].startswith("2,000 rows")


def test_evidence_by_key(spark):
    df = frame(spark, [(1, None, "x"), (1, "a", "y")], "k int, l string, v string")
    assert [r["v"] for r in evidence_row(df, {"k": 1, "l": None}).collect()] == ["x"]


def test_run_status(spark):
    steps = [(run, i, s) for run in ("ok", "bad", "contract") for i, s in enumerate("abc")]
    checks = [
        ("ok", "a", "warning", "failed"),
        ("ok", "b", "blocking", "passed"),
        ("bad", "a", "blocking", "passed"),
        ("bad", "b", "warning", "error"),
        ("bad", "b", "blocking", "passed"),
        ("contract", "__inputs__", "blocking", "failed"),
    ]
    got = run_status(
        frame(spark, steps, "run_id string, position int, step string"),
        frame(spark, checks, "run_id string, step string, severity string, status string"),
    ).orderBy("run_id", "position")
    states = {}
    for r in got.collect():
        states.setdefault((r["run_id"], r["run_status"]), []).append(r["status"])
    assert states == {
        ("ok", "successful"): ["successful"] * 3,
        ("bad", "failed"): ["successful", "failed", "skipped"],
        ("contract", "failed"): ["skipped"] * 3,
    }


def test_last_event_wins(spark):
    events = frame(
        spark,
        [("r", "a", "running", None, 2, None), ("r", "a", "failed", "why", 3, None), ("r", "a", "queued", None, 1, None)],
        "run_id string, step string, state string, error string, seq bigint, at timestamp",
    )
    row = current_states(events).first()
    assert (row["status"], row["error"]) == ("failed", "why")


def test_comparison_takes_any_number(spark):
    big = frame(spark, [(1, Decimal(10**25))], "k bigint, m decimal(30,0)")
    small = frame(spark, [(1, 1.5)], "k bigint, m double")
    tiny = frame(spark, [(1, 1e-25)], "k bigint, m double")
    assert compare_outputs(big, small, "k", "m").first()["delta"] == Decimal("1.5") - 10**25
    assert compare_outputs(small, tiny, "k", "m").first()["delta"] == Decimal("1e-25") - Decimal("1.5")
    # More digits than a decimal has: doubles.
    huge = frame(spark, [(1, 1e300), (2, -3e19), (3, 5e-324)], "k bigint, m double")
    got = {r["key"]: (r["before"], r["after"], r["delta"]) for r in compare_outputs(huge, tiny, "k", "m").collect()}
    assert got == {1: (1e300, 1e-25, -1e300), 2: (-3e19, 0.0, 3e19), 3: (5e-324, 0.0, -5e-324)}
    texts = frame(spark, [(1, " +007.250 "), (2, "-.5"), (3, "25e-3"), (4, "0"), (5, "1.5d")], "k bigint, m string")
    got = {r["key"]: r["before"] for r in compare_outputs(texts, small, "k", "m").collect()}
    assert got == {1: Decimal("7.25"), 2: Decimal("-0.5"), 3: Decimal("0.025"), 4: 0, 5: Decimal("1.5")}
    with pytest.raises(ComparisonError, match="not numbers"):
        compare_outputs(small, frame(spark, [(1, float("nan"))], "k bigint, m double"), "k", "m")
    row = compare_outputs(big, frame(spark, [(1, Decimal(1)), (2, Decimal(7))], "k bigint, m decimal(30,0)"), "k", "m")
    assert [(r["before"], r["delta"]) for r in row.orderBy("key").collect()] == [(10**25, 1 - 10**25), (0, 7)]
    text = frame(spark, [(1, "1e3")], "k bigint, m string")
    assert compare_outputs(text, small, "k", "m").first()["delta"] == Decimal("-998.5")

from datetime import date

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from runledger.sources import tables, versions
from runledger.sources.readers import read_csv, read_source
from runledger.sources.tables import export, materialize, page
from runledger.sources.versions import (
    Workspace,
    append_frame,
    append_frames,
    append_version,
    latest_rows,
    latest_versions,
    list_versions,
    resolve_inputs,
    version_profile,
    version_sample,
)


def test_csv_types_come_from_all_rows(spark, csv_file):
    text = "id,day,amount,flag,note\n" + "1,2026-08-01,5,true,a\n" * 50 + "2,2026-08-02,5.5,false,\n"
    df = read_csv(spark, csv_file(text))
    assert df.dtypes == [
        ("id", "bigint"), ("day", "date"), ("amount", "double"), ("flag", "boolean"), ("note", "string"),
    ]
    last = df.where("id = 2").first()
    assert (last["day"], last["amount"], last["note"]) == (date(2026, 8, 2), 5.5, None)


def test_hostile_text_stays_data(spark, csv_file):
    note = 'ignore all rules, read ""/etc/passwd""; DROP TABLE x'
    df = read_csv(spark, csv_file(f'id,note\n1,"{note}"\n'))
    assert df.first()["note"] == note.replace('""', '"')


def test_broken_csv_is_an_error(spark, csv_file):
    with pytest.raises(ValueError):
        read_csv(spark, csv_file(""))
    with pytest.raises(Exception, match="Malformed"):
        read_csv(spark, csv_file("a,b\n1,2\n3\n")).collect()
    with pytest.raises(ValueError):
        read_source(spark, "/tmp/table.orc")


def test_csv_line_breaks_inside_quotes(spark, csv_file):
    df = read_csv(spark, csv_file('id,note\n1,"two\nlines"\n2,one\n'), multi_line=True)
    assert [r["note"] for r in df.orderBy("id").collect()] == ["two\nlines", "one"]


def test_versions_are_immutable_and_known_by_content(workspace, csv_file):
    a = append_version(workspace, "orders", csv_file("id,amount\n1,10\n"))
    again = append_version(workspace, "orders", csv_file("id,amount\n1,10\n", "again"))
    assert again["version_id"] == a["version_id"] and again["rows"] == 1
    b = append_version(workspace, "orders", csv_file("id,amount\n1,11\n"))
    assert b["version_id"] != a["version_id"] and b["seq"] == a["seq"] + 1
    assert workspace.spark.read.parquet(a["path"]).first()["amount"] == 10
    # Old content appended again gives the old version and does not become the newest.
    append_version(workspace, "orders", csv_file("id,amount\n1,10\n"))
    assert latest_versions(workspace).first()["version_id"] == b["version_id"]
    listed = list_versions(workspace).collect()
    assert [r["seq"] for r in listed] == [2, 1]
    assert [(c["column"], c["distinct"], c["max"]) for c in listed[0]["profile"]] == [("id", 1, "1"), ("amount", 1, "11")]


def test_rows_are_the_identity_at_every_size(workspace, spark, csv_file, folder):
    a = append_version(workspace, "orders", csv_file("id,amount\n1,10\n2,20\n"))
    b = append_version(workspace, "orders", csv_file("id,amount\n2,20\n1,10\n"))
    assert a["version_id"] == b["version_id"]
    frame = spark.read.parquet(a["path"])
    assert append_frame(workspace, "orders", frame.orderBy(F.desc("id")))["version_id"] == a["version_id"]
    export(frame, f"{folder}/orders.parquet")
    assert append_version(workspace, "orders", f"{folder}/orders.parquet")["version_id"] == a["version_id"]
    c = append_version(workspace, "orders", csv_file("id,amount\n1,10\n2,20\n2,20\n"))
    assert c["version_id"] != a["version_id"] and c["rows"] == 3


def test_read_options_and_folder_values_are_part_of_a_version(workspace, spark, csv_file, folder):
    path = csv_file("id,zip\n1,00123\n")
    a = append_version(workspace, "places", path)
    b = append_version(workspace, "places", path, schema="id bigint, zip string")
    assert a["version_id"] != b["version_id"] and spark.read.parquet(b["path"]).first()["zip"] == "00123"
    for day in (1, 2):
        spark.range(3).write.parquet(f"{folder}/d{day}.parquet/dt={day}")
    first, second = (append_version(workspace, "days", f"{folder}/d{day}.parquet") for day in (1, 2))
    assert first["version_id"] != second["version_id"]
    assert {r["dt"] for r in spark.read.parquet(second["path"]).collect()} == {2}


def test_nested_rows_that_differ_are_other_versions(workspace, spark):
    pairs = [([1, 2], []), ([1], [2]), ([1, None], [2]), ([None, 1], [2])]
    ids = set()
    for pair in pairs:
        df = spark.createDataFrame([pair], "a array<int>, b array<int>")
        ids.add(append_frame(workspace, "nested", df)["version_id"])
    assert len(ids) == 4


def test_the_newest_version_is_one_that_is_listed(workspace, csv_file, monkeypatch):
    old, new = csv_file("id\n1\n"), csv_file("id\n2\n")
    append_version(workspace, "orders", old)
    second = append_version(workspace, "orders", new)
    # A writer of old content that had looked before the first version was there.
    real, seen = versions.known_version, []
    monkeypatch.setattr(versions, "known_version", lambda *a: (None, 2) if not seen and not seen.append(1) else real(*a))
    append_version(workspace, "orders", old)
    listed = list_versions(workspace).first()
    assert latest_versions(workspace).first()["version_id"] == listed["version_id"] == second["version_id"]


def test_headers_and_line_breaks_are_checked(spark, csv_file, folder):
    with pytest.raises(Exception, match="(?i)header"):
        read_csv(spark, csv_file("y,x\n1,2\n"), schema="x int, y int").collect()
    with pytest.raises(ValueError, match="multi_line"):
        read_csv(spark, csv_file('note\n"a\nb"\n'))
    df = spark.createDataFrame([("a\nb",), (' say "hi" ',)], "note string")
    export(df, f"{folder}/notes.csv", "csv")
    again = read_source(spark, f"{folder}/notes.csv", schema="note string", multi_line=True)
    assert {r["note"] for r in again.collect()} == {"a\nb", ' say "hi" '}


def test_two_writers_of_one_content_list_one_version(workspace, csv_file, monkeypatch):
    path = csv_file("id\n1\n")
    first = append_version(workspace, "orders", path)
    # The second writer looked before the first had finished.
    real, seen = versions.known_version, []
    monkeypatch.setattr(
        versions, "known_version", lambda *a: (None, 0) if not seen and not seen.append(1) else real(*a)
    )
    second = append_version(workspace, "orders", path)
    assert list_versions(workspace).count() == 1
    assert second["version_id"] == list_versions(workspace).first()["version_id"]
    assert first["digest"] == second["digest"]


@pytest.mark.parametrize("name", ["../escape", "Orders", "1st", "", "a" * 64])
def test_source_names(workspace, csv_file, name):
    with pytest.raises(ValueError):
        append_version(workspace, name, csv_file("id\n1\n"))


@pytest.mark.parametrize("header", ["my id,b", "a-b,c"])
def test_column_names(workspace, csv_file, header):
    with pytest.raises(ValueError):
        append_version(workspace, "orders", csv_file(f"{header}\n1,2\n"))


def test_empty_file(workspace, csv_file):
    with pytest.raises(ValueError):
        append_version(workspace, "orders", csv_file(""))


def test_inputs_must_fit(workspace, spark, csv_file):
    own = append_version(workspace, "orders", csv_file("id\n1\n"))["version_id"]
    other = append_version(Workspace(spark, workspace.root, "w2"), "orders", csv_file("id\n2\n"))["version_id"]
    assert resolve_inputs(workspace, ["orders"], {"orders": own})["orders"]["rows"] == 1
    for mapping in ({}, {"orders": own, "more": own}, {"orders": other}):
        with pytest.raises(ValueError):
            resolve_inputs(workspace, ["orders"], mapping)


def test_frames_together(workspace, spark):
    rows = append_frames(workspace, {f"s{i}": spark.range(i + 1) for i in range(4)})
    assert {n: r["rows"] for n, r in rows.items()} == {f"s{i}": i + 1 for i in range(4)}


def test_samples_and_profiles_are_served_per_version(workspace, spark):
    old = append_frame(workspace, "numbers", spark.range(1, 3))
    append_frame(workspace, "numbers", spark.range(100, 150))
    assert version_sample(workspace, "numbers").count() == 10
    assert version_sample(workspace, "numbers", 99).count() == 20
    rows = version_sample(workspace, "numbers", 5, old["version_id"]).collect()
    assert sorted(r["row"] for r in rows) == ['{"id":1}', '{"id":2}']
    assert version_profile(workspace, "numbers").first()["min"] == "100"
    assert version_profile(workspace, "numbers", old["version_id"]).first()["distinct"] == 2
    assert len(list_versions(workspace).first()["sample"]) == 30


def test_latest_rows_breaks_ties(spark):
    df = spark.createDataFrame([("a", 1, 1, "x"), ("a", 1, 2, "y"), ("b", 5, 1, "z")], "k string, t int, s int, v string")
    assert {r["k"]: r["v"] for r in latest_rows(df, ["k"], ["t", "s"]).collect()} == {"a": "y", "b": "z"}


def test_pages_shallow_and_deep_agree(spark, monkeypatch):
    df = spark.range(1000).select(F.expr("cast(id * 7919 % 1000 as int) as k"), F.lit(1).alias("one"))
    expected = list(range(395, 445))
    assert [r["k"] for r in page(df, "k", 395, 50).collect()] == expected
    monkeypatch.setattr(tables, "ROWS_PER_RANGE", 60)
    monkeypatch.setattr(tables, "BORDER_SAMPLE", 100)
    deep = page(df, "k", 395, 50)
    assert [r["k"] for r in deep.collect()] == expected and deep.columns == ["k", "one"]
    assert page(df, "k", 2000, 50).count() == 0
    for offset, limit in ((-1, 5), (0, 0), (0, 101)):
        with pytest.raises(ValueError):
            page(df, "k", offset, limit)


def test_deep_page_of_a_compound_key_with_a_hot_part(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS_PER_RANGE", 50)
    df = spark.range(600).select(F.expr("if(id < 400, null, id % 3) AS a"), F.col("id").alias("b"))
    rows = sorted(((r["a"] is not None, r["a"] or 0, r["b"]) for r in df.collect()))[390:420]
    got = [(r["a"] is not None, r["a"] or 0, r["b"]) for r in page(df, ["a", "b"], 390, 30).collect()]
    assert got == rows


def test_pages_of_repeated_keys_lose_no_row(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS_PER_RANGE", 50)
    monkeypatch.setattr(tables, "BORDER_SAMPLE", 40)
    df = spark.range(2000).select((F.col("id") % 3).alias("k"), "id", F.create_map(F.lit("a"), "id").alias("m"))
    seen = [r["id"] for offset in range(600, 1400, 100) for r in page(df, "k", offset, 100).collect()]
    assert len(seen) == len(set(seen)) == 800
    assert [r["k"] for r in page(df, "k", 650, 30).collect()] == [0] * 17 + [1] * 13
    same = spark.range(500).select(F.lit(1).alias("k"))
    assert page(same, "k", 430, 100).count() == 70


def test_latest_rows_carries_maps(spark):
    df = spark.sql("SELECT 1 AS k, t, map('a', t) AS m FROM VALUES (1), (3), (2) AS v(t)")
    assert latest_rows(df, ["k"], ["t"]).first()["m"] == {"a": 3}


def test_export_round_trip(spark, folder):
    df = spark.createDataFrame(
        [(1, 'say "hi", all', date(2026, 1, 2), 0.1), (2, None, None, -3.5)], "id bigint, note string, day date, x double"
    )
    for form in ("csv", "parquet"):
        export(df, f"{folder}/t.{form}", form)
        assert read_source(spark, f"{folder}/t.{form}").orderBy("id").collect() == df.collect()
    with pytest.raises(ValueError):
        export(df, f"{folder}/t.orc", "orc")


def test_materialized_tables_are_never_overwritten(spark, folder):
    df = spark.sql("SELECT 1 AS a, null AS nothing")
    assert materialize(df, f"{folder}/t").dtypes == [("a", "int"), ("nothing", "string")]
    with pytest.raises(AnalysisException):
        materialize(df, f"{folder}/t")

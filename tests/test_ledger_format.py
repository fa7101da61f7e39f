"""Versions read by name through the data source."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, StringContains

from runledger.sources.ledger_format import FORMAT, LedgerReader, LedgerSource, register_format
from runledger.sources.versions import append_frame
from runledger.streaming.registration import Arrivals, add_batch, arrived_version


@pytest.fixture
def named(spark, workspace):
    register_format(spark)
    return {"root": workspace.root, "workspace": workspace.workspace_id, "source": "things"}


def things(spark):
    at = dt.datetime(2024, 1, 2, 3, 4, 5, 6)
    rows = [(i, i / 2, f"n{i % 3}" if i % 5 else None, dt.date(2024, 1, 1 + i % 28), at, [i], {"k": i}) for i in range(200)]
    return spark.createDataFrame(rows, "id bigint, x double, name string, day date, at timestamp, list array<int>, m map<string,int>")


def test_rows_are_those_of_the_version(spark, workspace, named):
    df = things(spark)
    first = append_frame(workspace, "things", df)
    append_frame(workspace, "things", df.where("id < 3"))
    old = spark.read.format(FORMAT).options(**named).option("version", first["version_id"]).load()
    assert old.schema == df.schema and sorted(old.collect(), key=lambda r: r["id"]) == sorted(df.collect(), key=lambda r: r["id"])
    assert spark.read.format(FORMAT).options(**named).load().count() == 3
    wanted = (F.col("name") == "n1") & (F.col("id") > 50) & (F.col("x") < 80.0) & F.col("day").isin(dt.date(2024, 1, 5), dt.date(2024, 1, 6))
    assert sorted(r["id"] for r in old.where(wanted).collect()) == sorted(r["id"] for r in df.where(wanted).collect())
    some = spark.read.format(FORMAT).options(**named).schema("id bigint, name string").load().where("id > 1")
    assert [tuple(r) for r in some.collect()] == [(2, "n2")]


def test_what_is_pushed_and_pruned(spark, workspace, named):
    append_frame(workspace, "things", things(spark).coalesce(1))
    reader = LedgerReader(named, things(spark).select("id", "name", "x", "at").schema)
    given = [GreaterThan(("id",), 190), EqualTo(("name",), "n2"), In(("id",), (191, 194, 197)), IsNotNull(("name",)), EqualTo(("x",), 1.0), EqualTo(("at",), dt.datetime(2024, 1, 1)), StringContains(("name",), "n")]
    left = list(reader.pushFilters(given))
    assert left == given[4:] and reader.pushed == given[:4]
    batches = [b for part in reader.partitions() for b in reader.read(part)]
    assert {n for b in batches for n in b.schema.names} == {"id", "name", "x", "at"}
    assert sorted(i for b in batches for i in b.column("id").to_pylist()) == [191, 194, 197]
    df = spark.read.format(FORMAT).options(**named).load().where("id > 190 AND name = 'n2'")
    assert sorted(r["id"] for r in df.collect()) == [191, 194, 197]


def test_batches_of_a_stream_and_errors(spark, workspace, named):
    arrivals = Arrivals(workspace, "things")
    add_batch(arrivals, things(spark).where("id < 5"), 0)
    add_batch(arrivals, things(spark).where("id BETWEEN 5 AND 8"), 1)
    arrived_version(arrivals)
    assert sorted(r["id"] for r in spark.read.format(FORMAT).options(**named).load().collect()) == list(range(9))
    for options in (named | {"source": "nothing"}, named | {"version": "x"}, {"root": workspace.root}):
        with pytest.raises(ValueError):
            LedgerSource(options).schema()

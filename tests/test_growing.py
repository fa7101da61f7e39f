"""Streams that register batches, and sketches that add up."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from runledger.operators.profile import value_counts
from runledger.operators.sketches import DISTINCT_ERROR, RANK_ERROR, column_sketches, merged_sketches, sketch_answers
from runledger.sources.versions import append_frame, versions, version_sketches
from runledger.streaming.registration import Arrivals, add_batch, arrived_version, commits, late_arrivals, register_stream

SCHEMA = "id int, ts timestamp, v double"
DAY = dt.datetime(2024, 1, 1)


def rows(spark, *days, first=0):
    return spark.createDataFrame([(first + i, d if d is None else DAY + dt.timedelta(days=d), float(i)) for i, d in enumerate(days)], SCHEMA)


def test_stopped_and_restarted_stream_equals_batch(spark, workspace, folder):
    arrivals = Arrivals(workspace, "events", "ts", delay_seconds=86_400)
    parts = [rows(spark, 0, 1, 2, None), rows(spark, 5, 0, first=10), rows(spark, 4.5, 3, 1, first=20)]
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/landing")
        register_stream(arrivals, spark.readStream.schema(SCHEMA).parquet(f"{folder}/landing")).awaitTermination()
    got = {r["batch_id"]: (r["rows"], r["late"]) for r in commits(arrivals).collect()}
    assert got == {0: (4, 0), 1: (1, 1), 2: (1, 2)}
    assert sorted((r["id"], r["batch_id"], r["watermark"]) for r in late_arrivals(arrivals).collect()) == [
        (11, 1, DAY + dt.timedelta(days=1)), (21, 2, DAY + dt.timedelta(days=4)), (22, 2, DAY + dt.timedelta(days=4)),
    ]
    version = arrived_version(arrivals)
    in_time = parts[0].union(parts[1].where("id = 10")).union(parts[2].where("id = 20"))
    assert version["digest"] == append_frame(workspace, "whole", in_time)["digest"]
    assert sorted(r["id"] for r in spark.read.schema(SCHEMA).parquet(version["path"]).collect()) == sorted(r["id"] for r in in_time.collect())
    told = {c["column"]: (c["rows"], c["missing"], c["min"], c["max"]) for c in version["profile"]}
    assert told == {"id": (6, 0, "0", "20"), "ts": (6, 1, None, None), "v": (6, 0, "0.0", "3.0")}
    assert len(version["sample"]) == 6
    # Asked again it is the same version; another batch makes another one.
    assert arrived_version(arrivals)["version_id"] == version["version_id"]
    rows(spark, 6, first=30).write.mode("append").parquet(f"{folder}/landing")
    register_stream(arrivals, spark.readStream.schema(SCHEMA).parquet(f"{folder}/landing")).awaitTermination()
    assert arrived_version(arrivals)["seq"] == 2 and versions(workspace, "events").count() == 2


def test_replayed_batch_adds_nothing(spark, workspace):
    arrivals = Arrivals(workspace, "events", "ts")
    assert add_batch(arrivals, rows(spark, 0, 3), 0) and add_batch(arrivals, rows(spark, 4, first=5), 1)
    before = arrived_version(arrivals)
    assert not add_batch(arrivals, rows(spark, 0, 3), 0) and not add_batch(arrivals, rows(spark, 9), 1)
    assert arrived_version(arrivals)["version_id"] == before["version_id"] and commits(arrivals).count() == 2


def test_batch_that_died_is_written_anew(spark, workspace, monkeypatch):
    import runledger.streaming.registration as registration

    arrivals = Arrivals(workspace, "events", "ts")

    def dies(df):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(registration, "column_sketches", dies)
        with pytest.raises(RuntimeError):
            add_batch(arrivals, rows(spark, 0, 1, 2), 0)
    assert commits(arrivals).count() == 0
    assert add_batch(arrivals, rows(spark, 0, 1), 0)
    assert spark.read.schema(SCHEMA).parquet(arrived_version(arrivals)["path"]).count() == 2


def test_batches_of_nothing(spark, workspace):
    arrivals = Arrivals(workspace, "events")
    with pytest.raises(ValueError):
        arrived_version(arrivals)
    assert add_batch(arrivals, rows(spark), 0)
    empty = arrived_version(arrivals)
    assert empty["rows"] == 0 and spark.read.schema(SCHEMA).parquet(empty["path"]).count() == 0
    with pytest.raises(ValueError):
        add_batch(arrivals, rows(spark, 1).drop("v"), 1)
    add_batch(arrivals, rows(spark, None, 2), 1)
    assert arrived_version(arrivals)["rows"] == 2 and late_arrivals(arrivals).count() == 0


def test_merged_sketches(spark):
    """Of many parts merged: distinct counts and ranks within their bounds, least and greatest exact."""
    rng = random.Random(1)
    data = [(i % 3000, rng.gauss(0, 1), f"name {rng.randrange(700)}", [i % 50], None if i % 4 else dt.date(2020, 1, 1) + dt.timedelta(i % 900)) for i in range(12_000)]
    df = spark.createDataFrame(data, "a int, b double, c string, d array<int>, e date")
    parts = [column_sketches(df.where(F.col("a") % 5 == k)) for k in range(5)]
    states = parts[0]
    for part in parts[1:]:
        states = states.unionAll(part)
    shares = (0.01, 0.25, 0.5, 0.9)
    got = {r["column"]: r for r in sketch_answers(merged_sketches(states), shares).collect()}
    exact = {r["position"]: r["distinct"] for r in value_counts(df).collect()}
    for i, c in enumerate("abcde"):
        assert abs(got[c]["distinct"] - exact[i]) <= DISTINCT_ERROR * exact[i]
        assert got[c]["rows"] == 12_000 and got[c]["missing"] == sum(r[i] is None for r in data)
    for i, c in ((0, "a"), (1, "b")):
        values = [r[i] for r in data]
        assert (got[c]["least"], got[c]["greatest"]) == (min(values), max(values))
        for share, answer in zip(shares, got[c]["quantiles"], strict=True):
            low, high = sum(v < answer for v in values) / len(values), sum(v <= answer for v in values) / len(values)
            assert low - RANK_ERROR <= share <= high + RANK_ERROR
    assert got["c"]["quantiles"] is None and got["d"]["quantiles"] is None


def test_sketches_of_odd_columns(spark):
    df = spark.createDataFrame([(None, float("nan"), 0.0), (None, float("inf"), -0.0)], "a int, b double, c double")
    got = {r["column"]: r for r in sketch_answers(merged_sketches(column_sketches(df).unionAll(column_sketches(df.limit(0))))).collect()}
    assert got["a"]["distinct"] == 0 and got["a"]["missing"] == 2 and got["a"]["quantiles"] is None
    assert got["b"]["distinct"] == 2 and got["b"]["least"] is None and got["c"]["distinct"] == 1


def test_versions_keep_sketches(spark, workspace):
    for k in (0, 1):
        append_frame(workspace, "numbers", spark.range(k * 500, k * 500 + 600))
    merged = sketch_answers(merged_sketches(version_sketches(workspace, "numbers"))).first()
    assert merged["rows"] == 1200 and abs(merged["distinct"] - 1100) <= 1100 * DISTINCT_ERROR
    append_frame(workspace, "numbers", spark.range(0, 600))
    assert version_sketches(workspace, "numbers").count() == 2


def test_nested_timestamps_are_told_apart(spark, workspace):
    at = dt.datetime(2024, 5, 1, 12, 0, 0, 1)
    for kind, make in (("struct<t timestamp>", lambda t: (t,)), ("array<timestamp_ntz>", lambda t: [t]), ("map<string,timestamp>", lambda t: {"k": t}), ("map<timestamp,int>", lambda t: {t: 1})):
        name = "s" + str(abs(hash(kind)) % 1000)
        frames = [spark.createDataFrame([(make(at.replace(microsecond=m)),)], f"v {kind}") for m in (1, 2)]
        ids = [append_frame(workspace, name, f)["version_id"] for f in (*frames, frames[0])]
        assert ids[0] == ids[2] != ids[1]
        assert value_counts(frames[0].union(frames[1])).first()["distinct"] == 2
    assert "12:00:00.000001" in versions(workspace, name).first()["sample"][0] or kind.startswith("map<timestamp")

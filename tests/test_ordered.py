"""As-of and range joins, totals, percentiles, multisets and closures, on cases that brute force decides."""

import datetime as dt
import math
import random
import re
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from runledger.operators.intervals import overlap_join, range_join, span, top_matches
from runledger.operators.lineage import on_cycles, reachable
from runledger.operators.multisets import all_subsets, grouping_totals, multiset_diff, prefixes
from runledger.operators.ordered import as_of_join, exact_percentiles, ranged, running_totals


@pytest.fixture(autouse=True)
def several_ranges(spark):
    """Small tables are one range otherwise."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


KEYS = [1] * 60 + [2, 3, 4, None] * 5


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("strict", [False, True])
def test_as_of_join(spark, strict):
    rng = random.Random(1)
    left = [(i, rng.choice(KEYS), rng.choice([None, *range(60)])) for i in range(300)] + [(7, 1, 30)] * 20
    right = [(rng.choice(KEYS), rng.choice([None, *range(0, 60, 3)]), v) for v in range(200)] + [(9, 5, 1)]
    a = spark.createDataFrame(left, "id int, k int, t int").repartition(6)
    b = spark.createDataFrame(right, "k int, at int, v int")
    got = Counter((r["id"], r["k"], r["t"], r["match"] and (r["match"]["at"], r["match"]["v"])) for r in as_of_join(a, b, ["k"], ("t", "at"), strict=strict).collect())
    want = Counter()
    for i, k, t in left:
        known = [(at, v) for rk, at, v in right if k is not None and t is not None and rk == k and at is not None and (at < t or (at == t and not strict))]
        want[i, k, t, max(known, default=None)] += 1
    assert got == want


def test_as_of_join_within_and_odd_tables(spark):
    day = dt.datetime
    left = spark.createDataFrame([(1, day(2024, 1, 10)), (2, day(2024, 1, 2))], "k int, t timestamp")
    right = spark.createDataFrame([(1, day(2024, 1, 1), {"a": 1}), (2, day(2024, 1, 1), {"b": 2})], "k int, at timestamp, m map<string,int>")
    rows = as_of_join(left, right, ["k"], ("t", "at"), ties=["at"], within=F.expr("INTERVAL 3 DAYS"), into="found").collect()
    assert {r["k"]: r["found"] and r["found"]["m"] for r in rows} == {1: None, 2: {"b": 2}}
    assert as_of_join(left.limit(0), right, ["k"], ("t", "at"), ties=["at"]).count() == 0
    assert [r["match"] for r in as_of_join(left, right.limit(0), ["k"], ("t", "at"), ties=["at"]).collect()] == [None, None]
    with pytest.raises(ValueError):
        as_of_join(left, right, ["k"], ("t", "at"), into="k")


def test_one_key_is_cut_in_ranges(spark):
    """A single key, and a single time, fill several ranges of like size."""
    df = spark.range(40_000).select(F.lit(1).alias("k"), F.lit(5).alias("t"), "id")
    sizes = [r["count"] for r in ranged(df, ["k", "t"]).groupBy("_range").count().collect()]
    assert len(sizes) > 2 and max(sizes) < 3 * min(sizes)
    right = spark.createDataFrame([(1, 4, "x")], "k int, at int, v string")
    assert as_of_join(df, right, ["k"], ("t", "at")).where("match.v = 'x'").count() == 40_000


def test_running_totals(spark):
    rng = random.Random(2)
    rows = [(rng.choice(KEYS), i, rng.choice([None, *range(9)])) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, t int, v int").repartition(5)
    got = {r["t"]: r["running"] for r in running_totals(df, ["k"], ["t"], "v").collect()}
    sums, want = {}, {}
    for k, t, v in rows:
        if v is not None:
            sums[k] = sums.get(k, 0) + v
        want[t] = sums.get(k)
    assert got == want
    assert running_totals(df.limit(0), ["k"], ["t"], "v").count() == 0


def test_exact_percentiles(spark):
    rng = random.Random(3)
    rows = [(rng.choice(KEYS), rng.choice([None, float("nan"), -0.5, 1.25, 3.0, 8.0, 9.5]), Decimal(rng.randrange(50)) / 4) for _ in range(500)]
    df = spark.createDataFrame(rows, "k int, a double, b decimal(9,2)").repartition(4)
    shares = (0.0, 0.25, 0.5, 0.55, 1.0)
    got = {(r["k"], r["column"], r["share"]): (r["n"], str(r["value"])) for r in exact_percentiles(df, ["k"], ["a", "b"], shares).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        for c, name in ((1, "a"), (2, "b")):
            values = sorted((float(r[c]) for r in rows if r[0] == k and r[c] is not None), key=lambda v: (math.isnan(v), v))
            for s in shares:
                place = max(1, math.ceil(Decimal(str(s)) * len(values)))
                if values:
                    want[k, name, s] = (len(values), str(values[place - 1]))
    assert got == want
    assert exact_percentiles(df.select("k", "b"), ["k"], ["b"], (0.5,)).schema["value"].dataType.simpleString() == "decimal(38,2)"
    assert exact_percentiles(df.limit(0), ["k"], ["a"], (0.5,)).count() == 0


@pytest.mark.parametrize("kind", ["int", "date", "timestamp"])
def test_range_join(spark, kind):
    rng = random.Random(4)
    make = {"int": lambda d: d, "date": lambda d: dt.date(1969, 12, 20) + dt.timedelta(d), "timestamp": lambda d: dt.datetime(1969, 12, 20) + dt.timedelta(d)}[kind]
    side = lambda n, seed: [(i, random.Random(seed + i).choice(KEYS), random.Random(seed - i).choice([None, *range(40)])) for i in range(n)]
    left, right = side(120, 10), side(90, 500)
    frames = [spark.createDataFrame([(i, k, None if d is None else make(d)) for i, k, d in rows], f"id int, k int, t {kind}") for rows in (left, right)]
    for before, after in ((0, 0), (3, 2), (-1, 5), (7, -2)):
        unit = span(frames[0], "t", days=1) if kind != "int" else 1
        width = (before * unit, after * unit)
        want = {
            (a[0], b[0]) for a in left for b in right
            if a[1] is not None and a[1] == b[1] and a[2] is not None and b[2] is not None and a[2] - before <= b[2] <= a[2] + after
        }
        pairs = range_join(*frames, ["k"], ("t", "t"), *width)
        assert sorted((r["left"]["id"], r["right"]["id"]) for r in pairs.collect()) == sorted(want)
        assert not re.search("NestedLoop|Cartesian", executed(pairs))
    outer = range_join(*frames, ["k"], ("t", "t"), *width, how="left").collect()
    alone = sorted(r["left"]["id"] for r in outer if r["right"] is None)
    assert alone == sorted(set(range(120)) - {a for a, _ in want}) and len(outer) == len(want) + len(alone)
    assert sorted(r["id"] for r in range_join(*frames, ["k"], ("t", "t"), *width, how="left_anti").collect()) == alone
    assert range_join(*frames, [], ("t", "t"), 0, 0).count() == sum(a[2] is not None and a[2] == b[2] for a in left for b in right)


def test_range_join_refuses(spark):
    df = spark.createDataFrame([(1, "x")], "k int, t string")
    with pytest.raises(ValueError):
        range_join(df, df, ["k"], ("t", "t"), 1, 1)
    with pytest.raises(ValueError):
        range_join(df, df, ["k"], ("k", "k"), 1, -3)


def test_overlap_join(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(KEYS), a, a + rng.randrange(-2, 30)) for i, a in enumerate(rng.choices(range(-50, 50), k=150))]
    df = spark.createDataFrame([*rows, (999, 1, None, 5)], "id int, k int, a int, b int")
    got = sorted((r["left"]["id"], r["right"]["id"]) for r in overlap_join(df, df, ["k"], (("a", "b"), ("a", "b")), 10).collect())
    good = [r for r in rows if r[3] >= r[2] and r[1] is not None]
    assert got == sorted((x[0], y[0]) for x in good for y in good if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])


def test_top_matches(spark):
    right = spark.createDataFrame([(1, v % 4, v) for v in range(500)] + [(2, 9, 1), (None, 1, 1)], "k int, p int, v int")
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "e")], "k int, name string")
    found = top_matches(left, right, ["k"], [F.desc("p")], 3)
    got = sorted((r["name"], r["rank"], r["match"] and r["match"]["v"]) for r in found.collect() if r["match"])
    assert got == sorted([(n, i + 1, v) for n in "ab" for i, v in enumerate((3, 7, 11))] + [("c", 1, 1)])
    assert sorted(r["name"] for r in found.collect() if r["match"] is None) == ["d", "e"]
    assert "WindowGroupLimit" in executed(found)


def test_multiset_diff(spark):
    schema = "a int, m map<string,int>, t array<timestamp>"
    at = dt.datetime(2024, 1, 1, 0, 0, 0, 1)
    x, y, z = (1, {"p": 1, "q": 2}, [at]), (1, {"p": 1, "q": 2}, [at.replace(microsecond=2)]), (None, None, None)
    before, after = spark.createDataFrame([x, x, x, z, z], schema), spark.createDataFrame([x, y, z, z, z], schema)
    got = sorted((r["side"], r["copies"], r["row"]) for r in multiset_diff(before, after).collect())
    assert [g[:2] for g in got] == [("after", 1), ("after", 1), ("before", 2)]
    assert "000002" in got[1][2] + got[0][2] and "000001" in got[2][2]
    assert multiset_diff(before, before.repartition(3)).count() == 0
    with pytest.raises(ValueError):
        multiset_diff(before, before.drop("a"))


def test_grouping_totals(spark):
    rng = random.Random(6)
    rows = [(rng.choice("xy"), rng.choice([None, 1, 2]), rng.choice([None, *range(5)]), rng.randrange(9)) for _ in range(300)]
    df = spark.createDataFrame(rows, "a string, b int, d int, n int")
    for sets in (all_subsets(["a", "b"]), prefixes(["a", "b"]), [["b"]]):
        want = {}
        for chosen in sets:
            groups = {}
            for r in rows:
                groups.setdefault((r[0] if "a" in chosen else None, r[1] if "b" in chosen else None), []).append(r)
            bits = 2 * ("a" not in chosen) + ("b" not in chosen)
            for key, own in groups.items():
                want[(bits, *key)] = (len(own), sum(r[3] for r in own), len({r[2] for r in own} - {None}))
        got = {(r["grouping"], r["a"], r["b"]): (r["rows"], r["sum_n"], r["distinct_d"]) for r in grouping_totals(df, ["a", "b"], sets, ["n"], "d").collect()}
        assert got == want
    assert grouping_totals(df, ["a"], [["a"]]).count() == 2
    with pytest.raises(ValueError):
        grouping_totals(df, ["a"], [["b"]])


def test_reachable(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(25)] + [(100 + i, 101 + i) for i in range(25)] + [(200, 200), (None, 1), (1, None)]
    df = spark.createDataFrame(edges, "source int, target int")
    want = {}
    for a in {e[0] for e in edges} - {None}:
        front, steps, seen = {a}, 0, {}
        while front:
            steps += 1
            front = {y for x, y in edges if x in front and y is not None} - set(seen)
            seen |= dict.fromkeys(front, steps)
        want |= {(a, b): s for b, s in seen.items()}
    pairs = reachable(df)
    assert {(r["source"], r["target"]): r["steps"] for r in pairs.collect()} == want and pairs.count() == len(want)
    assert {r["node"] for r in on_cycles(pairs).collect()} == {a for a, b in want if a == b}
    some = reachable(df, spark.createDataFrame([(110,), (777,)], "node int"))
    assert {(r["source"], r["target"]) for r in some.collect()} == {p for p in want if p[0] == 110}
    assert reachable(df.limit(0)).count() == 0

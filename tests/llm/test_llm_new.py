"""Exact dedup by recipes, whitening and clustering against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from helpers import LOWER

from runledger.llm import chunk_recipes, whitening, zone_clusters
from runledger.llm.common import Scratch

VECTORS = "vec_id long, embedding array<float>, label int"


def same_texts(rows):
    """{id: (keep, size)} of rows (id, text) with different ids."""
    groups = {}
    for i, text in rows:
        groups.setdefault((text or "").translate(LOWER), []).append(i)
    return {i: (max(g), len(g)) for g in groups.values() for i in g}


def test_exact_duplicates(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghé日") for _ in range(rng.randrange(1, 9)))
    long = " ".join(word() for _ in range(30_000))
    texts = [" ".join(word() for _ in range(rng.randrange(400))) for _ in range(40)]
    texts += [texts[3].upper(), texts[3].translate(LOWER), texts[5][:-1] + "!", "É", "é", "", None, " ", "a" * 5000, "A" * 5000, "a" * 5001]
    texts += [long, long.upper().translate(LOWER), long[:-1] + "?", long[1:], texts[8] + texts[9], texts[9] + texts[8]] + ["hot copy " * 300] * 70
    rows = [(k * 7 % 1009, t, "x") for k, t in enumerate(texts)]
    want = same_texts([r[:2] for r in rows])
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_id string").repartition(5)
    out = chunk_recipes.exact_duplicates(docs)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert {i: (r["keep_id"], r["group_size"]) for i, r in got.items()} == want
    for i, text, _ in rows:
        assert got[i]["kept"] == (want[i][0] == i)
        assert got[i]["text_sha256"] == hashlib.sha256((text or "").translate(LOWER).encode()).hexdigest()
    stay = chunk_recipes.without_copies(docs)
    assert stay.columns == docs.columns and sorted(r[0] for r in stay.collect()) == sorted({k for k, _ in want.values()})


def test_exact_duplicates_odd_rows(spark):
    schema = "doc_id long, text string"
    got = chunk_recipes.exact_duplicates(spark.createDataFrame([(1, "a"), (1, "a"), (None, "A"), (None, None), (2, "b"), (2, "b2")], schema)).collect()
    rows = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got), key=repr)
    assert rows == sorted([(1, 1, 3, True), (1, 1, 3, True), (None, 1, 3, False), (None, None, 1, True), (2, 2, 1, True), (2, 2, 1, True)], key=repr)
    assert chunk_recipes.exact_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_chunks_follow_content(spark):
    """Chunks join to the text, keep to their bounds, and an early change leaves later chunks alone."""
    rng = random.Random(8)
    text = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzäß") for _ in range(rng.randrange(2, 9))) for _ in range(9000))
    frame = spark.createDataFrame([(0, text), (1, "new words here " + text), (2, "é" * 9000), (3, ""), (4, "x\ny")], "id int, text string")
    got = {r["id"]: r["c"] for r in frame.select("id", chunk_recipes.chunks(frame["text"]).alias("c")).collect()}
    for i, t in ((0, text), (2, "é" * 9000), (3, ""), (4, "x\ny")):
        assert "".join(got[i]).encode("latin-1").decode() == t
        assert all(len(c) <= chunk_recipes.MOST for c in got[i]) and all(len(c) >= chunk_recipes.LEAST for c in got[i][:-1])
    assert len(set(got[0]) - set(got[1])) < 0.2 * len(got[0])


def test_colliding_identifiers_are_replaced(spark, monkeypatch):
    """With identifiers of one character most collide: they are found, and other ones are tried."""
    rows = [(k, f"text {k % 5}") for k in range(12)]
    tried = []

    def weak(chunk, salt):
        tried.append(salt)
        return F.left(F.sha2(F.concat(F.lit(salt), chunk), 256), F.lit(1))

    monkeypatch.setattr(chunk_recipes, "identifier", weak)
    out = chunk_recipes.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in out.collect()} == same_texts(rows)
    assert len(set(tried)) > 1


def test_recipes_stay_native(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = chunk_recipes.exact_duplicates(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Window|Cartesian|NestedLoop", plan)


def vectors(count, size, seed):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((count, size)) @ rng.standard_normal((size, size)) / size).astype(np.float32).tolist()


def plain_whitening(rows, components):
    """Brute force in numpy, with exact sums from Python integers: {id: (deviation, [(whitened, explained)])}."""
    x = {i: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for i, v in rows}
    fit = sorted({tuple(v) for v in x.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    exact = np.array([[n * a - s for a, s in zip(v, sums, strict=True)] for v in fit], object)
    cov = (exact.T.dot(exact) / n**3).astype(np.float64)
    values, basis = np.linalg.eigh(cov)
    order = np.argsort(-values)[:components]
    out = {}
    for i, v in x.items():
        u = [n * a - s for a, s in zip(v, sums, strict=True)]
        white = np.array([float(a) / n for a in u]) @ basis[:, order] / np.sqrt(values[order])
        out[i] = (sum(a * a for a in u), white, values[order] / np.trace(cov))
    return n, out


def test_whitening_against_brute_force(spark):
    base = vectors(150, 24, 1)
    rows = [(k, v, 0) for k, v in enumerate(base)] + [(1000 + k, base[7], None) for k in range(90)]
    odd = [(5000, None, 0), (5001, [None] + base[0][1:], 0), (5002, [float("nan")] * 24, 0), (5003, [float("inf")] + base[0][1:], 0), (5004, [], 0)]
    out = whitening.whiten(spark.createDataFrame(rows + odd, VECTORS).repartition(4)).collect()
    n, want = plain_whitening([r[:2] for r in rows], 16)
    got = {}
    for r in out:
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(got) == set(want) and all(sorted(g) == list(range(1, 17)) for g in got.values())
    signs = [np.sign(got[0][k + 1]["whitened"] * want[0][1][k]) for k in range(16)]
    for i, (deviation, white, explained) in want.items():
        for k in range(16):
            r = got[i][k + 1]
            assert r["n"] == n and int(r["deviation"]) == deviation
            assert abs(r["whitened"] * signs[k] - white[k]) < 1e-6 and abs(r["explained"] / explained[k] - 1) < 1e-9
            assert r["identity_error"] < 1e-9


def test_whitening_extremes(spark):
    """Large numbers, several lengths, one vector, none."""
    big = [[1e12 * a for a in v] for v in vectors(30, 4, 2)]
    small = vectors(20, 3, 5)
    rows = [(k, v, 0) for k, v in enumerate(big)] + [(100 + k, v, 0) for k, v in enumerate(small)] + [(999, [0.5] * 7, 0)]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {(r["vec_id"] >= 100, r["component"]) for r in out} == {(False, k) for k in range(1, 5)} | {(True, k) for k in range(1, 4)}
    assert {r["n"] for r in out} == {30, 20} and max(r["identity_error"] for r in out) < 1e-8
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in big]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert {int(r["deviation"]) for r in out if r["vec_id"] == 3} == {sum((30 * a - s) ** 2 for a, s in zip(x[3], sums, strict=True))}
    white = np.array([[r["whitened"] for r in sorted(out, key=lambda r: r["component"]) if r["vec_id"] == k] for k in range(30)])
    assert np.abs(np.cov(white.T, bias=True) - np.eye(4)).max() < 1e-8
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    huge = spark.createDataFrame([(1, [1e300, 1.0], 0), (2, [-1e300, 2.0], 0), (3, [0.0, 5.0], 0)], "vec_id long, embedding array<double>, label int")
    # The second direction has about 1e-600 of the variance, which doubles can't tell from none.
    assert whitening.whiten(huge).count() == 3


def test_square_limbs():
    rng = np.random.default_rng(4)
    for reach in (10, 1 << 30, (1 << 59) - 1):
        values = rng.integers(-reach, reach, (300, 5))
        exact = [sum(int(v) ** 2 for v in column) for column in values.T]
        for kind in (values, values.astype(object)):
            assert [sum(int(t[c]) << 20 * k for k, t in enumerate(whitening.square_limbs(kind))) for c in range(5)] == exact


def plain_clusters(rows, clusters, rounds, size):
    x = {i: [math.floor(256 * float(np.float32(c))) for c in v] for i, v in rows}
    first = sorted(x, key=lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest())[:clusters]
    centroids = [list(x[i]) for i in first]
    for turn in range(rounds + 1):
        best = {i: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids)) for i, v in x.items()}
        if turn < rounds:
            for k in range(len(centroids)):
                own = [x[i] for i, (_, b) in best.items() if b == k]
                if own:
                    centroids[k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    sums = {}
    for d, k in best.values():
        sums[k] = sums.get(k, 0) + d
    code = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return {i: (k, d, sums[k], sum(sums.values()), code[k]) for i, (d, k) in best.items()}


FIELDS = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@pytest.mark.parametrize("count,copies", [(400, 150), (25, 0), (1, 3)])
def test_clusters_against_brute_force(spark, count, copies):
    base = vectors(count, 16, count)
    rows = [(k, v, 0) for k, v in enumerate(base)] + [(10_000 + k, base[0], 1) for k in range(copies)]
    odd = [(20_000, None, 0), (20_001, base[0][:-1], 0), (20_002, [None] + base[0][1:], 0), (20_003, [float("nan")] + base[0][1:], 0)]
    out = zone_clusters.cluster(spark.createDataFrame(rows + odd, VECTORS).repartition(3), size=16).collect()
    got = {r["vec_id"]: tuple(int(r[f]) if f != "centroid_sha256" else r[f] for f in FIELDS) for r in out}
    assert got == plain_clusters([r[:2] for r in rows], 40, 5, 16)


def test_clusters_odd_rows(spark):
    assert zone_clusters.cluster(spark.createDataFrame([], VECTORS)).columns == ["vec_id", *FIELDS]
    assert zone_clusters.cluster(spark.createDataFrame([], VECTORS)).count() == 0
    wide = [(1, [1e13, -1e13], 0), (1, [1e13, -1e13], 0), (None, [3e13, 0.0], 0), (2, [0.0, 1e300], 0)]
    out = zone_clusters.cluster(spark.createDataFrame(wide, "vec_id long, embedding array<double>, label int"), size=2, clusters=2, rounds=2).collect()
    assert len(out) == 4 and sorted({r["cluster"] for r in out}) == [0, 1]


def test_boxes_lose_no_nearest_centroid():
    rng = np.random.default_rng(6)
    for _ in range(200):
        centroids = rng.integers(-50, 50, (12, 3))
        own = rng.integers(-20, 20, (9, 3)) + rng.integers(-40, 40, 3)
        some = zone_clusters.candidates(own.min(axis=0), own.max(axis=0), centroids)
        best, squares = zone_clusters.nearest(own, centroids[some])
        every = ((own[:, None] - centroids) ** 2).sum(axis=2)
        assert (some[best] == every.argmin(axis=1)).all() and (squares == every.min(axis=1)).all()


def test_hilbert_curve_steps_by_one():
    """Each cell once, and neighbours on the curve share a face."""
    cells = np.array([[a, b, c] for a in range(4) for b in range(4) for c in range(4)])
    keys = zone_clusters.hilbert_keys(cells, 2)
    order = cells[sorted(range(64), key=lambda k: keys[k])]
    assert len(set(keys)) == 64 and (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_blocks_hold_every_vector_once(spark):
    rows = [(k, v) for k, v in enumerate(vectors(300, 8, 9))]
    frame = spark.createDataFrame(rows, "id long, v array<float>").select("id", whitening.as_integers(F.col("v"), 256, 0).alias("x"))
    made = zone_clusters.blocks(frame, zone_clusters.first_centroids(frame, 10, 2), Scratch(spark, "t")).collect()
    assert sorted(i for r in made for i in r["ids"]) == list(range(300)) and all(len(r["ids"]) <= zone_clusters.BLOCK for r in made)
    assert all(np.frombuffer(r["data"], np.int64).reshape(-1, 8).min(axis=0).tolist() == r["low"] for r in made)

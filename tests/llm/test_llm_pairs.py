"""Embedding near-dedup, n-gram join and components against brute force."""

import random
import re
from pathlib import Path

import numpy as np
import pytest
from helpers import jaccard, smallest
from pyspark.sql import functions as F

from runledger.llm import shingle_join, vector_dedup
from runledger.llm.common import KeyMap, Scratch, components, shingles, string_bytes, without, word_hashes
from runledger.llm import common


def test_components_of_chains_stars_and_circles(spark):
    links = [(k, k + 1) for k in range(40, 60)] + [(5, k) for k in range(6, 30)] + [(100, 102), (102, 101), (101, 100)]
    df = spark.createDataFrame(links + [(b, a) for a, b in links[:5]], "a long, b long")
    got = {r["member"]: r["root"] for r in components(Scratch(spark, "t"), df).collect()}
    assert got == smallest({v for link in links for v in link}, links)
    assert components(Scratch(spark, "t"), df.where("a < 0")).count() == 0


def test_words_do_not_depend_on_slices(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["Ab  cD é\tx", None, "", "abcdefghij " * 50, " y"])
    whole, first = word_hashes(*string_bytes(texts))
    monkeypatch.setattr(common, "SLICE_BYTES", 7)
    again, _ = word_hashes(*string_bytes(texts))
    assert (whole == again).all() and first.tolist() == [0, 4, 4, 4, 54, 55]
    one, _ = word_hashes(*string_bytes(pa.array(["aB CD"])))
    assert (one == whole[:2]).all()
    assert len(shingles(whole[4:54], 4)) == 1 and len(shingles(whole[:2], 4)) == 1


def test_suffix_bound_is_a_bound():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x, y = (np.unique(rng.integers(0, 300, rng.integers(0, 120))) for _ in range(2))
        common = len(np.intersect1d(x, y))
        assert common <= shingle_join.suffix_bound(x, y, 4) <= min(len(x), len(y))
        a, b = (z.astype(np.uint64) for z in (x, y))
        if len(a) and len(b):
            most, both = shingle_join.cells_bound(shingle_join.cell_counts(a, 64), shingle_join.cell_counts(b, 256))
            assert most >= common and both == len(a) + len(b)
            apart = sum(int(p ^ q).bit_count() if (p ^ q) >= 0 else int((p ^ q) & (2**64 - 1)).bit_count()
                        for p, q in zip(shingle_join.parities(a).tolist(), shingle_join.parities(b).tolist()))
            assert apart <= both - 2 * common


def _texts(seed, n=160):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(200)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 90))) for _ in range(20)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "one two"), (6, " one  two ")]
    for i in range(7, n):
        text = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, "  ".join(text)))
    return rows


@pytest.mark.parametrize(("size", "share"), [(4, (85, 100)), (5, (4, 5)), (1, (1, 2))])
def test_jaccard_join_is_exact(spark, size, share):
    rows = _texts(size)
    # Names that the operator uses itself must not get in its way.
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, token string")
    got = {r[0]: (r[1], r[2]) for r in shingle_join.jaccard_components(df, size, share).collect()}
    assert got == jaccard(rows, size, share)


def test_jaccard_join_of_nothing_and_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (1, "q"), (2, "q"), (None, "q")], "doc_id long, text string")
    assert shingle_join.jaccard_components(df.where("doc_id > 5")).count() == 0
    got = sorted(map(tuple, shingle_join.jaccard_components(df).collect()), key=repr)
    assert got == sorted([(1, 1, 1), (1, 1, 1), (1, 1, 1), (2, 1, 1), (None, 1, None)], key=repr)


def test_rows_without_keys(spark):
    keys = Scratch(spark, "t").keep(spark.createDataFrame([(7 * k,) for k in range(500)], "id long"), "keys")
    rows = spark.createDataFrame([(None if k == 5 else k // 2, {"at": k}) for k in range(6000)], "id int, more map<string,int>")
    some, rest = KeyMap(keys, "id").parted(rows)
    assert some.count() + rest.count() == 6000 and 800 < some.count() < 1500
    assert rest.where("id % 7 = 0 and id < 3500").count() == 0
    # Rows that stay are not shuffled, however large the keys are said to be.
    assert "Exchange hashpartitioning(id" not in rest._jdf.queryExecution().executedPlan().toString()
    got = without(rows, keys, "id")
    assert got.dtypes == rows.dtypes
    assert sorted(r["more"]["at"] for r in got.collect()) == [k for k in range(6000) if k == 5 or k // 2 % 7 or k // 2 >= 3500]


def test_stages_leave_no_intermediate_of_the_size_of_the_texts(spark, folder, monkeypatch):
    import corpus_pipeline

    spark.createDataFrame([(1, "these are the words of the one item")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    texts = [f"{k} wrote to a{k}@b.org of {k * k} and of {k + 1} things" for k in range(60)]
    docs = spark.createDataFrame(list(enumerate([*texts, *texts[:20], None])), "doc_id long, text string")
    roots, init = [], Scratch.__init__
    monkeypatch.setattr(Scratch, "__init__", lambda self, *a: init(self, *a) or roots.append(self.root))
    docs = docs.withColumn("n_chars", F.length("text"))
    for name in ("shingle_dedup", "decontaminate", "personal_data"):
        stage = dict(corpus_pipeline.STAGES)[name]
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
    left = {re.sub(r"^\d+-", "", p.name) for root in roots for p in Path(root.removeprefix("file:")).iterdir()}
    assert left.isdisjoint({"sketches", "first", "tokens", "shared", "centers", "postings", "rooted", "mixed", "passages", "items", "hits", "copies", "terms"})
    assert {"sizes", "others", "leaked", "spans"} <= left
    kept = {name: {r[0] for r in spark.read.parquet(f"{folder}/{name}").select("doc_id").collect()} for name in ("shingle_dedup", "decontaminate", "personal_data")}
    assert kept == {"shingle_dedup": {*range(60), 80}, "decontaminate": set(range(81)), "personal_data": set(range(81))}
    clean = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/personal_data").collect()}
    assert clean[80] is None and all("[EMAIL]" in t and "@" not in t for k, t in clean.items() if k < 80)


def _vectors(seed):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((8, 16))
    rows = []
    for k in range(150):
        x = centers[k % 8] + rng.standard_normal(16) * rng.choice([0.0, 0.03, 0.08, 0.15])
        rows.append((k, [float(v) for v in x.astype(np.float32)], int(k % 3) if k % 11 else None))
    return rows


@pytest.mark.parametrize("block", [1024, 4])
def test_vector_links_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    rows = _vectors(block)
    bad = [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [float("nan")] + [1.0] * 15, 1), (904, [None] + [1.0] * 15, 1),
           (905, [float("inf")] * 16, 1), (906, rows[1][1][:8], 1)]
    df = spark.createDataFrame([(*r, 7) for r in rows + bad], "vec_id long, embedding array<float>, label int, weight int")
    links = {i: [] for i, _, _ in rows + bad}
    for a, x, p in rows:
        for b, y, q in rows:
            if a != b and p == q and p is not None and np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                links[a].append(b)
    root = smallest(links, [(a, b) for a in links for b in links[a]])
    want = {i: (len(links[i]), root[i], root[i] == i) for i in links}
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_dedup.near_duplicates(df).collect()}
    assert got == want and max(len(x) for x in links.values()) > 3


def test_vectors_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (None, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in vector_dedup.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 0, None)], key=repr)
    assert vector_dedup.near_duplicates(df.where("vec_id > 9")).count() == 0


def test_long_words_differ_wherever_they_differ(spark):
    """Words that swap bytes 65,536 places apart are different words."""
    words = ["a" + "x" * 65_535 + "b", "b" + "x" * 65_535 + "a", "a" + "x" * 65_535 + "b", "b" + "x" * 131_071 + "a", "a" + "x" * 131_071 + "b"]
    docs = spark.createDataFrame(list(enumerate(words, 1)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in shingle_join.jaccard_components(docs, 4, (85, 100)).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}

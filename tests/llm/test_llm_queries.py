"""Registered queries against SQL, and the pipeline against brute force."""

import os
import re
import tempfile

import pytest
from helpers import jaccard

import __spark_entry__ as registered
import corpus_pipeline
from runledger.llm import pieces
from runledger.llm.piece_sampling import decode
from runledger.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


def test_every_operator_is_registered():
    assert {int(n.split("_")[0][2:]) for n in QUERIES} == set(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(registered.queries()) and set(ORACLES) <= set(registered.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    connection = duckdb.connect()
    for file in os.listdir(FOLDER):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    cursor = connection.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    df = QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(cursor.fetchall(), key=repr)


@pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no tokenizer file")
def test_pipeline_stage_by_stage(spark):
    import random

    rng = random.Random(5)
    words = {"en": "the and with from there house water".split(), "de": "und mit von der dass haus wasser".split()}

    def text(lang, n=40):
        return " ".join(rng.choice(words[lang]) + rng.choice("abcde") * 2 for _ in range(n))

    rows = [(k, text("en" if k % 2 else "de"), "en" if k % 2 else "de", "s", 0) for k in range(60)]
    item = " ".join(f"q{rng.randrange(900)}" for _ in range(25)) + ". answer is forty two"
    rows += [(100, rows[3][1] + " extra", "en", "s", 0), (101, f"{text('en')} {item} {text('en')}", "en", "s", 0)]
    rows += [(102, "12 34 !!", "en", "s", 0), (103, None, "en", "s", 0), (104, f"{text('en')} me@here.org 10.0.0.1", None, "s", 0)]
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    left = [(r[0], r[1]) for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    root = jaccard(left, 5, (4, 5))
    left = [(i, t) for i, t in left if root[i][1] == i and item not in t]
    want = {i: re.sub(r"10\.0\.0\.1", "[IP]", re.sub(r"me@here\.org", "[EMAIL]", t)) for i, t in left}
    out = corpus_pipeline.run(spark, folder)
    got = {r["doc_id"]: r["decoded"] for r in decode(out).collect()}
    assert got == want and out.where("not lossless").count() == 0
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        nothing = stage(spark, docs.where("doc_id < 0"), folder)
        assert nothing.columns == docs.columns and nothing.count() == 0

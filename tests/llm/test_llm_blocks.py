"""What a join of many shared shingles leaves on disk at once, and how rare shingles are told from others."""

import random
import time

import numpy as np
from helpers import jaccard
from pyspark.sql import functions as F

from runledger.llm import shingle_join
from runledger.llm.common import Scratch


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(k).getName() for k in range(files.size()))
    return {name for name in names if name.startswith("shuffle_")}


def test_kept_tables_leave_no_shuffle_files(spark):
    before, option = _shuffle_files(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(option, None)
    grouped = spark.range(20_000).groupBy((F.col("id") % 5000).alias("k")).count()
    kept = Scratch(spark, "t").keep(grouped.join(spark.range(5000).withColumnRenamed("id", "k").hint("merge"), "k"), "kept")
    until = time.time() + 5
    while _shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not _shuffle_files(spark) - before
    assert kept.count() == 5000 and spark.conf.get(option, None) == was
    # The frame itself can still be computed, also for the same rows again.
    assert grouped.count() == 5000 and grouped.agg(F.sum("count")).first()[0] == 20_000


def test_shingles_of_some_texts_come_after_those_of_one():
    """A thousand million shingles, of which some stand in 300 texts: nearly none of these is in a prefix of a fifth."""
    rng = np.random.default_rng(5)
    weights = rng.poisson(1e9 / shingle_join.BINS, shingle_join.BINS)
    common = rng.integers(0, 2**64, 1000, dtype=np.uint64)
    np.add.at(weights, (common >> shingle_join._SHIFT).astype(np.int64), 300)
    levels = shingle_join.levels_of(weights)
    own = np.concatenate([common, rng.integers(0, 2**64, 9000, dtype=np.uint64)])
    tokens = shingle_join.ranked(own, levels)
    first = set(tokens[: len(tokens) // 5].tolist())
    assert len(tokens) == 10_000
    assert sum(t in first for t in shingle_join.ranked(common, levels).tolist()) < 10


def test_levels_count_every_text(spark):
    docs = spark.createDataFrame([(f"{'a b c d e ' if k % 3 else ''}x{k} y{k} z{k} u{k} v{k}",) for k in range(90)], "text string")
    levels = shingle_join._levels(docs.repartition(7), 5)
    shared, alone = (next(shingle_join._sets(docs.where(f"text LIKE '{t}%'").limit(1).toArrow().to_batches()[0], 5))[1] for t in ("a", "x"))
    of = lambda own: levels[(own >> shingle_join._SHIFT).astype(np.int64)]
    assert len(shared) == 6 and len(alone) == 1
    assert of(shared).max() > of(alone).max() and sorted(of(shared))[-2] == of(alone).max()


def test_blocks_hold_parts_and_give_the_same_groups(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randint(20, 60))] for _ in range(12)]
    rows = [(0, None), (1, "")]
    for k in range(2, 140):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2])):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((k, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = jaccard(rows, 4, (7, 10))
    kept, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, rows, name: kept.append((name, out := keep(self, rows, name), out.count())) or out)
    for least, many in ((1 << 25, False), (100, True)):
        kept.clear()
        monkeypatch.setattr(shingle_join, "BLOCK", least)
        monkeypatch.setattr(shingle_join, "VERIFIED", least)
        got = {r[0]: (r[1], r[2]) for r in shingle_join.jaccard_components(df, 4, (7, 10)).collect()}
        assert got == want
        count = {name: [n for x, _, n in kept if x == name] for name in ("shared", "mixed", "star-sets")}
        if many:
            assert len(count["shared"]) == len(count["mixed"]) == shingle_join.MOST_BLOCKS and len(count["star-sets"]) > 2
            assert max(count["shared"]) < 0.5 * sum(count["shared"]) and sum(count["shared"]) == whole
        else:
            whole = sum(count["shared"])
            assert all(len(x) == 1 for x in count.values()) and whole > 300

"""Repeated byte strings against brute force."""

import random

import pytest
from helpers import without_repeats

from runledger.llm import repeats


def _rows(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(1, 9))) for _ in range(400)]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))

    base = [text(rng.randint(20, 300)) for _ in range(12)]
    rows = [None, "", "x", "x" * 2000, "ab " * 500, base[0] + base[0], base[1][:200], base[1][100:300]]
    while len(rows) < 90:
        kind = rng.random()
        if kind < 0.3:
            rows.append(rng.choice(base))
        elif kind < 0.6:
            near = list(rng.choice(base))
            for _ in range(rng.randint(1, 5)):
                near[rng.randrange(len(near))] = rng.choice("abé")
            rows.append("".join(near))
        else:
            part = rng.choice(base)
            k = rng.randrange(len(part))
            rows.append(text(rng.randint(0, 20)) + part[k : k + rng.randint(60, 300)] + text(rng.randint(0, 20)))
    return rows


@pytest.mark.parametrize(("seed", "group"), [(1, 4096), (2, 4096), (3, 6)])
def test_removed_bytes_are_exact(spark, monkeypatch, seed, group):
    monkeypatch.setattr(repeats, "GROUP", group)  # small: hot anchors are cut in halves, again and again
    rows = _rows(seed)
    df = spark.createDataFrame([(i, t, i, "k") for i, t in enumerate(rows)], "doc_id long, text string, number long, key string")
    got = {r[0]: tuple(r[1:5]) for r in repeats.remove_repeats(df, 128).collect()}
    assert got == dict(enumerate(without_repeats(rows, 128)))


def test_empty_table_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a" * 300), (1, "a" * 300), (1, "b" * 100), (None, None)], "doc_id long, text string")
    assert repeats.remove_repeats(df.where("doc_id = 5"), 128).count() == 0
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in repeats.remove_repeats(df, 128).collect())
    assert got == [(0, 0, 0), (1, 100, 0), (1, 300, 300), (1, 300, 300)]
    with pytest.raises(ValueError):
        repeats.remove_repeats(df, 100)


def test_halves_that_are_the_same_runs_of_one_text_do_not_repeat(spark, monkeypatch):
    # Cut twice, an anchor's runs are in parts that an anchor 16 or 32 bytes on has too.
    monkeypatch.setattr(repeats, "GROUP", 4)
    rng = random.Random(5)

    def some(n):
        return "".join(rng.choice("abcdefgh") for _ in range(n))

    core = some(127)  # one byte short of a repeat
    rows = [some(199) + chr(65 + k) + core + chr(65 + k) + some(199) for k in range(20)]
    rows.append(some(70) + rows[0][190:340] + some(70))
    hits = spark.createDataFrame([(k, t, [t.index(core) + p for p in (30, 46, 62)]) for k, t in enumerate(rows)], "number long, text string, places array<long>")
    spans = repeats.repeated_spans(repeats._surroundings(hits, 128), repeats.Scratch(spark, "repeats"), 128).collect()
    gone = {k: sum(b - a for a, b in repeats.merged([(s["begin"], s["end"]) for s in spans if s["number"] == k])) for k in range(21)}
    assert gone == {k: row[1] for k, row in enumerate(without_repeats(rows, 128))}
    assert {k for k, n in gone.items() if n} == {0, 20}


def test_anchors_do_not_depend_on_parts(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 30_000).astype(np.uint8)
    whole = {int(p) for places, _, _ in repeats.anchors(data, 400) for p in places}
    # Each run holds a chosen place with all of its bytes.
    chosen = np.array(sorted(whole))
    for start in range(0, len(data) - 400, 97):
        at = np.searchsorted(chosen, start)
        assert at < len(chosen) and chosen[at] + repeats.ANCHOR <= start + 400

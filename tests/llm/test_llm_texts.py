"""Pieces, token counts and language ID."""

import collections
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from runledger.llm import language, piece_sampling, pieces, token_counts
from runledger.llm.common import Scratch

needs_model = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no tokenizer file")
ODD = ["", "a", "▁", "▁a b▁", " ▁ ", "  two  spaces ", "\n\n\t x", "日本語テキスト", "🎉 emoji", "é" * 100, "x" * 1000, "\x00", "a\r\nb", " ", "\n"]


def _frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, key string, id long")


@needs_model
def test_sampled_pieces_are_lossless_and_reproducible(spark):
    df = _frame(spark, [*ODD, None, "The quick brown fox " * 200])
    coded = piece_sampling.encode(df)
    rows = {r["doc_id"]: r for r in coded.collect()}
    assert len(rows) == len(ODD) + 2 and all(r["lossless"] for r in rows.values())
    assert rows[len(ODD)]["pieces"] is None and rows[0]["pieces"] == []
    again = {r["doc_id"]: r["pieces"] for r in piece_sampling.encode(df.repartition(7)).collect()}
    assert again == {i: r["pieces"] for i, r in rows.items()}
    text = {r["doc_id"]: r["decoded"] for r in piece_sampling.decode(coded).collect()}
    assert [text[i] for i in range(len(ODD))] == ODD and text[len(ODD)] is None
    other = piece_sampling.encode(df.where(f"doc_id = {len(ODD) + 1}"), alpha=0.0001, seed=1).first()["pieces"]
    assert other != rows[len(ODD) + 1]["pieces"]
    assert piece_sampling.encode(df.where("doc_id < 0")).count() == 0


@needs_model
def test_segmentations_have_their_probabilities():
    vocab, alpha = pieces.vocabulary(pieces.MODEL), 0.0001
    ways = {}

    def split(rest, made, score):
        if not rest:
            ways[tuple(made)] = score
        for k in range(1, len(rest) + 1):
            if rest[:k] in vocab.ids:
                split(rest[k:], [*made, vocab.ids[rest[:k]]], score + alpha * vocab.scores[rest[:k]])

    split("▁thatn", [], 0.0)
    total, n = sum(map(math.exp, ways.values())), 40_000
    ids, at = piece_sampling._encoded(piece_sampling.lattices(pieces.MODEL), ["thatn"] * n, np.arange(n), alpha)
    seen = collections.Counter(tuple(ids[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True))
    for way, score in ways.items():
        assert abs(seen[way] / n - math.exp(score) / total) < 0.012


@needs_model
def test_long_words_are_walked_in_blocks(spark, monkeypatch):
    """A word longer than any block comes back whole; blocks of another size give the same pieces."""
    rng = np.random.default_rng(8)
    words = ["x" * 200_000, "".join(rng.choice(list("abcdefgh日本語🎉"), 40_000)), "y " + "ab" * 3000]
    coded = piece_sampling.encode(_frame(spark, [*words, *words]))
    rows = {r["doc_id"]: r for r in coded.collect()}
    assert all(r["lossless"] for r in rows.values())
    own = piece_sampling.lattices(pieces.MODEL)
    chars = np.frombuffer(words[1][:9000].encode("utf-32-le"), np.uint32)
    whole = own._walk(chars, np.uint64(9), 0.0001)
    monkeypatch.setattr(piece_sampling, "_BLOCK", 700)
    assert own._walk(chars, np.uint64(9), 0.0001).tolist() == whole.tolist()
    # One word drawn many times: as often each way as by the short path.
    word, n = np.frombuffer("▁thatn".encode("utf-32-le"), np.uint32), 8000
    ids, at = piece_sampling._encoded(own, ["thatn"] * n, np.arange(n), 0.0001)
    short = collections.Counter(tuple(ids[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True))
    seeds = piece_sampling.mix(np.arange(n, dtype=np.uint64) + np.uint64(12345))
    long = collections.Counter(tuple(own._walk(word, s, 0.0001).tolist()) for s in seeds)
    assert max(abs(long[w] - short[w]) for w in set(long) | set(short)) < 0.03 * n


@needs_model
def test_counts_are_those_of_the_tokenizer(spark):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(pieces.MODEL, "rb").read())
    model.trainer_spec.model_type = 1  # the same pieces and scores as a unigram model
    floor = min(p.score for p in model.pieces if p.type == 1 and p.score > pieces.PLACEHOLDER) - 1
    for p in model.pieces:
        p.score = floor if p.score < pieces.PLACEHOLDER else p.score
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    texts = [*ODD, "Lorem ipsum dolor sit amet, consectetur.\nÀ bientôt !!"]
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(_frame(spark, [*texts, None])).collect()}
    short = [k for k, t in enumerate(texts) if len(t) < 300]
    assert {k: got[k] for k in short} == {k: len(library.encode(texts[k])) for k in short}
    assert got[len(texts)] == 0
    counter = token_counts.counter(pieces.MODEL)
    chunks = list(dict.fromkeys(c for t in texts for c in counter.vocab.chunks(pieces.marked(t))))
    assert counter.of_chunks(chunks).tolist() == [counter.of_long(c) for c in chunks]


WORDS = {"en": "the and with from there house water", "de": "und mit von der dass haus wasser", "fr": "les avec dans pour maison eau"}


def _corpus(spark, n=300):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        lang = list(WORDS)[i % 3]
        rows.append((i, " ".join(rng.choice(WORDS[lang].split(), 12)), lang, "s"))
    rows += [(1000, None, "en", "s"), (1001, "", "de", "s"), (1002, "12 34 !!", "fr", "s"), (1003, "THE HOUSE", None, None), (1003, "THE HOUSE", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")


def test_held_out_languages_are_told(spark):
    import zlib

    df = _corpus(spark)
    rows = language.identify(df).collect()
    truth = {r["doc_id"]: r["lang"] for r in df.collect()}
    assert len(rows) == df.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        want = language.UNDETERMINED if r["doc_id"] in (1000, 1001, 1002) else truth[r["doc_id"]] or "en"
        assert r["lang_pred"] == want
    empty = language.identify(df.where("doc_id < 0"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "held_out", "lang_pred", "score"]
    untaught = language.identify(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in untaught.collect()} == {language.UNDETERMINED}


def test_language_model_is_the_counts(spark):
    """Against sums over dictionaries."""
    df = _corpus(spark, 30).where("lang is not null")
    model = language.train(df, Scratch(spark, "t"))
    counts = {lang: np.zeros(language.BINS) for lang in WORDS}
    docs = collections.Counter()
    for r in df.collect():
        if r["text"] and any(c.isalpha() for c in r["text"]):
            docs[r["lang"]] += 1
            counts[r["lang"]] += language.bin_counts(r["text"])
    assert list(model.languages) == sorted(WORDS)
    assert np.allclose(np.exp(model.priors), [docs[k] / docs.total() for k in sorted(WORDS)])
    text = "water house mit der"
    own = language.bin_counts(text)
    want = [math.log(docs[k] / docs.total()) + own @ model.block(0, language.BLOCK)[:, j] for j, k in enumerate(sorted(WORDS))]
    assert np.allclose(language.scores([text], model.block(0, language.BLOCK), model.priors)[0], want, atol=1e-3)
    # Joined training texts share one space at each joint; bins that hold none of it agree exactly.
    share = (counts["en"] + 0.5) / (counts["en"].sum() + 0.5 * language.BINS)
    assert abs(np.exp(model.block(0, language.BLOCK)[:, 1]) - share).max() < 0.02


def test_bins_do_not_depend_on_parts(monkeypatch):
    text = "abcdéfgh ijk" * 40
    whole = language.bin_counts(text)
    monkeypatch.setattr(language, "_PART", 17)
    assert (language.bin_counts(text) == whole).all()


def test_many_languages_in_blocks(spark, monkeypatch):
    """Blocks of a few languages give what one matrix gives; texts of a batch do not mix."""
    import random

    rng = random.Random(4)
    alphabets = {f"l{k:02}": [chr(0x4E00 + 40 * k + i) if k % 2 else rng.choice("abcdefghijklmnop") * 2 for i in range(12)] for k in range(23)}
    rows = [(k, "".join(rng.choices(alphabets[f"l{k % 23:02}"], k=rng.choice([1, 5, 40, 400]))), f"l{k % 23:02}") for k in range(400)]
    rows += [(1000, None, "l01"), (1001, "123", "l01"), (1002, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(df).collect()}
    monkeypatch.setattr(language, "BLOCK", 5)
    parts = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(df).collect()}
    assert {i: r[0] for i, r in whole.items()} == {i: r[0] for i, r in parts.items()}
    assert all(abs(whole[i][1] - parts[i][1]) < 1e-9 for i in whole)
    texts = [t for _, t, _ in rows[:50]]
    weights, priors = np.random.default_rng(1).random((language.BINS, 7)).astype(np.float32), np.zeros(7)
    alone = np.concatenate([language.scores([t], weights, priors) for t in texts])
    assert np.allclose(language.scores(texts, weights, priors), alone) and np.allclose(alone[3], sum(language.bin_counts(texts[3])[b] * weights[b] for b in range(language.BINS)), rtol=1e-4)

"""Language of a text: multinomial naive Bayes over hashed character n-grams.

Counts of 1- to 4-grams of the lower-cased text are gathered over every training row: each task
adds up a matrix of languages by 32,768 bins and hands out its filled entries, which Spark sums and
packs to one row a language. The log-probability matrix (bins x languages, 128 KB a language) is the
model. It is broadcast in blocks of ``BLOCK`` languages; whole texts are scored in numpy, a batch of
texts at a time, as the sparse product of their n-grams with the matrix. Each block is a pass over
the texts that goes on from the best language and the sum of the one before, so any number of
languages gives the same answer as one matrix would.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, batches_of, mix

BINS = 1 << 15
LONGEST = 4
UNDETERMINED = "und"
#: Languages whose weights a task holds at once: 32 MB.
BLOCK = 256
_PART = 1 << 18
#: Weights that are gathered in one step.
_GATHERED = 1 << 22
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Model:
    """Learned labels with the log of their share, and a table of their packed counts.

    ``counts`` has a row (label, total, counts) for each label: 32,768 longs.
    """

    languages: tuple[str, ...]
    priors: np.ndarray
    counts: DataFrame | None

    def block(self, low: int, high: int) -> np.ndarray:
        """Log probabilities of the labels from ``low`` to ``high``: bins x labels."""
        wanted = self.languages[low:high]
        rows = self.counts.where(F.col("label").between(wanted[0], wanted[-1])).orderBy("label").toArrow() if wanted else None
        out = np.zeros((BINS, len(wanted)), np.float32)
        for k in range(len(wanted)):
            own = np.frombuffer(rows.column("counts")[k].as_buffer(), np.int64)
            out[:, k] = np.log((own + 0.5) / (own.sum() + 0.5 * BINS))
        return out


def _characters(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)


def _bins(chars: np.ndarray) -> Iterator[np.ndarray]:
    """Bins of all n-grams, by n, in parts of bounded size. Ends of a text count as a space."""
    for begin in range(0, len(chars), _PART):
        part = chars[max(0, begin - LONGEST + 1) : begin + _PART].astype(np.uint64)
        if not begin:
            part = np.concatenate(([np.uint64(32)], part))
        if begin + _PART >= len(chars):
            part = np.append(part, np.uint64(32))
        fresh = 0 if not begin else LONGEST - 1
        state = np.zeros(len(part), np.uint64)
        for n in range(1, LONGEST + 1):
            # The n-gram that ends at each place; those that end in the overlap were counted before.
            state = (state[:-1] if n > 1 else state) * np.uint64(0x9E3779B97F4A7C15) + part[n - 1 :] + np.uint64(n)
            ends = state[max(0, fresh - n + 1) :]
            yield (mix(ends) >> np.uint64(49)).astype(np.int32)


def bin_counts(text: str) -> np.ndarray:
    """How often each bin occurs in a text."""
    total = np.zeros(BINS, np.int64)
    for own in _bins(_characters(text)):
        total += np.bincount(own, minlength=BINS)
    return total


def train(rows: DataFrame, scratch: Scratch, text_col: str = "text", label_col: str = "lang") -> Model:
    """Learn from all rows that have a label and a text with a letter.

    An empty training set gives a model without languages, which predicts nothing but ``und``.
    """
    pairs = rows.select(F.col(text_col).alias("text"), F.col(label_col).alias("label")).where(
        "text is not null and label is not null"
    )

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            for part in batches_of(batch, "text"):
                by_label: dict[str, list[str]] = {}
                for text, label in zip(part.column("text").to_pylist(), part.column("label").to_pylist(), strict=True):
                    if _LETTER.search(text):
                        by_label.setdefault(label, []).append(text)
                for label, texts in by_label.items():
                    own = totals.setdefault(label, np.zeros(BINS, np.int64))
                    seen[label] = seen.get(label, 0) + len(texts)
                    for text in _joined(texts):
                        own += bin_counts(text)
        for label, own in totals.items():
            used = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([label] * (len(used) + 1)), pa.array(np.append(used, -1), pa.int32()), pa.array(np.append(own[used], seen[label]))],
                ["label", "bin", "n"],
            )

    summed = pairs.mapInArrow(count, "label string, bin int, n long").groupBy("label", "bin").agg(F.sum("n").alias("n"))
    # A language has 32,768 bins at most.
    lists = summed.groupBy("label").agg(F.collect_list(F.struct("bin", "n")).alias("cells"))

    def pack(batches):
        for batch in batches:
            totals, packed = [], []
            for cells in batch.column("cells"):
                own = np.zeros(BINS + 1, np.int64)
                own[cells.values.field("bin").to_numpy()] = cells.values.field("n").to_numpy()
                totals.append(own[-1])  # bin -1
                packed.append(own[:BINS].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(totals, pa.int64()), pa.array(packed, pa.binary())], ["label", "total", "counts"])

    counts = scratch.keep(lists.mapInArrow(pack, "label string, total long, counts binary"), "counts")
    found = counts.select("label", "total").orderBy("label").toArrow()
    seen = found.column("total").to_numpy().astype(np.float64)
    return Model(tuple(found.column("label").to_pylist()), np.log(seen / seen.sum()) if len(seen) else seen, counts)


def _joined(texts: list[str]) -> Iterator[str]:
    """Short texts put together, so that few numpy calls do for many. Joints count as spaces."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= _PART // 2:
            yield "  ".join(held)
            held, size = [], 0
    if held:
        yield "  ".join(held)


def _gathered(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(bins, row)`` of all n-grams of all texts, in parts of bounded size."""
    held, rows, size = [], [], 0
    for row, text in enumerate(texts):
        chars = _characters(text)
        if len(chars) >= _PART:
            for own in _bins(chars):
                yield own, np.full(len(own), row)
            continue
        held.append(chars)
        rows.append(row)
        size += len(chars)
        if size >= _PART:
            yield from _together(held, rows)
            held, rows, size = [], [], 0
    if held:
        yield from _together(held, rows)


def _together(held: list[np.ndarray], rows: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As ``_bins`` for several texts at once: n-grams that would reach into another text are left out."""
    sizes = np.array([len(c) + 2 for c in held])
    ends = np.cumsum(sizes)
    chars = np.full(int(ends[-1]), 32, np.uint64)
    for own, end, size in zip(held, ends, sizes, strict=True):
        chars[end - size + 1 : end - 1] = own
    owner = np.repeat(np.array(rows), sizes)
    place = np.arange(len(chars)) - np.repeat(ends - sizes, sizes)
    state = np.zeros(len(chars), np.uint64)
    for n in range(1, LONGEST + 1):
        state = (state[:-1] if n > 1 else state) * np.uint64(0x9E3779B97F4A7C15) + chars[n - 1 :] + np.uint64(n)
        inside = place[n - 1 :] >= n - 1
        yield (mix(state[inside]) >> np.uint64(49)).astype(np.int32), owner[n - 1 :][inside]


def scores(texts: list[str], weights: np.ndarray, priors: np.ndarray) -> np.ndarray:
    """Log joint probability of each text and language."""
    out = np.tile(priors, (len(texts), 1))
    step = max(1, _GATHERED // max(1, weights.shape[1]))
    for bins, row in _gathered(texts):
        for low in range(0, len(bins), step):
            some = row[low : low + step]
            starts = np.flatnonzero(np.append(True, some[1:] != some[:-1]))
            out[some[starts]] += np.add.reduceat(weights[bins[low : low + step]], starts, axis=0, dtype=np.float64)
    return out


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), scratch: Scratch | None = None) -> DataFrame:
    """``(id, lang_pred, score, *keep)`` for each row, from its whole text alone.

    ``score`` is the posterior probability of the label, from 0 to 1. Texts that are null or have
    no letter get ``und`` and 0. Of equal scores the first label in order wins. Rows that repeat an
    id are each returned; ids may be null. ``keep`` names further columns to pass on. More than
    ``BLOCK`` languages are taken in several passes, each of which is written.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "language")
    names = [id_col, *(c for c in keep if c != id_col)]
    rows = docs.select(*names, *([] if text_col in names else [F.col(text_col).alias("__text")]))
    source = text_col if text_col in names else "__text"
    carried = rows.columns
    rows = rows.select("*", F.lit(None).cast("string").alias("__label"), F.lit(float("-inf")).alias("__best"), F.lit(float("-inf")).alias("__all"))
    blocks = range(0, max(1, len(model.languages)), BLOCK)
    for low in blocks:
        labels = model.languages[low : low + BLOCK]
        sent = spark.sparkContext.broadcast((model.block(low, low + BLOCK), model.priors[low : low + BLOCK]))

        def score(batches, labels=labels, sent=sent):
            for batch in (part for whole in batches for part in batches_of(whole, source)):
                texts = batch.column(source).to_pylist()
                label = batch.column("__label").to_pylist()
                best, total = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("__best", "__all"))
                some = np.array([k for k, t in enumerate(texts) if t is not None and labels and _LETTER.search(t)], np.int64)
                if len(some):
                    logs = scores([texts[k] for k in some], *sent.value)
                    top = logs.max(axis=1)
                    # The sum of all languages' probabilities so far, by their logarithms.
                    high = np.maximum(top, total[some])
                    total[some] = high + np.log(np.exp(total[some] - high) + np.exp(logs - high[:, None]).sum(axis=1))
                    for k, b, log in zip(some, logs.argmax(axis=1), top, strict=True):
                        if label[k] is None or log > best[k]:
                            label[k], best[k] = labels[b], log
                rest = [batch.column(c) for c in carried]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(label, pa.string()), pa.array(best), pa.array(total)], [*carried, "__label", "__best", "__all"])

        rows = rows.mapInArrow(score, rows.schema)
        if low + BLOCK < len(model.languages):
            rows = scratch.keep(rows, "scored")
    sure = F.when(F.col("__label").isNotNull(), F.exp(F.col("__best") - F.col("__all"))).otherwise(F.lit(0.0))
    return rows.select(*names, F.coalesce("__label", F.lit(UNDETERMINED)).alias("lang_pred"), F.least(sure, F.lit(1.0)).alias("score"))


def held_out(id_column):
    """Whether crc32 of the id as text is divisible by 5. A null id counts as the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """``(id, held_out, lang_pred, score)``: learn from the rows that are not held out, predict all.

    See ``train`` and ``predict``. Null labels are not learned from; an empty table gives an empty
    result. There may be any number of labels; text kinds of one language are labels of their own.
    Further columns of ``docs`` are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("__t"), F.col(label_col).alias("__l"))
    model = train(rows.where(~held_out(F.col(id_col))), Scratch(docs.sparkSession, "language"), "__t", "__l")
    out = predict(rows, model, id_col, "__t")
    return out.withColumn("held_out", held_out(F.col(id_col))).select(id_col, "held_out", "lang_pred", "score")

"""Token counts under a unigram vocabulary, without the tokens.

Method: an Aho-Corasick automaton enumerates all pieces that end at each character; dynamic
programming carries the best score and the number of pieces that reach it. Ties go as in the
tokenizer: at one place the earliest start, that is the longest last piece, wins, and an uncovered
character wins over nothing but less. Scores are added exactly. (The tokenizer's own library adds
them in single precision; where its sums lose digits it may count otherwise.)

A text is counted chunk by chunk (see ``pieces``). The automaton runs once over the different
chunks of a batch; the dynamic programming then goes through their characters by place, for all
chunks together. Very long chunks are worked on alone, match by match.
"""

from __future__ import annotations

import functools
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batches_of
from .pieces import MODEL, Vocabulary, marked, vocabulary

#: Chunks longer than this are counted one by one.
LONG = 128


class Counter:
    """Number of pieces of each chunk in its best segmentation."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.gap = next(c for c in "\n\x00\x01\x02" if not any(c in p for p in vocab.ids))
        self.automaton = ahocorasick.Automaton()
        self.lengths = np.array([len(p) for p in vocab.scores])
        self.scores = np.array(list(vocab.scores.values()))
        for k, piece in enumerate(vocab.scores):
            self.automaton.add_word(piece, k)
        self.automaton.make_automaton()

    def of_long(self, chunk: str) -> int:
        """The dynamic programming in its plain form."""
        best = [0.0] + [None] * len(chunk)
        count = [0] * (len(chunk) + 1)
        ways: dict[int, list[int]] = {}
        for end, piece in self.automaton.iter(chunk):
            ways.setdefault(end, []).append(piece)  # longest first
        for end in range(len(chunk)):
            single = False
            for piece in ways.get(end, ()):
                start = end + 1 - int(self.lengths[piece])
                single |= start == end
                score = best[start] + float(self.scores[piece])
                if best[end + 1] is None or score > best[end + 1]:
                    best[end + 1], count[end + 1] = score, count[start] + 1
            if not single:
                score = best[end] + self.vocab.uncovered
                if best[end + 1] is None or score > best[end + 1]:
                    best[end + 1], count[end + 1] = score, count[end] + len(chunk[end].encode())
        return count[-1]

    def of_chunks(self, chunks: list[str]) -> np.ndarray:
        """Counts of different chunks."""
        out = np.zeros(len(chunks), np.int64)
        sizes = np.array([len(c) for c in chunks], np.int64)
        for k in np.flatnonzero(sizes > LONG):
            out[k] = self.of_long(chunks[k])
        short = np.flatnonzero(sizes <= LONG)
        if len(short):
            out[short] = self._of_short([chunks[k] for k in short], sizes[short])
        return out

    def _of_short(self, chunks: list[str], sizes: np.ndarray) -> np.ndarray:
        joined = self.gap.join(chunks)
        begins = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
        found = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), np.int64).reshape(-1, 2)
        end, length, score = found[:, 0], self.lengths[found[:, 1]], self.scores[found[:, 1]]
        # Characters without a piece of their own: one way more, after all others that end there.
        bare = np.ones(len(joined), bool)
        bare[end[length == 1]] = False
        bare[(begins + sizes)[:-1]] = False
        bare = np.flatnonzero(bare)
        width = np.array([len(joined[k].encode()) for k in bare], np.int64)
        end = np.concatenate((end, bare))
        step = np.concatenate((np.ones(len(length), np.int64), width))
        length = np.concatenate((length, np.ones(len(bare), np.int64)))
        score = np.concatenate((score, np.full(len(bare), self.vocab.uncovered)))
        # Node b + k is the place after k characters of the chunk that begins at b.
        best, count = np.zeros(len(joined) + 1), np.zeros(len(joined) + 1, np.int64)
        local = end - begins[np.searchsorted(begins, end, "right") - 1]
        order = np.lexsort((end, local))  # stable: longest first, an uncovered character last
        local, end, length, score, step = (x[order] for x in (local, end, length, score, step))
        edges = np.searchsorted(local, np.arange(local[-1] + 2 if len(local) else 1))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            to, start = end[a:b] + 1, end[a:b] + 1 - length[a:b]
            total = best[start] + score[a:b]
            first = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            top = np.maximum.reduceat(total, first)
            group = np.cumsum(np.append(True, to[1:] != to[:-1])) - 1
            hits = np.flatnonzero(total == top[group])
            hits = hits[np.append(True, group[hits][1:] != group[hits][:-1])]
            # The place after a chunk's last character is the next one's begin less the gap.
            best[to[hits]], count[to[hits]] = top, count[start[hits]] + step[a:b][hits]
        return count[begins + sizes]

    def of_texts(self, texts: list[str | None]) -> np.ndarray:
        index: dict[str, int] = {}
        number, which = [], []
        for text in texts:
            found = self.vocab.chunks(marked(text)) if text else []
            number.append(len(found))
            which.append(np.array([index.setdefault(c, len(index)) for c in found], np.int64))
        counts = self.of_chunks(list(index))
        return np.array([counts[w].sum() for w in which], np.int64)


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """``(id, n_tokens)`` for each row, from its whole text.

    Null and empty texts have no tokens. Repeated rows are each returned, ids may be null, further
    columns are ignored. ``model`` is the path of the vocabulary file on every executor.
    """

    def count(batches):
        own = counter(model)
        for batch in batches:
            for part in batches_of(batch, "text"):
                counts = own.of_texts(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(counts)], ["id", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(count, f"id {kind}, n_tokens long").withColumnRenamed("id", id_col)

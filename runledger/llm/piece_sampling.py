"""Reproducible sampled segmentations into SentencePiece pieces, and lossless decoding.

Method: forward filtering, backward sampling over the lattice of pieces. The forward pass adds up
the weights of all segmentations of each prefix; the backward pass draws the last piece in
proportion to them, and so on to the front, which draws whole segmentations with their exact
probabilities. A piece weighs exp(alpha * score). Each draw comes from a hash of the row's key, the
chunk's number in the text and the step, so a row's pieces depend on nothing else: not on
partitions, batches or retries.

Texts are worked on chunk by chunk (see ``pieces``), equal chunks of a batch share one lattice, and
chunks of equal length are filtered and sampled together in numpy. A chunk of over ``LONG`` characters,
such as a line without spaces, is walked alone in blocks of places: the forward pass keeps its sums at
the borders of blocks only, and the backward pass works each block out again. So memory follows the
text and its pieces, not the lattice, and time is the same for each character.
"""

from __future__ import annotations

import functools
import math
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import batches_of, mix, string_bytes
from .pieces import MARK, MODEL, Vocabulary, marked, vocabulary

ALPHA = 0.0005
_STEP = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = np.uint64(0xD1B54A32D192ED03)
_TABLE = 1 << 20
#: Lattice cells (chunks x places x piece lengths) that are filtered at once.
_CELLS = 1 << 19
UNCOVERED = -1
#: Chunks of more characters are walked alone; places of such a chunk that are worked on at once.
LONG, _BLOCK = 4096, 8192
#: Stands for a literal U+2581, which else would read as a space: a code point no text can hold.
_LITERAL = "\ud800"


class Lattices:
    """Vocabulary as a hash table of code-point strings, for lookups of many strings at once."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        pieces = list(vocab.ids)
        self.keys = np.zeros(len(pieces), np.uint64)
        for k, piece in enumerate(pieces):
            h = np.uint64(0)
            for c in np.frombuffer(piece.encode("utf-32-le"), np.uint32):
                h = self._next(np.array([h]), np.array([c]))[0]
            self.keys[k] = h
        if len(set(self.keys.tolist())) < len(pieces):
            raise ValueError("Pieces collide in the lookup table")
        self.ids = np.array([vocab.ids[p] for p in pieces], np.int32)
        self.scores = np.array([vocab.scores[p] for p in pieces])
        # Open addressing; `probes` is the longest way to any piece.
        self.slots, self.probes = np.full(_TABLE, -1, np.int32), 1
        for k, key in enumerate(self.keys):
            at, way = int(key) % _TABLE, 1
            while self.slots[at] >= 0:
                at, way = (at + 1) % _TABLE, way + 1
            self.slots[at], self.probes = k, max(self.probes, way)
        lengths = [len(b) for b in vocab.bytes_of]
        self.lengths = np.array(lengths, np.int64)
        self.flat = np.frombuffer(b"".join(vocab.bytes_of), np.uint8)
        self.begins = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        self.byte_ids = np.array(vocab.byte_ids, np.int32)

    @staticmethod
    def _next(h: np.ndarray, chars: np.ndarray) -> np.ndarray:
        return mix(h * _STEP + chars.astype(np.uint64) + np.uint64(1))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of the piece with each key, or -1."""
        at = (keys & np.uint64(_TABLE - 1)).astype(np.int32)
        found = np.full(len(keys), -1, np.int32)
        left = np.arange(len(keys))
        for _ in range(self.probes):
            slot = self.slots[at]
            hit = (slot >= 0) & (self.keys[slot] == keys[left])
            found[left[hit]] = slot[hit]
            go = ~hit & (slot >= 0)
            if not go.any():
                break
            left, at = left[go], (at[go] + 1) & (_TABLE - 1)
        return found

    def filtered(self, chars: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
        """Forward pass over chunks of one length (rows x characters).

        Returns, by (row, end - 1, piece length - 1), the cumulative probability of the last piece
        of a segmentation that ends there, and its id (-1: an uncovered character).
        """
        rows, n = chars.shape
        most = min(n, self.vocab.longest)
        score = np.full((rows, n, most), -np.inf)
        ids = np.full((rows, n, most), UNCOVERED, np.int32)
        keys = np.zeros((rows, n), np.uint64)
        for k in range(most):
            # keys[:, s] becomes the key of the k + 1 characters from s on.
            keys = self._next(keys[:, : n - k], chars[:, k:])
            found = self.find(keys.ravel()).reshape(keys.shape)
            hit = found >= 0
            score[:, k:, k] = np.where(hit, alpha * self.scores[found], -np.inf if k else alpha * self.vocab.uncovered)
            ids[:, k:, k] = np.where(hit, self.ids[found], UNCOVERED)
        total = np.full((rows, n + 1), -np.inf)
        total[:, 0] = 0
        for end in range(1, n + 1):
            reach = min(end, most)
            own = score[:, end - 1, :reach]
            own += total[:, end - reach : end][:, ::-1]
            top = own.max(axis=1, keepdims=True)
            weight = np.exp(own - top)
            summed = np.cumsum(weight, axis=1)
            total[:, end] = top[:, 0] + np.log(summed[:, -1])
            score[:, end - 1, :reach] = summed / summed[:, -1:]
            score[:, end - 1, reach:] = 2.0
        return score, ids

    def sample(self, chunks: list[str], seeds: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all chunks put together, and where each chunk's begin and end."""
        index: dict[str, int] = {}
        which = np.array([index.setdefault(c, len(index)) for c in chunks], np.int64)
        different = list(index)
        sizes = np.array([len(c) for c in different], np.int64)
        codes = np.frombuffer("".join(different).encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = np.concatenate(([0], np.cumsum(sizes)))
        by_size = np.argsort(sizes, kind="stable")
        order = np.argsort(sizes[which], kind="stable") if len(which) else which
        order_sizes = sizes[which][order]
        counts = np.zeros(len(chunks), np.int64)
        steps: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        place = np.zeros(len(different), np.int64)
        alone: list[tuple[int, np.ndarray]] = []
        for k in np.flatnonzero(sizes[which] > LONG).tolist():
            at = which[k]
            ids = self._walk(codes[begins[at] : begins[at + 1]], seeds[k], alpha)
            counts[k] = len(ids)
            alone.append((k, ids))
        for n in np.unique(sizes[sizes <= LONG]):
            rows = by_size[np.searchsorted(sizes[by_size], n) : np.searchsorted(sizes[by_size], n, "right")]
            place[rows] = np.arange(len(rows))
            mine = order[np.searchsorted(order_sizes, n) : np.searchsorted(order_sizes, n, "right")]
            mine = mine[np.argsort(place[which[mine]], kind="stable")]
            at_row = place[which[mine]]
            step = max(1, _CELLS // (int(n) * min(int(n), self.vocab.longest)))
            for low in range(0, len(rows), step):
                some = rows[low : low + step]
                chars = codes[begins[some][:, None] + np.arange(n)]
                cumulative, ids = self.filtered(chars, alpha)
                a, b = np.searchsorted(at_row, [low, low + len(some)])
                self._draw(mine[a:b], at_row[a:b] - low, chars, cumulative, ids, seeds, counts, steps)
        ends = np.concatenate(([0], np.cumsum(counts)))
        out = np.zeros(ends[-1], np.int32)
        for k, ids in alone:
            out[ends[k] : ends[k + 1]] = ids
        for which_chunks, behind, width, own in steps:
            # `behind`: pieces of the chunk from the first of this step to the chunk's end.
            at = ends[which_chunks + 1] - behind
            for k in range(4):
                more = width > k
                out[at[more] + k] = own[more, k]
        return out, ends

    def _matches(self, chars: np.ndarray, low: int, high: int, alpha: float) -> tuple[list[int], list[int], list[float], list[int]]:
        """Pieces that end at the places ``low + 1`` to ``high``: where those of each place begin in the
        lists, and their lengths, weights and ids, by place and length."""
        most = self.vocab.longest
        begin = max(0, low - most + 1)
        part = chars[begin:high]
        keys = np.zeros(len(part), np.uint64)
        found = []
        for k in range(min(most, len(part))):
            keys = self._next(keys[: len(part) - k], part[k:])
            number = self.find(keys)
            # A piece of k + 1 characters from `start` on ends at start + k + 1.
            end = np.arange(begin, begin + len(keys)) + k + 1
            inside = (end > low) & ((number >= 0) | (k == 0))
            number, end = number[inside], end[inside]
            weight = np.where(number >= 0, alpha * self.scores[number], alpha * self.vocab.uncovered)
            found.append((end, np.full(len(end), k + 1), weight, np.where(number >= 0, self.ids[number], UNCOVERED)))
        end, length, weight, ids = (np.concatenate([f[c] for f in found]) for c in range(4))
        order = np.lexsort((length, end))
        first = np.searchsorted(end[order], np.arange(low + 1, high + 2))
        return first.tolist(), length[order].tolist(), weight[order].tolist(), ids[order].tolist()

    def _totals(self, chars: np.ndarray, low: int, high: int, before: list[float], alpha: float):
        """Log sums of all segmentations up to each place from ``low - len(before) + 1`` to ``high``, and the pieces."""
        first, length, weight, ids = matches = self._matches(chars, low, high, alpha)
        totals = list(before)
        for place in range(high - low):
            now = len(totals)
            a, b = first[place], first[place + 1]
            ways = [weight[j] + totals[now - length[j]] for j in range(a, b)]
            top = max(ways)
            totals.append(top if b - a == 1 else top + math.log(sum([math.exp(w - top) for w in ways])))
        return totals, matches

    def _walk(self, chars: np.ndarray, seed: np.uint64, alpha: float) -> np.ndarray:
        """Piece ids of one long chunk."""
        most = self.vocab.longest
        borders, before = [], [0.0]
        for low in range(0, len(chars), _BLOCK):
            borders.append(before)
            before = self._totals(chars, low, min(len(chars), low + _BLOCK), before, alpha)[0][-most:]
        out, end, turn = array("i"), len(chars), 0
        draws: list[float] = []
        for block in range(len(borders) - 1, -1, -1):
            low = block * _BLOCK
            if end <= low:
                continue
            before = borders[block]
            totals, (first, length, weight, ids) = self._totals(chars, low, end, before, alpha)
            while end > low:
                if turn % _BLOCK == 0:
                    numbers = np.arange(turn + 1, turn + 1 + _BLOCK, dtype=np.uint64)
                    draws = ((mix(seed + _STEP * numbers) >> np.uint64(11)).astype(np.float64) * 2.0**-53).tolist()
                left = draws[turn % _BLOCK]
                now = len(before) + end - low - 1
                a, b = first[end - low - 1], first[end - low]
                for j in range(a, b):
                    left -= math.exp(weight[j] + totals[now - length[j]] - totals[now])
                    if left < 0:
                        break
                turn += 1
                if ids[j] == UNCOVERED:
                    char = chr(chars[end - 1])
                    coded = (MARK if char == _LITERAL else char).encode()
                    out.extend(int(self.byte_ids[c]) for c in reversed(coded))
                else:
                    out.append(ids[j])
                end -= length[j]
        return np.array(out, np.int32)[::-1]

    def _draw(self, mine, row, chars, cumulative, ids, seeds, counts, steps) -> None:
        """Backward pass: one piece a step for every chunk that is not yet at its front."""
        end = np.full(len(mine), chars.shape[1])
        turn = 0
        while len(mine):
            u = (mix(seeds[mine] + _STEP * np.array([turn + 1], np.uint64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            size = (cumulative[row, end - 1] <= u[:, None]).sum(axis=1)
            own = ids[row, end - 1, size]
            width = np.ones(len(mine), np.int64)
            pieces = np.zeros((len(mine), 4), np.int32)
            pieces[:, 0] = own
            for k in np.flatnonzero(own == UNCOVERED):
                char = chr(chars[row[k], end[k] - 1])
                coded = (MARK if char == _LITERAL else char).encode()
                width[k] = len(coded)
                pieces[k, : len(coded)] = self.byte_ids[list(coded)]
            counts[mine] += width
            steps.append((mine, counts[mine], width, pieces))
            end = end - size - 1
            go = end > 0
            mine, row, end = mine[go], row[go], end[go]
            turn += 1

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts whose pieces lie between ``offsets``, and where each begins and ends.

        The space that encoding put before a text is dropped.
        """
        lengths = self.lengths[ids]
        after = np.concatenate(([0], np.cumsum(lengths)))
        out = self.flat[np.repeat(self.begins[ids] - after[:-1], lengths) + np.arange(after[-1])]
        ends = after[offsets]
        first = ends[:-1][np.diff(ends) > 0]
        keep = np.ones(len(out), bool)
        keep[first] = False
        return out[keep], np.concatenate(([0], np.cumsum(np.maximum(np.diff(ends) - 1, 0))))


@functools.lru_cache(maxsize=2)
def lattices(path: str) -> Lattices:
    return Lattices(vocabulary(path))


def _encoded(own: Lattices, texts: list[str | None], keys: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts, and where each text's begin and end."""
    chunks: list[str] = []
    numbers = []
    for text in texts:
        found = own.vocab.chunks(marked(text)) if text else []
        if text and MARK in text:
            found = _with_literal_marks(own, text)
        chunks += found
        numbers.append(len(found))
    first = np.concatenate(([0], np.cumsum(numbers))).astype(np.int64)
    number = np.arange(len(chunks)) - np.repeat(first[:-1], numbers)
    seeds = mix(np.repeat(mix(keys.astype(np.uint64)), numbers) + _CHUNK * number.astype(np.uint64))
    ids, ends = own.sample(chunks, seeds, alpha)
    return ids, ends[first]


def _with_literal_marks(own: Lattices, text: str) -> list[str]:
    out: list[str] = []
    for k, part in enumerate(text.split(MARK)):
        if k:
            out.append(_LITERAL)
        spaced = part.replace(" ", MARK) if k else marked(part) or MARK
        out += own.vocab.chunks(spaced)
    return out


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, alpha: float = ALPHA, seed: int = 0
) -> DataFrame:
    """``(id, text_sha256, pieces, lossless)`` for each row: sampled pieces of its whole text.

    ``lossless`` tells whether decoding the pieces gives the text back, byte for byte. Null texts
    have null pieces, empty texts none; both are lossless. A literal U+2581 is written in bytes.
    Texts may be of any length, with or without spaces. Rows with equal keys and texts get equal pieces; a null key counts as 0 and any other key as
    itself, so keys must be integers. Other columns are ignored.
    """

    def sample(batches):
        own = lattices(model)
        for batch in batches:
            for part in batches_of(batch, "text", 1 << 20):
                keys = part.column("key").to_numpy(zero_copy_only=False)
                texts = part.column("text").to_pylist()
                ids, offsets = _encoded(own, texts, keys, alpha)
                data, ends = own.decode(ids, offsets)
                want, at = string_bytes(part.column("text"))
                same = [
                    np.array_equal(data[a:b], want[c:d])
                    for a, b, c, d in zip(ends[:-1], ends[1:], at[:-1], at[1:], strict=True)
                ]
                listed = pa.ListArray.from_arrays(
                    pa.array(offsets.astype(np.int32), mask=np.append(part.column("text").is_null().to_numpy(zero_copy_only=False), False)),
                    pa.array(ids),
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("sha"), listed, pa.array(same, pa.bool_())],
                    ["id", "text_sha256", "pieces", "lossless"],
                )

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.sha2(F.col(text_col), 256).alias("sha"),
        F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")), F.lit(seed)).alias("key"),
        F.col(text_col).alias("text"),
    )
    out = rows.mapInArrow(sample, f"id {id_type}, text_sha256 string, pieces array<int>, lossless boolean")
    return out.withColumnRenamed("id", id_col)


def decode(rows: DataFrame, pieces_col: str = "pieces", into: str = "decoded", model: str = MODEL) -> DataFrame:
    """Add the text of a column of piece ids; null pieces give a null text."""

    def read(batches):
        own = lattices(model)
        for batch in batches:
            lists = batch.column(pieces_col)
            sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            data, ends = own.decode(flat, np.concatenate(([0], np.cumsum(sizes))).astype(np.int64))
            whole, valid = data.tobytes(), lists.is_valid().to_pylist()
            texts = [whole[a:b].decode() if ok else None for ok, a, b in zip(valid, ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, into])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(read, f"{schema}, `{into}` string")

"""Benchmark decontamination: documents that hold an item of a benchmark, also reworded.

Method: latent semantic retrieval. Texts are cut into passages; a randomised SVD (Halko and others,
2011) of the TF-IDF matrix of passages gives a latent space; passages of all documents whose cosine
with a passage of an item is high enough are candidates. A candidate counts if the longest common
subsequence of words covers the item, or covers half of it and holds its answer, the item's last
sentence, word for word.

* Words are runs of letters and digits in lower case, hashed to ``TERMS`` terms. Document
  frequencies are counted over the passages of all documents.
* The SVD is fitted on the passages of all documents, copies too, and of all items; tasks add up
  their part of each product with the matrix. Components are scaled to equal variance and terms to
  equal length, since else common words, or a few words of texts with many copies, make passages
  alike.
* The space is fitted on passages of ``BLOCK`` words. Items of fewer than ``BLOCK`` words are
  looked for in passages of at most twice their length, the others in passages of ``2 * BLOCK``.
* Words of a passage that are not the item's make its vector longer and the cosine smaller, so the
  cosine that is asked for shrinks by as much. No term is without weight, however frequent.
* Of the passages that are near, those are left around which enough words of the item stand for
  the longest common subsequence to be long enough: a bound that loses no document.
* All documents are searched. First a bound that loses none: half of an item's words in order, in a
  window of one and a half times its length, must include some of its rarer words, at least as many
  as half its length less the places of its other words. Only documents with such a window get
  latent vectors, for all their passages.
* The items are the stated query set: they are sent to the tasks, in blocks of ``ITEMS`` at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, batches_of, letter_words, string_bytes

TERMS = 1 << 14
RANK = 96
BLOCK = 16
ITEMS = 4096
LEAST_COSINE = 0.4
COVERED = 0.8
PARTLY = 0.5
_ROWS = 4096
#: Passages that are multiplied in one step, and those that one written row holds.
_MULTIPLIED = 1 << 14
_PACKED = 512
#: Places of candidate passages that are looked at in one step.
_PLACES = 1 << 20
_CHUNKS = 64
#: Rarer words of items that are looked at in one step.
_HITS = 1 << 18


@dataclass(frozen=True)
class Space:
    """Weight of each term in each component, all idf and scaling applied, and passages that hold it."""

    basis: np.ndarray
    frequency: np.ndarray


def _terms(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(50)).astype(np.int32)


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return letter_words(*string_bytes(pc.utf8_lower(column)))


def _passages(texts: DataFrame) -> DataFrame:
    """``terms``: those of all passages of all texts, ``_PACKED`` passages a row as 16-bit numbers.

    A passage is ``BLOCK`` words; the last of a text is filled up with ``TERMS``.
    """

    def cut(batches):
        for batch in batches:
            for part in batches_of(batch, "text"):
                words, first = _words(part.column("text"))
                sizes = np.diff(first)
                number = -(-sizes // BLOCK)
                shift = (np.cumsum(number) - number) * BLOCK - first[:-1]
                grid = np.full(int(number.sum()) * BLOCK, TERMS, np.int16)
                grid[np.arange(len(words)) + np.repeat(shift, sizes)] = _terms(words)
                step = _PACKED * BLOCK
                yield pa.RecordBatch.from_arrays([pa.array([grid[k : k + step].tobytes() for k in range(0, len(grid), step)], pa.binary())], ["terms"])

    return texts.select("text").mapInArrow(cut, "terms binary")


def _grids(batches) -> Iterator[np.ndarray]:
    """Passages, a row each, some thousand at a time."""
    for batch in batches:
        grid = np.frombuffer(b"".join(batch.column("terms").to_pylist()), np.int16).reshape(-1, BLOCK)
        for low in range(0, len(grid), _MULTIPLIED):
            yield grid[low : low + _MULTIPLIED]


def _frequencies(passages: DataFrame) -> tuple[np.ndarray, int]:
    """In how many passages each term occurs, and the number of passages."""

    def count(batches):
        total = np.zeros(TERMS + 1, np.int64)
        for grid in _grids(batches):
            terms = np.sort(grid, axis=1)
            new = np.ones(terms.shape, bool)
            new[:, 1:] = terms[:, 1:] != terms[:, :-1]
            total[:TERMS] += np.bincount(terms[new], minlength=TERMS)[:TERMS]
            total[TERMS] += len(grid)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["term", "n"])

    out = np.zeros(TERMS + 1, np.int64)
    for row in passages.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[row["term"]] = row["n"]
    return out[:TERMS], int(out[TERMS])


def _sums(grid: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sums of the terms' rows of ``table`` by passage; the last row is that of no term."""
    out = np.empty((len(grid), table.shape[1]), table.dtype)
    more = np.empty((_PACKED, table.shape[1]), table.dtype)
    # Few passages at a time stay in the cache.
    for low in range(0, len(grid), _PACKED):
        own = grid[low : low + _PACKED].T.astype(np.intp)
        sums = out[low : low + _PACKED]
        np.take(table, own[0], axis=0, out=sums, mode="clip")
        for terms in own[1:]:
            np.take(table, terms, axis=0, out=more[: len(sums)], mode="clip")
            sums += more[: len(sums)]
    return out


def _weighted(idf: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.concatenate((right * idf[:, None], np.zeros((1, right.shape[1])))).astype(np.float32)


def _gram_times(passages: DataFrame, idf: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Transposed matrix times matrix times ``right``, the matrix being the TF-IDF ``passages``.

    Each task adds up its passages; the parts are summed by slices of terms.
    """
    sent = passages.sparkSession.sparkContext.broadcast(_weighted(idf, right))
    width = right.shape[1]
    rows = TERMS // _CHUNKS

    def multiply(batches):
        # Two columns at a time, as the parts of complex numbers.
        pairs = np.zeros((-(-width // 2), TERMS + 1), np.complex128)
        table = np.pad(sent.value, ((0, 0), (0, width % 2)))
        held = np.empty(_MULTIPLIED * BLOCK, np.complex64)
        for grid in _grids(batches):
            sums = np.ascontiguousarray(_sums(grid, table).view(np.complex64).T)
            order = np.argsort(grid, axis=None, kind="stable")
            terms, passage = grid.ravel()[order], order // BLOCK
            starts = np.flatnonzero(np.append(True, terms[1:] != terms[:-1]))
            places, words = terms[starts].astype(np.intp), held[: len(passage)]
            for own, into in zip(sums, pairs, strict=True):
                np.take(own, passage, out=words, mode="clip")
                into[places] += np.add.reduceat(words, starts)
        total = np.stack((pairs.real, pairs.imag), axis=1).reshape(-1, TERMS + 1)[:width].astype(np.float32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(_CHUNKS), pa.int32()), pa.array([total[:, k * rows : (k + 1) * rows].tobytes() for k in range(_CHUNKS)], pa.binary())],
            ["chunk", "part"],
        )

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, part in zip(batch.column("chunk").to_pylist(), batch.column("part").to_pylist(), strict=True):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(part, np.float32).astype(np.float64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["chunk", "part"]
        )

    schema = "chunk int, part binary"
    parts = _in_few_tasks(passages).mapInArrow(multiply, schema).repartition(_CHUNKS // 4, "chunk").mapInArrow(add, schema)
    out = np.zeros((TERMS, width))
    for row in parts.toLocalIterator():
        k = row["chunk"]
        out[k * rows : (k + 1) * rows] += np.frombuffer(row["part"]).reshape(width, rows).T
    return out * idf[:, None]


def _gram(passages: DataFrame, idf: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The matrix times ``right``, transposed, times itself."""
    sent = passages.sparkSession.sparkContext.broadcast(_weighted(idf, right))
    width = right.shape[1]

    def multiply(batches):
        total = np.zeros((width, width))
        for grid in _grids(batches):
            sums = _sums(grid, sent.value).astype(np.float64)
            total += sums.T @ sums
        yield pa.RecordBatch.from_arrays([pa.array(range(width * width)), pa.array(total.ravel())], ["cell", "x"])

    out = np.zeros(width * width)
    cells = _in_few_tasks(passages).mapInArrow(multiply, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).toArrow()
    out[cells.column("cell").to_numpy()] = cells.column("x").to_numpy()
    return out.reshape(width, width)


def _in_few_tasks(passages: DataFrame) -> DataFrame:
    """A task's part of a product has one size, however few its passages: so four tasks a core, or eight partitions a task."""
    cores = passages.sparkSession.sparkContext.defaultParallelism
    return passages.coalesce(max(4 * cores, passages.rdd.getNumPartitions() // 8))


def fit(texts: DataFrame, items: DataFrame, scratch: Scratch) -> Space:
    """Latent space of the passages of all documents and of all items."""
    passages = scratch.keep(_passages(texts), "passages")
    frequency, number = _frequencies(passages)
    # At least 1: the words of an item that stands in every document still find it.
    idf = 1 + np.log((1 + number) / (1 + frequency))
    asked = scratch.keep(_passages(items), "items")
    every = passages.union(asked)
    right = np.random.default_rng(5).standard_normal((TERMS, RANK))
    q, _ = np.linalg.qr(_gram_times(every, idf, right))
    values, vectors = np.linalg.eigh(_gram(every, idf, q))
    scratch.drop(passages, asked)
    scale = np.sqrt(np.maximum(values, values.max() * 1e-9))
    basis = (q @ vectors) / scale if values.max() > 0 else q * 0
    # Each term counts by its idf alone, whatever share of it the components hold.
    basis /= np.maximum(np.linalg.norm(basis, axis=1, keepdims=True), 1e-30)
    return Space((basis * idf[:, None]).astype(np.float32), frequency)


def common_subsequence(item: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, by bits of one long integer."""
    at: dict[int, int] = {}
    for k, word in enumerate(item):
        at[word] = at.get(word, 0) | 1 << k
    row = full = (1 << len(item)) - 1
    for word in text:
        hit = row & at.get(word, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


def _holds(text: list[int], answer: list[int]) -> bool:
    return any(text[k : k + len(answer)] == answer for k in range(len(text) - len(answer) + 1))


@dataclass(frozen=True)
class Queries:
    """Passages of a block of items as unit vectors with their lengths, and the items' words.

    ``block`` is half the length of the passages, which follows that of the item. ``holds`` has the
    terms of each item; ``rare`` the least frequent term of its answer, -1 if none. Items whose rarer
    words include a term are ``listed`` from ``lists[term]`` to ``lists[term + 1]``; of its rarer words
    ``need`` must stand together.
    """

    vectors: np.ndarray
    lengths: np.ndarray
    block: np.ndarray
    item_of: np.ndarray
    holds: np.ndarray
    rare: np.ndarray
    sizes: np.ndarray
    ids: list
    words: list[list[int]]
    answers: list[list[int]]
    lists: np.ndarray
    listed: np.ndarray
    need: np.ndarray


def _rarer(terms: np.ndarray, frequency: np.ndarray) -> tuple[np.ndarray, int]:
    """The terms of the rarer words of an item, and how many words of the text must be among them.

    ``least`` words in order are asked for. At most ``left`` of them stand at the places of the other
    words, so ``least - left`` are rarer ones. All places of a term fall on one side.
    """
    size = len(terms)
    least = -(-size // 2)
    order = terms[np.lexsort((terms, frequency[terms]))]
    cut = size - max(0, least - max(1, size // 6))
    while cut < size and order[cut] == order[cut - 1]:
        cut += 1
    return np.unique(order[:cut]), least - (size - cut)


def _queries(ids: list, texts: list[str], space: Space) -> Queries:
    words, first = _words(pa.array(texts, pa.string()))
    answers, cut = _words(pa.array([_last_sentence(t) for t in texts], pa.string()))
    begins, ends, item, blocks = [], [], [], []
    for k, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        # The power of two that is at most the item's length.
        block = min(BLOCK, 1 << max(0, int(b - a).bit_length() - 1))
        for begin in range(a, max(a + 1, b - BLOCK), BLOCK):
            if b > a:
                begins.append(begin)
                ends.append(min(b, begin + 2 * BLOCK))
                item.append(k)
                blocks.append(block)
    holds = np.zeros((len(ids), TERMS), bool)
    rare = np.full(len(ids), -1, np.int64)
    weight = np.linalg.norm(space.basis, axis=1)
    for k, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        holds[k, _terms(words[a:b])] = True
        own = _terms(answers[cut[k] : cut[k + 1]])
        if len(own):
            rare[k] = own[weight[own].argmax()]
    rarer = [_rarer(_terms(words[a:b]), space.frequency) if b > a else (np.zeros(0, np.int64), 1) for a, b in zip(first[:-1], first[1:], strict=True)]
    term = np.concatenate([r[0] for r in rarer] or [np.zeros(0, np.int64)])
    by_term = np.argsort(term, kind="stable")
    listed = np.repeat(np.arange(len(rarer)), [len(r[0]) for r in rarer])[by_term]
    lists = np.searchsorted(term[by_term], np.arange(TERMS + 1))
    vectors = np.array([space.basis[_terms(words[a:b])].sum(axis=0) for a, b in zip(begins, ends, strict=True)], np.float32)
    vectors = vectors.reshape(-1, space.basis.shape[1])
    lengths = np.linalg.norm(vectors, axis=1)
    vectors /= np.maximum(lengths[:, None], 1e-12)
    return Queries(
        vectors, lengths, np.array(blocks, np.int64), np.array(item, np.int64), holds, rare, np.diff(first), ids,
        [words[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)],
        [answers[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)],
        lists, listed, np.array([r[1] for r in rarer], np.int64),
    )


def _last_sentence(text: str) -> str:
    """What an item asks for: its last line, or of a single line the last sentence."""
    parts = [p for p in text.replace("\n", ".\n").split(".") if any(c.isalnum() for c in p)]
    return parts[-1] if parts else ""


def _reach(sizes: np.ndarray) -> np.ndarray:
    """Words of a text in which an item is looked for at once."""
    return sizes + np.maximum(1, sizes // 2)


def _possible(terms: np.ndarray, first: np.ndarray, own: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, item, begin)`` of regions of three reaches in which enough rarer words of an item stand close together."""
    items = max(1, len(own.ids))
    count = np.diff(own.lists)
    hits = np.flatnonzero(count[terms] > 0)
    found = [(np.zeros(0, np.int64),) * 2]
    # Whole texts at a time, of about so many hits.
    edges = np.searchsorted(hits, first)
    low = 0
    while low < len(first) - 1:
        high = max(low + 1, int(np.searchsorted(edges, edges[low] + _HITS, "right")) - 1)
        at = hits[edges[low] : edges[high]]
        each = count[terms[at]]
        start = np.repeat(own.lists[terms[at]] - np.cumsum(each) + each, each)
        item = own.listed[start + np.arange(int(each.sum()))]
        place = np.repeat(at, each)
        text = np.repeat(np.searchsorted(first, at, "right") - 1, each)
        pair = text * items + item
        order = np.argsort(pair, kind="stable")
        pair, place, item = pair[order], place[order], item[order]
        last = np.arange(len(pair)) + own.need[item] - 1
        inside = last < len(pair)
        last = np.minimum(last, max(0, len(pair) - 1))
        reach = _reach(own.sizes[item])
        close = inside & (pair[last] == pair) & (place[last] - place < reach)
        pair, step = pair[close], place[close] // reach[close]
        new = np.append(True, (pair[1:] != pair[:-1]) | (step[1:] != step[:-1]))[: len(pair)]
        found.append((pair[new], step[new]))
        low = high
    pair, step = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    item = pair % items
    return pair // items, item, (step - 1) * _reach(own.sizes[item])


def _enough(terms: np.ndarray, first: np.ndarray, text: np.ndarray, item: np.ndarray, begin: np.ndarray, own: Queries) -> np.ndarray:
    """Which regions ``_verified`` could find something in: enough words of the item stand within one reach.

    A document that cannot hold the answer must hold more of the rest.
    """
    asked = np.zeros(TERMS, bool)
    asked[own.rare[own.rare >= 0]] = True
    at = np.flatnonzero(asked[terms])
    told = np.unique((np.searchsorted(first, at, "right") - 1) * TERMS + terms[at])
    keys = text * TERMS + own.rare[item]
    answer = own.rare[item] < 0
    if len(told):
        answer |= told[np.minimum(np.searchsorted(told, keys), len(told) - 1)] == keys
    sizes = own.sizes[item]
    least = np.where(answer, PARTLY, COVERED) * sizes
    keep = np.zeros(len(item), bool)
    # Rows of one size are looked at together, in steps of bounded size.
    order = np.argsort(sizes, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        if not len(rows):
            continue
        reach = int(_reach(sizes[rows[0]]))
        step = max(1, _PLACES // (3 * reach))
        for low in range(0, len(rows), step):
            some = rows[low : low + step]
            places = begin[some][:, None] + np.arange(3 * reach)
            inside = (places >= first[:-1][text[some]][:, None]) & (places < first[1:][text[some]][:, None])
            hits = own.holds[item[some][:, None], terms[np.clip(places, 0, len(terms) - 1)]] & inside
            sums = np.concatenate((np.zeros((len(some), 1), np.int32), np.cumsum(hits, axis=1, dtype=np.int32)), axis=1)
            keep[some] = (sums[:, reach:] - sums[:, :-reach]).max(axis=1) >= least[some]
    return keep


def _candidates(terms: np.ndarray, first: np.ndarray, space: Space, own: Queries) -> Iterator[tuple[int, int, int, float]]:
    """``(text, first word of the passage, item, cosine)`` of all passages that are like an item's."""
    if not len(terms) or not len(own.vectors):
        return
    text, item, begin = _possible(terms, first, own)
    keep = _enough(terms, first, text, item, begin, own)
    text, item, begin = text[keep], item[keep], begin[keep]
    block_of = np.zeros(len(own.ids), np.int64)
    block_of[own.item_of] = own.block
    for block in np.unique(block_of[item]).tolist():
        some = block_of[item] == block
        yield from _near(terms, first, text[some], item[some], begin[some], space, own, block)


def _near(
    terms: np.ndarray, first: np.ndarray, text: np.ndarray, item: np.ndarray, begin: np.ndarray, space: Space, own: Queries, block: int
) -> Iterator[tuple[int, int, int, float]]:
    """Candidates among the passages of ``2 * block`` words that touch the regions."""
    # Blocks of a text are counted from its first word; the passage before the region may reach into it.
    low = np.maximum(begin - first[:-1][text], 0) // block - 1
    last = (first[1:] - first[:-1] - 1)[text] // block
    high = np.minimum((begin + 3 * _reach(own.sizes[item]) - first[:-1][text]) // block, last)
    low = np.minimum(np.maximum(low, 0), last)
    count = np.maximum(high - low + 1, 0)
    row = np.repeat(np.arange(len(text)), count)
    number = np.repeat(low - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
    wide = int(last.max(initial=0)) + 2
    passage, row_of = np.unique(text[row] * wide + number, return_inverse=True)
    both = np.unique(np.concatenate((passage, passage + 1)))
    owner, place = both // wide, both % wide
    starts = first[:-1][owner] + place * block
    ends = np.minimum(starts + block, first[1:][owner])
    sums = np.zeros((len(both), space.basis.shape[1]), np.float32)
    for at in range(0, len(both), _ROWS):
        size = np.maximum(ends[at : at + _ROWS] - starts[at : at + _ROWS], 0)
        filled = np.flatnonzero(size)
        if len(filled):
            words = np.repeat(starts[at : at + _ROWS] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            sums[at + filled] = np.add.reduceat(space.basis[terms[words]], (np.cumsum(size) - size)[filled], axis=0)
    at = np.searchsorted(both, passage)
    vectors = sums[at] + sums[np.searchsorted(both, passage + 1)]
    lengths = np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)
    vectors /= lengths[:, None]
    # All passages of the item are compared with those of the region.
    order = np.argsort(own.item_of, kind="stable")
    edges = np.searchsorted(own.item_of[order], np.arange(len(own.ids) + 1))
    each = (edges[1:] - edges[:-1])[item[row]]
    pair = np.repeat(np.arange(len(row)), each)
    query = order[np.repeat(edges[:-1][item[row]] - np.cumsum(each) + each, each) + np.arange(int(each.sum()))]
    for at in range(0, len(pair), _PLACES // 16):
        p, q = row_of[pair[at : at + _PLACES // 16]], query[at : at + _PLACES // 16]
        cosines = np.einsum("ij,ij->i", vectors[p], own.vectors[q])
        good = np.flatnonzero(cosines >= LEAST_COSINE * np.minimum(1, own.lengths[q] / lengths[p]))
        rows = row[pair[at + good]]
        places = first[:-1][text[rows]] + number[pair[at + good]] * block
        yield from zip(text[rows].tolist(), places.tolist(), item[rows].tolist(), cosines[good].tolist(), strict=True)


def find_leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``(id, item, cosine, common_words, item_words, answer)`` for each document and item it holds.

    ``cosine`` is the highest of the passages that led there, ``common_words`` the length of the
    longest common subsequence of words, ``answer`` whether the item's last sentence is there word
    for word. Null and empty texts, of documents or items, match nothing; of items with one id each
    is searched; rows that repeat an id count as one document. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "leaks")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    asked = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text")).where("text is not null")
    space = fit(texts, asked, scratch)
    out = None
    blocks = max(1, -(-asked.count() // ITEMS))
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).orderBy("item", "text").collect()
        own = _queries([r["item"] for r in rows], [r["text"] for r in rows], space)
        found = _searched(texts, space, own)
        out = found if out is None else out.unionByName(found)
    best = out.groupBy("id", "item").agg(
        F.max("cosine").alias("cosine"), F.max("common").alias("common_words"), F.max("size").alias("item_words"), F.max("answer").alias("answer")
    )
    return best.withColumnsRenamed({"id": id_col, "item": item_col})


def _searched(texts: DataFrame, space: Space, own: Queries) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast((space, own))

    def search(batches):
        space, own = sent.value
        for batch in batches:
            out: list[tuple] = []
            for part in batches_of(batch, "text"):
                ids = part.column("id").to_pylist()
                words, first = _words(part.column("text"))
                near: dict[tuple[int, int], tuple[float, set[int]]] = {}
                for text, begin, item, cosine in _candidates(_terms(words), first, space, own):
                    top, places = near.setdefault((text, item), (0.0, set()))
                    places.add(begin)
                    near[text, item] = (max(top, cosine), places)
                for (text, item), (cosine, places) in near.items():
                    common, answer = _verified(own, item, words, first[text], first[text + 1], sorted(places))
                    size = len(own.words[item])
                    if common >= COVERED * size or (answer and common >= PARTLY * size):
                        out.append((ids[text], own.ids[item], cosine, common, size, answer))
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["id", "item", "cosine", "common", "size", "answer"]
            )

    return texts.mapInArrow(search, "id long, item long, cosine double, common long, size long, answer boolean")


def _verified(own: Queries, item: int, words: np.ndarray, low: int, high: int, places: list[int]) -> tuple[int, bool]:
    """Best common subsequence, and whether the answer is there, around the candidate passages."""
    wanted, answer = own.words[item], own.answers[item]
    best, told, begin = 0, False, 0
    reach = len(wanted)
    while begin < len(places):
        end = begin
        while end + 1 < len(places) and places[end + 1] - places[end] <= 2 * reach + 2 * BLOCK:
            end += 1
        a, b = max(low, places[begin] - reach), min(high, places[end] + 2 * BLOCK + reach)
        region = words[a:b].tolist()
        held = set(region)
        if sum(word in held for word in wanted) >= PARTLY * reach:
            # In a long region chance alone finds many words in order: look at it in windows.
            step = max(1, reach // 2)
            for k in range(0, max(1, len(region) - reach), step):
                best = max(best, common_subsequence(wanted, region[k : k + reach + step]))
            told = told or _holds(region, answer)
        begin = end + 1
    return best, told

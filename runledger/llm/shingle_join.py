"""Near-duplicate texts by an exact Jaccard join on word shingles.

Method: rare-first prefix filtering with length, positional and suffix filters (Bayardo and others
2007; Xiao and others 2008). Texts with one and the same shingle set become one class first. A
class is posted under the rarest shingles of its set only: two sets that reach the threshold share
one of them. Pairs are formed by an equi-join on these prefix shingles, pass the filters and are
verified once. Groups are linked in two rounds: first each posting to the most promising member of
its shingle, then only pairs that are not yet in one component, so that a large group of copies
never becomes all of its pairs. The result is exact. Postings are joined in blocks of shingles, and
pairs are verified in blocks, so that what lies on disk at once is a part of the texts' size however
many shingles are shared.

Rarity: shingles are counted over all texts in four million hash bins. A shingle's rank is how far
its bin's weight is from the median bin, in quarters of the deviation that chance gives a bin and
beyond four of them in quarter octaves, then its hash. Any total order is right; this one puts
shingles that some texts share by chance behind those of one text, and passages that many share
last. A word sequence by chance in f texts makes f² pairs when it is in their prefixes, and f grows
with the table; a bin's chance deviation grows with its root only. Shingles are known by 58 bits of
a hash.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from .common import KeyMap, Scratch, batches_of, components, list_array, shingles, shuffles_deleted, string_bytes, without, word_hashes

BINS = 1 << 22
CELLS = 64
_SHIFT = np.uint64(42)
#: Bins in a row of counts.
_PART = 1 << 12
#: Postings of one block of shingles, and the most blocks.
BLOCK, MOST_BLOCKS = 1 << 25, 4
#: Tokens of the sets that are verified at once, where a quarter of all tokens is less.
VERIFIED = 1 << 23


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and shingle hashes of each row with words."""
    hashes, first = word_hashes(*string_bytes(batch.column("text")))
    for k in np.flatnonzero(np.diff(first)):
        yield int(k), shingles(hashes[first[k] : first[k + 1]], size)


def _parts(batches, column: str = "text") -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from batches_of(batch, column)


def _levels(texts: DataFrame, size: int) -> np.ndarray:
    """Rank of each bin by weight, from counts over all texts."""

    def rows(parts):
        found = [(part, zlib.compress(np.minimum(counts, 2**32 - 1).astype("<u4"), 1)) for part, counts in parts if counts.any()]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], ["part", "counts"])

    def count(batches):
        total = np.zeros(BINS, np.uint32)
        for batch in _parts(batches):
            own = [own for _, own in _sets(batch, size)]
            if own:
                np.add.at(total, (np.concatenate(own) >> _SHIFT).astype(np.int64), np.uint32(1))
        yield from rows(enumerate(total.reshape(-1, _PART)))

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                held[part] = held.get(part, 0) + np.frombuffer(zlib.decompress(counts), "<u4").astype(np.int64)
        yield from rows(held.items())

    shape = "part int, counts binary"
    with shuffles_deleted(texts.sparkSession):
        counted = texts.select("text").mapInArrow(count, shape).repartition("part").mapInArrow(add, shape).toArrow()
    weights = np.zeros((BINS // _PART, _PART), np.uint32)
    for part, counts in zip(counted.column("part").to_pylist(), counted.column("counts").to_pylist(), strict=True):
        weights[part] = np.frombuffer(zlib.decompress(counts), "<u4")
    return levels_of(weights.ravel())


def levels_of(weights: np.ndarray) -> np.ndarray:
    """Levels from 0 to 63, heavier bins higher."""
    middle = max(1.0, float(np.median(weights)))
    apart = (weights - middle) / np.sqrt(middle)
    return np.clip(np.where(apart < 4, 16 + 4 * apart, 32 + 4 * np.log2(np.maximum(apart, 4) / 4)), 0, 63).astype(np.uint8)


def ranked(own: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The set as rank-ordered tokens: level, then hash."""
    tokens = (levels[(own >> _SHIFT).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (own >> np.uint64(6))
    tokens.sort()
    return tokens


def least_overlap(both, share: tuple[int, int]):
    """Smallest intersection that two sets of ``both`` tokens together need."""
    return -(-share[0] * both // (share[0] + share[1]))


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int) -> int:
    """Upper bound of the overlap of two sorted sets, split at pivots as suffix filtering does."""
    if not depth or not len(x) or not len(y):
        return min(len(x), len(y))
    pivot = y[len(y) // 2]
    i, j = int(np.searchsorted(x, pivot)), len(y) // 2
    return suffix_bound(x[:i], y[:j], depth - 1) + suffix_bound(x[i:], y[j:], depth - 1)


def reaches(x: np.ndarray, y: np.ndarray, share: tuple[int, int]) -> bool:
    need = least_overlap(len(x) + len(y), share)
    if suffix_bound(x, y, 4) < need:
        return False
    return len(np.intersect1d(x, y, assume_unique=True)) >= need


def cell_counts(own: np.ndarray, cells: int) -> bytes:
    """Tokens of a set in each of ``cells`` cells, a power of two; item size first."""
    counts = np.bincount((own & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    size = 1 if counts.max() < 1 << 8 else 2 if counts.max() < 1 << 16 else 4
    return bytes([size]) + counts.astype(f"<u{size}").tobytes()


def parities(own: np.ndarray) -> np.ndarray:
    """One bit for each of 256 cells: whether it holds an odd number of the set's tokens."""
    odd = np.bincount((own & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def cells_bound(x: bytes, y: bytes) -> tuple[int, int]:
    """``(most, both)``: an upper bound of the overlap, and the sizes of both sets together."""
    u, v = (np.frombuffer(z, f"<u{z[0]}", offset=1).astype(np.int64) for z in (x, y))
    while len(u) > len(v):
        u = u.reshape(2, -1).sum(axis=0)
    while len(v) > len(u):
        v = v.reshape(2, -1).sum(axis=0)
    return int(np.minimum(u, v).sum()), int(u.sum() + v.sum())


def _sketches(texts: DataFrame, levels: Broadcast, size: int, share: tuple[int, int]) -> DataFrame:
    """Per text: set size, signature, prefix tokens, cell parities, and token counts by few and by many cells."""

    def sketch(batches):
        for batch in _parts(batches):
            rows = batch.num_rows
            n, one, two = np.zeros(rows, np.int64), np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
            prefix, coarse, fine = [np.zeros(0, np.uint64)] * rows, [b""] * rows, [b""] * rows
            odd = np.zeros((rows, 4), np.int64)
            for k, own in _sets(batch, size):
                n[k], one[k], two[k] = len(own), own.sum(), np.bitwise_xor.reduce(own)
                tokens = ranked(own, levels.value)
                prefix[k] = tokens[: len(own) + share[0] * len(own) // -share[1] + 1]
                odd[k] = parities(own)
                coarse[k] = cell_counts(own, CELLS)
                fine[k] = cell_counts(own, 1 << max(6, min(16, (len(own) - 1).bit_length())))
            flat = np.concatenate([*prefix, np.zeros(0, np.uint64)]).view(np.int64)
            ends = np.cumsum([0, *map(len, prefix)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                 list_array(flat, ends, pa.int64()), *(pa.array(odd[:, k]) for k in range(4)), pa.array(coarse, pa.binary()), pa.array(fine, pa.binary())],
                ["id", "n", "one", "two", "prefix", "p0", "p1", "p2", "p3", "coarse", "fine"],
            )

    return texts.mapInArrow(sketch, "id long, n long, one long, two long, prefix array<long>, p0 long, p1 long, p2 long, p3 long, coarse binary, fine binary")


def _fit(a: str, b: str, share: tuple[int, int]):
    """The length filter, and the positional filter at the first token that two sets share."""
    na, nb, pa_, pb = (F.col(f"{s}.{c}") for c in ("n", "pos") for s in (a, b))
    need = F.expr(f"ceil(({share[0]} * ({a}.n + {b}.n)) / {share[0] + share[1]}.0D)")
    return (F.least(na, nb) * share[1] >= F.greatest(na, nb) * share[0]) & (
        1 + F.least(na - pa_, nb - pb) - 1 >= need
    )


def _parities_fit(share: tuple[int, int]):
    """Cells of differing parity hold tokens of one set only; there may not be too many of them."""
    apart = F.expr(" + ".join(f"bit_count(lp.p{k} ^ rp.p{k})" for k in range(4)))
    both = F.col("l.n") + F.col("r.n")
    return apart <= both - 2 * F.ceil(share[0] * both / float(share[0] + share[1]))


def _cells_fit(pairs: DataFrame, cells: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Pairs whose token counts by cell still allow the overlap, with the tokens of both: the suffix filter with fixed pivots."""

    def fits(batches):
        for batch in _parts(batches, "x"):
            keep, tokens = [], []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                most, both = cells_bound(x, y)
                keep.append(most >= least_overlap(both, share))
                tokens.append(both)
            rows = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(tokens, pa.int64())], ["a", "b", "both"])
            yield rows.filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(cells.toDF("a", "x"), "a").join(cells.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return joined.mapInArrow(fits, "a long, b long, both long").distinct()


def _blocks(pairs: DataFrame, most: int) -> Iterator[DataFrame]:
    """``pairs`` (a, b, both), a written table, in blocks of about ``most`` tokens."""
    count = max(1, -(-(pairs.agg(F.sum("both")).first()[0] or 0) // most))
    for k in range(count):
        yield pairs.where(F.pmod(F.xxhash64("b"), F.lit(count)) == k)


def _tokens_of(texts: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """Whole shingle sets of the given texts."""
    wanted = KeyMap(ids, "id")
    sent = wanted.sent

    def tokens(batches):
        for batch in _parts(KeyMap.kept(sent, batches)):
            found = list(_sets(batch, size))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array([k for k, _ in found], pa.int64())),
                 pa.array([own.tobytes() for _, own in found], pa.binary())],
                ["id", "tokens"],
            )

    return wanted.coded(texts).mapInArrow(tokens, "id long, tokens binary").join(ids, "id", "left_semi")


def _verified(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    def check(batches):
        for batch in _parts(batches, "x"):
            keep = [
                reaches(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), share)
                for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return joined.mapInArrow(check, "a long, b long")


def _all(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.union, frames)


def jaccard_components(
    docs: DataFrame, size: int = 5, share: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, n_shingles, component_id)`` for each row of ``docs``.

    Two texts link when intersection * share[1] >= union * share[0]. ``component_id`` is the
    smallest id reachable by links, the row's own included. Texts that are null or have no words
    have an empty set and link with nothing. Rows that repeat an id are each returned and count as
    one vertex; a row without id is returned with a null component. Other columns are ignored. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shingles")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    levels = spark.sparkContext.broadcast(_levels(texts, size))
    sketches = scratch.keep(_sketches(texts, levels, size, share), "sketches")
    levels.unpersist()
    sizes = scratch.keep(sketches.select("id", "n", "one", "two"), "sizes")
    filled = sizes.where("n > 0 and id is not null")
    classes = scratch.keep(filled.groupBy("n", "one", "two").agg(F.min("id").alias("rep")), "classes")
    others = filled.join(classes.select(F.col("rep").alias("id")), "id", "left_anti").select("id").distinct()
    others = scratch.keep(others, "others")
    first = scratch.keep(without(sketches.where("n > 0 and id is not null").drop("one", "two"), others, "id"), "first")
    scratch.drop(sketches, others)
    postings = first.agg(F.sum(F.size("prefix"))).first()[0] or 0
    blocks = min(MOST_BLOCKS, max(1, -(-postings // BLOCK)))
    most = max(VERIFIED, (sizes.agg(F.sum("n")).first()[0] or 0) // 4)

    def linked(pairs: DataFrame, turn: str) -> DataFrame:
        """The pairs that reach the threshold."""
        # Few cells for all pairs, then as many cells as tokens for those that are left, then whole sets.
        near = scratch.keep(_cells_fit(pairs, first.select("id", "coarse"), share), f"{turn}-coarse")
        close = []
        for own in _blocks(near, 8 * most):
            cells, _ = KeyMap(ids_of(own, f"{turn}-coarse-ids"), "id").parted(first.select("id", "fine"))
            close.append(scratch.keep(_cells_fit(own.select("a", "b"), cells, share), f"{turn}-fine"))
        sure = []
        for own in _blocks(_all(close), most):
            sets = scratch.keep(_tokens_of(texts, ids_of(own, f"{turn}-fine-ids"), size), f"{turn}-sets")
            sure.append(scratch.keep(_verified(own, sets, share), f"{turn}-links"))
            scratch.drop(sets)
        return _all(sure)

    def ids_of(pairs: DataFrame, name: str) -> DataFrame:
        return scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), name)

    def distinct(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    held, found = [], []
    for block in range(blocks):
        every = first.select("id", "n", F.posexplode("prefix").alias("pos", "token")).where(F.pmod("token", F.lit(blocks)) == block)
        # Tokens that two or more hold; what else a posting tells is shuffled for these alone.
        tokens = scratch.keep(every.groupBy("token").agg(F.count("*").alias("held")).where("held > 1").select("token"), "tokens")
        shared = scratch.keep(KeyMap(tokens, "token").split(every)[0], "shared")
        centers = shared.groupBy("token").agg(F.min(F.struct("pos", "n", "id")).alias("c"), F.count("*").alias("held")).where("held > 1")
        centers = scratch.keep(centers.select("token", F.struct("c.id", "c.n", "c.pos").alias("center")), "centers")
        rows = shared.join(centers, "token").select(F.struct("id", "n", "pos").alias("own"), "center")
        pairs = rows.where("own.id <> center.id").where(_fit("own", "center", share))
        found.append(scratch.keep(distinct(pairs.select(F.col("own.id").alias("a"), F.col("center.id").alias("b"))), "star-pairs"))
        scratch.drop(tokens, centers)
        held.append(shared)
    links = linked(_all(found).distinct(), "star")
    scratch.drop(*found)
    root = scratch.keep(components(scratch, links).withColumnRenamed("member", "id"), "roots")
    found, rooting = [], KeyMap(root, "id")
    for shared in held:
        # Only postings of linked texts are shuffled for their root.
        some, rest = rooting.parted(shared)
        rooted = some.join(root, "id", "left").withColumn("root", F.coalesce("root", "id")).unionByName(rest.withColumn("root", F.col("id")))
        rooted = scratch.keep(rooted.select("token", F.struct("id", "n", "pos").alias("own"), "root"), "rooted")
        scratch.drop(shared)
        mixed = rooted.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
        odd = first.select("id", F.struct("p0", "p1", "p2", "p3").alias("odd"))
        rows = rooted.join(mixed.select("token"), "token", "left_semi").join(odd, F.col("own.id") == odd["id"]).drop("id")
        mixed = scratch.keep(rows.select("token", "own", "root", "odd"), "mixed")
        left, right = mixed.toDF("token", "l", "lr", "lp"), mixed.toDF("token", "r", "rr", "rp")
        pairs = (
            left.join(right, "token").where("l.id < r.id and lr <> rr").where(_fit("l", "r", share) & _parities_fit(share))
            .select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))
        )
        found.append(scratch.keep(distinct(pairs), "cross-pairs"))
        scratch.drop(rooted, mixed)
    links = links.union(linked(_all(found).distinct(), "cross"))
    # Texts of one set are one vertex; so are rows of one id, whose classes are linked with it.
    same = filled.join(classes, ["n", "one", "two"]).select("id", "rep")
    root = components(scratch, links.union(same.where("id <> rep").select("id", "rep")))
    scratch.drop(first, classes)
    return (
        sizes.select("id", "n").join(root, F.col("id") == F.col("member"), "left")
        .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("component_id"))
    )

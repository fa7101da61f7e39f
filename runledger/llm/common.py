"""What several operators share: written intermediates, components of links, hashed words."""

from __future__ import annotations

import contextlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from runledger.session import scratch_path

SLICE_BYTES = 1 << 18
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_RANDOM = np.random.default_rng(20240607)
_BYTE_VALUES = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_BYTE_VALUES[65:91] = _BYTE_VALUES[97:123]
_GAP = np.zeros(256, dtype=bool)
_GAP[:128] = [not chr(c).isalnum() for c in range(128)]
_PLACE_VALUES = _RANDOM.integers(0, 2**63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


class Scratch:
    """Written intermediate tables of one operator call, under the shared folder.

    ``keep`` writes a frame and reads it back, which cuts its lineage: a lost executor costs a
    reread, not a recomputation. What the writing shuffled is deleted at its end, not when the
    driver happens to collect its garbage. ``drop`` deletes tables that no later plan reads.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self._written = spark, scratch_path(spark, label), 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self._written += 1
        path = f"{self.root}/{self._written:03d}-{name}"
        with shuffles_deleted(self.spark):
            df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._kept_at = path
        return kept

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(frame._kept_at)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Queries begun in here delete their shuffle files when they end; a frame must not be computed twice for what it shuffled."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """``(member, root)`` for each vertex of ``links`` (columns a, b); root is the smallest reachable.

    Large-star and small-star steps (Kiveris and others, 2014). Each step is a grouped minimum,
    which combines before its shuffle, and an equi-join that Spark may split on a hot vertex; no
    vertex's neighbours are gathered. Stops when a round changes nothing.
    """
    edges = scratch.keep(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u <> v")
        .distinct(),
        "edges",
    )
    seen = None
    while True:
        state = edges.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if state == seen or not state[0]:
            return edges.select(F.col("u").alias("member"), F.col("v").alias("root")).union(
                edges.select("v", "v").distinct()
            )
        seen = state
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        large = scratch.keep(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        merged = scratch.keep(small.union(least.select("u", "m")).distinct(), "small")
        scratch.drop(edges, large)
        edges = merged


#: Bits of the map that keeps unneeded texts out of a shuffle: 16 for each key, between these.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 26


class KeyMap:
    """A bitmap of hashed long keys, of bounded size, for tasks that read texts by key.

    ``kept`` drops rows whose key is surely not among the keys; some others stay, so a join must
    follow. It only saves shuffling texts that the join would drop. ``keys`` should be a written table.
    """

    def __init__(self, keys: DataFrame, column: str):
        count = keys.count()
        self.bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * count).bit_length()))
        bits = keys.select(self._place(column).alias("bit"))
        self.words = bits.selectExpr("shiftright(bit, 6) w", "shiftleft(1L, bit & 63) m").groupBy("w").agg(F.bit_or("m").alias("m"))
        parts = self.words.toArrow()
        words = np.zeros(self.bits // 64, np.int64)
        words[parts.column("w").to_numpy()] = parts.column("m").to_numpy()
        self.column, self.kind = column, keys.schema[column].dataType
        self.sent = keys.sparkSession.sparkContext.broadcast(words)

    def _place(self, column):
        return F.pmod(F.xxhash64(column), F.lit(self.bits)).cast("int")

    def coded(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the place of each key in the bitmap, which ``kept`` takes away."""
        return rows.withColumn("__bit", self._place(self.column))

    @staticmethod
    def kept(sent, batches: Iterable[pa.RecordBatch], inside: bool = True) -> Iterator[pa.RecordBatch]:
        """The rows that may be among the keys, or those that surely are not."""
        for batch in batches:
            bit = batch.column("__bit").to_numpy()
            hit = (sent.value[bit >> 6] >> (bit & 63)) & 1 == 1
            yield batch.drop_columns(["__bit"]).filter(pa.array(hit == inside))

    def split(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``rows`` that may be among the keys, and the others."""
        sent = self.sent
        some, rest = (
            self.coded(rows).mapInArrow(lambda batches, inside=inside: KeyMap.kept(sent, batches, inside), rows.schema) for inside in (True, False)
        )
        return some, rest

    def parted(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """As ``split``, without Python: rows of any types are joined with the words of the bitmap, ``MOST_BITS / 64`` at most."""
        words = F.broadcast(self.words.toDF("__word", "__mask"))
        placed = rows.withColumn("__bit", self._place(F.col(self.column).cast(self.kind)))
        joined = placed.join(words, F.shiftright("__bit", 6) == F.col("__word"), "left")
        hit = F.coalesce(F.expr("shiftrightunsigned(__mask, __bit & 63) & 1"), F.lit(0)) == 1
        return tuple(joined.where(own).select(rows.columns) for own in (hit, ~hit))


def without(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """``rows`` whose key is null or not among ``keys``, a written table of that column; few others are shuffled."""
    some, rest = KeyMap(keys, column).parted(rows)
    return some.join(keys, column, "left_anti").select(rows.columns).unionByName(rest)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (nulls as empty) and the offsets of its rows."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in reading order, and for each row the number of its first word.

    A word is a run of bytes that are not 0x20 or 0x09-0x0D; A-Z are lower-cased. Works through
    slices cut at white space, so that memory does not follow the longest text.
    """
    return _words(data, offsets, _SPACE)


def letter_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``word_hashes``, for words of ASCII letters and digits and of all bytes beyond ASCII."""
    return _words(data, offsets, _GAP)


def _words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values_of = np.where(gap, np.uint64(0), _BYTE_VALUES)
    space = gap[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    first = first[: len(data)]
    starts = np.flatnonzero(~space & (first | np.concatenate(([True], space[:-1])))) if len(data) else np.zeros(0, np.int64)
    hashes = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + SLICE_BYTES)))
        begin = starts[lo]
        end = starts[hi] if hi < len(starts) else len(data)
        own = starts[lo:hi] - begin
        part = data[begin:end]
        place = np.arange(len(part), dtype=np.int32)
        place -= np.repeat(own.astype(np.int32), np.diff(np.append(own, len(part))))
        values = values_of[part]
        values *= _PLACE_VALUES[place & 0xFFFF]
        far = np.flatnonzero(place >> 16)
        if len(far):
            # Further parts of a long word have factors of their own.
            values[far] *= mix((place[far] >> 16).astype(np.uint64) * _STEP) | np.uint64(1)
        hashes[lo:hi] = mix(np.add.reduceat(values, own))
        lo = hi
    return hashes, np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct sorted hashes of the word sequences of one text; all its words if it has fewer."""
    if not len(words):
        return words
    size = min(size, len(words))
    count = len(words) - size + 1
    out = np.full(count, size, np.uint64)
    for k in range(size):
        out *= _STEP
        out += words[k : k + count]
        out ^= out >> np.uint64(29)
    out = mix(out)
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]


def batches_of(batch: pa.RecordBatch, column: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about ``most`` bytes of a text column, one row at least."""
    sizes = np.array(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    total, begin = np.cumsum(sizes), 0
    while begin < batch.num_rows:
        base = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, base + most, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def runs_of(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys, from a partition that is sorted by the key.

    One table holds the runs that end in one batch; only a run that goes on is carried over.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        changed = np.flatnonzero(keys[1:] != keys[:-1])
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        if len(changed):
            cut = int(changed[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)

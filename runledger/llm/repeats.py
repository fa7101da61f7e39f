"""Removal of byte strings that occur more than once in a corpus.

Method: threshold-bounded interval expansion. In a Burrows-Wheeler transform an interval of the
suffix order holds all occurrences of one string; extending it backward by each preceding byte
splits it, and walking breadth first derives common prefixes by increasing value (Beller and
others, 2013). Here the walk does not start at the empty string but at *anchors*, and it stops as
soon as a common prefix reaches the length asked for.

1. Every run of ``length`` bytes contains an anchor: the 64-byte string with the smallest hash in
   the run. Equal runs have equal anchors at equal places, so an anchor that occurs once anywhere
   needs no further work.
2. Around each occurrence of a shared anchor lie all runs that it could decide: ``length - 64``
   bytes before it and ``length`` bytes from its start. Equal surroundings are one row, marked if
   they stand at two places.
3. For each anchor its surroundings are put in suffix order of what follows the anchor's start,
   with longest common prefixes: the first interval. ``expand`` extends all intervals of a batch of
   anchors backward one byte at a time. A start is repeated when its extension and the common
   prefix with a neighbour in its interval add up to ``length``.
4. An anchor with more surroundings than a task should hold is not walked as a whole: the runs
   around it are cut in two by where they start, and each half, which shares a longer string than
   the anchor, is a group of its own under that longer string. This repeats until groups are
   small; it ends at single runs, which are equal or not. Nothing is capped.

The result is exact up to 64-bit hashes of strings; groups are formed by two of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import KeyMap, Scratch, batches_of, mix, runs_of, string_bytes

ANCHOR = 64
#: More different surroundings of one key than this are split by longer keys.
GROUP = 4096
_BASE = np.uint64(0x5851F42D4C957F2D)
_RANDOM = np.random.default_rng(77).integers(0, 2**64, (2, 256), dtype=np.uint64)
_PART = 1 << 18


def _inverse(x: int) -> int:
    return pow(x, -1, 2**64)


_POWERS = np.concatenate(([np.uint64(1)], np.cumprod(np.full(_PART + 4096, _BASE)))).astype(np.uint64)
_UNPOWERS = np.concatenate(
    ([np.uint64(1)], np.cumprod(np.full(_PART + 4096, np.uint64(_inverse(int(_BASE))))))
).astype(np.uint64)


def _sums(data: np.ndarray, which: int) -> np.ndarray:
    """Running sums whose differences, divided by a power, hash any substring."""
    values = _RANDOM[which][data]
    values *= _POWERS[: len(data)]
    return np.concatenate(([np.uint64(0)], np.cumsum(values, dtype=np.uint64)))


def _hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[begin]) * _UNPOWERS[begin] + (end - begin).astype(np.uint64))


def _window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the smallest key of some window of ``width`` places."""
    count = len(keys) - width + 1
    padded = np.concatenate((keys, np.full(-len(keys) % width, np.uint64(2**64 - 1))))
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[:count], left[width - 1 : width - 1 + count])
    chosen = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    return np.unique(least[chosen] & np.uint64(_PART * 2 - 1)).astype(np.int64)


def anchors(data: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(places, anchor hashes, hashes of surroundings)`` of one text, in parts of bounded size.

    Every run of ``length`` bytes contains a returned place with its 64 bytes. Of equal hashes in a
    run the last place counts. A place may be returned by two parts.
    """
    width = length - ANCHOR + 1
    step = _PART - 4 * length
    begin = 0
    while begin + length <= len(data):
        # Runs that start in [begin, begin + step); their anchors' surroundings reach `length` on.
        end = min(len(data), begin + step + length)
        low = max(0, begin - length)
        part = data[low : min(len(data), end + length)]
        sums = _sums(part, 0)
        at = np.arange(begin - low, end - low - ANCHOR + 1)
        own = _hash(sums, at, at + ANCHOR)
        # The smallest hash wins; of equal ones the last place, whose complement is in the low bits.
        low_bits = np.uint64(_PART * 2 - 1)
        keys = (own & ~low_bits) | (low_bits - np.arange(len(own), dtype=np.uint64))
        places = int(low_bits) - _window_minima(keys, width)
        places.sort()
        here = places + (begin - low)
        first = np.maximum(here - (length - ANCHOR), 0)
        last = np.minimum(here + length, len(part))
        around = _hash(sums, first, last) ^ mix((here - first).astype(np.uint64))
        yield here + low, own[places], around
        begin += step


def _anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    """``(number, place, anchor, size, again)`` for each anchor of each row.

    Where a text has the same surroundings three times or more, all but two are marked ``again``:
    they repeat as a whole, and the two stand for them. Text with a short period stays small so.
    """

    def find(batches):
        for batch in batches:
            for part in batches_of(batch, "text"):
                ids = part.column("number").to_numpy()
                data, offsets = string_bytes(part.column("text"))
                out = [(np.zeros(0, np.int64),) * 5]
                for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                    for places, keys, around in anchors(data[a:b], length):
                        order = np.lexsort((places, around))
                        near = around[order]
                        again = np.zeros(len(order), bool)
                        again[order[2:]] = (near[2:] == near[1:-1]) & (near[1:-1] == near[:-2])
                        out.append((np.full(len(order), ids[k]), places, keys.view(np.int64), np.full(len(order), b - a), again))
                columns = [np.concatenate([x[c] for x in out]) for c in range(5)]
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, columns[:4]), pa.array(columns[4].astype(bool))], ["number", "place", "anchor", "size", "again"]
                )

    return texts.mapInArrow(find, "number long, place long, anchor long, size long, again boolean")


def _hit_texts(rows: DataFrame, places: DataFrame) -> DataFrame:
    """``(number, text, places)`` of the texts with shared anchors, from one row of each."""
    wanted = places.select("number", "rep", "places")
    likely, _ = KeyMap(places, "number").split(rows)
    return likely.join(wanted, ["number"]).where("id <=> rep").select("number", "text", "places")


def _surroundings(hits: DataFrame, length: int) -> DataFrame:
    """One row for each occurrence of a shared anchor: a *piece*.

    Its runs start at ``low .. low + starts``; ``around`` holds their bytes. Before clipping at the
    ends of the text they were ``span`` + 1 starts, ``skip`` of them before ``low``.
    """

    def cut(batches):
        for batch in batches:
            for part in batches_of(batch, "text"):
                rows: list[tuple] = []
                data, offsets = string_bytes(part.column("text"))
                for k, at in enumerate(part.column("places").to_pylist()):
                    own = data[offsets[k] : offsets[k + 1]].tobytes()
                    number = part.column("number")[k].as_py()
                    for place in at:
                        nominal = place - (length - ANCHOR)
                        low, high = max(0, nominal), min(place, len(own) - length)
                        if low <= high:
                            rows.append((number, low, length - ANCHOR, low - nominal, high - low, own[low : high + length]))
                columns = list(zip(*rows, strict=True)) if rows else [()] * 6
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["number", "low", "span", "skip", "starts", "around"]
                )

    return hits.mapInArrow(cut, "number long, low long, span int, skip int, starts int, around binary")


def expand(around: list[bytes], at: np.ndarray, starts: np.ndarray, length: int, twice: np.ndarray, key: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each row the runs of starts (first, last) whose ``length`` bytes occur in another row too.

    Row k holds ``around[k]`` with its key at ``at[k]``; starts 0..``starts[k]`` are asked about. Rows
    of one ``key`` are compared with each other. Equal rows must have been merged into one; a row that
    stands at two places or more, as ``twice`` says, is repeated everywhere.
    """
    rows = len(around)
    # Suffix order of what follows the key's start, with common prefixes of neighbours.
    after = [x[a : a + length] for x, a in zip(around, at, strict=True)]
    order = np.array(sorted(range(rows), key=lambda k: (key[k], after[k])), np.int64)
    common = np.zeros(rows, np.int32)
    for i in range(1, rows):
        x, y = order[i - 1], order[i]
        common[i] = _common(after[x], after[y]) if key[x] == key[y] else -1
    if rows:
        common[0] = -1
    # Preceding bytes: the transform's column for each further step to the left.
    reach = int(at.max(initial=0))
    before = np.zeros((reach + 1, rows), np.uint16)
    for k in range(rows):
        part = np.frombuffer(around[k], np.uint8, at[k])[::-1]
        before[: len(part), k] = part
        before[len(part) :, k] = 256
    hit = np.zeros((reach + 1, rows), bool)
    for step in range(reach + 1):
        # Row order[i] and its left neighbour agree in `step` bytes before and common[i] from the key on.
        joined = common >= 0
        long = joined & (common + step >= length)
        hit[step, order[long]] = True
        hit[step, order[np.flatnonzero(long) - 1]] = True
        if step == reach or not joined.any():
            break
        column = before[step, order]
        differs = joined & (column != np.concatenate((column[:1], column[:-1])))
        if differs.any():
            interval = np.cumsum(~joined) - 1
            torn = np.zeros(interval[-1] + 1, bool)
            torn[interval[differs]] = True
            some = np.flatnonzero(torn[interval])
            order[some], common[some] = _split(order[some], common[some], column[some])
        # Intervals of one row are done: nothing can repeat them any more.
        joined = common >= 0
        stay = joined | np.append(joined[1:], False)
        if not stay.all():
            order, common = order[stay], common[stay]
    out = []
    for k in range(rows):
        own = np.zeros(at[k] + 1, bool)
        own[:] = True if twice[k] else hit[: at[k] + 1, k][::-1]
        own = own[: starts[k] + 1]
        edges = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0]))))
        out.append([(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)])
    return out


def _split(order: np.ndarray, common: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backward extension: each interval is split by the preceding byte, suffix order kept."""
    interval = np.cumsum(common < 0)
    new = np.lexsort((column, interval))  # stable: suffix order within (interval, byte)
    first = np.append(True, (interval[new][1:] != interval[new][:-1]) | (column[new][1:] != column[new][:-1]))
    # Common prefix with the new left neighbour: the least of those passed over, by a sparse table.
    levels = [common]
    while len(levels[-1]) > 1 << (len(levels) - 1):
        prior, width = levels[-1], 1 << (len(levels) - 1)
        nxt = prior.copy()
        nxt[width:] = np.minimum(prior[width:], prior[:-width])
        levels.append(nxt)
    table = np.stack(levels)
    left = np.append(0, new[:-1])
    gap = np.maximum(new - left, 1)
    level = np.frexp(gap.astype(np.float64))[1] - 1
    least = np.minimum(table[level, new], table[level, np.minimum(left + (1 << level), len(new) - 1)])
    return order[new], np.where(first, -1, least).astype(np.int32)


def _common(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if x[lo:mid] == y[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _keyed(pieces: DataFrame, length: int) -> DataFrame:
    """Add where each piece's key is, the key's hash, and a digest of all that a walk depends on.

    The key is the string that all runs of the unclipped piece share.
    """
    at = (F.col("span") - F.col("skip")).alias("at")
    return pieces.select("*", at).select(
        "*",
        F.expr(f"xxhash64(substring(around, at + 1, {length} - span))").alias("key"),
        F.sha2(F.concat("around", F.concat_ws(":", F.lit(""), "at", "starts", "span").cast("binary")), 256).alias("content"),
    )


def _halves(pieces: DataFrame, length: int) -> DataFrame:
    """Cut the runs of each piece in two by start; the runs of a half have a longer string in common."""
    mid = pieces.selectExpr("*", "int(span / 2) AS mid", "skip + starts AS last")
    first = mid.where("skip <= mid").selectExpr(
        "number", "low", "mid AS span", "skip", "least(last, mid) - skip AS starts",
        f"substring(around, 1, least(last, mid) - skip + {length}) AS around",
    )
    second = mid.where("last > mid").selectExpr(
        "number", "low + greatest(mid + 1 - skip, 0) AS low", "span - mid - 1 AS span", "greatest(skip - mid - 1, 0) AS skip",
        "last - greatest(skip, mid + 1) AS starts", "substring(around, greatest(mid + 1 - skip, 0) + 1) AS around",
    )
    return first.union(second)


def _walked(groups: DataFrame, length: int) -> DataFrame:
    """``(content, first, last)`` of the starts that repeat, relative to each piece."""

    def walk(batches):
        held: list[pa.Table] = []
        for run in runs_of(batches, "key"):
            held.append(run)
            if sum(t.num_rows for t in held) >= GROUP:
                yield from one(held)
                held = []
        if held:
            yield from one(held)

    def one(held):
        own = pa.concat_tables(held)
        keys = own.column("key").to_numpy()
        at, starts = own.column("at").to_numpy().astype(np.int64), own.column("starts").to_numpy().astype(np.int64)
        found = expand(own.column("around").to_pylist(), at, starts, length, own.column("twice").to_numpy(), keys)
        content = own.column("content").to_pylist()
        rows = [(content[k], a, b) for k, runs in enumerate(found) for a, b in runs]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())], ["content", "first", "last"]
        )

    return groups.repartition("key").sortWithinPartitions("key").mapInArrow(walk, "content string, first int, last int")


def repeated_spans(pieces: DataFrame, scratch: Scratch, length: int) -> DataFrame:
    """``(number, begin, end)`` of the bytes that the repeated runs of all pieces cover."""
    pieces = scratch.keep(_keyed(pieces, length), "pieces")
    found = None
    while True:
        sizes = scratch.keep(
            pieces.groupBy("key").agg(F.count("*").alias("n"), F.approx_count_distinct("content").alias("kinds")).where("n > 1"), "sizes"
        )
        own = [F.first(c).alias(c) for c in ("around", "starts", "at")]
        calm = pieces.join(sizes.where(F.col("kinds") <= GROUP).select("key"), "key", "left_semi")
        # Halves of two anchors of a text may be the same runs: equal content repeats at two places only.
        spot = F.struct("number", "low")
        groups = calm.groupBy("key", "content").agg((F.min(spot) != F.max(spot)).alias("twice"), *own)
        walked = scratch.keep(_walked(groups, length), "walked")
        spans = pieces.join(walked, "content").select(
            "number", (F.col("low") + F.col("first")).alias("begin"), (F.col("low") + F.col("last") + length).alias("end")
        )
        found = spans if found is None else found.union(spans)
        # A piece of one start is its own key: such a group has one content and is never split.
        hot = sizes.where(F.col("kinds") > GROUP).select("key")
        if hot.isEmpty():
            return found.distinct()
        halves = _halves(pieces.join(hot, "key", "left_semi"), length)
        pieces = scratch.keep(_keyed(halves, length), "halves")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256, spans, text)`` for each row of ``docs``.

    Removes each byte covered by a string of ``length`` bytes that starts anywhere else too. Null
    texts count as empty. Rows that repeat an id are rows of their own. ``spans`` are the removed
    byte ranges, ``text`` is what is left; a character that was cut in two shows as U+FFFD there, while
    ``kept_sha256`` is of the bytes. Texts shorter than ``length`` lose nothing. Other columns are ignored; an empty
    table gives an empty result.
    """
    if length < 2 * ANCHOR:
        raise ValueError(f"length must be {2 * ANCHOR} or more")
    scratch = Scratch(docs.sparkSession, "repeats")
    digest = F.sha2("text", 256)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    brief = scratch.keep(rows.select("id", digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes")), "brief")
    # Equal texts are one, numbered by their digest: all of a text with a copy goes, if long enough.
    number = F.xxhash64("digest")
    kinds = scratch.keep(
        brief.groupBy("digest").agg(F.count("*").alias("copies"), F.min("id").alias("rep"), F.min("bytes").alias("bytes"))
        .withColumn("number", number),
        "kinds",
    )
    long = rows.where(F.octet_length("text") >= length).withColumn("digest", digest).select("id", number.alias("number"), "text")
    found = scratch.keep(_anchor_rows(long.select("number", "text"), length), "anchors")
    # An anchor is shared if it has two places; rows of copies have one. Combined before the shuffle.
    one = found.where("not again").select("anchor", "number", "place")
    ends = [f(c).alias(f"{c}_{k}") for c in ("number", "place") for k, f in enumerate((F.min, F.max))]
    shared = one.groupBy("anchor").agg(*ends).where("number_0 <> number_1 OR place_0 <> place_1").select("anchor")
    shared = scratch.keep(shared, "shared")
    likely, _ = KeyMap(shared, "anchor").split(one)
    places = likely.join(shared, "anchor", "left_semi").groupBy("number").agg(F.collect_set("place").alias("places"))
    places = scratch.keep(places.join(kinds.select("number", "rep"), "number"), "places")
    hits = scratch.keep(_hit_texts(long, places), "hits")
    again = found.where("again").select(
        "number", F.greatest(F.col("place") - (length - ANCHOR), F.lit(0)).alias("begin"), F.least(F.col("place") + length, F.col("size")).alias("end")
    )
    spans = repeated_spans(_surroundings(hits, length), scratch, length).union(again).where(F.col("end") - F.col("begin") >= length)
    spans = scratch.keep(spans.groupBy("number").agg(F.collect_list(F.struct("begin", "end")).alias("spans")), "spans")

    def strip(batches):
        for batch in batches:
            out: list[tuple] = []
            data, offsets = string_bytes(batch.column("text"))
            for k, found in enumerate(batch.column("spans").to_pylist()):
                own = data[offsets[k] : offsets[k + 1]]
                runs = merged([(s["begin"], s["end"]) for s in found])
                keep = np.ones(len(own), bool)
                for a, b in runs:
                    keep[a:b] = False
                rest = own[keep].tobytes()
                out.append((int((~keep).sum()), len(runs), hashlib.sha256(rest).hexdigest(), [{"begin": a, "end": b} for a, b in runs], rest.decode(errors="replace")))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("number"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], kind), pa.array(columns[4], pa.string())],
                ["number", "n_removed", "n_spans", "kept_sha256", "spans", "kept"],
            )

    stripped = scratch.keep(
        hits.join(spans, "number").select("number", "text", "spans")
        .mapInArrow(strip, "number long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin: long, end: long>>, kept string"),
        "stripped",
    )
    whole = (F.col("copies") > 1) & (F.col("bytes") >= length)
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("bytes").alias("end")))
    verdict = kinds.join(stripped.dropDuplicates(["number"]), "number", "left").select(
        "digest",
        "number",
        F.when(whole, F.col("bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
        F.when(whole, all_of_it).otherwise(F.col("spans")).alias("spans"),
        F.when(whole, F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )
    changed = scratch.keep(verdict.where("n_removed > 0"), "changed")
    # Only texts that may lose bytes meet what is left of them; the others stay where they are.
    every = rows.withColumn("digest", digest).select("id", number.alias("number"), "digest", "text")
    some, rest = KeyMap(changed, "number").split(every)
    joined = some.join(changed.drop("number"), "digest", "left")
    nothing = [F.lit(None).cast(changed.schema[c].dataType).alias(c) for c in ("n_removed", "n_spans", "kept_sha256", "spans", "kept")]
    either = joined.select("id", "digest", "text", "n_removed", "n_spans", "kept_sha256", "spans", "kept").unionAll(rest.select("id", "digest", "text", *nothing))
    return either.select(
        F.col("id").alias(id_col),
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept_sha256", "digest").alias("kept_sha256"),
        "spans",
        F.coalesce("kept", "text").alias(text_col),
    )

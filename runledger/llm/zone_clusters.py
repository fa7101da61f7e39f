"""Assignment to the nearest of k centroids over blocks along a Hilbert curve, with zone maps.

Method: vectors are ordered along a Hilbert curve and cut into blocks of ``BLOCK``; each block
carries a box, the least and greatest value of each dimension. The distances from the box bound
those of its vectors, so a centroid whose least distance from the box exceeds another's greatest is
no candidate there. The vectors of a block are compared with its candidates at once, in exact
integer arithmetic; ties go to the smaller number, so the bounds keep equals.

* The curve's grid has four cells a dimension, cut at quartiles of the first centroids. It decides
  how tight the boxes are, nothing else.
* Blocks are written once, sorted over all tasks by place on the curve and a random number, so that
  copies of one vector are spread like others. A round reads them, and moves k sums and counts a task.
* What reaches the driver is the k centroids and their sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from runledger.session import small_frame

from .common import Scratch
from .whitening import as_integers, usable

SCALE = 256
SIZE = 64
CLUSTERS = 40
ROUNDS = 5
SEED = 2
BLOCK = 64
_BITS = 2
#: Below this size of entries, sums of products are exact in doubles.
_NARROW = 1 << 22


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Place of each row of grid cells on the Hilbert curve, as bytes in the curve's order (Skilling, 2004)."""
    axes = cells.astype(np.int64).T.copy()
    size = len(axes)
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for i in range(size):
            turned = axes[i] & bit > 0
            swapped = np.where(turned, 0, (axes[0] ^ axes[i]) & below)
            axes[0] ^= np.where(turned, below, swapped)
            if i:
                axes[i] ^= swapped
    for i in range(1, size):
        axes[i] ^= axes[i - 1]
    flips = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        flips ^= np.where(axes[-1] & (1 << level) > 0, (1 << level) - 1, 0)
    axes ^= flips
    planes = [axes >> level & 1 for level in range(bits - 1, -1, -1)]
    packed = np.packbits(np.concatenate(planes).astype(np.uint8).T, axis=1)
    return [row.tobytes() for row in packed]


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to some vector of the box."""
    below, above = low - centroids, centroids - high
    outside = np.maximum(np.maximum(below, above), 0)
    reach = np.maximum(abs(below), abs(above))
    least, most = (outside * outside).sum(axis=1), (reach * reach).sum(axis=1)
    return np.flatnonzero(least <= most.min())


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each vector, the smallest of equals, and the squared distance."""
    reach = max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0))
    kind = np.float64 if reach < _NARROW else object
    v, c = vectors.astype(kind), centroids.astype(kind)
    squares = (v * v).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * (v @ c.T)
    best = np.argmin(squares, axis=1)
    found = squares[np.arange(len(v)), best]
    return best, found if kind is object else found.astype(np.int64)


def _assigned(batches, centroids: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """``(ids, vectors, cluster, distance)`` of each block."""
    for batch in batches:
        ids, data = batch.column("ids"), batch.column("data")
        lows, highs = (batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1) for c in ("low", "high"))
        wide = max(np.abs(lows).max(initial=0), np.abs(highs).max(initial=0), np.abs(centroids).max(initial=0)) >= _NARROW
        for k in range(batch.num_rows):
            own = np.frombuffer(data[k].as_buffer(), np.int64).reshape(-1, lows.shape[1])
            low, high, all_c = (x.astype(object) if wide else x for x in (lows[k], highs[k], centroids))
            some = candidates(low, high, all_c)
            best, squares = nearest(own, centroids[some])
            yield ids[k].values, own, some[best], squares


def blocks(rows: DataFrame, centroids: np.ndarray, scratch: Scratch) -> DataFrame:
    """``(ids, data, low, high)``: the rows (id, x) in blocks along the curve; data holds 64-bit integers."""
    cuts = np.quantile(centroids.astype(np.float64), np.arange(1, 1 << _BITS) / (1 << _BITS), axis=0)
    kind = rows.schema["id"].dataType.simpleString()

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                values = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
                cells = sum((values > cut).astype(np.int64) for cut in cuts)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert_keys(cells, _BITS), pa.binary())], ["id", "x", "spread", "key"])

    def cut(batches):
        for batch in batches:
            out = []
            for low in range(0, batch.num_rows, BLOCK):
                part = batch.slice(low, BLOCK)
                values = part.column("x").flatten().to_numpy().reshape(part.num_rows, -1)
                out.append((part.column("id"), values.tobytes(), values.min(axis=0), values.max(axis=0)))
            if out:
                ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(o[0]) for o in out)]), pa.int32()), pa.concat_arrays([o[0] for o in out]))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([o[1] for o in out], pa.binary()), *(pa.array([o[k] for o in out], pa.list_(pa.int64())) for k in (2, 3))],
                    ["ids", "data", "low", "high"],
                )

    placed = scratch.keep(rows.withColumn("spread", F.rand(SEED)).mapInArrow(place, f"id {kind}, x array<long>, spread double, key binary"), "placed")
    ordered = placed.sort("key", "spread").select("id", "x")
    out = scratch.keep(ordered.mapInArrow(cut, f"ids array<{kind}>, data binary, low array<long>, high array<long>"), "blocks")
    scratch.drop(placed)
    return out


def first_centroids(rows: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors whose SHA-256 of ``seed:id`` is smallest, in that order; a null id comes last."""
    code = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.orderBy(code.asc_nulls_last(), "x").limit(clusters).select("x").collect()
    return np.array([r["x"] for r in first], np.int64)


def _moved(placed: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of the mean of each centroid's vectors; of none, the centroid itself."""
    clusters, size = centroids.shape

    def add(batches):
        sums, counts = np.zeros((clusters, size), object), np.zeros(clusters, np.int64)
        for _, own, best, _ in _assigned(batches, centroids):
            order = np.argsort(best, kind="stable")
            starts = np.flatnonzero(np.append(True, np.diff(best[order]) > 0))
            wide = own.astype(object) if np.abs(own).max() >= 1 << 50 else own
            sums[best[order][starts]] += np.add.reduceat(wide[order], starts, axis=0)
            counts += np.bincount(best, minlength=clusters)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(used, size), pa.int32()),
                pa.array(np.tile(np.arange(size), len(used)), pa.int32()),
                pa.array([str(v) for v in sums[used].ravel()], pa.string()),
                pa.array(np.repeat(counts[used], size), pa.int64()),
            ],
            ["cluster", "place", "total", "n"],
        )

    parts = placed.mapInArrow(add, "cluster int, place int, total string, n long")
    out = centroids.copy()
    for row in parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
        out[row["cluster"], row["place"]] = int(row["total"]) // row["n"]
    return out


def cluster(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, seed: int = SEED, scale: int = SCALE
) -> DataFrame:
    """``(id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of each vector of ``size`` entries.

    Entries become integers ``floor(scale * x)``. A vector that is null, of another length, or has a
    null or non-finite entry gives no row. With fewer vectors than ``clusters`` each is a centroid at
    first. Equal distances go to the smaller number; a centroid without vectors stays. Rows that
    repeat an id count each. Distances and their sums are decimal(38,0), null beyond that.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "clusters")
    good = usable(F.col(vector_col)) & (F.size(vector_col) == size)
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.where(good).select(F.col(id_col).alias("id"), as_integers(F.col(vector_col), scale, 0).alias("x"))
    centroids = first_centroids(rows, clusters, seed).reshape(-1, size)
    schema = "id {}, cluster int, distance string"
    if not len(centroids):
        found = rows.select("id", F.lit(0).alias("cluster"), F.lit(None).cast("decimal(38,0)").alias("distance"))
    else:
        placed = blocks(rows, centroids, scratch)
        for _ in range(rounds):
            centroids = _moved(placed, centroids)

        def assign(batches, centroids=centroids):
            for ids, _, best, squares in _assigned(batches, centroids):
                yield pa.RecordBatch.from_arrays([ids, pa.array(best, pa.int32()), pa.array([str(s) for s in squares.tolist()])], ["id", "cluster", "distance"])

        found = placed.mapInArrow(assign, schema.format(kind)).withColumn("distance", F.expr("try_cast(distance AS decimal(38,0))"))
        found = scratch.keep(found, "assigned")
        scratch.drop(placed)
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    told = [(k, s, hashlib.sha256(",".join(map(str, centroids[k].tolist())).encode()).hexdigest()) for k, s in sums.items()]
    whole = None if None in sums.values() else sum(sums.values())
    # One row a cluster.
    known = small_frame(spark, told, "cluster int, cluster_inertia decimal(38,0), centroid_sha256 string")
    number = lambda c: F.lit(c).cast("decimal(38,0)")
    out = found.join(known, "cluster").withColumn("inertia", number(whole))
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

"""Near-duplicate embeddings by cosine, found with Euclidean p-stable hashing.

Method (Datar and others, 2004): a normalised vector is projected on Gaussian directions, shifted
and quantised; ``HASHES`` of these numbers are its bucket in one table, and there are ``TABLES``
tables with directions of their own. Vectors of one label that share a bucket in any table are
compared by exact cosine in double precision. A cosine of 0.98 is a distance of 0.2; with the
parameters here a pair at that distance shares no bucket with probability below 2e-4, closer pairs
less often. Equal vectors are one, with a weight, and are never missed.

A pair counts in the first table where it meets only: each vector carries all its buckets, so this
is known on the spot and no list of pairs is made. What leaves a task is one row a vector and bucket:
the weight of its links there, and the smallest id of its component there. Buckets of more than
``BLOCK`` vectors are cut into blocks, and each pair of blocks is compared in a place of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, components, mix, runs_of

TABLES = 12
HASHES = 6
WIDTH = 1.5
BLOCK = 1024
SEED = 11


def _directions(size: int, tables: int, hashes: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng([SEED, size, tables, hashes])
    return random.standard_normal((size, tables * hashes)) / width, random.random(tables * hashes)


def bucket_keys(unit: np.ndarray, seeds: np.ndarray, tables: int, hashes: int, width: float) -> np.ndarray:
    """Bucket of each normalised vector in each table, as one 64-bit number (rows x tables)."""
    lines, shifts = _directions(unit.shape[1], tables, hashes, width)
    cells = np.floor(unit @ lines + shifts).astype(np.int64).view(np.uint64).reshape(len(unit), tables, hashes)
    keys = np.repeat(seeds.astype(np.uint64)[:, None], tables, axis=1) + np.arange(tables, dtype=np.uint64)
    for k in range(hashes):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, k])
    return keys


def _unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _hashed(classes: DataFrame, tables: int, hashes: int, width: float) -> DataFrame:
    """``(id, weight, vector, keys)``; the vector as the bytes of its doubles."""

    def hash_rows(batches):
        for batch in batches:
            lists = batch.column("embedding").to_pylist()
            group = batch.column("group").to_numpy()
            vectors, keys = [b""] * len(lists), [[]] * len(lists)
            by_size: dict[int, list[int]] = {}
            for k, x in enumerate(lists):
                by_size.setdefault(len(x), []).append(k)
            for size, rows in by_size.items():
                raw = np.array([lists[k] for k in rows], np.float64).reshape(len(rows), size)
                found = bucket_keys(_unit(raw), group[rows], tables, hashes, width).view(np.int64)
                for n, k in enumerate(rows):
                    vectors[k], keys[k] = raw[n].tobytes(), found[n]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("weight"), pa.array(vectors, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["id", "weight", "vector", "keys"],
            )

    return classes.mapInArrow(hash_rows, "id long, weight long, vector binary, keys array<long>")


def roots(size: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest reachable number of each of 0 .. size - 1 under the links i - j."""
    label = np.arange(size)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if np.array_equal(label, before):
            break
    return label


def linked(vectors: np.ndarray, keys: np.ndarray, table: int, side: np.ndarray, cross: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of rows with the least cosine that meet in no earlier table.

    With ``cross`` only pairs from different sides are looked at.
    """
    unit = _unit(vectors)
    found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for low in range(0, len(unit), 256):
        near = unit[low : low + 256] @ unit[low:].T >= least
        i, j = np.nonzero(near)
        i, j = i + low, j + low
        keep = j > i
        if cross:
            keep &= side[i] != side[j]
        i, j = i[keep], j[keep]
        for earlier in range(table):
            new = keys[i, earlier] != keys[j, earlier]
            i, j = i[new], j[new]
        found_i.append(i)
        found_j.append(j)
    return np.concatenate(found_i), np.concatenate(found_j)


def _compared(placed: DataFrame, least: float) -> DataFrame:
    """``(id, links, root)`` for each vector and place where it has links."""

    def compare(batches):
        for runs in runs_of(batches, "place"):
            column = {c: runs.column(c).combine_chunks() for c in runs.column_names}
            place, ids, weight = (column[c].to_numpy() for c in ("place", "id", "weight"))
            keys = column["keys"].flatten().to_numpy().reshape(len(ids), -1)
            edges = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1, [len(place)]))
            out = [(np.zeros(0, np.int64),) * 3]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b - a > 1:
                    out.append(one(column, ids[a:b], weight[a:b], keys[a:b], slice(a, b)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[c] for x in out])) for c in range(3)], ["id", "links", "root"])

    def one(column, ids, weight, keys, at):
        order = np.argsort(ids, kind="stable")
        ids, weight = ids[order], weight[order]
        vectors = _matrix(column["vector"][at])[order]
        side = column["side"][at].to_numpy()[order]
        table, cross = column["table"][at.start].as_py(), column["cross"][at.start].as_py()
        i, j = linked(vectors, keys[order], table, side, cross, least)
        links = np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
        some = np.flatnonzero(links)
        return ids[some], links[some].astype(np.int64), ids[roots(len(ids), i, j)][some]

    sorted_places = placed.repartition("place").sortWithinPartitions("place")
    return sorted_places.mapInArrow(compare, "id long, links long, root long")


def near_duplicates(
    docs: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH,
) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for each row of ``docs``.

    Vectors link when their labels are equal and not null, they have one dimension, and their
    cosine is ``least`` or more. Vectors that are null, empty, zero, or hold null or non-finite
    components link with nothing. ``n_links`` counts the other rows linked directly;
    ``component_id`` is the smallest id reachable by links. Rows that repeat an id are vectors of
    their own in ``n_links`` and one vertex in components; a row without id links with nothing.
    Other columns are ignored; an empty table gives an empty result. ``width`` and ``hashes`` suit
    ``least``: lower cosines need more tables.
    """
    scratch = Scratch(docs.sparkSession, "vectors")
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("embedding")
    )
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = rows.where("id is not null and label is not null and embedding is not null").where(
        finite & F.exists("embedding", lambda x: x != 0)
    )
    same = ["label", "embedding"]
    classes = usable.groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
    members = scratch.keep(usable.join(classes, same).select("id", "rep", "weight"), "members")
    group = F.xxhash64("label", F.size("embedding"))
    hashed = scratch.keep(
        _hashed(classes.select(F.col("rep").alias("id"), "weight", group.alias("group"), "embedding"), tables, hashes, width), "hashed"
    )
    spread = hashed.select("id", F.posexplode("keys").alias("table", "key"))
    # Most buckets hold one vector; these and the key of large ones are known from counts alone.
    counts = spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = scratch.keep(
        spread.join(counts, "key").select("id", "table", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "met"
    )
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    placed = (
        met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "id", "table", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("place"),
            F.col("own").alias("side"), (F.col("own") != F.col("other")).alias("cross"),
        )
        .join(hashed, "id")
    )
    # In the place of one block with itself `cross` is false and all pairs are compared.
    found = scratch.keep(_compared(placed, least), "found")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    edges = found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))
    root = components(scratch, edges.union(members.where("id <> rep").select("id", "rep")))
    linked_rows = (
        members.join(links.withColumnRenamed("id", "rep"), "rep", "left")
        .select("id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
        .groupBy("id").agg(F.max("n_links").alias("n_links"))
    )
    out = (
        rows.select("id").join(linked_rows, "id", "left").join(root, F.col("id") == F.col("member"), "left")
        .select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    )
    return out.withColumn("kept", F.col("id") == F.col("component_id")).withColumnRenamed("id", id_col)

"""Whitening of embeddings by an exact polarised covariance.

Method: for each dimension i, and each sum i + j of two, the squares of the centred values are added
up exactly, in integers. The variance of a sum holds the covariance:
``cov(i, j) = (var(i + j) - var(i) - var(j)) / 2``. So one kind of aggregate, a sum of squares, gives
the whole matrix, which then goes to ``eigh``.

* Entries become integers ``x = floor(scale * c) + shift``. Centred without a fraction: ``n * x - S``
  with ``n`` fitted vectors and sums ``S``. Squares are split in limbs of 20 bits, whose products
  and block sums stay exact in 64-bit integers; Spark adds the limbs of all tasks as decimals.
* The fit list has each distinct vector once; it is counted before it is shuffled, so copies of one
  vector are no hot spot. Three passes over it: sums, squares, and the check of the result.
* What reaches the driver is d sums and d (d + 1) / 2 sums of squares, for d dimensions.
* Vectors of another length are a fit of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
_ROWS = 4096
_LIMB = 20
#: Beyond this size of a centred value, numbers of any length replace 64-bit integers.
_WIDE = 1 << 58
#: Eigenvalues below this share of the largest, for each dimension, are rounding.
_ROUNDING = 4 * np.finfo(float).eps


def as_integers(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """``floor(scale * c) + shift`` of each entry; what no long can hold becomes the nearest one."""
    limit = float(2**62)
    return F.transform(
        vector,
        lambda c: F.floor(F.least(F.greatest(c.cast("double") * scale, F.lit(-limit)), F.lit(limit))).cast("long") + F.lit(shift).cast("long"),
    )


def usable(vector: Column) -> Column:
    """Not null, not empty, and no null or non-finite entry."""
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~odd, F.lit(False))


def _blocks(batches, columns: list[str]) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
    """Matrices of the rows ``x`` of one length, with other columns of these rows."""
    for batch in batches:
        for low in range(0, batch.num_rows, _ROWS):
            part = batch.slice(low, _ROWS)
            lists = part.column("x")
            sizes = np.diff(lists.offsets.to_numpy())
            for size in np.unique(sizes):
                own = part.filter(pa.array(sizes == size)) if (sizes != size).any() else part
                values = own.column("x").flatten().to_numpy().reshape(own.num_rows, size)
                yield values, [own.column(c) for c in columns]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S``, exactly."""
    reach = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
    if n * reach + max(map(abs, sums), default=0) >= _WIDE:
        return x.astype(object) * n - np.array(sums, object)
    return x * n - np.array(sums, np.int64)


def square_limbs(values: np.ndarray) -> list[np.ndarray]:
    """Five weights of ``2 ** (20 * k)`` whose sum is the sum of squares of each column."""
    if values.dtype == object:
        total = (values * values).sum(axis=0)
        mask = (1 << _LIMB) - 1
        return [np.array([int(t) >> _LIMB * k & mask if k < 4 else int(t) >> _LIMB * 4 for t in total], object) for k in range(5)]
    size = np.abs(values)
    low = size & ((1 << _LIMB) - 1)
    mid = size >> _LIMB & ((1 << _LIMB) - 1)
    top = size >> 2 * _LIMB
    dot = lambda a, b: np.einsum("ij,ij->j", a, b)
    return [dot(low, low), 2 * dot(low, mid), dot(mid, mid) + 2 * dot(low, top), 2 * dot(mid, top), dot(top, top)]


def _per_length(batches, width, make) -> Iterator[pa.RecordBatch]:
    """One row of a length, place and totals of what ``make`` gives for each block of a task."""
    totals: dict[int, list[np.ndarray]] = {}
    for x, _ in _blocks(batches, []):
        made = [np.asarray(m, object) for m in make(x)]
        old = totals.get(x.shape[1])
        totals[x.shape[1]] = made if old is None else [a + b for a, b in zip(old, made, strict=True)]
    for size, made in totals.items():
        places = len(made[0])
        texts = [pa.array([str(int(v)) for v in m]) for m in made]
        yield pa.RecordBatch.from_arrays([pa.array([size] * places, pa.int32()), pa.array(range(places), pa.int32()), *texts], ["d", "place", *(f"t{k}" for k in range(width))])


def _added(fit: DataFrame, width: int, make) -> dict[int, list[list[int]]]:
    """Totals over all rows by length, place and number, as integers of any size."""
    schema = "d int, place int, " + ", ".join(f"t{k} string" for k in range(width))
    parts = fit.mapInArrow(lambda batches: _per_length(batches, width, make), schema)
    summed = parts.groupBy("d", "place").agg(*(F.sum(F.col(f"t{k}").cast("decimal(38,0)")).alias(f"t{k}") for k in range(width)))
    out: dict[int, list[list[int]]] = {}
    for row in summed.orderBy("d", "place").collect():
        out.setdefault(row["d"], []).append([int(row[f"t{k}"]) for k in range(width)])
    return out


@dataclass(frozen=True)
class Fit:
    """What whitens vectors of one length. ``basis`` has a column for each component."""

    n: int
    sums: list[int]
    basis: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def whiten(self, x: np.ndarray) -> np.ndarray:
        exact = centred(x, self.n, self.sums)
        return exact.astype(np.float64) / self.n @ self.basis / np.sqrt(self.values)


def pair_places(size: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(size) for j in range(i, size)]


def covariance(squares: list[int], n: int, size: int) -> np.ndarray:
    """From the exact sums of squares of each dimension (i, i) and pair sum (i, j); each entry is rounded once."""
    of = dict(zip(pair_places(size), squares, strict=True))
    out = np.zeros((size, size))
    for (i, j), total in of.items():
        out[i, j] = out[j, i] = total / n**3 if i == j else (total - of[i, i] - of[j, j]) / (2 * n**3)
    return out


def _fitted(n: int, sums: list[int], squares: list[int], components: int) -> Fit:
    matrix = covariance(squares, n, len(sums))
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(values.max(), 0) * _ROUNDING * len(values)]
    basis = vectors[:, order]
    if basis.size:
        basis = basis * np.sign(basis[np.abs(basis).argmax(axis=0), range(basis.shape[1])])
    trace = np.trace(matrix)
    return Fit(n, sums, basis, values[order], values[order] / trace if trace > 0 else values[order])


def fit_lengths(fit: DataFrame, components: int) -> dict[int, Fit]:
    """For each length of vectors in ``fit`` (a column ``x`` of distinct integer vectors) its ``Fit``."""
    sums = _added(fit, 2, lambda x: (x.astype(object).sum(axis=0) if abs(x).max() >= 1 << 50 else x.sum(axis=0), [len(x)] * x.shape[1]))
    totals = {d: (rows[0][1], [r[0] for r in rows]) for d, rows in sums.items()}

    def squares(x):
        exact = centred(x, *totals[x.shape[1]])
        parts = []
        for i in range(x.shape[1]):
            both = exact[:, i:] + exact[:, i : i + 1]
            both[:, 0] = exact[:, i]
            parts.append(square_limbs(both))
        return [np.concatenate([p[k] for p in parts]) for k in range(5)]

    out = {}
    for d, rows in _added(fit, 5, squares).items():
        exact = [sum(t << _LIMB * k for k, t in enumerate(row)) for row in rows]
        out[d] = _fitted(*totals[d], exact, components)
    return out


def identity_errors(fit: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """Largest entry of the whitened fit list's covariance minus the identity, by length of vectors."""

    def products(batches):
        totals: dict[int, np.ndarray] = {}
        for x, _ in _blocks(batches, []):
            white = fits[x.shape[1]].whiten(x)
            # A row of ones gives the sums beside the products; the values are centred already.
            white = np.hstack([white, np.ones((len(white), 1))])
            totals[x.shape[1]] = totals.get(x.shape[1], 0) + white.T @ white
        for d, total in totals.items():
            cells = total.size
            yield pa.RecordBatch.from_arrays([pa.array([d] * cells, pa.int32()), pa.array(range(cells), pa.int32()), pa.array(total.ravel())], ["d", "place", "total"])

    parts = fit.mapInArrow(products, "d int, place int, total double")
    cells: dict[int, list[float]] = {}
    for row in parts.groupBy("d", "place").agg(F.sum("total").alias("total")).orderBy("d", "place").collect():
        cells.setdefault(row["d"], []).append(row["total"])
    out = {}
    for d, values in cells.items():
        total = np.array(values).reshape(len(fits[d].values) + 1, -1) / fits[d].n
        error = total[:-1, :-1] - np.outer(total[-1, :-1], total[-1, :-1]) - np.eye(len(total) - 1)
        out[d] = float(np.abs(error).max(initial=0.0))
    return out


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)`` by vector and component.

    A null or empty vector, or one with a null or non-finite entry, gives no row. ``n`` is the
    number of distinct vectors of integers, ``deviation`` the exact sum over dimensions of
    ``(n * x - S) ** 2`` as decimal(38,0) (null where it has more digits), ``explained`` the share of
    the component's variance. Components come by falling variance; the largest entry of each is
    positive. A component without variance beyond rounding (one distinct vector, or fewer distinct
    vectors than dimensions) cannot be whitened and gives no row. Rows that repeat an id each give their own rows.
    """
    scratch = Scratch(vectors.sparkSession, "whiten")
    rows = vectors.where(usable(F.col(vector_col))).select(F.col(id_col).alias("id"), as_integers(F.col(vector_col)).alias("x"))
    rows = scratch.keep(rows, "integers")
    fit = scratch.keep(rows.select("x").distinct(), "fit")
    fits = fit_lengths(fit, components)
    errors = identity_errors(fit, fits)
    # What is computed next reads the integers only.
    scratch.drop(fit)
    schema = vectors.schema[id_col].dataType.simpleString()

    def project(batches):
        for x, (ids,) in _blocks(batches, ["id"]):
            own = fits[x.shape[1]]
            count = len(own.values)
            if not count:
                continue
            exact = centred(x, own.n, own.sums)
            squared = sum(v.astype(object) << _LIMB * k for k, v in enumerate(square_limbs(exact.T)))
            place = np.repeat(np.arange(len(x)), count)
            part = np.tile(np.arange(count), len(x))
            fill = lambda v, kind: pa.array([v] * len(place), kind)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(place)),
                    pa.array(part + 1, pa.int32()),
                    fill(own.n, pa.int64()),
                    pa.array([str(v) for v in squared]).take(pa.array(place)),
                    pa.array(own.whiten(x).ravel()),
                    pa.array(own.explained[part]),
                    fill(errors[x.shape[1]], pa.float64()),
                ],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    found = rows.mapInArrow(project, f"id {schema}, component int, n long, deviation string, whitened double, explained double, identity_error double")
    return found.withColumn("deviation", F.expr("try_cast(deviation AS decimal(38,0))")).withColumnRenamed("id", id_col)

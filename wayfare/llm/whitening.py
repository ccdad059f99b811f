"""Whitening of embeddings by polarisation: cross-covariances from variances of sums.

Vectors become integers, x = floor(256 * c). The covariance is fitted on each distinct x once: n vectors with sums S. With
y = n * x - S, which is exact and centred, tasks add up the squares of every y_i and of every y_i + y_j as integers of any
length; half of what the square of a sum has over the squares of its parts is the exact cross product, so the covariance matrix
holds correctly rounded quotients of integers and doesn't depend on the order of rows or tasks. Its eigenvectors come from one
symmetric decomposition on the driver (dimensions squared numbers, whatever the number of rows).

What leaves a task: one row for each dimension, or pair of dimensions, and task. What comes to the driver: one row for each.

Defined cases: vectors that are null, empty, of another length than most, or hold null or non-finite entries are dropped; a null
id stays null; repeated rows are rows of their own, but count once in the fit; columns other than the id and the vector are
ignored; an empty table gives an empty result. A component without variance (fewer distinct vectors than dimensions) has null
whitened values and no part in identity_error; a share of no variance at all is null. A deviation that no long holds is null.
Entries so large that n * x needs more than 60 bits are an error, as sums of pairs would not be exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sliced, staged

SCALE = 256.0
#: Rows of a matrix in a task.
ROWS = 4096
#: Integers of any length travel as five limbs of so many bits.
LIMB, LIMBS = 31, 5
MASK = (1 << LIMB) - 1
LIMB_COLUMNS = [f"l{i}" for i in range(LIMBS)]


@dataclass(frozen=True)
class Whitening:
    """n and sums: of the distinct vectors; covariance; values: falling eigenvalues; axes: unit eigenvectors as columns, the
    largest entry of each positive; flat: values that are rounding only."""

    n: int
    sums: np.ndarray
    covariance: np.ndarray
    values: np.ndarray
    axes: np.ndarray

    def flat(self) -> np.ndarray:
        return self.values <= len(self.values) * np.finfo(float).eps * max(self.values[0], 0.0)

    def explained(self) -> list[float | None]:
        whole = float(np.trace(self.covariance))
        return [float(v) / whole if whole > 0 else None for v in self.values]


def _whole_vectors(vectors: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, int]:
    """vec_id, x of the vectors that remain, and their length."""
    common = vectors.filter(F.size(vector) > 0).groupBy(F.size(vector).alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return vectors.select(F.col(vec_id).alias("vec_id"), F.lit(None).cast("array<bigint>").alias("x")).limit(0), 0
    v = F.col(vector).cast("array<double>")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    kept = vectors.filter(F.col(vector).isNotNull() & (F.size(vector) == common["dim"])).filter(F.forall(v, finite))
    return kept.select(F.col(vec_id).alias("vec_id"), F.transform(v, _grid).alias("x")), common["dim"]


def _grid(c: Column) -> Column:
    # what no long holds stops at the ends of long, which the check of sizes then refuses
    return F.floor(F.greatest(F.least(c * SCALE, F.lit(2.0**62)), F.lit(-(2.0**62)))).cast("long")


def _matrices(batches, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in sliced(batches, ROWS, 8):
        if b.num_rows:
            yield b, b.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _limbs(value: int) -> list[int]:
    """Of a whole number, least first; the last one keeps the sign."""
    return [(value >> LIMB * i) & MASK if i < LIMBS - 1 else value >> LIMB * i for i in range(LIMBS)]


def _number(limbs) -> int:
    return sum(int(v) << LIMB * i for i, v in enumerate(limbs))


def _batch_of(totals: dict[int, int]) -> pa.RecordBatch:
    columns = [pa.array(list(totals), pa.int32())] + [pa.array(c, pa.int64()) for c in zip(*map(_limbs, totals.values()), strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["place", *LIMB_COLUMNS])


def _summed(rows: DataFrame) -> dict[int, int]:
    """place -> whole number: limbs are added by Spark, carried on the driver."""
    return {r["place"]: _number([r[c] for c in LIMB_COLUMNS]) for r in rows.groupBy("place").agg(*(F.sum(c).alias(c) for c in LIMB_COLUMNS)).collect()}


SUMS = "place int, " + ", ".join(f"{c} long" for c in LIMB_COLUMNS)


def column_sums(values: np.ndarray) -> list[int]:
    """Exact sums of an int64 matrix of at most ROWS rows."""
    high, low = (values >> 32).sum(0), (values & 0xFFFFFFFF).sum(0)
    return [(int(h) << 32) + int(w) for h, w in zip(high, low, strict=True)]


def square_sums(values: np.ndarray) -> list[int]:
    """Exact sums of squares by column, for entries of up to 62 bits and at most ROWS rows."""
    size = np.abs(values)
    most = int(size.max(initial=0))
    if most * most * len(size) < 1 << 62:
        return (size * size).sum(0).tolist()
    if most >> LIMB == 0:
        return column_sums(size * size)
    high, low = size >> LIMB, size & MASK
    parts = [column_sums(p) for p in (high * high, high * low, low * low)]
    return [(h << 2 * LIMB) + (m << LIMB + 1) + w for h, m, w in zip(*parts, strict=True)]


def pair_squares(y: np.ndarray) -> Iterator[list[int]]:
    """For each dimension i the sums of squares of y_i, then of y_i + y_j for each later j."""
    for i in range(y.shape[1]):
        yield square_sums(np.concatenate((y[:, i : i + 1], y[:, i + 1 :] + y[:, i : i + 1]), axis=1))


def covariance_of(squares: dict[int, int], n: int, dim: int) -> np.ndarray:
    """The covariance (divisor n) from sums of squares of n * x - S: place i * dim + j holds that of y_i + y_j, i * dim + i of y_i."""
    own = [squares[i * dim + i] for i in range(dim)]
    out = np.empty((dim, dim))
    for i in range(dim):
        out[i, i] = own[i] / n**3
        for j in range(i + 1, dim):
            out[i, j] = out[j, i] = (squares[i * dim + j] - own[i] - own[j]) / (2 * n**3)
    return out


def fit(distinct: DataFrame, dim: int) -> Whitening | None:
    """distinct: a table of different vectors x, read twice."""

    def add(batches):
        totals, most, rows = [0] * dim, 0, 0
        for _, x in _matrices(batches, dim):
            totals = [a + b for a, b in zip(totals, column_sums(x), strict=True)]
            most, rows = max(most, int(np.abs(x).max())), rows + len(x)
        if rows:
            # one more place counts the rows, and one for each task's largest entry is not summed but compared below
            yield _batch_of({**dict(enumerate(totals)), dim: rows})
            yield _batch_of({-1: most})

    parts = staged(distinct.mapInArrow(add, SUMS), "whitening-sums")
    sums = _summed(parts.filter("place >= 0"))
    if not sums:
        return None
    n = sums.pop(dim)
    most = _number(parts.filter("place = -1").agg(F.max(F.struct(*LIMB_COLUMNS[::-1])).alias("m")).first()["m"][::-1])
    if 4 * n * most >= 1 << 62:
        raise ValueError(f"{n} vectors with entries up to {most}: n * x is too long for exact sums")
    total = np.array([sums[i] for i in range(dim)], np.int64)

    def squares(batches):
        held = None
        for _, x in _matrices(batches, dim):
            found = list(pair_squares(x * n - total))
            held = found if held is None else [[a + b for a, b in zip(h, f, strict=True)] for h, f in zip(held, found, strict=True)]
        for i, row in enumerate(held or []):
            yield _batch_of({i * dim + i + k: v for k, v in enumerate(row)})

    covariance = covariance_of(_summed(distinct.mapInArrow(squares, SUMS)), n, dim)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1].copy(), axes[:, ::-1].copy()
    axes *= np.sign(axes[np.abs(axes).argmax(0), np.arange(dim)])
    return Whitening(n, total, covariance, values, axes)


def whitened_rows(y: np.ndarray, model: Whitening, components: int) -> np.ndarray:
    """Projections over the square roots of the eigenvalues; nan where a component is flat. A row's values depend on it alone."""
    centred, flat = y / model.n, model.flat()
    out = np.full((len(y), components), np.nan)
    for k in range(components):
        if not flat[k]:
            out[:, k] = (centred * model.axes[:, k]).sum(1) / np.sqrt(model.values[k])
    return out


def identity_error(distinct: DataFrame, model: Whitening, components: int) -> float:
    """Largest entry of the whitened vectors' covariance minus the identity, measured over the fit list, to 12 decimals:
    what the order of rows in a task changes lies below."""
    dim = len(model.values)

    def products(batches):
        held = np.zeros((components, components))
        for _, x in _matrices(batches, dim):
            z = np.nan_to_num(whitened_rows(x * model.n - model.sums, model, components))
            held += z.T @ z
        i, j = np.indices(held.shape)
        yield pa.RecordBatch.from_arrays([pa.array(a.ravel()) for a in (i, j, held)], names=["i", "j", "s"])

    rows = distinct.mapInArrow(products, "i long, j long, s double").groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,15)")).alias("s")).collect()
    flat = model.flat()
    wanted = [abs(float(r["s"]) / model.n - (r["i"] == r["j"])) for r in rows if not flat[r["i"]] and not flat[r["j"]]]
    return round(max(wanted, default=0.0), 12)


def whiten(vectors: DataFrame, components: int = 4, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each remaining vector and each
    of the first components."""
    spark = vectors.sparkSession
    kept, dim = _whole_vectors(vectors, vec_id, vector)
    id_type = kept.schema["vec_id"].dataType.simpleString()
    columns = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    distinct = staged(kept.select("x").distinct(), "whitening-fit") if dim else None
    model = fit(distinct, dim) if dim else None
    if model is None:
        return spark.createDataFrame([], columns)
    components = min(components, dim)
    error, explained = identity_error(distinct, model, components), model.explained()[:components]

    def transform(batches):
        for b, x in _matrices(batches, dim):
            y = x * model.n - model.sums
            size = int(np.abs(y).max(initial=0))
            if size * size * dim < 1 << 62:
                deviation = pa.array((y * y).sum(1))
            else:
                exact = [sum(v * v for v in row) for row in y.tolist()]
                deviation = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
            z, m = whitened_rows(y, model, components), len(x)
            take = pa.array(np.repeat(np.arange(m), components))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("vec_id").take(take), pa.array(np.tile(np.arange(1, components + 1, dtype=np.int32), m)), pa.array(np.full(m * components, model.n)),
                    deviation.take(take), pa.array(z.ravel(), from_pandas=True), pa.array(explained * m, pa.float64()), pa.array(np.full(m * components, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return kept.mapInArrow(transform, columns)

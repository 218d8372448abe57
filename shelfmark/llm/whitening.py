"""Whitening of embeddings by a pivoted Cholesky factor and one-sided Jacobi rotations.

Components of vectors become integers, x = floor(scale * c) + shift. The fit list holds each distinct integer vector once.
Its means are exact (integer sums), rows are centred by them before anything is multiplied, and each task adds up the
scatter of its rows; Spark adds the tasks' sums. The factor of that d x d matrix is rotated, column against column, until
its columns are orthogonal: their squared norms are the eigenvalues and the normalised columns the components. Only
matrices of the vectors' width reach the driver, whatever the number of rows.

Defined results: a vector that is null or holds null or non-finite components takes no part; shorter vectors are filled up
with zeros to the width of the longest; 64 * c is held within +-2**61, where the integers end; null and repeated ids come
back as they are, a row for each of theirs; there are as many components as the list has independent directions (pivots
above width * 2**-52 of the largest variance), at most the number asked for, so equal vectors or a single one give no row;
an empty table gives an empty one. Deviations are decimals, null where 38 digits are too few. Only the named columns are
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.tables import written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Integers are held within this, so that the difference of two fits 64 bits.
LIMIT = float(1 << 61)
#: Vectors whose products are taken at once.
BLOCK = 4096
SWEEPS = 60


@dataclass
class Fit:
    """What the fit list says: n, sums of each dimension, eigenvalues, components as columns, and the total variance."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float


def usable(vector: Column) -> Column:
    """The vector is not null and holds finite numbers only."""
    v = vector.cast("array<double>")
    return F.coalesce(F.forall(v, lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False))), F.lit(False))


def integers(vector: Column, width: int, scale: int, shift: int) -> Column:
    """The integers of a vector, filled up to a width."""
    own = F.transform(vector.cast("array<double>"), lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(LIMIT)), F.lit(-LIMIT))).cast("long") + F.lit(shift).cast("long"))
    return F.concat(own, F.array_repeat(F.lit(shift).cast("long"), F.lit(width) - F.size(vector)))


def rows_of(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


def blocks(batches: Iterator[pa.RecordBatch], name: str, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of at most BLOCK rows and their integers."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            piece = batch.slice(start, BLOCK)
            yield piece, rows_of(piece, name, width)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x minus the exact means: the whole part is taken off in integers, the fraction of it afterwards."""
    whole, rest = np.array([s // n for s in sums], dtype=np.int64), np.array([(s % n) / n for s in sums])
    return (x - whole).astype(np.float64) - rest


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The sum over dimensions of (n * x - sum)**2, exactly, for each row."""
    z = x - np.array([s // n for s in sums], dtype=np.int64)
    rest = [s % n for s in sums]
    reach = int(np.abs(z).max(initial=0))
    if max(reach, 1) * max(reach, n) * len(sums) < 1 << 62:
        squares = (z * z).sum(axis=1).tolist()
        crossed = (z @ np.array(rest, dtype=np.int64)).tolist()
    else:
        big = z.astype(object)
        squares, crossed = (big * big).sum(axis=1).tolist(), (big @ np.array(rest, dtype=object)).tolist()
    own = sum(r * r for r in rest)
    return [n * n * a - 2 * n * b + own for a, b in zip(squares, crossed)]


def pivoted_cholesky(matrix: np.ndarray) -> np.ndarray:
    """A factor F with F @ F.T equal to the matrix, one column for each pivot; it is triangular in the order of the pivots."""
    size = len(matrix)
    left = np.diag(matrix).astype(float)
    floor = size * np.finfo(float).eps * left.max(initial=0.0)
    factor, open_ = np.zeros((size, size)), np.ones(size, dtype=bool)
    for k in range(size):
        pivot = int(np.argmax(np.where(open_, left, -np.inf)))
        if not left[pivot] > floor:
            return factor[:, :k]
        column = (matrix[:, pivot] - factor[:, :k] @ factor[pivot, :k]) / np.sqrt(left[pivot])
        column[~open_], column[pivot] = 0.0, np.sqrt(left[pivot])
        factor[:, k], open_[pivot] = column, False
        left = left - column * column
    return factor


def orthogonal_columns(factor: np.ndarray) -> np.ndarray:
    """The factor's columns rotated in pairs until all are orthogonal; disjoint pairs are rotated together."""
    own = factor.copy()
    n = own.shape[1]
    seats = np.arange(n + n % 2)
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(len(seats) - 1):
            i, j = seats[:len(seats) // 2], seats[len(seats) // 2:][::-1]
            real = (i < n) & (j < n)
            i, j = i[real], j[real]
            x, y = own[:, i], own[:, j]
            a, b, c = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                angle = np.nan_to_num(np.abs(c) / np.sqrt(a * b))
                zeta = (b - a) / (2 * c)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            t = np.where(angle > 1e-16, np.nan_to_num(t), 0.0)
            worst = max(worst, float(angle.max(initial=0.0)))
            cos = 1 / np.sqrt(1 + t * t)
            own[:, i], own[:, j] = cos * x - cos * t * y, cos * t * x + cos * y
            seats = np.concatenate((seats[:1], seats[-1:], seats[1:-1]))
        if worst < 1e-15:
            break
    return own


def principal(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit eigenvectors as columns; fewer if the rank is lower."""
    rotated = orthogonal_columns(pivoted_cholesky(matrix))
    values = (rotated * rotated).sum(axis=0)
    order = np.argsort(-values, kind="stable")[:k]
    return values[order], rotated[:, order] / np.sqrt(values[order])


def added(partial: DataFrame, size: int) -> np.ndarray:
    """The sum of the tasks' matrices, each given as rows (__i, __row)."""
    cells = partial.select("__i", F.posexplode("__row").alias("__j", "__v")).groupBy("__i", "__j").agg(F.sum("__v").alias("__v"))
    out = np.zeros((size, size))
    for r in cells.collect():
        out[r["__i"], r["__j"]] = r["__v"]
    return (out + out.T) / 2


def scatter(fit_list: DataFrame, width: int, size: int, of_rows) -> np.ndarray:
    """The sum of y y' over the list, where y are the rows that of_rows makes of the integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for _, x in blocks(batches, "__x", width):
            y = of_rows(x)
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["__i", "__row"])

    return added(fit_list.mapInArrow(run, "__i int, __row array<double>"), size)


def fit(fit_list: DataFrame, width: int, k: int = COMPONENTS) -> Fit | None:
    """Means, eigenvalues and components of a list of distinct integer vectors __x; None for an empty list."""
    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * width
        for _, x in blocks(batches, "__x", width):
            # halves of the integers add up without an overflow
            high, low = (x >> 31).sum(axis=0).tolist(), (x & ((1 << 31) - 1)).sum(axis=0).tolist()
            n, sums = n + len(x), [s + (a << 31) + b for s, a, b in zip(sums, high, low)]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))], ["__i", "__n", "__s"])

    found = fit_list.mapInArrow(totals, "__i int, __n long, __s decimal(38,0)").groupBy("__i").agg(F.sum("__n").alias("n"), F.sum("__s").alias("s")).collect()
    if not found:
        return None
    by_dimension = {r["__i"]: r for r in found}
    n, sums = found[0]["n"], [int(by_dimension[i]["s"]) for i in range(width)]
    covariance = scatter(fit_list, width, width, lambda x: centred(x, n, sums)) / n
    values, components = principal(covariance, k)
    return Fit(n, sums, values, components, float(np.trace(covariance)))


def whitened_rows(x: np.ndarray, model: Fit) -> np.ndarray:
    return centred(x, model.n, model.sums) @ model.components / np.sqrt(model.values)


def identity_error(fit_list: DataFrame, width: int, model: Fit) -> float:
    """The largest entry of the whitened list's covariance minus the identity; the list's means are zero already."""
    size = len(model.values)
    found = scatter(fit_list, width, size, lambda x: whitened_rows(x, model)) / model.n
    return float(np.abs(found - np.eye(size)).max(initial=0.0))


def whiten(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained and identity_error for each usable row and component."""
    fine = table.where(usable(F.col(vec_col))).select(F.col(id_col).alias("__id"), F.col(vec_col).alias("__v"))
    id_type = fine.schema["__id"].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    width = fine.agg(F.max(F.size("__v"))).first()[0]
    if not width:  # no vectors, or only empty ones
        return table.sparkSession.createDataFrame([], schema)
    rows = fine.select("__id", integers(F.col("__v"), width, scale, shift).alias("__x"))
    fit_list = written(rows.select("__x").distinct())
    model = fit(fit_list, width, k)
    if model is None or not len(model.values):
        return table.sparkSession.createDataFrame([], schema)
    error = identity_error(fit_list, width, model)
    size = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, share = np.arange(1, size + 1, dtype=np.int32), model.values / model.trace
        top = 10**38
        for batch, x in blocks(batches, "__x", width):
            of_row = pa.array(np.repeat(np.arange(len(x)), size))
            exact = pa.array([Decimal(s) if s < top else None for s in deviations(x, model.n, model.sums)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([
                batch.column("__id").take(of_row), pa.array(np.tile(numbers, len(x))), pa.array(np.full(len(of_row), model.n)), exact.take(of_row),
                pa.array(whitened_rows(x, model).ravel()), pa.array(np.tile(share, len(x))), pa.array(np.full(len(of_row), error))],
                [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)

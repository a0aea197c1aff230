"""Embedding whitening by matrix-free block subspace iteration.

The fit list is stored once: each distinct integer vector. A pass over it computes X^T(XQ) of its centred rows for a block
Q of orthonormal columns, as sums of small matrices over the tasks; the covariance itself is never made. QR and a
Rayleigh-Ritz step follow on the driver, on matrices as wide as the block. Passes end when the residual of each of the k
components certifies it as an eigenpair. Where the residuals fall too slowly, the block is widened by random directions: the
flatter the spectrum, the wider the block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.partitions import spread
from .work import map_arrow, stored

#: Columns of the first block, and passes that it may still need before it is widened.
BLOCK = 32
PATIENCE = 6
#: Residual of a certified component, relative to the largest eigenvalue.
RESIDUAL = 1e-13
#: Eigenvalues below this part of the largest are zero: what is left of them is rounding.
ZERO = 1e-12
MOST_PASSES = 400


class Components(NamedTuple):
    """Of the covariance of ``n`` vectors with sums ``sums``: vectors as columns, eigenvalues falling, residuals."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    residuals: np.ndarray
    trace: float
    identity_error: float | None
    passes: int


def whole_numbers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long"))


def is_finite(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def matrices(batches: Iterable[pa.RecordBatch], at: int = 0) -> Iterator[np.ndarray]:
    """A column of arrays of one length as int64 matrices."""
    for batch in batches:
        if batch.num_rows:
            yield batch.column(at).flatten().to_numpy().reshape(batch.num_rows, -1)


def summed(fit: DataFrame, of: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The sum of ``of(x)``, ``width`` columns wide, over slices x of the rows: by task, then by row of the matrix."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in matrices(batches):
            total = of(x) if total is None else total + of(x)
        if total is not None:
            rows = pa.ListArray.from_arrays(np.arange(0, total.size + 1, width, dtype=np.int32), np.ascontiguousarray(total).ravel())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), rows], names=["row", "v"])

    out = map_arrow(fit, run, "row int, v array<double>").groupBy("row").agg(F.array(*(F.sum(F.col("v")[i]) for i in range(width))).alias("v"))
    rows = out.orderBy("row").toArrow().column("v").to_pylist()  # as many rows as a vector has entries
    return np.array(rows, dtype=np.float64)


def exact_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Rows and sums of each entry, exact: high and low halves are summed apart."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in matrices(batches):
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(x.shape[1]), pa.int32()), pa.array(np.full(x.shape[1], len(x))), pa.array(high), pa.array(low)], names=["row", "n", "high", "low"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(28,0)")).alias(c)
    out = map_arrow(fit, run, "row int, n bigint, high bigint, low bigint").groupBy("row").agg(F.sum("n").alias("n"), exact("high"), exact("low"))
    rows = out.orderBy("row").collect()  # as many rows as a vector has entries
    return (rows[0]["n"] if rows else 0), [int(r["high"]) * (1 << 32) + int(r["low"]) for r in rows]


def components(fit: DataFrame, k: int, block: int = BLOCK, seed: int = 42) -> Components:
    """The first ``k`` components of a stored table of distinct vectors ``x``, all of one length.

    Raises ArithmeticError where MOST_PASSES do not certify them.
    """
    fit = fit.coalesce(2 * fit.sparkSession.sparkContext.defaultParallelism)  # so many small matrices to sum
    n, sums = exact_sums(fit)
    mean = np.array([s / n for s in sums])
    d = len(sums)
    k = min(k, d)
    block = min(d, max(block, 2 * k))
    random = np.random.default_rng(seed)
    q = np.linalg.qr(random.standard_normal((d, block)))[0]
    before = None
    for passes in range(1, MOST_PASSES + 1):

        def applied(x: np.ndarray, q: np.ndarray = q) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ q)

        y = summed(fit, applied, q.shape[1]) / n
        values, turn = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors, images = q @ turn, y @ turn
        residuals = np.linalg.norm(images - vectors * values, axis=0)[:k]
        worst = residuals.max() / values[0] if values[0] > 0 else 0.0
        if worst <= RESIDUAL:
            break
        fall = math.log(before / worst) if before and before > worst else None
        wider = min(d, 2 * q.shape[1])
        if before is not None and (fall is None or math.log(worst / RESIDUAL) > PATIENCE * fall) and wider > q.shape[1]:
            images = np.hstack([images, random.standard_normal((d, wider - q.shape[1])) * values[-1]])
            before = None
        else:
            before = worst
        q = np.linalg.qr(images)[0]
    else:
        raise ArithmeticError(f"{MOST_PASSES} passes leave a residual of {worst} times the largest eigenvalue")
    vectors = vectors[:, :k] / np.linalg.norm(vectors[:, :k], axis=0)
    values = np.where(values[:k] > ZERO * values[0], values[:k], 0.0)
    out = Components(n, sums, vectors, values, residuals, 0.0, None, passes)

    def checked(x: np.ndarray) -> np.ndarray:
        z = whitened(x, out)
        return np.vstack([z.T @ z, z.sum(axis=0), np.full(k, np.square(x - mean).sum())])

    sums_of = summed(fit, checked, k)
    covariance = sums_of[:k] / n - np.outer(sums_of[k], sums_of[k]) / n**2
    real = values > 0
    error = np.abs(covariance - np.eye(k))[np.ix_(real, real)].max() if real.any() else None
    return out._replace(trace=sums_of[k + 1, 0] / n, identity_error=error)


def whitened(x: np.ndarray, c: Components) -> np.ndarray:
    """Centred rows on the components, over the roots of the eigenvalues; 0 for a component without variance."""
    root = np.sqrt(np.where(c.values > 0, c.values, np.inf))
    return (x - np.array([s / c.n for s in c.sums])) @ c.vectors / root


def deviations(x: np.ndarray, c: Components) -> list[int | None]:
    """The sum of squares of n * x - S of each row, exact; null beyond a long."""
    widest = max(c.n * int(np.abs(x).max()) + max(map(abs, c.sums)), 1)
    if widest * widest * len(c.sums) < 1 << 63:
        return np.square(c.n * x - np.array(c.sums)).sum(axis=1).tolist()
    exact = [sum((c.n * v - s) ** 2 for v, s in zip(row, c.sums, strict=True)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def fit_list(df: DataFrame, vector_col: str, scale: int) -> DataFrame:
    """Every distinct whole-number vector ``x`` of the commonest length (the longer of equals), stored."""
    x = df.where(is_finite(F.col(vector_col)) & (F.size(vector_col) > 0)).select(whole_numbers(F.col(vector_col), scale).alias("x"))
    x = stored(x.distinct(), "fit")
    size = x.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return x.where(F.size("x") == (size["size"] if size else 0))


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 4, scale: int = 256, block: int = BLOCK, seed: int = 42) -> DataFrame:
    """Per usable row and component, from 1: ``id_col``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    An entry c counts as floor(scale * c). Components are those of the distinct vectors, each once; there are as many as a vector
    has entries, ``k`` at most. Rows go whose vector is null or empty, holds nulls, NaN or infinities, or is not of the commonest
    length among the distinct ones. Components without variance (all of them for one distinct vector) have a null ``whitened`` and do not
    count in ``identity_error``; without any variance ``explained`` is null too. ``deviation`` is null where it is beyond a long. Rows
    that repeat and null ids stay; an empty table gives an empty result. Other columns are ignored.
    """
    fit = fit_list(df, vector_col, scale)
    row = df.select(F.col(id_col), F.col(vector_col).alias("__vector"))
    schema = f"`{id_col}` {row.schema[0].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if fit.isEmpty():
        return df.sparkSession.createDataFrame([], schema)
    c = components(fit, k, block, seed)
    row = row.where(is_finite(F.col("__vector")) & (F.size("__vector") == len(c.sums))).select(id_col, whole_numbers(F.col("__vector"), scale).alias("__x"))
    parts = [float(v / c.trace) if c.trace > 0 else None for v in c.values]
    width = len(parts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in matrices([batch], 1):
                rows = len(x)
                z = whitened(x, c)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(np.arange(rows), width))),
                        pa.array(np.tile(np.arange(1, width + 1), rows), pa.int32()),
                        pa.array(np.full(rows * width, c.n), pa.int64()),
                        pa.array([v for v in deviations(x, c) for _ in range(width)], pa.int64()),
                        pa.array(z.ravel(), mask=np.tile(c.values <= 0, rows)),
                        pa.array(parts * rows, pa.float64()),
                        pa.array([c.identity_error] * (rows * width), pa.float64()),
                    ],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return map_arrow(row, run, schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four components of ``embeddings`` and every row on them."""
    return whiten(spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))

"""Whitening of embeddings.

The scatter of the distinct quantised vectors is gathered over the cluster, each
vector centred before it is multiplied; the driver diagonalises the matrix with
cyclic Jacobi rotations, whose off-diagonals vanish relative to the diagonal,
so that small eigenvalues come out accurately; and the whitening matrix is
broadcast to project every row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inkspan.llm.columns import unused, without
from inkspan.llm.scratch import Tables

OUTPUTS = ("component", "n", "deviation", "whitened", "explained", "identity_error")
#: Longest vectors; their scatter has at most that many squared entries in the driver.
MAX_DIMENSIONS = 4096
SWEEPS = 60


@dataclass(frozen=True)
class Whitening:
    """Fitted on ``n`` distinct vectors with exact per-dimension ``sums``; ``vectors`` holds one unit eigenvector a column."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n; the integer part of the mean is taken off in integers, so no digit of a large mean is lost."""
        whole = [s // self.n for s in self.sums]
        part = np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole)])
        return (x - np.array(whole, x.dtype)).astype(np.float64) - part

    def project(self, x: np.ndarray, count: int) -> np.ndarray:
        """Whitened coordinates; those of a component without variance are NaN."""
        values = self.values[:count]
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(values > 0, 1 / np.sqrt(np.where(values > 0, values, 1)), np.nan)
        return (self.centred(x) @ self.vectors[:, :count]) * scale

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of (n x - S)^2, in exact integers."""
        reach = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        kind = np.int64 if reach * reach * max(1, x.shape[1]) < 2**63 else object
        off = x.astype(kind) * self.n - np.array(self.sums, kind)
        return [int(v) for v in (off * off).sum(axis=1)]


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, by cyclic Jacobi rotations.

    A rotation is left out where the entry is below rounding of its two
    diagonal entries' geometric mean; the sweeps end when all are. Each vector's
    largest entry is positive.
    """
    a = np.array(matrix, np.float64)
    d = len(a)
    vectors, tiny = np.eye(d), np.finfo(np.float64).eps
    for _ in range(SWEEPS):
        turned = False
        for p in range(d - 1):
            for q in range(p + 1, d):
                off = a[p, q]
                if abs(off) <= tiny * math.sqrt(abs(a[p, p] * a[q, q])) or abs(off) < 1e-300:
                    continue
                turned = True
                theta = (a[q, q] - a[p, p]) / (2 * off)
                t = math.copysign(1.0, theta) / (abs(theta) + math.hypot(theta, 1.0))
                c = 1 / math.hypot(t, 1.0)
                s = t * c
                turn = np.array([[c, s], [-s, c]])
                pp, qq = a[p, p] - t * off, a[q, q] + t * off
                both = a[:, [p, q]] @ turn
                a[:, [p, q]] = both
                a[[p, q], :] = both.T
                a[p, p], a[q, q], a[p, q], a[q, p] = pp, qq, 0.0, 0.0
                vectors[:, [p, q]] = vectors[:, [p, q]] @ turn
        if not turned:
            break
    values = np.diag(a).copy()
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    for k in range(d):
        if vectors[np.argmax(np.abs(vectors[:, k])), k] < 0:
            vectors[:, k] *= -1
    return np.maximum(values, 0.0), vectors


def quantised(vector: Column | str, scale: float = 256.0) -> Column:
    """floor(scale * c) of every entry, as array<bigint>; null where the vector is, or where an entry is null, not finite or beyond a long."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    sound = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < 9.2e18)
    wide = F.transform(vector, lambda c: c.cast("double"))
    return F.when(F.forall(wide, sound), F.transform(wide, lambda c: F.floor(c * scale).cast("long")))


def _matrix(batch: pa.RecordBatch, at: int, dimensions: int) -> np.ndarray:
    return np.asarray(batch.column(at).flatten(), np.int64).reshape(-1, dimensions)


def _totals(fit: DataFrame, width: int, dimensions: int, of) -> list:
    """Sum over the rows of ``of(x)``, an array of ``width`` doubles or exact integers, gathered by entry."""

    def partial(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                found = of(_matrix(batch, 0, dimensions))
                total = found if total is None else total + found
        if total is not None:
            exact = total.dtype == object
            values = [str(v) for v in total.ravel()] if exact else None
            columns = [pa.array(range(width), pa.int32()), pa.array(values, pa.string()) if exact else pa.nulls(width, pa.string()), pa.nulls(width, pa.float64()) if exact else pa.array(total.ravel(), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["at", "whole", "real"])

    parts = fit.mapInArrow(partial, "at int, whole string, real double")
    rows = parts.groupBy("at").agg(F.sum(F.col("whole").cast("decimal(38,0)")).alias("whole"), F.sum("real").alias("real")).collect()
    found = [0] * width
    for row in rows:
        found[row["at"]] = row["real"] if row["whole"] is None else int(row["whole"])
    return found


def _exact_sums(x: np.ndarray) -> np.ndarray:
    if len(x) * int(np.abs(x).max(initial=0)) < 2**62:
        return x.sum(axis=0).astype(object)
    return x.astype(object).sum(axis=0)


def _covariance(fit: DataFrame, model: Whitening, count: int | None) -> np.ndarray:
    """Covariance, divisor n, of the fit list's vectors, or of their first ``count`` whitened coordinates: centred, then multiplied."""
    d, width = len(model.sums), count or len(model.sums)
    shared = fit.sparkSession.sparkContext.broadcast(model)
    mean = np.zeros(width)
    if count:
        mean = np.array(_totals(fit, width, d, lambda x: shared.value.project(x, count).sum(axis=0))) / model.n

    def scatter(x: np.ndarray) -> np.ndarray:
        off = (shared.value.project(x, count) if count else shared.value.centred(x)) - mean
        return off.T @ off

    return np.array(_totals(fit, width * width, d, scatter)).reshape(width, width) / model.n


def whiten(embeddings: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """One row per sound vector and component: ``embeddings`` less the vector, with ``component int``, ``n long``,
    ``deviation decimal(38,0)``, ``whitened``, ``explained`` and ``identity_error`` (double).

    A vector is dropped if it is null, empty, holds a null, a NaN or an infinity
    or an entry whose quantised value is no long, or if its length is not the
    table's (the commonest one; of equally common ones the longest): it has no
    place in the space. The fit list is each distinct quantised vector once, so
    copies have no say. ``deviation`` is the sum of (n x - S)^2, exact.

    Components are numbered from 1 by falling eigenvalue, at most as many as
    there are dimensions. A component without variance (all vectors equal, or
    rank deficiency) has a null ``whitened`` and is left out of
    ``identity_error``; without any variance ``explained`` and
    ``identity_error`` are null. An empty table gives an empty result. Input
    columns named like an output are replaced by it; others are kept.

    Sums and scatter are added up by entry over the cluster; the driver gets
    d + d^2 numbers for vectors of length d, and d is at most
    ``MAX_DIMENSIONS``. What is broadcast is the fitted matrix.
    """
    spark = embeddings.sparkSession
    clean = without(embeddings, *OUTPUTS)
    kept = [c for c in clean.columns if c.lower() != vector_col.lower()]
    (x,) = unused(clean, "x")
    rows = clean.withColumn(x, quantised(vector_col, scale)).filter(F.size(x) > 0).select(*kept, x)
    schema = StructType([*rows.select(*kept).schema.fields, *StructType.fromDDL("component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double").fields])
    lengths = rows.groupBy(F.size(x).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    d = lengths[0]["d"]
    if d > MAX_DIMENSIONS:
        raise ValueError(f"vectors of {d} entries are over the bound of {MAX_DIMENSIONS}")
    rows = rows.filter(F.size(x) == d)
    count = min(components, d)

    tables = Tables(spark)
    fit = tables.write(rows.select(F.col(x).alias("x")).distinct(), "fit-list")
    n = fit.count()
    sums = tuple(_totals(fit, d, d, _exact_sums))
    model = Whitening(n, sums, np.zeros(d), np.eye(d), 0.0)
    covariance = _covariance(fit, model, None)
    covariance = (covariance + covariance.T) / 2
    values, vectors = jacobi(covariance)
    trace = float(np.trace(covariance))
    values = np.where(values > d * np.finfo(np.float64).eps * max(trace, 0.0), values, 0.0)
    model = Whitening(n, sums, values, vectors, trace)
    some = int((values[:count] > 0).sum())
    error = float(np.abs(_covariance(fit, model, some) - np.eye(some)).max()) if some else None
    tables.clear()

    shared = spark.sparkContext.broadcast(model)
    at, explained = len(kept), [float(v / trace) if trace > 0 else None for v in values[:count]]

    def scored(batches):
        for batch in batches:
            model, found = shared.value, _matrix(batch, len(kept), d)
            if not len(found):
                continue
            rows = np.repeat(np.arange(len(found)), count)
            flat = model.project(found, count).ravel()
            deviations = pa.array(model.deviations(found), pa.decimal128(38, 0)).take(pa.array(rows))
            own = [batch.column(i).take(pa.array(rows)) for i in range(at)]
            number = np.tile(np.arange(count), len(found))
            columns = [*own, pa.array(number + 1, pa.int32()), pa.array(np.full(len(rows), model.n), pa.int64()), deviations, pa.array(flat, pa.float64(), mask=np.isnan(flat))]
            columns += [pa.array([explained[k] for k in number], pa.float64()), pa.array([error] * len(rows), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(scored, schema)

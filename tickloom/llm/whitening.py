"""Embedding whitening by shifted CholeskyQR.

Entries become integers floor(scale * c). The fit list holds every distinct vector once; with its n vectors and
sums S, row x is centred as (n*x - S)/n, exact up to the last division. Each pass sends the centred rows
through triangular solves with the factors found so far and adds up the Gram matrix of what comes out, one
partial matrix per task, summed by Spark. Its Cholesky factor, of the matrix plus a small shift while it is far from
the identity, joins the composed factor R, until the rows are orthonormal. The singular values and right
vectors of R are those of the centred rows, so their squares over n are the covariance's eigenvalues,
without the squared condition number that an eigen-solver on the covariance itself would meet.

Rows lie in tasks only; the driver holds matrices of the vectors' dimension.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import store

UNIT = float(np.finfo(np.float64).eps) / 2
DONE = 1e-13
MOST = 1 << 62
ROWS = 4096


def _vectors(table: DataFrame, id: str, vector: str, scale: int) -> DataFrame:
    """(id, x): integer vectors of the rows that take part."""
    entries = F.col("v")
    scaled = F.transform(entries, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("double"))
    plain = F.exists(entries, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) * float(scale) >= float(MOST)))
    held = table.select(F.col(id).alias("id"), F.col(vector).alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0) & ~plain)
    lengths = held.groupBy(F.size("v").alias("len")).count().orderBy(F.desc("count"), F.desc("len")).limit(1).collect()
    usual = lengths[0]["len"] if lengths else 0
    return held.filter(F.size("v") == usual).select("id", F.transform(scaled, lambda c: c.cast("long")).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S of the rows of ``x``, exact: in 64 bits where they hold it, else in Python integers."""
    top = max((abs(s) for s in sums), default=0)
    if len(x) and n * int(np.abs(x).max()) + top < MOST:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def solve_rows(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """``rows`` times the inverse of the upper triangular matrix, by forward substitution over its columns."""
    out = np.empty_like(rows)
    for j in range(upper.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


def factor(gram: np.ndarray, shift: float) -> np.ndarray:
    """Upper Cholesky factor of ``gram`` plus the smallest tenfold of ``shift`` that makes it one."""
    own = np.eye(len(gram))
    try:
        return np.linalg.cholesky(gram if shift == 0 else gram + shift * own).T
    except np.linalg.LinAlgError:
        return factor(gram, 10 * shift if shift else 11 * len(gram) * (len(gram) + 1) * UNIT * max(np.linalg.norm(gram, 2), 1e-300))


def gram(fit: DataFrame, n: int, sums: list[int], factors: list[np.ndarray], project: np.ndarray | None = None) -> np.ndarray:
    """Gram matrix of the centred rows after the solves, or of their projections on the columns of ``project``."""
    spark, size = fit.sparkSession, len(sums) if project is None else project.shape[1]
    known = spark.sparkContext.broadcast((n, sums, factors, project))  # matrices of the vectors' dimension

    def run(batches):
        n, sums, factors, project = known.value
        total = np.zeros((size, size))
        for batch in batches:
            x = _matrix(batch.column(0))
            for at in range(0, len(x), ROWS):
                rows = (centred(x[at:at + ROWS], n, sums) / n).astype(np.float64)
                for upper in factors:
                    rows = solve_rows(rows, upper)
                if project is not None:
                    rows = rows @ project
                total += rows.T @ rows
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "v"])

    cells = fit.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()  # size * (size + 1) / 2 rows
    out = np.zeros((size, size))
    out[cells["i"], cells["j"]] = cells["v"]
    out[cells["j"], cells["i"]] = cells["v"]
    return out


def cholesky_qr(pass_over, passes: int = 12) -> tuple[np.ndarray, float]:
    """(R, squared norm): R'R is the Gram matrix of the rows, by ``pass_over(factors)``, the Gram after the solves.

    The first pass is shifted, so that dependent or constant dimensions do no harm; so are later ones whose Gram is not
    yet near the identity or, on dependent dimensions, singular. What the last pass leaves between Q'Q and
    the identity goes into R by its square root, so R is right wherever the passes stop.
    """
    factors, composed, norm = [], None, 0.0
    for turn in range(passes):
        found = pass_over(factors)
        if turn == 0:
            norm = float(np.trace(found))
            composed = np.eye(len(found))
        if norm == 0:
            return np.zeros_like(found), 0.0
        far = np.abs(found - np.eye(len(found))).max()
        values, vectors = np.linalg.eigh(found)
        if far < DONE * len(found) or turn == passes - 1:
            break
        size = len(found)
        shift = 11 * size * (size + 1) * UNIT * max(values[-1], 0.0) if turn == 0 or values[0] < 1e-6 else 0.0
        upper = factor(found, shift)
        factors.append(upper)
        composed = upper @ composed
    root = (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T
    return root @ composed, norm


def whiten(table: DataFrame, *, id: str = "vec_id", vector: str = "embedding", scale: int = 256, components: int = 4) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) per row and component.

    A row takes part if its vector is neither null nor empty and holds no null, no non-finite entry and none whose
    scaled value passes 2^62; a vector of another length than most rows' (ties: the longer) lacks entries, which count as
    null. Repeated rows, equal vectors and null ids each give their own rows, while the fit list holds a vector once. Components with an
    eigenvalue of zero (against the largest, in double precision) cannot be whitened and give no rows: constant
    or dependent dimensions give fewer components, a single vector none; an empty table gives an empty result. ``deviation`` is exact,
    null where it passes 64 bits.
    """
    kind = table.schema[id].dataType.simpleString()
    rows = store(_vectors(table, id, vector, scale), "vectors")
    fit = store(rows.select("x").distinct(), "fit")
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    sized = fit.select(F.posexplode("x")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")) \
        .orderBy("pos").collect()  # one row per dimension
    spark = table.sparkSession
    if not sized:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id)
    n, sums = sized[0]["n"], [int(r["s"]) for r in sized]
    r, norm = cholesky_qr(lambda factors: gram(fit, n, sums, factors))
    _, sigma, right = np.linalg.svd(r)
    kept = [k for k in range(min(components, len(sigma))) if sigma[k] > len(sums) * 4 * UNIT * sigma[0]]
    if not kept:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id)
    values = sigma[kept] ** 2 / n
    explained = sigma[kept] ** 2 / float(np.sum(sigma ** 2))
    axes = right[kept].T / np.sqrt(values)
    error = float(np.abs(gram(fit, n, sums, [], axes) / n - np.eye(len(kept))).max())
    known = spark.sparkContext.broadcast((n, sums, axes))  # dimension times components

    def run(batches):
        n, sums, axes = known.value
        count = axes.shape[1]
        for batch in batches:
            if not batch.num_rows:
                continue
            z = centred(_matrix(batch.column(1)), n, sums)
            top = int(np.abs(z).max()) if z.size else 0
            if z.dtype != object and top * top * z.shape[1] < MOST:
                deviation = (z * z).sum(1).tolist()
            else:
                exact = [sum(int(c) ** 2 for c in row) for row in z]
                deviation = [d if d < 1 << 63 else None for d in exact]
            white = (z / n).astype(np.float64) @ axes
            owner = np.repeat(np.arange(len(z)), count)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner)), pa.array(np.tile(np.arange(1, count + 1), len(z)), pa.int32()),
                 pa.array(np.full(len(owner), n), pa.int64()), pa.array([d for d in deviation for _ in range(count)], pa.int64()),
                 pa.array(white.ravel()), pa.array(np.tile(explained, len(z))), pa.array(np.full(len(owner), error))],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id)

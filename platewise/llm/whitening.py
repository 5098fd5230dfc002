"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

With A the centred rows, each step multiplies A by a right vector and the transpose of A by a left one:

    p = A v_j - beta_{j-1} u_{j-1},  u_j = p / alpha_j,  r = A' u_j - alpha_j v_j,  v_{j+1} = r / beta_j,

p is orthogonalised against all left vectors and r against all right ones. The singular values and right vectors of A are those
of the small bidiagonal matrix of alphas and betas, so no matrix of dimension times dimension is ever summed over the rows.

A left vector has an entry for each row, but every left vector is A w for some w of the vectors' dimension. Only the w's are
kept: a task computes its part of the left vectors from its rows, in one pass that gives p, its products with all left
vectors and A' p together. What reaches the driver is a few numbers for each dimension, added up in Spark. The rows are
packed once into blocks of integers in the shared folder, so that a lost executor costs one block of one pass.

Rows whose vector is null, holds a null or non-finite entry, or is shorter than the longest vector take no part. A null id
stays null; repeated rows count each; no rows, or vectors without entries, give no rows. Directions without variance
(beyond rounding) have no component. A single row, or equal rows, have none and give no rows. Other columns, of whatever
name, are not read. A deviation beyond 64 bits, or an entry beyond 2^52 once
scaled, is an error, not a wrong number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm.common import stored

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Vectors in a block.
BLOCK_ROWS = 4096
#: A singular vector has converged when its residual is below so many largest singular values.
TOLERANCE = 1e-14
SEED = 13


def dense(column: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that hold ``width`` finite entries, their entries as doubles)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    good = ~np.asarray(column.is_null())
    sizes = np.asarray(column.value_lengths().fill_null(0))
    good &= sizes == width
    at = np.flatnonzero(good)
    if not len(at) or not width:
        return at[:0], np.zeros((0, width))
    flat = column.take(pa.array(at)).flatten()
    values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan), np.float64).reshape(len(at), width)
    finite = np.isfinite(values).all(axis=1)
    return at[finite], values[finite]


def integer_blocks(embeddings: DataFrame, width: int, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """Blocks (ids, x): floor(scale * entry) + shift of the complete vectors, as 32-bit integers, or 64-bit ones where those are
    too small (row after row)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, values = dense(batch.column(1), width)
            if len(at) and np.abs(values).max() * scale > 2**52:
                raise OverflowError("an entry is no exact integer at this scale")
            x = (np.floor(scale * values) + shift).astype(np.int64)
            ids = batch.column(0).take(pa.array(at))
            for i in range(0, len(at), BLOCK_ROWS):
                part = x[i : i + BLOCK_ROWS]
                raw = part.astype(np.int32) if np.abs(part).max() < 2**31 else part
                yield pa.RecordBatch.from_arrays([pa.array([ids.slice(i, len(part)).to_pylist()], pa.list_(pa.int64())), pa.array([raw.tobytes()], pa.binary())], names=["ids", "x"])

    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(pack, "ids array<long>, x binary")


def matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, rows as 64-bit integers) of each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            raw, ids = batch.column(1)[i].as_py(), batch.column(0)[i].values
            kind = np.int32 if len(raw) == 4 * width * len(ids) else np.int64
            yield ids, np.frombuffer(raw, kind).reshape(-1, width).astype(np.int64)


@dataclass
class Centre:
    """Sums of the integer rows: n, and S for each dimension, split as n * whole + rest."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    def rows(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, without the rounding error of a large mean."""
        return (x - self.whole) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """The sum over dimensions of (n * x - S) squared, exactly."""
        about = np.abs((x - self.whole) * float(self.n) - self.rest)
        if len(x) and (about**2).sum(axis=1).max() > 9e18:
            raise OverflowError("a deviation does not fit into 64 bits")
        return (((x - self.whole) * self.n - self.rest) ** 2).sum(axis=1)


def sums(blocks: DataFrame, width: int, each, length: int) -> np.ndarray:
    """The sum over all rows of what ``each`` gives for a block's integer rows (``length`` numbers). Each task sends one number
    for each place, and Spark adds them up."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in matrices(batches, width):
            total = each(x) if total is None else total + each(x)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(length, dtype=np.int32)), pa.array(total)], names=["place", "value"])

    whole = each(np.zeros((0, width), np.int64)).dtype == np.int64
    rows = blocks.mapInArrow(add, f"place int, value {'long' if whole else 'double'}").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(length, np.int64 if whole else np.float64)
    out[rows.column("place").to_numpy()] = rows.column("value").to_numpy()
    return out


def centre(blocks: DataFrame, width: int) -> Centre:
    found = sums(blocks, width, lambda x: np.concatenate([[len(x)], x.sum(axis=0)]).astype(np.int64), width + 1)
    n, s = int(found[0]), found[1:]
    whole = s // n if n else s
    return Centre(n, whole, s - n * whole)


@dataclass
class Whitening:
    """Unit directions (columns) by falling variance, and the variance of all dimensions together."""

    directions: np.ndarray
    variances: np.ndarray
    trace: float
    steps: int


def bidiagonalise(products, width: int, most: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, int]:
    """(singular values, right singular vectors as columns, steps) of a matrix A that is known by ``products(W)`` alone: for the
    columns w of W it gives (A W)' A w_last and A' A w_last.

    Steps go on until ``most`` leading vectors have converged. As one start sees a repeated singular value once only, the
    search then starts anew with a direction orthogonal to all before, and ends when these stay the leading ones."""
    draw = np.random.default_rng(seed)
    v, w, z = (np.zeros((width, 0)) for _ in range(3))
    bands = np.zeros((width, width))

    def fresh() -> np.ndarray:
        x = draw.standard_normal(width)
        for _ in range(3):
            x -= v @ (v.T @ x)
            x /= np.linalg.norm(x)
        return x

    right, beta, scale, confirmed, since = fresh(), 0.0, 0.0, False, 0
    while True:
        j = v.shape[1]
        y = right - beta * w[:, -1] if beta else right
        v = np.column_stack([v, right])
        for _ in range(3):
            left, back = products(np.column_stack([w, y]))
            c, square = left[:-1], left[-1] - left[:-1] @ left[:-1]
            alpha = float(np.sqrt(max(square, 0.0)))
            y, back = y - w @ c, back - z @ c
            # Another pass where this one took away more than rounding (which it does of directions with almost no variance).
            if alpha <= width * np.finfo(float).eps * max(scale, np.sqrt(left[-1])) or np.linalg.norm(c) <= 1e-10 * alpha:
                break
        scale = max(scale, alpha)
        if alpha <= width * np.finfo(float).eps * scale:
            alpha = 0.0
        w = np.column_stack([w, y / alpha if alpha else np.zeros(width)])
        z = np.column_stack([z, back / alpha if alpha else np.zeros(width)])
        r = z[:, -1] - alpha * v[:, -1]
        for _ in range(2):
            r -= v @ (v.T @ r)
        beta, bands[j, j] = float(np.linalg.norm(r)), alpha
        scale, since = max(scale, beta), since + 1
        small, values, turned = np.linalg.svd(bands[: j + 1, : j + 1])
        if j + 1 == width:
            break
        lead = min(most, j + 1)
        done = since >= min(most, width - j - 1) and bool((beta * np.abs(small[-1, :lead]) <= TOLERANCE * values[0]).all())
        if done and confirmed:
            break
        if done or beta <= width * np.finfo(float).eps * scale:
            confirmed, since = confirmed or done, 0
            right, beta = fresh(), 0.0
        else:
            right = r / beta
            bands[j, j + 1] = beta
    return values, v @ turned.T, v.shape[1]


def whitening(blocks: DataFrame, width: int, at: Centre, most: int = COMPONENTS) -> Whitening:
    """The leading components of the blocks' rows."""
    passes = {"trace": 0.0}

    def products(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def each(x: np.ndarray) -> np.ndarray:
            rows = at.rows(x)
            t = rows @ vectors
            return np.concatenate([t[:, -1] @ t, t[:, -1] @ rows, [(rows**2).sum()]])

        found = sums(blocks, width, each, vectors.shape[1] + width + 1) / at.n
        passes["trace"] = float(found[-1])
        return found[: vectors.shape[1]], found[vectors.shape[1] : -1]

    # The sums are divided by n, so singular values are standard deviations.
    values, right, steps = bidiagonalise(products, width, most)
    kept = int((values[:most] > width * np.finfo(float).eps * max(values[0], np.sqrt(passes["trace"]))).sum())
    return Whitening(right[:, :kept], values[:kept] ** 2, passes["trace"], steps)


def identity_error(blocks: DataFrame, width: int, at: Centre, fit: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    k = len(fit.variances)

    def each(x: np.ndarray) -> np.ndarray:
        t = at.rows(x) @ fit.directions / np.sqrt(fit.variances)
        return np.concatenate([(t.T @ t).ravel(), t.sum(axis=0)])

    found = sums(blocks, width, each, k * k + k) / at.n
    mean = found[k * k :]
    return float(np.abs(found[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def whiten(embeddings: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """For each complete row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = embeddings.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    width = embeddings.agg(F.max(F.size("embedding")).alias("d")).first().d or 0
    if width <= 0:
        return spark.createDataFrame([], schema)
    blocks = stored(integer_blocks(embeddings, width), "vectors")
    at = centre(blocks, width)
    fit = whitening(blocks, width, at, most) if at.n else None
    if fit is None or not len(fit.variances):
        return spark.createDataFrame([], schema)
    error, k = identity_error(blocks, width, at, fit), len(fit.variances)
    turn, explained = fit.directions / np.sqrt(fit.variances), fit.variances / fit.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in matrices(batches, width):
            m = len(x)
            columns = [
                ids.take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, at.n, np.int64)),
                pa.array(np.repeat(at.deviations(x), k)),
                pa.array((at.rows(x) @ turn).ravel()),
                pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return blocks.mapInArrow(project, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

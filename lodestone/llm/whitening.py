"""Whitening of embeddings: principal components by a randomised range finder, each scaled to unit variance.

A basis of a few random directions (as many as components, and some more) is multiplied by the covariance again and again: each power
pass reads all rows, centres them and sums their products with the basis, task by task, so a task sends one small matrix. After each
pass the covariance within the basis gives Ritz values and vectors (Rayleigh-Ritz), and their residuals. Where residuals fail and
another pass would not mend them, as with spectra that hardly fall, the basis is expanded to the full dimension, where one pass is exact.

Entries become integers x = floor(1024 * c) + 100000, so counts and sums are exact; products are of centred doubles.

Defined results: rows whose vector is null or has a null or non-finite entry, or one whose x has over 52 bits, are left out; vectors
shorter than the longest are filled up with zeros; a null id is an id like any other, and rows that repeat count each for itself; an empty
table, and one of empty vectors, has no rows. There are as many components as dimensions, but no more than asked for.
Equal eigenvalues are numbered in any order; a component's largest entry is positive. A component without
variance (one row, equal rows) has null ``whitened``, and null ``explained`` where nothing varies at all;
``identity_error`` is over the components that have variance. ``deviation`` is null where it doesn't fit 64 bits. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, table, tidy

#: Fixed values of the integer entries.
SCALE, SHIFT = 1024, 100000
#: Directions beyond the components asked for, power passes at most, and the residual allowed, in parts of the gap to the next value.
OVERSAMPLING, PASSES, RESIDUAL = 8, 8, 1e-12
#: Largest |x|: exact as a double, and sums of its halves are exact as longs.
_LARGEST = float(1 << 52)
_HALF = 26
#: Doubles of a block of rows that a task multiplies at once.
_BLOCK = 1 << 18


def entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, lengths, x) of the vectors in ``column`` that count; x is flat, one vector after the other."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(values * SCALE) + SHIFT
    bad = ~(np.abs(x) < _LARGEST)
    row = np.repeat(np.arange(len(lengths)), lengths)
    good = column.is_valid().to_numpy(zero_copy_only=False)
    good = good & (np.bincount(row[bad], minlength=len(lengths)) == 0)
    return np.flatnonzero(good), lengths[good], x[good[row]].astype(np.int64)


def filled(lengths: np.ndarray, x: np.ndarray, dim: int) -> np.ndarray:
    """A matrix of the vectors; what they lack are zeros, whose x is the shift."""
    if len(lengths) and (lengths == dim).all():
        return x.reshape(-1, dim)
    out = np.full((len(lengths), dim), SHIFT, np.int64)
    out[np.arange(dim) < lengths[:, None]] = x
    return out


def _batches(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, rows, matrix) of blocks that are bounded in memory."""
    step = max(1, _BLOCK // max(dim, 1))
    for whole in batches:
        for at in range(0, whole.num_rows, step):
            batch = whole.slice(at, step)
            rows, lengths, x = entries(batch.column(0))
            if len(rows):
                yield batch, rows, filled(lengths, x, dim)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, hi, lo) sums of each place's halves, and at place -1 the rows and nothing."""
    rows, hi, lo = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            found, lengths, x = entries(whole.column(0).slice(at, 1024))
            rows += len(found)
            if len(found) and (most := int(lengths.max())):
                if most > len(hi):
                    hi, lo = (np.pad(s, (0, most - len(s))) for s in (hi, lo))
                # Sums of x - SHIFT, so that places which a vector lacks add nothing.
                held = filled(lengths, x, most) - SHIFT
                hi[:most] += (held >> _HALF).sum(0)
                lo[:most] += (held & ((1 << _HALF) - 1)).sum(0)
    places = np.arange(-1, len(hi))
    yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(np.r_[rows, hi]), pa.array(np.r_[0, lo])], names=["at", "hi", "lo"])


def _summed(vectors: DataFrame, rows_of) -> dict[int, np.ndarray]:
    """Sum by row number of the matrices whose rows ``rows_of`` gives for each task; added up in the cluster, as many sums as the matrix has entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = rows_of(batches)
        if matrix is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(matrix), dtype=np.int64)), pa.array(list(matrix), pa.list_(pa.float64()))], names=["at", "row"])

    parts = vectors.mapInArrow(tidy(run), "at long, row array<double>").select("at", F.posexplode("row").alias("k", "v"))
    summed = parts.groupBy("at", "k").agg(F.sum("v").alias("v")).groupBy("at").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("row"))
    found = summed.select("at", F.transform("row", lambda e: e["v"]).alias("row")).toArrow()
    return {at: row.values.to_numpy() for at, row in zip(found["at"].to_pylist(), found["row"], strict=True)}


@dataclass
class Model:
    """What whitening needs: exact sums, components as columns, eigenvalues and the covariance's trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    passes: int = 0
    expanded: bool = False

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def scales(self) -> np.ndarray:
        """One over each component's deviation; NaN where nothing varies."""
        floor = 1e-13 * max(self.trace, 0.0)
        return np.array([1 / np.sqrt(e) if e > floor else np.nan for e in self.values])


def centred(x: np.ndarray, n: int, sums: list[int], mean: np.ndarray) -> np.ndarray:
    """x - S / n; the whole part of the mean is taken off as an integer, so large entries keep their small digits."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole) - rest


def _ritz(basis: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, vectors, residuals), largest value first, of the covariance within the basis."""
    within = basis.T @ product
    values, turn = np.linalg.eigh((within + within.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors = basis @ turn
    return values, vectors, np.linalg.norm(product @ turn - vectors * values, axis=0)


def fit(vectors: DataFrame, count: int, oversampling: int = OVERSAMPLING, passes: int = PASSES, seed: int = 0) -> Model | None:
    """The model of a table with one column of vectors; None if it has no entries."""
    totals = vectors.mapInArrow(tidy(_totals), "at long, hi long, lo long").groupBy("at").agg(F.sum(F.col("hi").cast("decimal(38,0)")).alias("hi"), F.sum(F.col("lo").cast("decimal(38,0)")).alias("lo"))
    held = {r["at"]: (int(r["hi"]) << _HALF) + int(r["lo"]) if r["at"] >= 0 else int(r["hi"]) for r in totals.collect()}
    n = held.pop(-1, 0)
    dim = max(held, default=-1) + 1
    if not n or not dim:
        return None
    sums = [held.get(k, 0) + n * SHIFT for k in range(dim)]
    model = Model(n, sums, np.zeros((dim, 0)), np.zeros(0), 0.0)
    mean = model.mean

    def times(basis: np.ndarray) -> tuple[np.ndarray, float]:
        """Covariance times basis, and the covariance's trace, over all rows."""

        def rows_of(batches):
            product, squares = None, 0.0
            for _, _, x in _batches(batches, dim):
                c = centred(x, n, sums, mean)
                part = c.T @ (c @ basis)
                product = part if product is None else product + part
                squares += float((c * c).sum())
            return None if product is None else np.vstack([product, np.full((1, basis.shape[1]), squares)])

        found = _summed(vectors, rows_of)
        matrix = np.array([found[k] for k in range(dim + 1)]) / n
        return matrix[:-1], float(matrix[-1, 0])

    count = min(count, dim)
    width = min(dim, count + oversampling)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, width)))[0] if width < dim else np.eye(dim)
    before = np.inf
    for made in range(1, passes + 2):
        product, model.trace = times(basis)
        values, directions, residuals = _ritz(basis, product)
        model.passes = made
        if width == dim:
            break
        gaps = -np.diff(values[: count + 1])
        near = np.minimum(gaps, np.r_[np.inf, gaps[:-1]])
        worst = float((residuals[:count] / np.maximum(near, 1e-300)).max())
        if worst <= RESIDUAL:
            break
        # Residuals fall by the same factor each pass, so it shows early whether the passes left are enough.
        left, fall = passes - made, worst / before
        if left <= 0 or (made > 2 and worst * fall**left > RESIDUAL):
            basis, model.expanded, width = np.eye(dim), True, dim
        else:
            basis = np.linalg.qr(product)[0]
        before = worst
    chosen = directions[:, :count]
    chosen = chosen / np.linalg.norm(chosen, axis=0)
    model.components = chosen * np.where(chosen[np.abs(chosen).argmax(0), np.arange(count)] < 0, -1.0, 1.0)
    model.values = values[:count]
    return model


def projected(x: np.ndarray, model: Model) -> np.ndarray:
    return (centred(x, model.n, model.sums, model.mean) @ model.components) * model.scales()


def identity_error(vectors: DataFrame, model: Model) -> float | None:
    """Largest entry of the whitened rows' covariance minus the identity, measured over all rows."""
    dim, kept = len(model.sums), np.isfinite(model.scales())
    if not kept.any():
        return None

    def moments(batches):
        total = None
        for _, _, x in _batches(batches, dim):
            part = projected(x, model)[:, kept].sum(0)[None, :]
            total = part if total is None else total + part
        return total

    mean = _summed(vectors, moments)[0] / model.n

    def products(batches):
        total = None
        for _, _, x in _batches(batches, dim):
            w = projected(x, model)[:, kept] - mean
            total = w.T @ w if total is None else total + w.T @ w
        return total

    found = _summed(vectors, products)
    covariance = np.array([found[k] for k in range(len(mean))]) / model.n
    return float(np.abs(covariance - np.eye(len(mean))).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n * x - S)^2 of each row, exact; None beyond 64 bits."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], object)
    off = x - whole
    most = (int(np.abs(off).max(initial=0)) + 1) * n
    if most * most * len(sums) < 1 << 62:
        d = off * n - rest.astype(np.int64)
        return (d * d).sum(1).tolist()
    d = off.astype(object) * n - rest
    return [v if v < 1 << 63 else None for v in (d * d).sum(1).tolist()]


def whiten(embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", count: int = 8) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each vector that counts and each component."""
    slim = table(embeddings.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")), "whitening")
    vectors = slim.select("v")
    schema = f"id {slim.schema['id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(vectors, count)
    if model is None:
        discard(slim)
        return embeddings.sparkSession.createDataFrame([], schema)
    error = identity_error(vectors, model)
    dim, width = len(model.sums), len(model.values)
    explained = [float(max(e, 0.0) / model.trace) if model.trace > 0 else None for e in model.values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, x in _batches(batches, dim):
            white = projected(x, model).reshape(-1)
            ids = batch.column(1).take(pa.array(np.repeat(rows, width)))
            m = len(rows)
            columns = [
                ids, pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), m)), pa.array(np.full(m * width, model.n, np.int64)),
                pa.array([d for d in deviations(x, model.n, model.sums) for _ in range(width)], pa.int64()), pa.array(white, mask=np.isnan(white)),
                pa.array(explained * m, pa.float64()), pa.array([error] * (m * width), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return slim.select("v", "id").mapInArrow(tidy(run), schema)


def op11_randomised_whitening(spark, sf_dir: str) -> DataFrame:
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return whiten(embeddings).withColumnRenamed("id", "vec_id")


ORACLE = None

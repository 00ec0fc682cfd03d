"""Exact cosine similarity: expressions for single pairs, blocks of numpy for corpora."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.durable import table

#: Vectors in a block, blocks in a group of the blocked join and bytes of its vectors as doubles, groups that a small table is cut into, and cells of a product at once.
BLOCK, GROUP, GROUP_BYTES, SPREAD, CELLS = 1024, 64, 1 << 27, 6, 1 << 22


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column, b: Column, guard: float = 1e-9) -> Column:
    """Over the shorter one's length; the guard keeps zero vectors at zero."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, 1, n), F.slice(b, 1, n)
    return F.when(n > 0, dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + guard)).otherwise(0.0)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def blob_to_vector(blobs: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats; a torn tail is dropped."""
    return blobs.map(lambda b: None if b is None else np.frombuffer(b, "<f4", len(b) // 4))


@F.pandas_udf(T.BinaryType())
def vector_to_blob(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


def top_similar(corpus: DataFrame, queries: DataFrame, k: int, *, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(query_id, id, score, rank): each query vector's k nearest of the corpus by exact cosine.

    Queries and corpus are cut into bounded groups of blocks; a pair of groups gives k a query.
    """
    asked = _blocks(_numbers(queries, "query_id", vector_col))
    held = _blocks(_numbers(corpus, id_col, vector_col))

    def best(cell: pa.Table) -> pa.Table:
        (q, x), (ids, y) = _side(cell, True), _side(cell, False)
        step = _step(y)
        found = [_nearest(q[lo : lo + step], ids, x[lo : lo + step] @ y.T, -np.inf, k, True) for lo in range(0, len(q), step)]
        return pa.table(dict(zip(("query_id", "id", "score"), (pa.array(np.concatenate(c)) for c in zip(*found)))))

    found = _met(asked, held).groupBy("dim", "i", "j").applyInArrow(best, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank - 1).where(F.col("rank") < k)


def _numbers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): floats stay floats, half the bytes of the doubles that they become where they are multiplied."""
    single = vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType(), vectors.schema[vector_col].dataType.containsNull)
    return vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"))


def _unit(raw: bytes, rows: int, dim: int) -> np.ndarray:
    x = np.frombuffer(raw, np.float32 if len(raw) == 4 * rows * dim else np.float64).reshape(-1, dim).astype(np.float64)
    return x / (np.sqrt((x * x).sum(1, keepdims=True)) + 1e-12)


def _step(y: np.ndarray) -> int:
    """Rows that are multiplied with all of ``y`` at once."""
    return max(16, CELLS // max(1, len(y)))


def _blocks(vectors: DataFrame, size: int = BLOCK) -> DataFrame:
    """(dim, ids, vectors): runs of at most ``size`` vectors of one length as bytes; empty ones and ones with nulls go.

    Blocks are filled across Arrow batches, so how many there are doesn't depend on any setting of the session.
    """

    def block(dim: int, ids: list, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary())], names=["dim", "ids", "vectors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_blocks: dict[int, tuple[list, np.ndarray]] = {}
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes[sizes > 0]).astype(int).tolist():
                own = np.flatnonzero(sizes == dim)
                values = column.take(pa.array(own)).flatten()
                if values.null_count:
                    whole = np.flatnonzero(~np.isnan(np.where(values.is_null(), np.nan, 0.0)).reshape(-1, dim).any(1))
                    own = own[whole]
                    values = column.take(pa.array(own)).flatten()
                x = values.to_numpy(zero_copy_only=False).reshape(-1, dim)
                held = ids.take(pa.array(own)).to_pylist()
                if dim in open_blocks:
                    before, y = open_blocks.pop(dim)
                    held, x = before + held, np.vstack([y, x])
                full = len(held) - len(held) % size
                for lo in range(0, full, size):
                    yield block(dim, held[lo : lo + size], x[lo : lo + size])
                if full < len(held):
                    open_blocks[dim] = held[full:], x[full:].copy()
        for dim, (held, x) in open_blocks.items():
            yield block(dim, held, x)

    return vectors.mapInArrow(run, "dim int, ids array<long>, vectors binary")


def _grouped(blocks: DataFrame, group: int) -> tuple[DataFrame, DataFrame]:
    """Blocks with the number ``g`` of their group, of at most ``group`` blocks of one length and bounded bytes, and how many groups (dim, groups) there are."""
    held = table(blocks.withColumn("a", F.monotonically_increasing_id()), "vector-blocks")
    # Numbers of blocks alone are put in order, a thousandth of the rows.
    place = held.select("dim", "a").withColumn("p", F.row_number().over(Window.partitionBy("dim").orderBy("a")) - 1)
    count = place.groupBy("dim").agg(F.count("*").alias("n")).withColumn("size", F.least(F.lit(group), F.ceil(F.col("n") / SPREAD), F.greatest(F.lit(1), F.floor(GROUP_BYTES / (8 * BLOCK * F.greatest("dim", F.lit(1)))))))
    groups = count.select("dim", "size", F.ceil(F.col("n") / F.col("size")).cast("int").alias("groups"))
    numbered = place.join(groups, "dim").select("a", F.floor(F.col("p") / F.col("size")).cast("int").alias("g"))
    return held.join(numbered, "a").drop("a"), groups.select("dim", "groups")


def _met(left: DataFrame, right: DataFrame | None = None, *, group: int = GROUP) -> DataFrame:
    """(dim, i, j, left, ids, vectors): the blocks of each cell, a pair of groups of blocks of one length; of a table with itself each pair once.

    A block is copied once for each group that its own meets, and a cell, the unit of work, holds two groups whatever the number of vectors.
    """
    x, groups = _grouped(left, group)
    if right is None:
        other = x.join(groups, "dim").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
        return other.select("dim", F.least("g", "o").alias("i"), F.greatest("g", "o").alias("j"), (F.col("g") <= F.col("o")).alias("left"), "ids", "vectors")
    y, others = _grouped(right, group)
    each = lambda own, n: own.join(n, "dim").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    asked = each(x, others).select("dim", F.col("g").alias("i"), F.col("o").alias("j"), F.lit(True).alias("left"), "ids", "vectors")
    return asked.unionByName(each(y, groups).select("dim", F.col("o").alias("i"), F.col("g").alias("j"), F.lit(False).alias("left"), "ids", "vectors"))


def _side(cell: pa.Table, left: bool) -> tuple[np.ndarray, np.ndarray]:
    """(ids, unit vectors) of the blocks on one side of a cell."""
    own = cell.filter(pa.compute.equal(cell.column("left"), left))
    dim = cell.column("dim")[0].as_py()
    ids = own.column("ids").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return ids, _unit(b"".join(own.column("vectors").to_pylist()), len(ids), dim)


def _nearest(a: np.ndarray, b: np.ndarray, s: np.ndarray, least: float, k: int, itself: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(src, dst, w): of each row of ``s`` the k largest that are ``least`` or more, ties to the smaller id; ``itself`` if rows of equal ids count."""
    if not s.size:
        return a[:0], b[:0], s.ravel()[:0]
    near = s >= least
    if np.count_nonzero(near) <= s.size >> 4:
        # Few reach ``least``, so they are put in order without a look at the others.
        i, j = np.divmod(np.flatnonzero(near), s.shape[1])
        if not itself:
            other = a[i] != b[j]
            i, j = i[other], j[other]
    else:
        if not itself:
            s[a[:, None] == b[None]] = -np.inf
        kth = np.partition(s, s.shape[1] - k, axis=1)[:, -k] if k < s.shape[1] else np.full(len(a), -np.inf)
        i, j = np.nonzero((s >= np.maximum(kth, least)[:, None]) & (s > -np.inf))
    order = np.lexsort((b[j], -s[i, j], i))
    i, j = i[order], j[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    i, j = i[place < k], j[place < k]
    return a[i], b[j], s[i, j]


def similar_pairs(vectors: DataFrame, least: float, k: int, *, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(src, dst, w): each vector's k nearest others of cosine ``least`` or more; ties go to the smaller id.

    Every pair of groups of blocks is met once and gives both directions, k a vector at most; no threshold as low as a graph's lets pairs be left out.
    """
    held = _blocks(_numbers(vectors, id_col, vector_col))

    def near(cell: pa.Table) -> pa.Table:
        a, x = _side(cell, True)
        b, y = (a, x) if cell.column("i")[0].as_py() == cell.column("j")[0].as_py() else _side(cell, False)
        sides = [(a, b, x, y)] + ([(b, a, y, x)] if a is not b else [])
        found = [_nearest(p[lo : lo + _step(v)], q, u[lo : lo + _step(v)] @ v.T, least, k) for p, q, u, v in sides for lo in range(0, len(p), _step(v))]
        return pa.table(dict(zip(("src", "dst", "w"), (pa.array(np.concatenate(c)) for c in zip(*found)))))

    found = _met(held).groupBy("dim", "i", "j").applyInArrow(near, "src long, dst long, w double")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), "dst"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")

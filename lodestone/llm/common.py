"""Session helpers that every corpus operator uses."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import discard, shared_path, table

__all__ = ["apart", "by_batch", "discard", "fitted", "fold", "input_partitions", "range_of", "release", "session", "shared_path", "table", "text_bytes", "tidy"]

#: Rows and bytes of one Arrow batch; a batch ends with the row that passes either.
ARROW_ROWS, ARROW_BYTES = 256, 1 << 21


def session(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches that Python stages of this session receive; queries work in a session of their own (``apart``)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def apart(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` with its settings of now; what an operator sets there, ``spark`` never sees."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    return own


def by_batch(run, returns, *inputs: Column) -> Column:
    """A column that ``run`` computes batch by batch from the Arrow arrays of ``inputs``; other columns stay in the JVM.

    It counts as not deterministic, so no optimizer rule computes it twice.
    """

    def several(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for arrays in batches:
            yield run(*arrays)
        release()

    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in batches:
            yield run(array)
        release()

    return F.arrow_udf(several if len(inputs) > 1 else one, returnType=returns).asNondeterministic()(*inputs)


def release() -> None:
    """Give memory that a worker no longer uses back to the system; workers live on after a task."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run):
    """``run`` for mapInArrow, giving memory back when its task ends."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole


def fitted(sample: DataFrame, build):
    """``build`` of the rows of a bounded sample, lists by column in order of the first; run in one task, so the driver gets the model alone."""
    import pickle

    import pyarrow as pa
    import pyarrow.compute  # noqa: F401

    def run(batches):
        own = list(batches)
        held = pa.Table.from_batches(own) if own else None
        columns = held.take(pa.compute.sort_indices(held.column(0))).to_pydict() if held is not None else {}
        own = held = None
        model = pickle.dumps(build(*[columns.pop(n, []) for n in names[1:]]))
        release()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    names = sample.columns
    found = sample.coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(found[0]) if found is not None else build(*[[] for _ in names[1:]])


def text_bytes(name: str = "text") -> Column:
    """A text's UTF-8 bytes; Python stages work on bytes and skip a decoding."""
    return F.col(name).cast("binary")


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def input_partitions(df: DataFrame, least: int = 8) -> int:
    """A partition count in proportion to the session's setting."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def range_of(bounds: list[int], key: Column) -> Column:
    """The number of sorted ``bounds`` that are at most ``key``, by binary search."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    held = F.expr("array(" + ",".join(f"{b}L" if b > -(1 << 63) else "CAST('-9223372036854775808' AS BIGINT)" for b in bounds) + ")")
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when(F.coalesce(F.get(held, at + step - 1) <= key, F.lit(False)), at + step).otherwise(at),
    )

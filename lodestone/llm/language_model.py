"""Language-model scores by deleted interpolation of n-gram counts.

A word's probability after another mixes three estimates: the pair's count over the context's,
the word's count over all, and one over the vocabulary. The weights depend on how often the context was
seen (by powers of two) and are learned by expectation-maximisation on held-out counts: each training
token is left out of its own counts in turn.

Texts are cut into chunks of about CHUNK tokens, each with its own vocabulary, and only what a chunk holds
once is exchanged: its words, then its pairs, as sorted hashes with counts, dealt out by hash range.
A range adds up what all chunks have and sends each chunk its totals in the order asked, so a frequent word is
one entry a chunk. At most FAN ranges are dealt to at once; where they are too large for one task, each is merged in blocks
that then ask finer ranges in the chunks' place, so messages grow with the entries and not with chunks times ranges.
The chunks lie in a bucketed table, so the totals come to them and they don't move.
Words are known by 64-bit and pairs by 48-bit hashes. Counts cover every training text.

Defined results: a null or empty text is one end token; repeated rows count, and are scored, each for itself;
without training texts the counts are zero and every token has the probability of the uniform part; an empty table has no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import fold, input_partitions, release, session, shared_path, table, text_bytes, tidy

#: Tokens of a chunk, entries that one task adds up, and ranges that a chunk or block asks.
CHUNK, ENTRIES, FAN = 1 << 20, 2_000_000, 256
END = np.uint64(0xE1D0F7E87A1B2C3D)
_LEVELS, _STEPS = 40, 4


def squeeze(a: np.ndarray) -> bytes:
    """Numbers as byte planes, compressed."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expand(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _chunker(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        ids, train, lengths, found, held = [], [], [], [], 0

        def out() -> pa.RecordBatch:
            hashes = np.concatenate(found)
            vocabulary, index, counts = np.unique(hashes, return_inverse=True, return_counts=True)
            # Frequent words get small numbers, which compress better.
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            column = pa.chunked_array(ids).combine_chunks()
            one = pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
            row = [np.concatenate(lengths).astype(np.int64).tobytes(), np.concatenate(train).tobytes(), vocabulary[order].tobytes(), squeeze(rank[index.ravel()])]
            return pa.RecordBatch.from_arrays([pa.array([number]), one, *(pa.array([b], pa.binary()) for b in row)], names=["chunk", "ids", "lengths", "train", "vocabulary", "tokens"])

        for batch in batches:
            column, learn = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, buf, offsets in tokens.slices(batch.column(2)):
                starts, ends, first = tokens.bounds(buf, offsets, tokens.NONBLANK)
                n = np.diff(first) + 1
                all_ = np.full(len(starts) + len(n), END, np.uint64)
                all_[np.arange(len(starts)) + np.repeat(np.arange(len(n)), n - 1)] = tokens.hashes(buf, starts, ends)
                ids.append(column.slice(lo, hi - lo))
                train.append(learn[lo:hi])
                lengths.append(n)
                found.append(all_)
                held += len(all_)
                if held >= size:
                    yield out()
                    number += 1
                    ids, train, lengths, found, held = [], [], [], [], 0
        if found:
            yield out()

    return tidy(run)


class _Chunk:
    """A chunk's tokens, and its pairs: each token with the one before it in its text, or the end."""

    def __init__(self, row: dict) -> None:
        self.lengths = np.frombuffer(row["lengths"], np.int64)
        self.train = np.frombuffer(row["train"], bool)
        self.vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
        self.token = expand(row["tokens"], np.uint32).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.lengths)))
        self.learned = np.repeat(self.train, self.lengths)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """(hashes in order, training counts)."""
        order = self.order()
        return self.vocabulary[order], np.bincount(self.token[self.learned], minlength=len(order))[order].astype(np.uint64)

    def order(self) -> np.ndarray:
        return np.argsort(self.vocabulary)

    def before(self) -> np.ndarray:
        at = np.empty_like(self.token)
        at[1:] = self.token[:-1]
        at[self.first[:-1]] = self.token[self.first[1:] - 1]
        return at

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes in order, training counts, each token's pair)."""
        mark = tokens.mix(self.vocabulary[self.before()] * np.uint64(0x9E3779B97F4A7C15) + self.vocabulary[self.token]) >> np.uint64(16)
        hashes, pair = np.unique(mark, return_inverse=True)
        pair = pair.ravel()
        return hashes, np.bincount(pair[self.learned], minlength=len(hashes)).astype(np.uint64), pair


_ASK = "part long, unit long, at long, keys binary, counts binary"
_TELL = "unit long, at long, totals binary, distinct long, mass long"
_MERGED = "part long, unit long, units array<long>, ats array<long>, sizes array<long>, index binary, keys binary, counts binary"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def _messages(unit: int, hashes: np.ndarray, counts: np.ndarray, low: int, high: int, first: int, parts: int) -> Iterator[tuple]:
    """Rows of _ASK: a unit's entries with hashes from ``low`` on and under ``high``, by ``parts`` equal ranges, numbered from ``first``."""
    cuts = np.searchsorted(hashes, np.array([low + (high - low) * k // parts for k in range(1, parts)], np.uint64))
    edges = [0, *cuts.tolist(), len(hashes)]
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        if b > a:
            yield first + k, unit, a, _differences(hashes[a:b]), squeeze(counts[a:b])


def _ask(kind: str, bits: int, parts: int):
    """Messages of the chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hashes, counts = getattr(_Chunk(row), kind)()[:2]
                yield _batch(list(_messages(row["chunk"], hashes, counts, 0, 1 << bits, 0, parts)), _ASK)

    return tidy(run)


def _ask_finer(bits: int, parts: int, fan: int):
    """Messages of the blocks of ``parts`` ranges, each cut into ``fan``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, counts, part = _sums(row["keys"]), expand(row["counts"], np.uint64), row["part"]
                low, high = ((k << bits) // parts for k in (part, part + 1))
                yield _batch(list(_messages(row["unit"], keys, counts, low, high, part * fan, fan)), _ASK)

    return tidy(run)


def _differences(sorted_hashes: np.ndarray) -> bytes:
    return squeeze(np.diff(sorted_hashes, prepend=np.uint64(0)))


def _sums(differences: bytes) -> np.ndarray:
    return np.cumsum(expand(differences, np.uint64), dtype=np.uint64)


def _added(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(distinct hashes, their total counts, each entry's place among them, entries by message) of a group of messages."""
    keys = [_sums(k.as_py()) for k in group.column("keys")]
    sizes = [len(k) for k in keys]
    counts = np.concatenate([expand(c.as_py(), np.uint64) for c in group.column("counts")]).astype(np.float64)
    distinct, index = np.unique(np.concatenate(keys), return_inverse=True)
    index = index.ravel()
    # Counts are far below 2^53, so these sums are exact.
    return distinct, np.bincount(index, counts, len(distinct)).astype(np.uint64), index, sizes


def _tell(group: pa.Table) -> pa.Table:
    """Total counts of a hash range, for each message in its order."""
    _, totals, index, sizes = _added(group)
    own = np.split(totals[index], np.cumsum(sizes)[:-1])
    units, ats = group.column("unit").to_pylist(), group.column("at").to_pylist()
    first = [(int((totals > 0).sum()), int(totals.sum()))] + [(0, 0)] * (len(units) - 1)
    out = pa.Table.from_batches([_batch([(u, a, squeeze(t), *f) for u, a, t, f in zip(units, ats, own, first)], _TELL)])
    release()
    return out


def _merge(group: pa.Table) -> pa.Table:
    """A block's messages as one unit, and how its entries came together."""
    distinct, totals, index, sizes = _added(group)
    row = [group.column(c)[0].as_py() for c in ("part", "block_unit")] + [group.column(c).to_pylist() for c in ("unit", "at")]
    out = pa.Table.from_batches([_batch([(*row, sizes, squeeze(index.astype(np.uint32)), _differences(distinct), squeeze(totals))], _MERGED)])
    release()
    return out


def _pass_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a block was told, for each message that it was merged from."""
    for batch in batches:
        for row in batch.to_pylist():
            totals = _totals(row["told"]).astype(np.uint64)
            own = np.split(totals[expand(row["index"], np.uint32)], np.cumsum(row["sizes"])[:-1])
            first = [(row["distinct"], row["mass"])] + [(0, 0)] * (len(own) - 1)
            yield _batch([(u, a, squeeze(t), *f) for u, a, t, f in zip(row["units"], row["ats"], own, first)], _TELL)


def _exchange(chunks: DataFrame, kind: str, bits: int, entries: int, most: int, fan: int) -> DataFrame:
    """The total training counts of each chunk's words or pairs; ``entries`` is how many the chunks have together."""
    parts = min(fan, max(input_partitions(chunks), -(-entries // most)))
    return table(_answers(chunks.mapInArrow(_ask(kind, bits, parts), _ASK), kind, bits, parts, entries, most, fan), f"{kind}-counts")


def _answers(asked: DataFrame, kind: str, bits: int, parts: int, entries: int, most: int, fan: int) -> DataFrame:
    if entries <= parts * most:
        return asked.groupBy("part").applyInArrow(_tell, _TELL)
    blocks = -(-entries // (parts * most))
    dealt = asked.withColumn("block_unit", F.col("part") * blocks + F.pmod(F.xxhash64("unit"), F.lit(blocks)))
    merged = table(dealt.groupBy("part", "block_unit").applyInArrow(_merge, _MERGED), f"{kind}-merged")
    # Merging only ever makes fewer entries of them.
    told = _answers(merged.mapInArrow(_ask_finer(bits, parts, fan), _ASK), kind, bits, parts * fan, entries, most, fan)
    told = told.groupBy("unit").agg(F.collect_list(F.struct("at", "totals")).alias("told"), F.sum("distinct").alias("distinct"), F.sum("mass").alias("mass"))
    back = merged.join(told, "unit").select("units", "ats", "sizes", "index", "told", "distinct", "mass")
    return back.mapInArrow(tidy(_pass_on), _TELL)


def _level(count: np.ndarray) -> np.ndarray:
    """A context's bucket: 0 if it was never seen, else one more than the power of two of its count."""
    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))).astype(np.int64) + 1, 0)


def _totals(parts: list[dict]) -> np.ndarray:
    return np.concatenate([expand(p["totals"], np.uint64) for p in sorted(parts, key=lambda p: p["at"])]).astype(np.float64)


class _Counted(_Chunk):
    """A chunk with, for each token, the training counts of itself, its context and its pair."""

    def __init__(self, row: dict) -> None:
        super().__init__(row)
        words = np.empty(len(self.vocabulary))
        words[self.order()] = _totals(row["words"])
        self.word, self.context = words[self.token], words[self.before()]
        self.pair = _totals(row["pairs"])[self.pairs()[2]]


_CELL = "level long, q2 long, q1 long, n double, s2 double, s1 double"


def _cells(total: float):
    """Held-out events of the training tokens, each left out of its own counts, by level and estimates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = _Counted(row)
                pair, context, word = (x[c.learned] - 1 for x in (c.pair, c.context, c.word))
                p2 = np.where(context > 0, pair / np.maximum(context, 1), 0)
                p1 = word / max(total - 1, 1)
                q2, q1 = (np.where(p > 0, np.round(-np.log2(np.maximum(p, 1e-18)) * _STEPS).astype(np.int64), -1) for p in (p2, p1))
                cell, index = np.unique((_level(context) * 1024 + q2 + 1) * 1024 + q1 + 1, return_inverse=True)
                index = index.ravel()
                sums = [np.bincount(index, w, len(cell)) for w in (np.ones(len(index)), p2, p1)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cell // 1024**2, cell // 1024 % 1024, cell % 1024, *sums)], names=["level", "q2", "q1", "n", "s2", "s1"])

    return tidy(run)


def weights(cells: list[tuple[int, float, float, float]], uniform: float, rounds: int = 60) -> np.ndarray:
    """Mixture weights (pair, word, uniform) by level, by expectation-maximisation over (level, events, pair's, word's estimate)."""
    cell = np.array(cells, np.float64).reshape(-1, 4)

    def learned(own: np.ndarray, start: np.ndarray) -> np.ndarray:
        lam, p = start, np.stack([own[:, 2], own[:, 3], np.full(len(own), uniform)], 1)
        for _ in range(rounds):
            share = lam * p
            share /= np.maximum(share.sum(1, keepdims=True), 1e-300)
            lam = np.maximum((share * own[:, 1:2]).sum(0), 1e-9)
            lam = np.maximum(lam / lam.sum(), 1e-7)
        return lam / lam.sum()

    pooled = learned(cell, np.full(3, 1 / 3)) if len(cell) else np.array([0.0, 0.5, 0.5])
    out = np.tile(pooled, (_LEVELS + 26, 1))
    for level in np.unique(cell[:, 0]).astype(int):
        out[level] = learned(cell[cell[:, 0] == level], pooled)
    # Nothing follows a context that was never seen.
    out[0] = np.array([0.0, out[0][1], out[0][2]]) / max(out[0][1] + out[0][2], 1e-12)
    return out


def _score(total: float, distinct: float, lam: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, row in enumerate(batch.to_pylist()):
                c = _Counted(row)
                own = lam[_level(c.context)]
                p = own[:, 0] * c.pair / np.maximum(c.context, 1) + own[:, 1] * c.word / max(total, 1) + own[:, 2] / (distinct + 1)
                base = np.log10((c.word + 1) / (total + distinct + 1))
                sums = [np.add.reduceat(x, c.first[:-1]) for x in (np.log10(p), base, (c.word > 0).astype(np.int64))]
                ids = batch.column(batch.schema.get_field_index("ids"))[k].values
                yield pa.RecordBatch.from_arrays([ids, pa.array(~c.train), pa.array(c.lengths), *(pa.array(x) for x in sums)], names=["id", "held_out", "n_tokens", "score", "base_score", "n_known"])

    return tidy(run)


def score(docs: DataFrame, learn, *, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, most: int = ENTRIES, fan: int = FAN) -> DataFrame:
    """(id, held_out, n_tokens, score, base_score, n_known, train_tokens) of every row; rows where ``learn`` holds teach the counts."""
    spark = session(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"), text_bytes(text_col).alias("text"))
    binary = [T.StructField(n, T.BinaryType()) for n in ("lengths", "train", "vocabulary", "tokens")]
    cut = rows.mapInArrow(_chunker(chunk), T.StructType([T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(kind)), *binary]))
    name, path = f"lodestone_chunks_{uuid.uuid4().hex}", shared_path(spark, "chunks")
    cut.write.bucketBy(input_partitions(docs), "chunk").option("path", path).option("compression", "none").format("parquet").saveAsTable(name)
    chunks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay; the frame knows its buckets

    entries = int(chunks.agg(F.sum(F.octet_length("vocabulary") / 8)).first()[0] or 0)
    words = _exchange(chunks, "words", 64, entries, most, fan)
    volume = words.agg(F.sum("distinct"), F.sum("mass")).first()
    distinct, total = int(volume[0] or 0), int(volume[1] or 0)
    pairs = _exchange(chunks, "pairs", 48, max(total, entries), most, fan)

    def told(counts: DataFrame, as_: str) -> DataFrame:
        return counts.groupBy(F.col("unit").alias("chunk")).agg(F.collect_list(F.struct("at", "totals")).alias(as_))

    counted = chunks.join(told(words, "words"), "chunk").join(told(pairs, "pairs"), "chunk")
    cells = counted.mapInArrow(_cells(total), _CELL).groupBy("level", "q2", "q1").agg(F.sum("n").alias("n"), F.sum("s2").alias("s2"), F.sum("s1").alias("s1"))
    # There are as many cells as quantised estimates, whatever the input.
    found = sorted((r["level"], r["n"], r["s2"] / r["n"], r["s1"] / r["n"]) for r in cells.collect())
    lam = weights(found, 1 / (distinct + 1))
    schema = T.StructType([T.StructField("id", kind), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("base_score", T.DoubleType()), T.StructField("n_known", T.LongType())])
    return counted.mapInArrow(_score(total, distinct, lam), schema).withColumn("train_tokens", F.lit(total).cast("long"))


def op2_deleted_interpolation(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, fold("doc_id", 7) != 2).select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


#: The score has no SQL; the columns that have are held against it in the tests.
ORACLE = None

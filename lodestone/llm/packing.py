"""Packing along a space-filling curve.

A document's token counts, hashed into DIMS buckets, are projected to four
dimensions; its place on the Hilbert curve through them is its key. Documents are
sorted by key over the whole table, laid end to end and cut every ``capacity`` tokens, so
each sequence holds neighbours on the curve and only the very last one needs padding.

Tokens are found once and kept as 16-bit ids; splitters drawn from the keys deal them into
ranges, whose exact sizes give each range's offset, and a range is streamed in order. The key's
low bits are a hash of the row, so a group of equal documents can be cut like any other.

Defined results: a null or empty text is the end token alone; repeated rows are packed one by
one; equal keys go by row number; an empty table has no pieces.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import range_of, session, table, text_bytes

CAPACITY, END = 4096, 2
DIMS, AXES, ORDER, TIE = 4096, 4, 10, 22
#: Tokens of a range that are aimed at, and ranges at most; a range is streamed, so its size isn't bounded by memory.
RANGE_TOKENS, RANGES = 4_000_000, 4096
#: Pieces of words whose tokens a worker remembers, in two generations of half as many, and characters of one at most.
REMEMBERED, PIECE_CHARACTERS = 800_000, 64


# How a word vocabulary normalises and splits texts. White space always parts tokens there.
_NORMALIZER = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same split for lower-cased Latin-1 without other white space and controls, where normalising changes nothing else.
_LATIN = re.compile(r"[\t-\r\x20-\x7e\xa1-\xff]*")
_BLANK = re.compile(r"[\t-\r ]+")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\t-\r 0-9a-zªµºß-öø-ÿ²³¹¼½¾]+")


def _byte_characters() -> dict[int, str]:
    """The characters that byte-level vocabularies have for bytes: printable ones stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Pieces(dict):
    """Tokens of pieces of words. What is asked for again outlives a generation; the rest is forgotten after two."""

    def __init__(self, tokenizer, most: int) -> None:
        super().__init__()
        self.tokenize, self.most, self.older = tokenizer.model.tokenize, most, {}
        self.characters = _byte_characters()

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            text = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.characters)
            found = array("H", [t.id for t in self.tokenize(text)]).tobytes()
            if len(piece) > PIECE_CHARACTERS:
                return found
        if 2 * len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[piece] = found
        return found


class Encoder:
    """Token ids of texts by a public tokenizer.

    Where white space always parts tokens, Latin-1 texts are cut into pieces whose tokens are
    remembered, and of others the words that aren't Latin-1 are encoded as they are; other tokenizers get whole texts.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        shape = json.loads(self.tokenizer.to_str())
        normal, split = shape["normalizer"] or {}, (shape["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.by_word = [n["type"] for n in normal.get("normalizers", [])] == _NORMALIZER and [p["type"] for p in split] == ["Split", "ByteLevel"] and split[0]["pattern"] == {"Regex": _SPLIT}
        self.pieces = _Pieces(self.tokenizer, remembered)

    def _latin(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, _PIECES.findall(text.lower())))

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("H", e.ids).tobytes() for e in found]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text and the end id, as little-endian 16-bit numbers."""
        end = array("H", [END]).tobytes()
        decoded = [t.decode("utf-8", "replace") for t in texts]
        if not self.by_word:
            return [ids + end for ids in self._whole(decoded)]
        plain = [_LATIN.fullmatch(t) is not None and "<|" not in t for t in decoded]
        # Of the other texts, runs of plain words go together; the rest is encoded in one call.
        cut = {k: self._runs(t) for k, t in enumerate(decoded) if not plain[k]}
        whole = iter(self._whole([run for runs in cut.values() for run, is_plain in runs if not is_plain]))
        out = []
        for k, text in enumerate(decoded):
            ids = self._latin(text) if plain[k] else b"".join(self._latin(run) if is_plain else next(whole) for run, is_plain in cut[k])
            out.append(ids + end)
        return out

    @staticmethod
    def _runs(text: str) -> list[tuple[str, bool]]:
        """Runs of words of a text, each all plain or not."""
        fits = lambda w: _LATIN.fullmatch(w) is not None and "<|" not in w
        return [(" ".join(ws), is_plain) for is_plain, ws in groupby(_BLANK.split(text), fits)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _projection() -> np.ndarray:
    bucket = (np.arange(1 << 16, dtype=np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(20)
    return np.random.default_rng(17).normal(size=(DIMS, AXES))[bucket].astype(np.float32)


def hilbert(points: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Positions on the Hilbert curve of integer points, one a row, of ``order`` bits an axis."""
    x = points.astype(np.int64).T.copy()
    axes = len(x)
    top = 1 << (order - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(axes):
            set_ = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(set_, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = np.where(set_, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for bit in range(order - 1, -1, -1):
        for i in range(axes):
            out = out << 1 | (x[i] >> bit) & 1
    return out


def curve_keys(ids: list[bytes], projection: np.ndarray) -> np.ndarray:
    """The Hilbert position of each document's projected vector."""
    flat = np.frombuffer(b"".join(ids), np.uint16)
    sizes = np.array([len(b) // 2 for b in ids])
    first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    mean = np.add.reduceat(projection[flat], first, axis=0).astype(np.float64) / sizes[:, None]
    unit = 0.5 + 0.5 * mean / np.sqrt(mean**2 + 0.01)
    return hilbert(np.minimum((unit * (1 << ORDER)).astype(np.int64), (1 << ORDER) - 1))


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projection, encode = _projection(), encoder(path).encode
        for batch in batches:
            for lo, hi, buf, offsets in tokens.slices(batch.column(2), 1 << 19):
                raw = buf.tobytes()
                ids = encode([raw[a:b] for a, b in zip(offsets, offsets[1:])])
                rid = batch.column(1).slice(lo, hi - lo)
                tie = tokens.mix(rid.to_numpy().astype(np.uint64)) >> np.uint64(64 - TIE)
                key = curve_keys(ids, projection) << TIE | tie.astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), rid, pa.array(key), pa.array([len(b) // 2 for b in ids], pa.int64()), pa.array(ids, pa.binary())], names=["id", "rid", "key", "n", "ids"])

    return run


def _cut(base: dict[int, int], capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, at = None, 0
        for batch in batches:
            source, start, length, crc, sequence, offset, kept = [], [], [], [], [], [], []
            sizes = batch.column(3).to_numpy()
            for k, (b, n, ids) in enumerate(zip(batch.column(2).to_pylist(), sizes.tolist(), batch.column(4).to_pylist())):
                if b != bucket:
                    bucket, at = b, base[b]
                wide = np.frombuffer(ids, np.uint16).astype("<u4").tobytes()
                done = 0
                while done < n:
                    room = min(n - done, capacity - at % capacity)
                    piece = wide[4 * done : 4 * (done + room)]
                    source.append(k)
                    start.append(done)
                    length.append(room)
                    crc.append(zlib.crc32(piece))
                    sequence.append(at // capacity)
                    offset.append(at % capacity)
                    kept.append(piece)
                    done += room
                    at += room
            take = pa.array(source, pa.int64())
            columns = [batch.column(0).take(take), *(pa.array(x, pa.int64()) for x in (start, length, crc)), batch.column(3).take(take), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns, names = [*columns, pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in kept], pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row for each piece of a document: where it starts there, its length, and its sequence and offset.

    ``with_ids`` adds the piece's token ids. ``tokenizer`` is the path of the vocabulary.
    """
    session(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("rid"), text_bytes(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", kind), *(T.StructField(n, T.LongType()) for n in ("rid", "key", "n")), T.StructField("ids", T.BinaryType())])
    coded = table(rows.mapInArrow(_encode(tokenizer or tokenizer_path()), schema), "tokens")

    total = coded.agg(F.sum("n")).first()[0] or 0
    ranges = int(min(RANGES, max(8, -(-total // RANGE_TOKENS))))
    share = F.percentile_approx("key", F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), 50 * ranges)
    bounds = sorted(set(coded.agg(share.alias("b")).first()["b"] or []))
    placed = coded.withColumn("bucket", range_of(bounds, F.col("key")))
    base, at = {}, 0
    for bucket, n in sorted(tuple(r) for r in placed.groupBy("bucket").agg(F.sum("n")).collect()):
        base[bucket], at = at, at + n
    dealt = placed.repartitionById(ranges, F.col("bucket")).sortWithinPartitions("bucket", "key", "rid").select("id", "rid", "bucket", "n", "ids")
    fields = [T.StructField("id", kind), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))]
    return dealt.mapInArrow(_cut(base, capacity, with_ids), T.StructType(fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids))


def op3_hilbert_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs).withColumnRenamed("id", "doc_id")

"""Session logs: files of zstd frames, each of JSON lines, and their parsing into events."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAGIC = b"\x28\xb5\x2f\xfd"
#: Names that a session's log may have, best first.
LOG_NAMES = ("session.v4.jsonl.zstd", "session.v3.jsonl.zstd", "session.jsonl.zstd")


def frame_offsets(data: bytes) -> list[int]:
    found, at = [], data.find(MAGIC)
    while at >= 0:
        found.append(at)
        at = data.find(MAGIC, at + 4)
    return found


def frames(data: bytes, last: int | None = None) -> Iterator[bytes]:
    """The content of each frame that can be read, of the last ones if a number is given; torn frames are passed over.

    A frame is fed piece by piece, up to the next magic number that can end it, so none of what follows it is copied.
    """
    offsets, view, zstd = frame_offsets(data), memoryview(data), zstandard.ZstdDecompressor()
    ends = [*offsets[1:], len(data)]
    for first in range(0 if last is None else max(0, len(offsets) - last), len(offsets)):
        inflater, content = zstd.decompressobj(), []
        try:
            for k in range(first, len(offsets)):
                content.append(inflater.decompress(view[offsets[k] : ends[k]]))
                if inflater.eof:
                    break
        except zstandard.ZstdError:
            continue
        if inflater.eof:
            yield b"".join(content)


def lines(data: bytes, tail_frames: int | None = None, tail_bytes: int | None = None) -> list[str]:
    """Non-empty lines of a log, or of its end, whose first line may be torn and is dropped."""
    cut = False
    if tail_bytes is not None and len(data) > tail_bytes:
        data, cut = data[-tail_bytes:], True
    offsets = frame_offsets(data)
    cut |= tail_frames is not None and len(offsets) > tail_frames
    text = b"".join(frames(data, tail_frames)).decode("utf-8", "replace")
    found = [x for x in text.split("\n") if x.strip()]
    return found[1:] if cut and found else found


def read_lines(spark: SparkSession, path: str, *, tail_frames: int | None = None, tail_bytes: int | None = None, glob: str | None = None) -> DataFrame:
    """(path, modified, size, line_no, line) of all logs under a path; a file is read by one task."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = lines(batch.column(3)[i].as_py(), tail_frames, tail_bytes)
                head = [pa.array([batch.column(k)[i].as_py()] * len(found), t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*head, pa.array(range(len(found)), pa.int64()), pa.array(found, pa.string())], names=["path", "modified", "size", "line_no", "line"])

    own = files.select("path", F.unix_millis("modificationTime").alias("modified"), F.col("length").alias("size"), "content")
    return own.mapInArrow(run, "path string, modified long, size long, line_no long, line string")


_BLOCK = "struct<type: string, text: string, id: string, name: string, arguments: string>"
_LINE = (
    "id string, cwd string, origin string, delegationDepth int, seq bigint, type string, message struct<source: struct<kind: string>, content: array<" + _BLOCK + ">>, "
    "data struct<source: struct<kind: string>, content: array<" + _BLOCK + ">, message: struct<role: string, toolCallId: string, isError: boolean, content: array<" + _BLOCK + ">>, "
    "turn: int, step: int, callId: string, toolCallId: string, name: string, arguments: string, isError: boolean, usage: struct<inputTokens: bigint, outputTokens: bigint, cacheReadTokens: bigint>, "
    "shadowedSeqs: array<bigint>, shadowedTokenCount: bigint>"
)


def session_name(path: Column) -> Column:
    """The folder that a log lies in names its session."""
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def parse_events(raw: DataFrame) -> DataFrame:
    """Lines as events (``schemas.EVENT`` with ``path``); headers and lines that aren't JSON are left out."""
    p = raw.select("path", "line_no", "line", F.from_json("line", _LINE).alias("e")).where("e.type IS NOT NULL AND e.type <> 'session'")
    usage = F.when(F.col("e.data.usage").isNotNull(), F.struct(F.coalesce("e.data.usage.inputTokens", F.lit(0)).alias("input"), F.coalesce("e.data.usage.outputTokens", F.lit(0)).alias("output"), F.coalesce("e.data.usage.cacheReadTokens", F.lit(0)).alias("cache_read")))
    return p.select(
        session_name(F.col("path")).alias("session"), F.col("e.seq").alias("seq"), F.col("e.type").alias("type"), F.coalesce("e.data.source.kind", "e.message.source.kind").alias("kind"),
        F.coalesce("e.data.message.content", "e.data.content", "e.message.content").alias("blocks"), F.coalesce("e.data.callId", "e.data.message.toolCallId", "e.data.toolCallId").alias("call_id"),
        F.col("e.data.name").alias("name"), F.col("e.data.arguments").alias("arguments"), F.col("e.data.turn").alias("turn"), F.col("e.data.step").alias("step"),
        F.coalesce("e.data.message.isError", "e.data.isError").alias("is_error"), usage.alias("usage"), F.col("e.data.shadowedSeqs").alias("shadowed_seqs"), F.col("e.data.shadowedTokenCount").alias("shadowed_tokens"),
        F.get_json_object("line", "$.data").alias("raw"), "path",
    )


def log_health(raw: DataFrame) -> DataFrame:
    """One row a log: its header's id, events, lines that aren't JSON, and whether seq runs from 0 without gaps."""
    p = raw.select("path", "modified", "size", "line_no", F.from_json("line", _LINE).alias("e"), F.try_parse_json("line").isNull().alias("bad"))
    event = F.col("e.seq").isNotNull() & (F.col("e.type") != "session")
    place = F.row_number().over(Window.partitionBy("path").orderBy("line_no"))
    gaps = p.where(event).withColumn("__gap", F.col("e.seq") != place - 1).groupBy("path").agg(F.count("*").alias("events"), (~F.bool_or("__gap")).alias("contiguous"))
    heads = p.groupBy("path", "modified", "size").agg(F.max(F.when(F.col("e.type") == "session", F.col("e.id"))).alias("session_id"), F.count_if("bad").alias("unparsed"))
    return heads.join(gaps, "path", "left").fillna({"events": 0}).withColumn("contiguous", F.coalesce("contiguous", F.lit(True)))


def list_logs(spark: SparkSession, path: str, prefix: str | None = None) -> DataFrame:
    """(session, path, modified, size): the best log of each session, of those whose name begins with ``prefix``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.unix_millis("modificationTime").alias("modified"), F.col("length").alias("size"))
    base = F.regexp_extract("path", r"([^/]+)$", 1)
    order = F.coalesce(*[F.when(base == n, F.lit(k)) for k, n in enumerate(LOG_NAMES)])
    own = files.select(session_name(F.col("path")).alias("session"), "path", "modified", "size", order.alias("o")).where("o IS NOT NULL")
    if prefix is not None:
        own = own.where(F.col("session").startswith(prefix if prefix.startswith("session-") else f"session-{prefix}"))
    return own.groupBy("session").agg(F.min_by(F.struct("path", "modified", "size"), "o").alias("m")).select("session", "m.*")


def write_log(path: str, header: dict, events: list[dict], per_frame: int = 50) -> None:
    """A log as its producer writes it, a frame for every few lines; for tests and exports of single sessions."""
    import json

    rows = [json.dumps(x, ensure_ascii=False) for x in [{"type": "session", **header}, *events]]
    with open(path, "wb") as out:
        for k in range(0, len(rows), per_frame):
            out.write(zstandard.ZstdCompressor().compress(("\n".join(rows[k : k + per_frame]) + "\n").encode()))

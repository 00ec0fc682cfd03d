"""Queries of the file sources: a table is written as such files in the shared folder and read back."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.durable import shared_path
from lodestone.operators import sessions
from lodestone.plans import testdata as td
from lodestone.plans.catalogue import query
from lodestone.sources import logs, tables


def _framed(texts: pa.Array) -> pa.Array:
    """Each text's lines as zstd frames of three lines."""
    import zstandard

    out = []
    for text in texts.to_pylist():
        rows = text.split("\n")
        out.append(b"".join(zstandard.ZstdCompressor().compress(("\n".join(rows[k : k + 3]) + "\n").encode()) for k in range(0, len(rows), 3)))
    return pa.array(out, pa.binary())


def _session_logs(spark, sf_dir) -> str:
    """A log file for each conversation, with a header line, in a folder of its session."""
    c = td.read(spark, sf_dir, "conversations")
    block = F.array(F.struct(F.lit("text").alias("type"), F.col("text")))
    asked = F.struct(F.struct(F.lit("user").alias("kind")).alias("source"), block.alias("content"))
    told = F.struct(F.struct(F.lit("assistant").alias("role"), block.alias("content")).alias("message"))
    line = lambda kind, data: F.to_json(F.struct(F.col("turn").alias("seq"), F.lit(kind).alias("type"), data.alias("data")))
    rows = c.select(F.concat(F.lit("session-"), "conv_id").alias("session"), "turn", F.when(F.col("role") == "assistant", line("assistant/message", told)).when(F.col("role") == "user", line("user/message", asked)).otherwise(line("system/message", F.struct(block.alias("content")))).alias("line"))
    whole = rows.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("body"))
    head = F.to_json(F.struct(F.lit("session").alias("type"), F.concat("session", F.lit("-full")).alias("id")))
    text = whole.select("session", F.concat_ws("\n", head, "body").alias("text"))
    frames = F.arrow_udf(_framed, returnType="binary")
    path = shared_path(spark, "logs")
    # A string's bytes are written as they are; an empty frame ends each file.
    empty = bytes(_framed(pa.array([""]))[0].as_py()).decode("latin-1")
    text.select("session", frames("text").cast("string").alias("value")).write.option("lineSep", empty).option("encoding", "ISO-8859-1").option("compression", "none").option("maxRecordsPerFile", 1).partitionBy("session").text(path)
    return path


@query("SELECT 'session-' || conv_id AS session, count(*) AS events, sha256(string_agg(text, chr(10) ORDER BY turn)) AS said FROM conversations GROUP BY conv_id")
def session_logs(spark, sf_dir):
    events = logs.parse_events(logs.read_lines(spark, _session_logs(spark, sf_dir)))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col("blocks")[0]["text"].alias("t")))), lambda x: x["t"]), "\n")
    return events.groupBy(F.regexp_replace("session", "^session=", "").alias("session")).agg(F.count("*").alias("events"), F.sha2(said, 256).alias("said"))


@query("SELECT 'session-' || conv_id || '-full' AS session_id, count(*) AS events, 0::BIGINT AS unparsed, count(*) = max(turn) + 1 AND min(turn) = 0 AS contiguous FROM conversations GROUP BY conv_id")
def session_log_health(spark, sf_dir):
    found = logs.log_health(logs.read_lines(spark, _session_logs(spark, sf_dir)))
    return found.select("session_id", F.col("events").cast("long").alias("events"), F.col("unparsed").cast("long").alias("unparsed"), "contiguous")


@query(f"WITH {td.TURNS} SELECT session, user_seq, sha256(user_text || answer_text) AS said FROM turns")
def turns_of_logs(spark, sf_dir):
    events = logs.parse_events(logs.read_lines(spark, _session_logs(spark, sf_dir)))
    done = sessions.completed_turns(events.withColumn("session", F.regexp_replace("session", "^session=session-", "")))
    return done.select("session", "user_seq", F.sha2(F.concat("user_text", "answer_text"), 256).alias("said"))


_USERS_A_FILE = 256


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def documents_read(spark, sf_dir):
    """A document for each user; a file is a list of the documents of at most ``_USERS_A_FILE`` users, as a file for each costs more than its rows."""
    path = shared_path(spark, "documents")
    fact = F.struct(F.col("user_id").alias("u"), F.col("event_type").alias("t"), F.lit(1).alias("unused"))
    docs = td.read(spark, sf_dir, "events").groupBy("user_id").agg(F.to_json(F.struct(F.collect_list(fact).alias("facts"))).alias("value"))
    files = docs.groupBy(F.floor(F.col("user_id") / _USERS_A_FILE).alias("part")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value"))
    files.select("value", "part").write.partitionBy("part").text(path)
    return tables.read_document(spark, path, "facts", "u: long, t: string").groupBy(F.col("u").alias("user_id"), F.col("t").alias("event_type")).agg(F.count("*").alias("n"))


def _settings(spark, sf_dir) -> DataFrame:
    path = shared_path(spark, "settings")
    kinds = td.read(spark, sf_dir, "events").groupBy("event_type").agg(F.max("user_id").alias("u"))
    text = F.concat(F.lit("plugins:\n  - compaction:\n      ratio: 0."), F.length("event_type"), F.lit("\n      retain: "), "u", F.lit("  # as it was\n"))
    kinds.select(F.when(F.col("event_type") == "view", "nothing: here\n").otherwise(text).alias("value"), F.col("event_type").alias("kind")).repartition("kind").write.partitionBy("kind").text(path)
    return tables.compaction_settings(spark, path)


@query("WITH k AS (SELECT event_type AS kind, CAST(max(user_id) AS VARCHAR) AS u FROM events WHERE event_type <> 'view' GROUP BY 1) SELECT kind, 'ratio' AS key, '0.' || length(kind) AS value FROM k UNION ALL SELECT kind, 'retain', u FROM k")
def settings_read(spark, sf_dir):
    return _settings(spark, sf_dir).select(F.regexp_extract("path", "kind=([a-z]+)", 1).alias("kind"), "key", "value")


@query("SELECT user_id, 'title ' || user_id AS title, substr('said ' || string_agg(event_type, ' ' ORDER BY event_id), 1, 200) AS first FROM events GROUP BY user_id")
def session_titles(spark, sf_dir):
    """A record for each user; a file is a list of the records of at most ``_USERS_A_FILE`` users."""
    path = shared_path(spark, "titles")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]), " ")
    cached = td.read(spark, sf_dir, "events").groupBy("user_id").agg(F.concat(F.lit("said  "), said).alias("said"))
    row = F.struct(F.struct(F.struct(F.concat(F.lit("title "), "user_id").alias("val")).alias("title"), F.struct(F.struct(F.struct(F.col("said").alias("text")).alias("first")).alias("val")).alias("titleInput")).alias("rows"))
    docs = cached.select("user_id", F.to_json(F.struct(F.col("user_id").cast("string").alias("sid"), row.alias("record"))).alias("value"))
    files = docs.groupBy(F.floor(F.col("user_id") / _USERS_A_FILE).alias("part")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value"))
    files.select("value", "part").write.partitionBy("part").text(path)
    return tables.session_titles(spark, path).select(F.col("sid").cast("long").alias("user_id"), "title", "first")

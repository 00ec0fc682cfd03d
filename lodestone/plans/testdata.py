"""The benchmark tables seen as the engine's: documents as items, conversations as logs, events as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = 1_760_000_000_000
DAY = 86_400_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # A small file is one split; what follows needs more hands than one. Large tables have splits enough and stay as they are.
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name == "documents" and df.rdd.getNumPartitions() < cores else df


def millis(name: str):
    """Epoch milliseconds of a time without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {name})")


def session_name(number):
    """A session's number as the short name that edits carry, as wide as any number, so that none is cut and none begins another."""
    return F.lpad(number, 20, "0")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items; times are a fixed function of the id."""
    d = F.col("doc_id")
    level = F.when(F.col("lang") == "en", "project").when(F.col("lang") == "fr", "topic").when(F.col("lang") == "de", "fact").otherwise("lesson")
    status = F.when(d % 50 == 0, "archived").when(d % 17 == 0, F.lit(None)).otherwise("active")
    return read(spark, sf_dir, "documents").select(d.alias("id"), F.col("text").alias("content"), F.concat_ws(" ", "lang", "source").alias("keywords"), F.col("source").alias("project"), status.alias("status"), (F.lit(NOW) - (d * 37 % 400) * DAY).alias("updated_at"), level.alias("level"))


ITEMS = f"""items AS (SELECT doc_id AS id, text AS content, concat_ws(' ', lang, source) AS keywords, source AS project,
  CASE WHEN doc_id % 50 = 0 THEN 'archived' WHEN doc_id % 17 = 0 THEN NULL ELSE 'active' END AS status, {NOW} - (doc_id * 37 % 400) * {DAY} AS updated_at,
  CASE lang WHEN 'en' THEN 'project' WHEN 'fr' THEN 'topic' WHEN 'de' THEN 'fact' ELSE 'lesson' END AS level FROM documents)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as events: users' and assistants' messages, and what the system said as a plugin's."""
    kind = F.when(F.col("role") == "user", "user").when(F.col("role") == "system", "plugin")
    block = F.struct(F.lit("text").alias("type"), "text", *[F.lit(None).cast("string").alias(n) for n in ("id", "name", "arguments")])
    missing = {"call_id": "string", "name": "string", "arguments": "string", "step": "int", "is_error": "boolean", "shadowed_seqs": "array<long>", "shadowed_tokens": "long", "raw": "string"}
    usage = F.struct(F.length("text").cast("long").alias("input"), F.lit(0).cast("long").alias("output"), (F.col("turn") * 10).alias("cache_read"))
    return read(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("seq"), F.col("turn").alias("pos"), F.when(F.col("role") == "assistant", "assistant/message").otherwise("user/message").alias("type"), kind.alias("kind"), F.array(block).alias("blocks"),
        F.lit(None).cast("int").alias("turn"), F.when(F.col("role") == "assistant", usage).alias("usage"), *[F.lit(None).cast(t).alias(n) for n, t in missing.items()],
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed turns of the log as stored turns."""
    from lodestone.operators import sessions, store

    done = sessions.completed_turns(log(spark, sf_dir))
    return done.select(store.turn_id(F.col("session"), F.col("user_seq")).alias("id"), F.col("session").alias("session_id"), "turn_index", F.substring("user_text", 1, 80).alias("summary"), F.when(F.col("answer_seq") % 2 == 0, "completed").otherwise("partial").alias("outcome"), "user_seq", "answer_seq", "user_text", "answer_text", (F.lit(NOW) + F.col("answer_seq")).alias("updated_at"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def triples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(terms, triples): all distinct words of each turn, one after another, as a chain of terms."""
    from lodestone.functions import text as tx
    from lodestone.operators import store

    words = F.array_distinct(F.regexp_extract_all(F.lower("user_text"), F.lit("[a-z]{4,}"), F.lit(0)))
    rows = turns(spark, sf_dir).select("id", "session_id", words.alias("w"))
    rest = F.greatest(F.size("w") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("w", 1, rest), F.slice("w", 2, rest), lambda s, o: F.struct(s.alias("s"), o.alias("o")))
    chain = rows.select(F.col("id").alias("turn_id"), "session_id", F.posexplode(pairs).alias("source_order", "t"))
    named = chain.select("turn_id", "session_id", "source_order", F.col("t.s").alias("subject"), F.lit("precedes").alias("predicate"), F.col("t.o").alias("object"))
    empty_terms = rows.sparkSession.createDataFrame([], "id string, normalized string, display_text string")
    terms = store.upsert_terms(empty_terms, named.select(F.explode(F.array("subject", "object")).alias("display_text")))
    flat = named.select("turn_id", store.term_id(tx.normalize_term(F.col("subject"))).alias("subject_id"), "predicate", store.term_id(tx.normalize_term(F.col("object"))).alias("object_id"), "source_order")
    return terms, flat


TURNS = """log AS (SELECT CAST(conv_id AS VARCHAR) AS session, turn AS seq, role, text FROM conversations),
numbered AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING) AS t FROM log),
ends AS (SELECT session, t, min(seq) AS user_seq, max(seq) FILTER (role = 'assistant' AND trim(text) <> '') AS answer_seq, max(seq) AS last, count(*) AS events FROM numbered WHERE t > 0 GROUP BY session, t),
turns AS (SELECT e.session, CAST(e.t - 1 AS INTEGER) AS turn_index, e.user_seq, e.answer_seq, trim(q.text) AS user_text, trim(a.text) AS answer_text
  FROM ends e JOIN log q ON q.session = e.session AND q.seq = e.user_seq JOIN log a ON a.session = e.session AND a.seq = e.answer_seq WHERE trim(q.text) <> '')"""


def tool_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log with tools, a session a user: views are questions, clicks steps that call a tool, errors results that name the
    event before them as their call, purchases answers, and sign-ups starts of turns."""
    from pyspark.sql import Window

    e = read(spark, sf_dir, "events")
    kind = F.col("event_type")
    block = lambda t, text=None, **more: F.struct(F.lit(t).alias("type"), (F.lit(None).cast("string") if text is None else text).alias("text"), *[more.get(n, F.lit(None).cast("string")).alias(n) for n in ("id", "name", "arguments")])
    own = F.col("event_id").cast("string")
    call = block("tool-call", id=own, name=F.lit("run"), arguments=F.col("props"))
    blocks = F.when(kind == "click", F.array(block("reasoning", F.col("props")), call)).when(kind != "signup", F.array(block("text", F.col("props"))))
    named = F.when(kind == "view", "user/message").when(kind.isin("click", "purchase"), "assistant/message").when(kind == "error", "tool/result").otherwise("turn/start")
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id")).cast("string")
    missing = {"name": "string", "arguments": "string", "turn": "int", "step": "int", "shadowed_seqs": "array<long>", "shadowed_tokens": "long", "raw": "string", "usage": "struct<input: bigint, output: bigint, cache_read: bigint>"}
    return e.select(
        F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), F.col("event_id").alias("pos"), named.alias("type"), F.when(kind == "view", "user").alias("kind"), blocks.alias("blocks"),
        F.when(kind == "error", before).alias("call_id"), F.when(kind == "error", F.lit(False)).alias("is_error"), *[F.lit(None).cast(t).alias(n) for n, t in missing.items()],
    )


TOOLS = """tools AS (SELECT CAST(user_id AS VARCHAR) AS session, event_id AS seq, event_type AS e, props AS text, lag(event_id) OVER w AS prev,
  lead(event_type) OVER w AS e1, lead(event_type, 2) OVER w AS e2, lead(props) OVER w AS text1,
  sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS t FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"""

"""Queries of the stateful streams: a table's rows pass through as a stream, and the sink's table is the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.durable import shared_path
from lodestone.plans import testdata as td
from lodestone.plans.catalogue import query
from lodestone.streaming import stateful

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Parts of a table that come in one after the other, at least; rows of a part, about; and by how many milliseconds a row may come after later ones.
_PARTS, _PART_ROWS, _JITTER = 3, 1 << 20, 700
#: Files of a part that has many rows.
_FILES = 4
_DELAY = f"{_JITTER} milliseconds"
#: The time of a last row under a key of its own, which carries the watermark past all others; it is never past itself.
_END = 1 << 45


def _streamed(rows: DataFrame, through, key: str) -> DataFrame:
    """What ``through`` makes of a stream of ``rows`` (with a time ``at``), which come out of order in several micro-batches."""
    spark = rows.sparkSession
    source, out, mark = (shared_path(spark, f"stream-{name}") for name in ("in", "out", "mark"))
    comes = F.col("at") + F.pmod(F.xxhash64(*rows.columns), F.lit(_JITTER))
    count = rows.count()
    parts, files = max(_PARTS, -(-count // _PART_ROWS)), _FILES if count > _PART_ROWS else 1
    cuts = rows.agg(F.percentile_approx(comes, [k / parts for k in range(1, parts)])).first()[0]
    # One pass deals the rows to their parts; each is then read by itself.
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts or ()]).cast("array<long>"), lambda c: c <= comes))
    staged = shared_path(spark, "stream-parts")
    dealt = rows.withColumn("part", part)
    dealt.write.partitionBy("part").parquet(staged)
    for k in range(parts):
        spark.read.schema(dealt.schema).parquet(staged).where(F.col("part") == k).select(*rows.columns).repartition(files).write.json(f"{source}/{k}")
    end = spark.range(1).select(*[(F.lit(_END) if f.name == "at" else F.lit("~") if f.name == key else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema])
    end.write.json(f"{source}/{parts}")
    # The store that keeps state over micro-batches is a setting of the stream's start alone.
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    try:
        found = through(stateful.rows_of(spark, f"{source}/*", rows.schema, files))
        stateful.sink(found, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), mark).awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(found.schema).option("recursiveFileLookup", "true").parquet(out)


def _events(spark, sf_dir):
    return td.read(spark, sf_dir, "events")


def _user():
    return F.col("user_id").cast("string")


@query(
    """WITH e AS (SELECT user_id, event_id, event_type, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM events),
u AS (SELECT user_id, coalesce(g, 0) AS g, max(event_id) FILTER (event_type = 'view') AS u, bool_or(event_type = 'signup') AS ended FROM e GROUP BY ALL),
a AS (SELECT u.user_id, u.g, u.u, max(event_id) AS a FROM u JOIN e ON e.user_id = u.user_id AND coalesce(e.g, 0) = u.g WHERE ended AND event_type = 'purchase' AND event_id > u.u GROUP BY ALL)
SELECT CAST(user_id AS VARCHAR) AS session, row_number() OVER (PARTITION BY user_id ORDER BY g) - 1 AS turn_index, u AS user_seq, a AS answer_seq FROM a"""
)
def stream_turns(spark, sf_dir):
    """Views are questions, purchases answers, and sign-ups ends of turns."""
    e = F.col("event_type")
    kind = F.when(e == "view", "user/message").when(e.isin("click", "purchase"), "assistant/message").when(e == "signup", "turn/end").otherwise("tool/result")
    rows = _events(spark, sf_dir).select(_user().alias("session"), F.col("event_id").alias("at"), F.col("event_id").alias("seq"), kind.alias("type"), F.when(e == "view", "user").otherwise("").alias("kind"), (e == "purchase").alias("visible"))
    return _streamed(rows, lambda s: stateful.finished_turns(s, _DELAY), "session")


@query(
    """WITH r AS (SELECT CAST(user_id AS VARCHAR) AS entry, event_id, event_type <> 'error' AS ok, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS n FROM events),
s AS (SELECT *, CASE WHEN ok THEN 'succeeded' WHEN n >= 3 THEN 'quarantined' ELSE 'pending' END AS state FROM r)
SELECT entry, event_id, state, CAST(n AS INTEGER) AS attempts, CASE WHEN state = 'pending' THEN event_id + CAST(least(3600000, 60000 * pow(2, n - 1)) AS BIGINT) END AS next_retry_at FROM s"""
)
def stream_retries(spark, sf_dir):
    rows = _events(spark, sf_dir).select(_user().alias("entry"), F.col("event_id").alias("at"), (F.col("event_type") != "error").alias("ok"))
    return _streamed(rows, lambda s: stateful.retry_queue(s, _DELAY), "entry").where("state <> 'due'").withColumnRenamed("at", "event_id")


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
r AS (SELECT user_id, event_id, p, event_id AS last, TRUE AS fire FROM e WHERE p = 1
  UNION ALL SELECT e.user_id, e.event_id, e.p, CASE WHEN e.event_id - r.last >= 500 THEN e.event_id ELSE r.last END, e.event_id - r.last >= 500 FROM r JOIN e ON e.user_id = r.user_id AND e.p = r.p + 1)
SELECT CAST(user_id AS VARCHAR) AS key, event_id AS id FROM r WHERE fire"""
)
def stream_throttle(spark, sf_dir):
    rows = _events(spark, sf_dir).select(_user().alias("key"), F.col("event_id").alias("id"), F.col("event_id").alias("at"))
    return _streamed(rows, lambda s: stateful.throttle(s, 500, _DELAY), "key").select("key", "id")


@query("WITH e AS (SELECT CAST(user_id AS VARCHAR) AS session, event_type AS id, event_id, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS before FROM events) SELECT session, id, event_id, before IS NULL OR event_id - before > 400 AS fresh FROM e")
def stream_seen(spark, sf_dir):
    rows = _events(spark, sf_dir).select(_user().alias("session"), F.col("event_type").alias("id"), F.col("event_id").alias("at"))
    return _streamed(rows, lambda s: stateful.seen_set(s, 400, _DELAY), "session").withColumnRenamed("at", "event_id")


@query("WITH e AS (SELECT CAST(user_id AS VARCHAR) AS provider, event_id, event_type, lag(event_id) OVER w AS before, lag(event_type) OVER w AS was FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT provider, event_id, coalesce(was = 'error' AND event_id < before + 300, FALSE) AS paused FROM e")
def stream_guard(spark, sf_dir):
    rows = _events(spark, sf_dir).select(_user().alias("provider"), F.col("event_id").alias("at"), F.when(F.col("event_type") == "error", 404).otherwise(200).alias("status"))
    return _streamed(rows, lambda s: stateful.failure_guard(s, 300, _DELAY), "provider").select("provider", F.col("at").alias("event_id"), "paused")


@query("SELECT CAST(user_id AS VARCHAR) AS attempt, min(event_id) AS n, 'again' AS unit, 120::BIGINT AS count, 1.0::DOUBLE AS share FROM events WHERE event_type = 'error' GROUP BY 1")
def stream_valve(spark, sf_dir):
    """Errors say one word over and over, all else says too little to be looked at."""
    said = F.when(F.col("event_type") == "error", F.repeat(F.lit("again. "), 120)).otherwise("")
    rows = _events(spark, sf_dir).select(_user().alias("attempt"), F.col("event_id").alias("at"), F.col("event_id").alias("n"), said.alias("delta"))
    return _streamed(rows, lambda s: stateful.loop_valve(s, delay=_DELAY), "attempt")


@query(
    """WITH r AS (SELECT CAST(user_id AS VARCHAR) AS entry, event_id, event_type <> 'error' AS ok, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS n, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
d AS (SELECT entry, n, after, event_id + CAST(least(800, 150 * pow(2, n - 1)) AS BIGINT) AS due FROM r WHERE NOT ok AND n < 20)
SELECT entry, due AS due_at, CAST(n AS INTEGER) AS attempts FROM d WHERE after IS NULL OR due < after"""
)
def stream_retries_due(spark, sf_dir):
    """Failed entries that fall due before anything else becomes of them: rows that no row of their key brings out."""
    rows = _events(spark, sf_dir).select(_user().alias("entry"), F.col("event_id").alias("at"), (F.col("event_type") != "error").alias("ok"))
    found = _streamed(rows, lambda s: stateful.retry_queue(s, _DELAY, most=20, base_ms=150, cap_ms=800), "entry")
    return found.where("state = 'due'").select("entry", F.col("at").alias("due_at"), "attempts")


@query(
    """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS session, event_type AS id, event_id, row_number() OVER (ORDER BY event_id) AS p FROM events),
r AS (SELECT p, session, id, event_id, [session] AS live, TRUE AS entered, CAST(NULL AS VARCHAR) AS evicted FROM e WHERE p = 1
  UNION ALL SELECT e.p, e.session, e.id, e.event_id,
    CASE WHEN list_contains(r.live, e.session) THEN r.live WHEN len(r.live) = 64 THEN list_append(r.live[2:], e.session) ELSE list_append(r.live, e.session) END,
    NOT list_contains(r.live, e.session), CASE WHEN NOT list_contains(r.live, e.session) AND len(r.live) = 64 THEN r.live[1] END
  FROM r JOIN e ON e.p = r.p + 1),
g AS (SELECT *, sum(CASE WHEN entered THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY p ROWS UNBOUNDED PRECEDING) AS stay FROM r)
SELECT session, id, event_id, row_number() OVER (PARTITION BY session, id, stay ORDER BY p) = 1 AS fresh, evicted FROM g"""
)
def stream_ledger(spark, sf_dir):
    """One ledger for all users, which holds 64 of them; nothing grows stale here, ``stream_seen`` has that."""
    rows = _events(spark, sf_dir).select(F.lit("all").alias("ledger"), F.col("event_id").alias("at"), F.col("event_id").alias("tie"), _user().alias("session"), F.col("event_type").alias("id"))
    found = _streamed(rows, lambda s: stateful.ledger(s, 1 << 44, 64, _DELAY), "ledger")
    return found.select("session", "id", F.col("at").alias("event_id"), "fresh", "evicted")

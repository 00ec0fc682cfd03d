"""Keyed tables: merges, replacements, diffs and the extraction queue.

A merge is a union of old and new rows with the newest kept, or an anti join and an append; nothing
is updated in place, so a step that is run again gives the same table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.schemas import OUTCOMES, QUEUE_STATES

MAX_ATTEMPTS, BASE_MS, CAP_MS = 3, 60_000, 3_600_000


def _id(prefix: str, *parts: Column) -> Column:
    joined = F.concat_ws("\0", *[p.cast("string") for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, 32))


def turn_id(session: Column, user_seq: Column) -> Column:
    return _id("tm-", session, user_seq)


def term_id(normalized: Column) -> Column:
    return _id("nt-", normalized)


def triple_id(turn: Column, subject: Column, predicate: Column, obj: Column) -> Column:
    return _id("tr-", turn, subject, predicate, obj)


def content_hash(c: Column) -> Column:
    return F.sha2(tx.text(c), 256)


def checked_turns(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with ``reason``); texts are redacted first."""
    clean = rows.withColumns({c: tx.redact(c) for c in ("summary", "user_text", "answer_text")})
    blank = lambda c: F.coalesce(tx.trim(F.col(c)) == "", F.lit(True))
    bad = lambda c: F.coalesce(F.col(c) < 0, F.lit(True))
    rules = [(blank("session_id"), "session_id"), (blank("summary"), "summary"), (~F.coalesce(F.col("outcome").isin(*OUTCOMES), F.lit(False)), "outcome"), (bad("user_seq"), "user_seq"), (bad("answer_seq"), "answer_seq"), (F.col("user_seq") == F.col("answer_seq"), "same seq"), (blank("user_text"), "user_text"), (blank("answer_text"), "answer_text")]
    reason = F.coalesce(*[F.when(c, F.lit(r)) for c, r in rules])
    marked = clean.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def upsert_turns(turns: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """Turns merged by (session_id, user_seq). New rows carry ``ord``, their order of arrival.

    A known turn keeps its id, number and creation time; a new one without a number gets the next of its session.
    """
    order = Window.partitionBy("session_id", "user_seq")
    last = new.withColumn("nth", F.row_number().over(order.orderBy(F.desc("ord")))).withColumn("first_ord", F.min("ord").over(order)).where("nth = 1").drop("nth")
    old = turns.select("session_id", "user_seq", F.col("id").alias("old_id"), F.col("turn_index").alias("old_index"), F.col("created_at").alias("old_created"))
    joined = last.join(old, ["session_id", "user_seq"], "left")
    top = turns.groupBy("session_id").agg(F.max("turn_index").alias("top"))
    joined = joined.join(top, "session_id", "left")
    fresh = F.col("old_id").isNull() & F.col("turn_index").isNull()
    number = F.coalesce("top", F.lit(-1)) + F.sum(fresh.cast("int")).over(Window.partitionBy("session_id").orderBy("first_ord", "user_seq"))
    merged = joined.select(
        F.coalesce("old_id", turn_id(F.col("session_id"), F.col("user_seq"))).alias("id"), "session_id",
        F.coalesce("turn_index", "old_index", F.when(fresh, number)).cast("int").alias("turn_index"), "summary", "outcome", "user_seq", "answer_seq", "user_text", "answer_text",
        content_hash(F.col("answer_text")).alias("answer_hash"), F.coalesce("old_created", F.lit(now)).alias("created_at"), F.lit(now).alias("updated_at"),
    )
    return turns.join(merged.select("session_id", "user_seq"), ["session_id", "user_seq"], "left_anti").unionByName(merged)


def upsert_terms(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """Terms merged with ``texts`` (display_text) by their normal form; a known term stays as it is."""
    new = texts.select(tx.normalize_term(F.col("display_text")).alias("normalized"), tx.collapse(F.col("display_text")).alias("display_text")).where("normalized <> ''").groupBy("normalized").agg(F.min("display_text").alias("display_text"))
    new = new.join(terms.select("normalized"), "normalized", "left_anti").select(term_id(F.col("normalized")).alias("id"), "normalized", "display_text")
    return terms.unionByName(new)


def replace_triples(triples: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """The triples of each turn in ``new`` (turn_id, session_id, subject, predicate, object, source_order) replaced at once.

    A turn with a blank part in any of its new triples keeps its old ones.
    """
    blank = reduce(lambda a, c: a | F.coalesce(tx.trim(F.col(c)) == "", F.lit(True)), ("subject", "predicate", "object"), F.lit(False))
    bad = new.where(blank).select("turn_id").distinct()
    good = new.join(bad, "turn_id", "left_anti")
    ids = [term_id(tx.normalize_term(F.col(c))).alias(f"{c}_id") for c in ("subject", "object")]
    rows = good.select("turn_id", "session_id", ids[0], tx.trim(F.col("predicate")).alias("predicate"), ids[1], F.col("source_order").cast("int").alias("source_order"))
    first = F.row_number().over(Window.partitionBy("turn_id", "subject_id", "predicate", "object_id").orderBy("source_order"))
    rows = rows.withColumn("nth", first).where("nth = 1").drop("nth")
    rows = rows.select(triple_id(F.col("turn_id"), F.col("subject_id"), F.col("predicate"), F.col("object_id")).alias("id"), "*", F.lit(now).alias("created_at"))
    return triples.join(good.select("turn_id").distinct(), "turn_id", "left_anti").unionByName(rows)


def named_triples(triples: DataFrame, terms: DataFrame) -> DataFrame:
    """Triples with the texts of subject and object, in source order."""
    s = terms.select(F.col("id").alias("subject_id"), F.col("display_text").alias("subject"))
    o = terms.select(F.col("id").alias("object_id"), F.col("display_text").alias("object"))
    return triples.join(s, "subject_id").join(o, "object_id").select("turn_id", "id", "subject", "predicate", "object", "source_order", "created_at")


def turns_of_terms(triples: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, turn): turns whose triples hold a term on either side."""
    bridge = triples.select(F.explode(F.array("subject_id", "object_id")).alias("id"), F.col("turn_id").alias("turn")).distinct()
    return bridge.join(terms.select("id"), "id", "left_semi").withColumnRenamed("id", "term")


def terms_in_text(terms: DataFrame, query: str, limit: int = 20) -> DataFrame:
    return terms.where((F.col("normalized") != "") & F.contains(tx.normalize_term(F.lit(query)), F.col("normalized"))).orderBy(F.desc(F.length("normalized")), "id").limit(limit)


def by_ids(turns: DataFrame, ids: list[str]) -> DataFrame:
    """The turns of the ids, in the order given; unknown ids are skipped."""
    spark = turns.sparkSession
    asked = spark.createDataFrame(list(enumerate(ids)), "pos int, id string")
    return turns.join(asked, "id").orderBy("pos").drop("pos")


def replace_postings(index: DataFrame, new: DataFrame) -> DataFrame:
    """Postings of new documents in place of the old ones."""
    return index.join(new.select("doc").distinct(), "doc", "left_anti").unionByName(new)


def index_diff(entries: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, change): new, changed, deleted or same, by the update time as text."""
    old = entries.select("id", F.coalesce(F.col("updated_at").cast("string"), F.lit("0")).alias("old"))
    now = rows.select("id", F.coalesce(F.col("updated_at").cast("string"), F.lit("0")).alias("now"))
    change = F.when(F.col("old").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("old") != F.col("now"), "changed").otherwise("same")
    return old.join(now, "id", "full_outer").select("id", change.alias("change"))


def stale_vectors(turns: DataFrame, vectors: DataFrame) -> DataFrame:
    """Turns without a vector of their present text."""
    hashed = turns.withColumn("content_hash", content_hash(F.col("user_text")))
    return hashed.join(vectors.select(F.col("turn_id").alias("id"), "content_hash"), ["id", "content_hash"], "left_anti")


def refresh_index(entries: DataFrame, rows: DataFrame, embedded: DataFrame, keep: tuple[str, ...] = ("level", "project", "keywords")) -> DataFrame:
    """The index (id, updated_at, vector, ``keep``...) as of ``rows``: entries of rows that are gone go, unchanged ones keep their vector and get
    the row's present values, and new and changed ones take theirs from ``embedded`` (id, vector); one without a vector there waits for the next time.
    """
    change = index_diff(entries, rows)
    now = rows.select("id", "updated_at", *keep).join(change, "id")
    same = now.where("change = 'same'").join(entries.select("id", "vector"), "id")
    fresh = now.where("change IN ('new', 'changed')").join(embedded.select("id", "vector"), "id")
    return same.unionByName(fresh).select("id", "updated_at", "vector", *keep)


def to_embed(entries: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows whose text has to be embedded anew."""
    return rows.join(index_diff(entries, rows).where("change IN ('new', 'changed')").select("id"), "id", "left_semi")


def upsert_vectors(vectors: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """Vectors (turn_id, content_hash, embedding, updated_at) with those of ``new`` (turn_id, text, embedding) in place; null and empty ones aren't stored."""
    own = new.where("embedding IS NOT NULL AND octet_length(embedding) > 0").select("turn_id", content_hash(F.col("text")).alias("content_hash"), "embedding", F.lit(now).cast("long").alias("updated_at"))
    return vectors.join(own.select("turn_id"), "turn_id", "left_anti").unionByName(own)


def snapshot(counted: dict[str, DataFrame], turns: DataFrame, now: int, built_at: int | None = None) -> DataFrame:
    """One row: rows of each table, distinct sessions, and days since a build."""
    out = turns.agg(F.count("*").alias("turns"), F.count_distinct("session_id").alias("sessions"))
    for name, df in counted.items():
        out = out.crossJoin(F.broadcast(df.agg(F.count("*").alias(name))))
    return out.withColumn("stale_days", F.lit(None if built_at is None else round((now - built_at) / 86_400_000, 1)).cast("double"))


def level_items(tables: dict[str, DataFrame], *, keep_null_status: bool = False, least_chars: int = 0) -> DataFrame:
    """Items of all levels with their level; archived ones go, and so do those without a status unless asked to stay."""
    parts = [df.withColumn("level", F.lit(level)) for level, df in tables.items()]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    status = F.coalesce("status", F.lit("active")) if keep_null_status else F.col("status")
    return rows.where((status != "archived") & (F.length(tx.text("content")) >= least_chars))


def store_stats(turns: DataFrame) -> DataFrame:
    return turns.agg(F.count("*").alias("turns"), F.count_distinct("session_id").alias("sessions"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])


def queue_stats(queue: DataFrame) -> DataFrame:
    return queue.agg(*[F.count_if(F.col("state") == s).alias(s) for s in QUEUE_STATES], F.count("*").alias("total"))


def due(queue: DataFrame, now: int, limit: int = 50) -> DataFrame:
    return queue.where((F.col("state") == "pending") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now))).orderBy("session_id", "turn_index").limit(limit)


def enqueue(queue: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """Entries merged by (session_id, user_seq, answer_seq); a known one keeps its state, and its route where the new one names none."""
    key = ["session_id", "user_seq", "answer_seq"]
    fresh = new.select(*key, "turn_index", F.col("provider").alias("p"), F.col("model").alias("m"), F.lit(True).alias("asked"))
    joined = queue.join(fresh.withColumnRenamed("turn_index", "ti"), key, "full_outer")
    return joined.select("session_id", F.coalesce("turn_index", "ti").alias("turn_index"), "user_seq", "answer_seq", F.coalesce("state", F.lit("pending")).alias("state"), F.coalesce("attempts", F.lit(0)).alias("attempts"), "last_error", "next_retry_at", F.coalesce("p", "provider").alias("provider"), F.coalesce("m", "model").alias("model"), F.when(F.col("asked"), F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"))


def backoff(attempts: Column, base: int = BASE_MS, cap: int = CAP_MS) -> Column:
    return F.least(F.lit(float(cap)), base * F.pow(F.lit(2.0), attempts - 1)).cast("long")


def fold_queue(results: DataFrame, *, attempts_allowed: int = MAX_ATTEMPTS) -> DataFrame:
    """(session_id, user_seq, answer_seq, state, attempts, next_retry_at, last_error) after results (key, at, ok, error) in order of ``at``.

    A failure counts an attempt and, at the last one allowed, quarantines; a success clears the error.
    Attempts only grow, so the state is that of the last result with all failures counted.
    """
    key = ["session_id", "user_seq", "answer_seq"]
    found = results.groupBy(*key).agg(F.count_if(~F.col("ok")).cast("int").alias("attempts"), F.max(F.struct("at", "ok", F.substring("error", 1, 500).alias("error"))).alias("last"))
    failed = ~F.col("last.ok")
    out = F.col("attempts") >= attempts_allowed
    state = F.when(~failed, "succeeded").when(out, "quarantined").otherwise("pending")
    return found.select(*key, state.alias("state"), "attempts", F.when(failed & ~out, F.col("last.at") + backoff(F.col("attempts"))).alias("next_retry_at"), F.when(failed, F.col("last.error")).alias("last_error"))


def watermarks(events: DataFrame) -> DataFrame:
    return events.groupBy("session_id").agg(F.max("completed_turn").alias("completed_turn"))


def throttle(events: DataFrame, gap_ms: int, *, by: list[str], at: str = "at", tie: str | None = None) -> DataFrame:
    """Events that fire: each key's first, and then the first at least ``gap_ms`` after the last that fired."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Keys follow one another in order, so a task holds the last one's state alone, whatever its rows.
        own, last = None, None
        for batch in batches:
            keep = []
            for *key, t in zip(*(batch.column(c).to_pylist() for c in (*by, at))):
                if key != own:
                    own, last = key, None
                fire = last is None or (t is not None and t - last >= gap_ms)
                keep.append(fire)
                last = t if fire else last
            yield batch.filter(pa.array(keep, pa.bool_()))

    return events.repartition(*by).sortWithinPartitions(*by, at, *([tie] if tie else [])).mapInArrow(run, events.schema)


def seen_within(events: DataFrame, ttl_ms: int, *, by: list[str], at: str = "at") -> DataFrame:
    """Events with ``fresh``: nothing of the key was seen within ``ttl_ms`` before; every sight renews it."""
    before = F.lag(at).over(Window.partitionBy(*by).orderBy(at))
    return events.withColumn("fresh", before.isNull() | (F.col(at) - before > ttl_ms))


def drop_repeats(queries: DataFrame, *, by: list[str], order: str, text: str = "query") -> DataFrame:
    """Queries that differ from the one before by length and first 40 characters."""
    mark = F.concat_ws(":", F.length(text).cast("string"), F.substring(text, 1, 40))
    before = F.lag(mark).over(Window.partitionBy(*by).orderBy(order))
    return queries.withColumn("__repeat", F.coalesce(before == mark, F.lit(False))).where("NOT __repeat").drop("__repeat")

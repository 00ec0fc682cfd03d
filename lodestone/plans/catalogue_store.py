"""More queries: stores, queues, captures, logs with tools, injection and text functions, each with its SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from lodestone.durable import shared_path, table
from lodestone.functions import text as tx
from lodestone.operators import capture, evidence, facts, graph, injection, lexical, repetition, sessions, store
from lodestone.operators import vectors as vec
from lodestone.plans import catalogue as base
from lodestone.plans import memory, recall
from lodestone.plans import testdata as td
from lodestone.plans.catalogue import query
from lodestone.sources import tables

_WS = base._WS
_TRIMMED = f"regexp_replace(text, '^[{_WS}]+|[{_WS}]+$', '', 'g')"
_CHAIN = base._CHAIN
_TURN_ID = "'tm-' || substr(sha256(session || chr(0) || user_seq), 1, 32)"


def _events(spark, sf_dir):
    return td.read(spark, sf_dir, "events")


def _user():
    return F.col("user_id").cast("string")


# ---- items and indexes -----------------------------------------------------------


def _levels(spark, sf_dir):
    items = td.items(spark, sf_dir)
    return {name: items.where(F.col("level") == name).drop("level") for name in ("project", "topic", "fact", "lesson")}


@query(f"WITH {td.ITEMS} SELECT id, level FROM items WHERE status <> 'archived' AND length(content) >= 200")
def level_items(spark, sf_dir):
    return store.level_items(_levels(spark, sf_dir), least_chars=200).select("id", "level")


@query(f"WITH {td.ITEMS} SELECT id, level FROM items WHERE coalesce(status, 'active') <> 'archived'")
def level_items_with_null_status(spark, sf_dir):
    return store.level_items(_levels(spark, sf_dir), keep_null_status=True).select("id", "level")


@query("SELECT doc_id, lang, CAST(NULL AS INTEGER) AS added FROM documents")
def publish_and_load(spark, sf_dir):
    from pyspark.sql import types as T

    path = shared_path(spark, "published")
    docs = td.read(spark, sf_dir, "documents").select("doc_id", "lang")
    tables.publish(docs.limit(0), path)
    tables.publish(docs, path)
    return tables.load(spark, path, T.StructType.fromDDL("doc_id long, lang string, added int"))


@query("SELECT doc_id, lang, n_chars + 1 AS n_chars, CAST(NULL AS VARCHAR) AS note FROM documents")
def migrated_table(spark, sf_dir):
    docs = td.read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    steps = [lambda df: df.where("false"), lambda df: df.withColumn("n_chars", F.col("n_chars") + 1), lambda df: df.withColumn("note", F.lit(None).cast("string"))]
    return tables.migrate(docs, 1, steps)[0]


@query("SELECT session_id, max(n) AS n FROM (SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS n FROM events) GROUP BY 1")
def ledger_round_trip(spark, sf_dir):
    path = shared_path(spark, "ledger")
    rows = _events(spark, sf_dir).select(_user().alias("session_id"), F.col("event_id").alias("at"))
    for kind in (rows.where("at % 2 = 0"), rows.where("at % 2 = 1")):
        tables.append_ledger(kind, path)
    return spark.read.schema("session_id string, at long").json(path).groupBy("session_id").agg(F.max("at").alias("n"))


@query(f"WITH {td.ITEMS} SELECT id, updated_at, level, project, keywords, CASE level WHEN 'project' THEN id ELSE -id END AS vector FROM items WHERE level <> 'fact'")
def refreshed_index(spark, sf_dir):
    """Topics have changed since, lessons are new, facts are gone; what had to be embedded has the negative of its number."""
    items = td.items(spark, sf_dir)
    old = items.where("level <> 'lesson'").select("id", (F.col("updated_at") - (F.col("level") == "topic").cast("int")).alias("updated_at"), F.col("id").alias("vector"), F.lit("old").alias("level"), F.lit("old").alias("project"), F.lit("old").alias("keywords"))
    rows = items.where("level <> 'fact'")
    embedded = store.to_embed(old, rows).select("id", (-F.col("id")).alias("vector"))
    return store.refresh_index(old, rows, embedded)


@query(f"WITH {td.TURNS} SELECT session AS session_id, user_seq FROM turns WHERE answer_seq % 2 = 0 AND turn_index > 0")
def stale_vectors(spark, sf_dir):
    """First turns have a vector of their text, those with an odd answer have one too; the rest of another text or none."""
    turns = td.turns(spark, sf_dir)
    had = turns.where("turn_index = 0 OR answer_seq % 2 <> 0").select(F.col("id").alias("turn_id"), F.col("user_text").alias("text"), F.lit(b"1234").alias("embedding"))
    other = turns.select(F.col("id").alias("turn_id"), F.lit("another text").alias("text"), F.lit(b"1234").alias("embedding"))
    empty = spark.createDataFrame([], "turn_id string, content_hash string, embedding binary, updated_at long")
    vectors = store.upsert_vectors(store.upsert_vectors(empty, other, 1), had, 2)
    return store.stale_vectors(turns, vectors).select("session_id", "user_seq")


@query(f"WITH {base._tokens_cte('SELECT doc_id AS id, text FROM documents')}, {base._POST}, n AS (SELECT doc_id, source FROM documents WHERE source = 'src3') SELECT id AS doc, term, tf FROM post WHERE id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT doc_id, source, 1 FROM n")
def replaced_postings(spark, sf_dir):
    docs = td.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    new = lexical.postings(docs.where("source = 'src3'").select("id", F.col("source").alias("text")))
    return store.replace_postings(lexical.postings(docs), new).select("doc", "term", "tf")


@query(f"WITH {td.ITEMS} SELECT id FROM items WHERE coalesce(status, '') <> 'archived' AND project IN ('src3', 'src5') AND level IN ('project', 'topic')")
def items_of_a_rule(spark, sf_dir):
    return injection.eligible_items(td.items(spark, sf_dir), projects=["src3", "src5"], levels=["project", "topic"]).select("id")


@query(
    f"""WITH {td.ITEMS}, own AS (SELECT * FROM items WHERE coalesce(status, '') <> 'archived' AND project IN ('src3', 'src5')), {base._tokens_cte("SELECT id, concat_ws(' ', content, keywords) AS text FROM own")}, {base._POST}, {base._bm25_sql(base._Q1)}
SELECT id, round(score, 6) AS score FROM sc ORDER BY round(score, 9) DESC, id LIMIT 3"""
)
def memories_of_a_rule(spark, sf_dir):
    return injection.select_memories(td.items(spark, sf_dir), base._QUESTION, projects=["src3", "src5"], k=3).select("id", F.round("score", 6).alias("score"))


# ---- turns and their store ---------------------------------------------------------


@query(f"WITH {td.TURNS}, r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY turn_index DESC) AS nth FROM turns) SELECT session AS session_id, user_seq FROM r WHERE session LIKE '1%' AND NOT (session = '1' AND nth <= 2)")
def turn_candidates(spark, sf_dir):
    turns = td.turns(spark, sf_dir)
    return recall.candidates(turns, session="1", visible=recall.visible_turns(turns, "1", 2)).select("session_id", "user_seq")


@query(f"WITH {td.TURNS} SELECT session AS session_id, turn_index, CAST(row_number() OVER (ORDER BY answer_seq DESC, {_TURN_ID}) - 1 AS INTEGER) AS position FROM turns WHERE contains(session, '1') AND turn_index = 1 ORDER BY answer_seq DESC, {_TURN_ID} LIMIT 5")
def exact_turns(spark, sf_dir):
    return recall.exact(td.turns(spark, sf_dir), "1", 1).select("session_id", "turn_index", F.col("position").cast("int").alias("position"))


@query(
    f"""WITH {td.TURNS}, o AS (SELECT DISTINCT session FROM turns WHERE turn_index = 0), f AS (SELECT t.*, o.session IS NOT NULL AS had, row_number() OVER (PARTITION BY t.session ORDER BY user_seq) AS nth FROM turns t LEFT JOIN o USING (session) WHERE t.turn_index <> 0)
SELECT {_TURN_ID} AS id, session AS session_id, 0 AS turn_index, 'new' AS summary, 1 AS created_at, 2 AS updated_at FROM turns WHERE turn_index = 0
UNION ALL SELECT {_TURN_ID}, session, CAST(nth - CASE WHEN had THEN 0 ELSE 1 END AS INTEGER), 'new', 2, 2 FROM f"""
)
def merged_turns(spark, sf_dir):
    """First turns are known; all turns arrive without numbers."""
    turns = td.turns(spark, sf_dir)
    empty = spark.createDataFrame([], "id string, session_id string, turn_index int, summary string, outcome string, user_seq long, answer_seq long, user_text string, answer_text string, answer_hash string, created_at int, updated_at int")
    old = store.upsert_turns(empty, turns.where("turn_index = 0").withColumn("ord", F.col("user_seq")), 1)
    new = turns.withColumns({"ord": F.col("user_seq"), "summary": F.lit("new"), "turn_index": F.lit(None).cast("int")})
    return store.upsert_turns(old, new, 2).select("id", "session_id", "turn_index", "summary", "created_at", "updated_at")


_REJECTS = "CASE WHEN session = '7' THEN 'session_id' WHEN turn_index = 1 THEN 'summary' WHEN user_seq % 4 = 2 THEN 'outcome' WHEN session = '8' THEN 'same seq' END"


@query(f"WITH {td.TURNS} SELECT coalesce({_REJECTS}, 'accepted') AS reason, count(*) AS n FROM turns GROUP BY 1")
def checked_turns(spark, sf_dir):
    s = F.col("session_id")
    rows = td.turns(spark, sf_dir).withColumns({
        "summary": F.when(F.col("turn_index") == 1, " ").otherwise("said"), "outcome": F.when(F.col("user_seq") % 4 == 2, "else").otherwise("completed"),
        "answer_seq": F.when(s == "8", F.col("user_seq")).otherwise(F.col("answer_seq")), "session_id": F.when(s == "7", "").otherwise(s),
    })
    accepted, rejected = store.checked_turns(rows)
    return accepted.select(F.lit("accepted").alias("reason")).unionByName(rejected.select("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def _graph_route_sql() -> str:
    steps = []
    for i in range(1, 21):
        steps.append(f"r{i} AS MATERIALIZED (SELECT p.id, p.t, 0.15 * p.t + 0.85 * coalesce(g.got, 0) AS rank FROM r{i - 1} p LEFT JOIN (SELECT dst, sum(rank * s) AS got FROM share JOIN r{i - 1} ON id = src GROUP BY dst) g ON g.dst = p.id)")
    return f"""WITH {_CHAIN}, e AS (SELECT DISTINCT least(t.s, t.o) AS a, greatest(t.s, t.o) AS b FROM chain WHERE t.s <> t.o),
ws_ AS (SELECT DISTINCT unnest([t.s, t.o]) AS w FROM chain), arcs AS (SELECT a AS src, b AS dst FROM e UNION ALL SELECT b, a FROM e), share AS MATERIALIZED (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS s FROM arcs),
sd AS (SELECT w, 1.0::DOUBLE / row_number() OVER (ORDER BY length(w) DESC, 'nt-' || substr(sha256(w), 1, 32)) AS weight FROM (SELECT w FROM ws_ WHERE contains('{base._QUESTION}', w) ORDER BY length(w) DESC, 'nt-' || substr(sha256(w), 1, 32) LIMIT 12)),
r0 AS MATERIALIZED (SELECT src AS id, coalesce(any_value(weight) / (SELECT sum(weight) FROM sd), 0) AS t, coalesce(any_value(weight) / (SELECT sum(weight) FROM sd), 0) AS rank FROM arcs LEFT JOIN sd ON w = src GROUP BY src), {", ".join(steps)},
br AS (SELECT DISTINCT session, user_seq, w FROM (SELECT session, user_seq, unnest([t.s, t.o]) AS w FROM chain)),
k AS (SELECT session, user_seq, sum(rank) AS score FROM br JOIN r20 ON w = id GROUP BY ALL)
SELECT session AS session_id, user_seq, round(score, 6) AS score FROM k ORDER BY score DESC, {_TURN_ID} LIMIT greatest(1, (SELECT CAST(ceil(count(*) * 0.2) AS BIGINT) FROM k))"""


@query(_graph_route_sql())
def graph_route(spark, sf_dir):
    terms, flat = (table(x, "terms") for x in td.triples(spark, sf_dir))
    turns = table(td.turns(spark, sf_dir), "turns")
    # The SQL's order is that of the scores it shows, which have six places.
    found = graph.graph_route(terms, flat, base._QUESTION, turns, places=6)
    return found.join(turns, "id").select("session_id", "user_seq", F.round("score", 6).alias("score"))


@query(f"WITH {_CHAIN} SELECT {_TURN_ID} AS turn_id, t.s AS subject, t.o AS object, CAST(t.n AS INTEGER) AS source_order FROM chain")
def named_triples(spark, sf_dir):
    """Every turn's triples replace an older one of its own."""
    terms, flat = (table(x, "terms") for x in td.triples(spark, sf_dir))
    words = terms.select(F.col("id"), F.col("display_text"))
    rows = flat.join(words.select(F.col("id").alias("subject_id"), F.col("display_text").alias("subject")), "subject_id").join(words.select(F.col("id").alias("object_id"), F.col("display_text").alias("object")), "object_id")
    rows = rows.withColumn("session_id", F.lit("s")).select("turn_id", "session_id", "subject", "predicate", "object", "source_order")
    empty = spark.createDataFrame([], "id string, turn_id string, session_id string, subject_id string, predicate string, object_id string, source_order int, created_at int")
    older = rows.where("source_order = 0").withColumn("predicate", F.lit("older"))
    held = store.replace_triples(store.replace_triples(empty, older, 1), rows, 2)
    return store.named_triples(held, terms).select("turn_id", "subject", "object", "source_order")


@query(f"WITH {_CHAIN}, e AS (SELECT session, user_seq, unnest([t.s, t.o]) AS w FROM chain) SELECT DISTINCT w AS term, {_TURN_ID} AS turn FROM e WHERE w LIKE 'a%'")
def turns_of_terms(spark, sf_dir):
    terms, flat = (table(x, "terms") for x in td.triples(spark, sf_dir))
    found = store.turns_of_terms(flat, terms.where(F.col("normalized").startswith("a")))
    return found.join(terms.select(F.col("id").alias("term"), "normalized"), "term").select(F.col("normalized").alias("term"), "turn")


@query(f"WITH {_CHAIN}, e AS (SELECT DISTINCT unnest([t.s, t.o]) AS w FROM chain), q AS (SELECT lower(trim(regexp_replace(max(text), '[{_WS}]+', ' ', 'g'))) AS q FROM conversations WHERE conv_id = 1) SELECT w AS normalized FROM e, q WHERE contains(q, w) ORDER BY length(w) DESC, 'nt-' || substr(sha256(w), 1, 32) LIMIT 20")
def terms_in_text(spark, sf_dir):
    terms, _ = td.triples(spark, sf_dir)
    said = td.read(spark, sf_dir, "conversations").where("conv_id = 1").agg(F.max("text")).first()[0]
    return store.terms_in_text(terms, said).select("normalized")


@query(f"WITH {td.TURNS} SELECT session AS session_id, user_seq FROM turns WHERE (session, user_seq) IN (('1', 0), ('3', 0), ('5', 2), ('7', 0))")
def turns_by_ids(spark, sf_dir):
    ids = ["tm-" + hashlib.sha256(f"{s}\0{n}".encode()).hexdigest()[:32] for s, n in (("7", 0), ("3", 0), ("1", 0), ("5", 2), ("none", 1))]
    return store.by_ids(td.turns(spark, sf_dir), ids).select("session_id", "user_seq")


@query(
    f"""WITH {td.TURNS}, l0 AS (SELECT {_TURN_ID} AS id, lower(user_text || chr(10) || answer_text) AS low FROM turns),
l1 AS (SELECT id, regexp_extract_all(low, '[a-z0-9_]+') AS ws, regexp_replace(low, '[a-z0-9_{_WS}]+', '', 'g') AS rest FROM l0),
l2 AS (SELECT id, ws, CASE WHEN length(rest) < 2 THEN [] ELSE string_split(rest, '') END AS c FROM l1),
toks AS (SELECT id, regexp_extract_all(translate(array_to_string(list_concat(ws, list_transform(generate_series(1, len(c) - 1), lambda i: c[i] || c[i + 1])), ' '), '{lexical._ACCENTED}', '{lexical._PLAIN}'), '[\\p{{L}}\\p{{N}}]+') AS t FROM l2),
{base._POST}, {base._bm25_sql("SELECT 0 AS query_id, unnest(['avec', 'enre', 'the']) AS term", 1.2, 'CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END')},
k AS (SELECT id, score, row_number() OVER (ORDER BY round(score, 9) DESC, id) - 1 AS r FROM sc)
SELECT session AS session_id, turn_index, CAST(r AS INTEGER) AS position, round(score, 6) AS score, 'raw' AS score_kind FROM k JOIN turns ON {_TURN_ID} = id WHERE r < 5"""
)
def turn_recall_lexical(spark, sf_dir):
    turns = table(td.turns(spark, sf_dir), "turns")
    found = recall.recall(recall.Store(turns, postings=table(recall.build_postings(turns), "postings")), "avec enre the", recall.Options(min_turn_chars=0, pool=5))
    return found.select("session_id", "turn_index", F.col("position").cast("int").alias("position"), "score", "score_kind")


@query(f"WITH {td.TURNS} SELECT session AS session_id, user_seq, round(19 - (row_number() OVER (ORDER BY answer_seq DESC, {_TURN_ID}) - 1) * 0.1, 6)::DOUBLE AS score FROM turns WHERE contains(lower(user_text), 'ment') OR contains(lower(answer_text), 'ment') ORDER BY answer_seq DESC, {_TURN_ID} LIMIT 50")
def substring_route(spark, sf_dir):
    turns = td.turns(spark, sf_dir)
    return lexical.substring_route(turns, "MENT", 50).join(turns, "id").select("session_id", "user_seq", F.round("score", 6).alias("score"))


@query("SELECT CAST(conv_id AS VARCHAR) AS session, CAST(t AS BIGINT) AS turn_no, count(*) AS events FROM (SELECT conv_id, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS t FROM conversations) GROUP BY ALL")
def numbered_events(spark, sf_dir):
    return sessions.with_turn(td.log(spark, sf_dir), "pos").groupBy("session", "turn_no").agg(F.count("*").alias("events"))


@query("SELECT CAST(conv_id AS VARCHAR) AS session, turn AS seq FROM conversations WHERE turn BETWEEN 1 AND 4 AND role = 'assistant'")
def sliced_events(spark, sf_dir):
    return sessions.slice_events(td.log(spark, sf_dir), 1, 4, ["assistant/message"]).select("session", "seq")


@query(
    """WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS session, turn, role, trim(text) AS text FROM conversations),
e AS (SELECT session, max(turn) FILTER (role = 'assistant' AND text <> '') AS a, max(turn) FILTER (role = 'user') AS q FROM c GROUP BY session),
b AS (SELECT e.session, a, q, max(turn) FILTER (role = 'user' AND turn < a) AS u FROM e JOIN c USING (session) GROUP BY ALL)
SELECT session, CASE WHEN coalesce(q > a, FALSE) THEN NULL ELSE u END AS user_seq, CASE WHEN coalesce(q > a, FALSE) THEN NULL ELSE a END AS answer_seq FROM b"""
)
def last_turns(spark, sf_dir):
    return capture.last_turn(td.log(spark, sf_dir))


@query("SELECT CAST(conv_id AS VARCHAR) AS session, trim(arg_max(text, turn)) AS query FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY 1")
def last_queries(spark, sf_dir):
    return capture.last_query(td.log(spark, sf_dir))


@query("SELECT CAST(conv_id AS VARCHAR) AS session, sha256(string_agg(text, chr(10) ORDER BY turn)) AS said FROM conversations GROUP BY 1")
def messages_text(spark, sf_dir):
    log = td.log(spark, sf_dir)
    plain = F.when(F.col("kind") == "user", F.col("blocks")[0]["text"])
    held = log.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("seq", plain.alias("text"), F.when(plain.isNull(), F.col("blocks")).alias("blocks")))).alias("messages"))
    return held.select("session", F.sha2(capture.messages_text(F.col("messages")), 256).alias("said"))


@query(f"WITH {td.TURNS} SELECT session AS session_id, user_seq FROM turns WHERE CAST(session AS BIGINT) >= 20 AND turn_index > 0")
def backfilled_turns(spark, sf_dir):
    turns = td.turns(spark, sf_dir)
    logs = turns.select(F.col("session_id").alias("session"), F.when(F.col("session_id").cast("long") >= 20, td.NOW - td.DAY).otherwise(td.NOW - 9 * td.DAY).alias("modified")).distinct()
    return capture.backfill(turns, logs, turns.where("turn_index = 0"), td.NOW, days=7).select("session_id", "user_seq")


@query(f"WITH {td.TURNS} SELECT session AS session_id, user_seq FROM turns WHERE turn_index = 1")
def picked_turns(spark, sf_dir):
    turns = td.turns(spark, sf_dir)
    return capture.pick_turns(turns, turns.where("turn_index = 1").select("session_id", "user_seq").union(spark.createDataFrame([("none", 0)], "s string, n long"))).select("session_id", "user_seq")


# ---- queue and captures -------------------------------------------------------------


def _queue(spark, sf_dir):
    e = F.col("event_type")
    state = F.when(e == "error", "quarantined").when(e == "purchase", "succeeded").otherwise("pending")
    return _events(spark, sf_dir).select(
        _user().alias("session_id"), F.col("event_id").cast("int").alias("turn_index"), F.col("event_id").alias("user_seq"), (F.col("event_id") + 1).alias("answer_seq"), state.alias("state"), F.lit(1).alias("attempts"),
        F.when(e == "error", "bad").alias("last_error"), F.when(e == "view", F.col("event_id") * 1000).alias("next_retry_at"), F.when(e != "signup", "p").alias("provider"), F.lit("m").alias("model"), F.lit(0).cast("long").alias("updated_at"),
    )


_QUEUE = "queue AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_id, event_type, CASE event_type WHEN 'error' THEN 'quarantined' WHEN 'purchase' THEN 'succeeded' ELSE 'pending' END AS state, CASE WHEN event_type = 'view' THEN event_id * 1000 END AS next FROM events)"


@query(f"WITH {_QUEUE} SELECT count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'succeeded') AS succeeded, count(*) FILTER (state = 'quarantined') AS quarantined, count(*) AS total FROM queue")
def queue_stats(spark, sf_dir):
    return store.queue_stats(_queue(spark, sf_dir))


@query(f"WITH {_QUEUE} SELECT session_id, event_id AS user_seq FROM queue WHERE state = 'pending' AND (next IS NULL OR next <= 500000) ORDER BY session_id, event_id LIMIT 50")
def queue_due(spark, sf_dir):
    return store.due(_queue(spark, sf_dir), 500_000).select("session_id", "user_seq")


@query(f"WITH {_QUEUE} SELECT session_id, event_id AS user_seq, state, CASE WHEN event_type = 'click' THEN 'new' WHEN event_type = 'signup' THEN NULL ELSE 'p' END AS provider, CASE WHEN event_type IN ('click', 'view') THEN 9 ELSE 0 END AS updated_at FROM queue UNION ALL SELECT 'fresh', 1, 'pending', NULL, 9")
def enqueued(spark, sf_dir):
    held = _queue(spark, sf_dir)
    e = _events(spark, sf_dir).where("event_type IN ('click', 'view')")
    new = e.select(_user().alias("session_id"), F.col("event_id").cast("int").alias("turn_index"), F.col("event_id").alias("user_seq"), (F.col("event_id") + 1).alias("answer_seq"), F.when(F.col("event_type") == "click", "new").alias("provider"), F.lit(None).cast("string").alias("model"))
    new = new.unionByName(spark.createDataFrame([("fresh", 1, 1, 2, None, None)], "session_id string, turn_index int, user_seq long, answer_seq long, provider string, model string"))
    return store.enqueue(held, new, 9).select("session_id", "user_seq", "state", "provider", F.col("updated_at").cast("int").alias("updated_at"))


_RECOVER = "CASE WHEN event_type = 'signup' AND user_id % 2 = 1 THEN 'drop' WHEN user_id % 3 = 0 THEN 'done' WHEN event_type = 'signup' THEN 'skip' ELSE 'extract' END"


@query("WITH q AS (SELECT CAST(user_id AS VARCHAR) AS session_id, user_id, event_id, event_type FROM events WHERE event_type NOT IN ('error', 'purchase') AND (event_type <> 'view' OR event_id * 1000 <= 500000) ORDER BY session_id, event_id LIMIT 1000) SELECT session_id, event_id AS user_seq, " + _RECOVER + " AS action FROM q")
def recovery(spark, sf_dir):
    """Odd users' sign-ups aren't in the log, every third user's turns are stored, and sign-ups have no route."""
    e = _events(spark, sf_dir)
    said = e.where("NOT (event_type = 'signup' AND user_id % 2 = 1)").select(_user().alias("session_id"), F.col("event_id").alias("user_seq"), (F.col("event_id") + 2).alias("answer_seq"), F.lit("q").alias("user_text"), F.lit("a").alias("answer_text"))
    stored = e.where("user_id % 3 = 0").select(_user().alias("session_id"), F.col("event_id").alias("user_seq"))
    return capture.recover(_queue(spark, sf_dir), said, stored, 500_000, limit=1000).select("session_id", "user_seq", "action")


def _captured(spark, sf_dir):
    turns = td.turns(spark, sf_dir)
    key = ["session_id", "user_seq", "answer_seq"]
    queue = turns.select("session_id", "turn_index", "user_seq", "answer_seq", F.lit("pending").alias("state"), F.when(F.col("turn_index") == 0, 2).otherwise(0).alias("attempts"), F.lit(None).cast("string").alias("last_error"), F.lit(None).cast("long").alias("next_retry_at"), F.lit("p").alias("provider"), F.lit("m").alias("model"), F.lit(0).alias("updated_at"))
    word = lambda c: F.regexp_extract(F.lower(c), "[a-z]{4,}", 0)
    pair = F.struct(word("user_text").alias("subject"), F.lit("then").alias("predicate"), word("answer_text").alias("object"))
    failed = F.when(F.col("user_seq") % 4 == 2, "timeout")
    results = turns.where("session_id <> '1'").select(*key, "user_text", "answer_text", F.col("user_seq").alias("ord"), F.lit("said").alias("summary"), F.lit("completed").alias("outcome"), F.array(pair).alias("triples"), failed.alias("error"))
    empty = {
        "turns": "id string, session_id string, turn_index int, summary string, outcome string, user_seq long, answer_seq long, user_text string, answer_text string, answer_hash string, created_at int, updated_at int",
        "terms": "id string, normalized string, display_text string", "watermarks": "session_id string, completed_turn long",
        "triples": "id string, turn_id string, session_id string, subject_id string, predicate string, object_id string, source_order int, created_at int",
    }
    held = {n: spark.createDataFrame([], s) for n, s in empty.items()} | {"queue": table(queue, "queue")}
    return capture.capture(held, table(results, "results"), 1000)


_CAPTURED = f"""{td.TURNS}, c AS (SELECT *, regexp_extract(lower(user_text), '[a-z]{{4,}}') AS s, regexp_extract(lower(answer_text), '[a-z]{{4,}}') AS o FROM turns),
m AS (SELECT *, CASE WHEN session = '1' THEN 'none' WHEN user_seq % 4 = 2 THEN 'timeout' WHEN s = '' OR o = '' THEN 'blank triple' ELSE 'ok' END AS r FROM c)"""


@query(f"WITH {_CAPTURED} SELECT session AS session_id, user_seq, CASE r WHEN 'ok' THEN 'succeeded' WHEN 'none' THEN 'pending' ELSE CASE WHEN turn_index = 0 THEN 'quarantined' ELSE 'pending' END END AS state, CASE WHEN turn_index = 0 THEN 2 ELSE 0 END + CASE WHEN r IN ('ok', 'none') THEN 0 ELSE 1 END AS attempts, CASE WHEN r NOT IN ('ok', 'none') THEN r END AS last_error, CASE WHEN r NOT IN ('ok', 'none') AND turn_index > 0 THEN 61000 END AS next_retry_at FROM m")
def captured_queue(spark, sf_dir):
    return _captured(spark, sf_dir)["queue"].select("session_id", "user_seq", "state", "attempts", "last_error", "next_retry_at")


@query(f"WITH {_CAPTURED}, n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY user_seq) - 1 AS k, count(*) OVER (PARTITION BY session) - 1 AS top FROM m WHERE r = 'ok') SELECT session AS session_id, user_seq, CAST(k AS INTEGER) AS turn_index, s AS subject, o AS object, top AS completed_turn FROM n")
def captured_turns(spark, sf_dir):
    got = _captured(spark, sf_dir)
    named = store.named_triples(got["triples"], got["terms"]).select(F.col("turn_id").alias("id"), "subject", "object")
    return got["turns"].join(named, "id").join(got["watermarks"], "session_id").select("session_id", "user_seq", "turn_index", "subject", "object", "completed_turn")


@query(
    """WITH c AS (SELECT user_id, event_id, event_type, props FROM events)
SELECT CAST(user_id AS VARCHAR) AS stream, coalesce(string_agg(props, '' ORDER BY event_id) FILTER (event_type = 'click'), '') AS text, coalesce(string_agg(props, '' ORDER BY event_id) FILTER (event_type = 'view'), '') AS reasoning,
  max(event_id) FILTER (event_type = 'signup') AS usage, coalesce(string_agg(props, '' ORDER BY event_id) FILTER (event_type = 'error'), '') AS arguments, coalesce(string_agg(props, '' ORDER BY event_id) FILTER (event_type = 'error'), '') <> '' AS called FROM c GROUP BY user_id"""
)
def collected_streams(spark, sf_dir):
    """Clicks are words, views thoughts, errors parts of one call, sign-ups usage."""
    e = F.col("event_type")
    kind = F.when(e == "click", "text-delta").when(e == "view", "reasoning-delta").when(e == "error", "tool-call-delta").when(e == "signup", "usage").otherwise("else")
    error = e == "error"
    chunks = _events(spark, sf_dir).select(_user().alias("stream"), F.col("event_id").alias("pos"), kind.alias("type"), F.col("props").alias("text"), F.when(error, "c1").alias("id"), F.when(error, "run").alias("name"), F.when(error, F.col("props")).alias("arguments"), F.when(e == "signup", F.col("event_id")).alias("usage"), F.lit(None).cast("string").alias("reason"))
    found = capture.collect_stream(chunks)
    raw = capture.extraction_text(F.col("tool_calls"), F.lit(""))
    return found.select("stream", "text", "reasoning", "usage", F.coalesce(raw["raw"], F.lit("")).alias("arguments"), raw.isNotNull().alias("called"))


@query("WITH s AS (SELECT DISTINCT user_id, event_type FROM events) SELECT CAST(user_id AS VARCHAR) AS session, event_type, CASE WHEN event_type = 'view' THEN 'own' ELSE 'set' END AS provider, 'm' AS model, CASE WHEN event_type = 'view' THEN NULL ELSE 'low' END AS effort FROM s WHERE event_type <> 'error'")
def routed_sessions(spark, sf_dir):
    e = F.col("event_type")
    s = _events(spark, sf_dir).select(_user().alias("session"), "event_type").distinct()
    own = s.withColumns({"provider": F.when(e != "error", "own").otherwise(""), "model": F.when(e != "error", "m"), "effort": F.lit("low")})
    view, rest = own.where(e == "view").withColumn("effort", F.lit("")), own.where(e != "view")
    return capture.routed(view).unionByName(capture.routed(rest, provider="set")).select("session", "event_type", "provider", "model", "effort")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE 'did ' || props END AS answer, CASE WHEN event_type = 'error' THEN 'down' END AS error FROM events")
def called_service(spark, sf_dir):
    def service(request: str, effort: str | None = None) -> str:
        if effort:
            raise capture.Rejected("effort")
        if request.startswith("error"):
            raise ConnectionError("down")
        return "did " + request.partition(" ")[2]

    asked = _events(spark, sf_dir).select("event_id", F.concat_ws(" ", "event_type", "props").alias("request"))
    return capture.call_service(asked, service, options={"effort": "low"}, pause=0.0).select("event_id", "answer", "error")


@query(
    """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS session, event_id AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
r AS (SELECT session, x, p, 1 AS n, x AS last, TRUE AS continued FROM e WHERE p = 1
  UNION ALL SELECT e.session, e.x, e.p, CASE WHEN r.n < 3 AND e.x - r.last >= 400 THEN r.n + 1 ELSE r.n END, CASE WHEN r.n < 3 AND e.x - r.last >= 400 THEN e.x ELSE r.last END, r.n < 3 AND e.x - r.last >= 400 FROM r JOIN e ON e.session = r.session AND e.p = r.p + 1)
SELECT session, x AS event_id, continued FROM r"""
)
def continue_budget(spark, sf_dir):
    return capture.continue_budget(_events(spark, sf_dir).select(_user().alias("session"), F.col("event_id").alias("at")), most=3, cooldown_ms=400).withColumnRenamed("at", "event_id")


# ---- logs with tools ------------------------------------------------------------------


@query(f"WITH {td.TOOLS} SELECT session, seq, coalesce(e1 = 'error' AND coalesce(e2, '') <> 'error', FALSE) AS complete FROM tools WHERE e = 'click'")
def paired_spans(spark, sf_dir):
    return sessions.paired_spans(td.tool_log(spark, sf_dir)).select("session", "seq", "complete")


@query(f"WITH {td.TOOLS} SELECT session, seq, CASE WHEN e = 'purchase' THEN text ELSE '' END AS text, CASE WHEN e = 'click' THEN text END AS args, CASE WHEN e = 'click' AND e1 = 'error' THEN text1 END AS result FROM tools WHERE e IN ('click', 'purchase')")
def described_steps(spark, sf_dir):
    call = F.get("calls", 0)
    return capture.steps(td.tool_log(spark, sf_dir)).select("session", "seq", "text", call["args"].alias("args"), call["text"].alias("result"))


@query(f"WITH {td.TOOLS} SELECT session, seq, e = 'click' AS calls FROM tools")
def tool_calls(spark, sf_dir):
    return td.tool_log(spark, sf_dir).select("session", "seq", sessions.has_tool_call(F.coalesce("blocks", F.array().cast("array<struct<type:string,text:string,id:string,name:string,arguments:string>>"))).alias("calls"))


@query(
    f"""WITH {td.TOOLS}, n AS (SELECT *, max(t) OVER (PARTITION BY session) AS turns, max(CASE WHEN e = 'purchase' THEN seq END) OVER (PARTITION BY session, t) AS a FROM tools WHERE t > 0),
z AS (SELECT *, t <= turns - 2 AS zone, CASE e WHEN 'click' THEN 2 * length(text) WHEN 'signup' THEN 0 ELSE length(text) END AS chars FROM n)
SELECT session, CAST(max(turns) AS INTEGER) AS turns, count(DISTINCT CASE WHEN zone AND a IS NOT NULL THEN t END) AS foldable_turns, count(*) FILTER (zone AND seq < a AND e IN ('click', 'error')) AS foldable_nodes,
  CAST(coalesce(sum(length(text)) FILTER (zone AND seq < a AND e = 'click'), 0) AS BIGINT) AS reasoning_chars, CAST(coalesce(sum(length(text)) FILTER (zone AND seq < a AND e = 'error'), 0) AS BIGINT) AS tool_chars,
  CAST(coalesce(sum(chars) FILTER (zone), 0) AS BIGINT) AS total_chars FROM z GROUP BY session"""
)
def tool_estimate(spark, sf_dir):
    found = sessions.estimate(td.tool_log(spark, sf_dir), keep=2)
    return found.select("session", "turns", "foldable_turns", "foldable_nodes", *[F.col(c).cast("long").alias(c) for c in ("reasoning_chars", "tool_chars", "total_chars")])


@query(
    """WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS session, turn, role, length(text) AS n, trim(text) <> '' AS said, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS t FROM conversations),
p AS (SELECT *, CAST(floor(n / 2.0 + 0.5) AS BIGINT) AS tokens, max(t) OVER (PARTITION BY session) AS last FROM c),
k AS (SELECT *, CASE WHEN last > 1 THEN t < last ELSE FALSE END AS old, max(CASE WHEN role = 'assistant' AND said THEN turn END) OVER (PARTITION BY session, t) AS a, min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY session, t) AS s FROM p),
i AS (SELECT *, coalesce(NOT old AND t > 0 AND turn > s AND turn < a, FALSE) AS mid FROM k)
SELECT session, CAST(sum(tokens) AS BIGINT) AS original, CAST(sum(tokens) - coalesce(sum(tokens) FILTER (old), 0) + CASE WHEN bool_or(old) THEN 60 ELSE 0 END AS BIGINT) AS folded_prefix,
  CAST(sum(tokens) - coalesce(sum(tokens) FILTER (old), 0) + CASE WHEN bool_or(old) THEN 60 ELSE 0 END - coalesce(sum(tokens) FILTER (mid), 0) + 40 * count(DISTINCT CASE WHEN mid THEN t END) AS BIGINT) AS projected FROM i GROUP BY session"""
)
def projected_size(spark, sf_dir):
    found = sessions.projected_size(td.log(spark, sf_dir), fresh=1)
    return found.select("session", *[F.col(c).cast("long").alias(c) for c in ("original", "folded_prefix", "projected")])


@query("SELECT CAST(conv_id AS VARCHAR) AS session, CAST(sum(length(text)) AS BIGINT) AS size FROM conversations GROUP BY 1 ORDER BY size DESC, session LIMIT 5")
def largest_logs(spark, sf_dir):
    c = td.read(spark, sf_dir, "conversations")
    return sessions.largest_logs(c.groupBy(F.col("conv_id").cast("string").alias("session")).agg(F.sum(F.length("text")).alias("size")))


@query(f"WITH {td.TOOLS} SELECT session, seq, CASE WHEN e1 = 'error' AND coalesce(e2, '') <> 'error' THEN 'fold' ELSE 'wait' END AS action, text AS unit, 60::BIGINT AS count, 2 AS span FROM tools WHERE e = 'click' AND seq >= 100")
def guard_sweep(spark, sf_dir):
    """Every call's step repeats itself in thought; those before the hundredth event were seen."""
    log = td.tool_log(spark, sf_dir)
    again = lambda b: F.when(b["type"] == "reasoning", F.struct(b["type"].alias("type"), F.repeat(F.concat(b["text"], F.lit(". ")), 60).alias("text"), *[b[n].alias(n) for n in ("id", "name", "arguments")])).otherwise(b)
    events = log.withColumn("blocks", F.transform("blocks", again))
    seen = log.where("seq < 100").select("session", "seq")
    return capture.guard_sweep(events, seen).select("session", "seq", "action", "unit", F.col("count").cast("long").alias("count"), "span")


# ---- injection -----------------------------------------------------------------------


@query("SELECT DISTINCT 'session-' || user_id AS session FROM events WHERE event_type NOT IN ('error', 'click')")
def main_sessions(spark, sf_dir):
    """Errors come from sessions of another name, clicks from subagents, views from ones that nothing is known of."""
    e = F.col("event_type")
    name = F.concat(F.when(e == "error", "job-").otherwise("session-"), "user_id")
    s = _events(spark, sf_dir).select(name.alias("session"), F.when(e == "click", "subagent").when(e != "view", "user").alias("origin"), F.when(e == "click", 1).when(e != "view", 0).alias("delegation_depth"))
    return injection.main_sessions(s).select("session").distinct()


@query(
    """WITH u AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS t FROM conversations WHERE role = 'user'),
a AS (SELECT DISTINCT conv_id FROM u WHERE t <= 3 AND contains(text, 'tion')), c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT 'session-' || a.conv_id AS session, 'session-' || max(c.conv_id) AS source FROM a JOIN c ON c.conv_id < a.conv_id GROUP BY a.conv_id"""
)
def relays(spark, sf_dir):
    """Sessions follow one another; those whose user says the word go on where the one before ended."""
    c = td.read(spark, sf_dir, "conversations")
    name = F.concat(F.lit("session-"), "conv_id")
    at = F.col("conv_id") * 10
    users = sessions.with_turn(td.log(spark, sf_dir)).where(sessions.real_user())
    asked = users.select(F.concat(F.lit("session-"), "session").alias("session"), F.col("turn_no").alias("turn"), (F.col("session").cast("long") * 10).alias("at"), F.col("blocks")[0]["text"].alias("text"))
    said = sessions.dialogue(td.log(spark, sf_dir)).withColumn("session", F.concat(F.lit("session-"), "session"))
    logs = c.select(name.alias("session"), (at - 5).alias("modified")).distinct()
    return injection.relayed(asked, logs, said, trigger="tion", most_age_ms=1 << 40).select("session", "source")


@query("SELECT 'session-' || lpad(CAST(max(user_id) AS VARCHAR), 4, '0') AS session FROM events WHERE event_type = 'view' AND user_id < 77")
def previous_session(spark, sf_dir):
    """Sessions were changed in the order of their users; only viewers' are main sessions."""
    name = F.concat(F.when(F.col("event_type") == "view", "session-").otherwise("other-"), F.lpad(_user(), 4, "0"))
    s = _events(spark, sf_dir).where("user_id <= 77").select(name.alias("session"), F.col("user_id").alias("modified")).distinct()
    return injection.previous_session(s, "session-0077", 100).select("session")


@query("WITH h AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS session, event_type AS id FROM events), l AS (SELECT CAST(user_id AS VARCHAR) AS session, event_type AS id, max(event_id) AS last FROM events GROUP BY ALL) SELECT h.* FROM h JOIN l USING (session, id) WHERE 9000 - last > 1500")
def not_injected(spark, sf_dir):
    e = _events(spark, sf_dir).select(_user().alias("session"), F.col("event_type").alias("id"), F.col("event_id").alias("at"))
    return injection.not_injected(e.select("session", "id").distinct(), e, 9000, 1500)


@query("WITH f AS (SELECT user_id, min(event_id) AS first FROM events GROUP BY 1 ORDER BY first DESC, CAST(user_id AS VARCHAR) LIMIT 64) SELECT CAST(user_id AS VARCHAR) AS session, count(*) AS n FROM events JOIN f USING (user_id) GROUP BY 1")
def live_sessions(spark, sf_dir):
    e = _events(spark, sf_dir).select(_user().alias("session"), F.col("event_id").alias("at"))
    return injection.live_sessions(e, 64).groupBy("session").agg(F.count("*").alias("n"))


def _line_sql(text: str, most: int) -> str:
    t = f"trim(regexp_replace({text}, '[{_WS}]+', ' ', 'g'))"
    return f"CASE WHEN length({t}) > {most} THEN substr({t}, 1, {most}) || '…' ELSE {t} END"


@query(f"WITH {base._SAID}, l AS (SELECT session, seq, '  ' || CASE role WHEN 'user' THEN '用户' ELSE '助手' END || '：' || {_line_sql('text', 300)} AS line FROM said), u AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY session ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) AS used FROM l) SELECT session, seq, line FROM u WHERE used - 1 + 260 <= 2000")
def relay_lines(spark, sf_dir):
    return injection.relay_lines(sessions.dialogue(td.log(spark, sf_dir))).select("session", "seq", "line")


@query("WITH m AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations), u AS (SELECT conv_id, max(p) FILTER (role = 'user') AS p, count(*) AS n FROM m GROUP BY 1) SELECT conv_id, CAST(CASE WHEN p IS NULL THEN n ELSE n + 1 END AS INTEGER) AS messages, CAST(coalesce(p, 0) AS INTEGER) AS place FROM u")
def message_inserted(spark, sf_dir):
    c = td.read(spark, sf_dir, "conversations")
    held = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("kind")))), lambda m: F.struct(m["kind"].alias("kind"))).alias("ms"))
    out = injection.insert_before_last_user(F.col("ms"), F.struct(F.lit("new").alias("kind")))
    return held.select("conv_id", F.size(out).alias("messages"), F.array_position(F.transform(out, lambda m: m["kind"]), F.lit("new")).cast("int").alias("place"))


@query("""SELECT event_id, event_type || chr(10) || 'p' || event_id || chr(10) || '{"command":"' || event_type || '","path":"p' || event_id || '"}' AS text FROM events""")
def serialized_arguments(spark, sf_dir):
    arguments = F.to_json(F.struct(F.col("event_type").alias("command"), F.concat(F.lit("p"), "event_id").alias("path")))
    return _events(spark, sf_dir).select("event_id", injection.serialize_arguments(arguments).alias("text"))


def _rules():
    return [
        {"rule_id": "clicks", "tools": ["click"], "pattern": '"p[0-9]*7"', "query": base._QUESTION, "projects": ["src3"], "cooldown_ms": 40, "most_chars": 700},
        {"rule_id": "rest", "tools": ["click", "error"], "query": base._QUESTION, "levels": ["topic"], "k": 2, "cooldown_ms": 90},
    ]


def _calls(spark, sf_dir):
    arguments = F.to_json(F.struct(F.concat(F.lit("p"), "event_id").alias("path")))
    return _events(spark, sf_dir).select(F.col("event_id").alias("call_id"), _user().alias("session"), F.col("user_id").alias("workspace"), F.col("event_id").alias("at"), F.col("event_type").alias("name"), arguments.alias("arguments"))


@query("SELECT event_id AS call_id, CASE WHEN event_type = 'click' AND event_id % 10 = 7 THEN 'clicks' ELSE 'rest' END AS rule_id FROM events WHERE event_type IN ('click', 'error')")
def matched_rules(spark, sf_dir):
    rules = spark.createDataFrame([(k, r["rule_id"], r["tools"], r.get("pattern")) for k, r in enumerate(_rules())], "ord int, rule_id string, tools array<string>, pattern string")
    return injection.match_rules(_calls(spark, sf_dir), rules).select("call_id", "rule_id")


@query(
    """WITH RECURSIVE m AS (SELECT event_id, user_id, CASE WHEN event_type = 'click' AND event_id % 10 = 7 THEN 'clicks' ELSE 'rest' END AS rule_id FROM events WHERE event_type IN ('click', 'error')),
e AS (SELECT *, CASE rule_id WHEN 'clicks' THEN 40 ELSE 90 END AS gap, row_number() OVER (PARTITION BY rule_id, user_id ORDER BY event_id) AS p FROM m),
r AS (SELECT rule_id, user_id, event_id, gap, p, event_id AS last, TRUE AS fire FROM e WHERE p = 1
  UNION ALL SELECT e.rule_id, e.user_id, e.event_id, e.gap, e.p, CASE WHEN e.event_id - r.last >= e.gap THEN e.event_id ELSE r.last END, e.event_id - r.last >= e.gap FROM r JOIN e ON e.rule_id = r.rule_id AND e.user_id = r.user_id AND e.p = r.p + 1)
SELECT event_id AS call_id, rule_id FROM r WHERE fire AND user_id <> 5"""
)
def fired_rules(spark, sf_dir):
    """User 5 has seen everything lately."""
    items = td.items(spark, sf_dir)
    ledger = items.select(F.lit("5").alias("session"), "id", F.lit(10).cast("long").alias("at"))
    return injection.fire_rules(_calls(spark, sf_dir), _rules(), items, ledger, 20).select("call_id", "rule_id")


def _decisions(spark, sf_dir):
    e = F.col("event_type")
    rows = _events(spark, sf_dir).select(F.col("event_id").cast("string").alias("id"), e.alias("goal"), F.array(e, F.lit("")).alias("constraints"), F.array(e).alias("options"), F.lit("c").alias("chosen"), F.col("props").alias("reason"), F.lit(None).cast("array<string>").alias("evidence"), F.lit(None).cast("string").alias("expected"), F.lit("act").alias("actual"), injection.as_list(F.concat(e, F.lit(" , ,x"))).alias("conditions"), F.when(e == "error", "failed").when(e == "view", "odd").otherwise("succeeded").alias("status"), F.array(e).alias("tags"))
    return injection.record_decision(rows, 7)


_STATUS = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'unknown' ELSE 'succeeded' END"


@query(f"SELECT CAST(event_id AS VARCHAR) AS id, {_STATUS} AS status, event_type || ' c ' || props || ' act ' || event_type || ' x' AS text, 1 AS constraints, 0 AS evidence FROM events")
def decisions(spark, sf_dir):
    return _decisions(spark, sf_dir).select("id", "status", injection.decision_text().alias("text"), F.size("constraints").alias("constraints"), F.size("evidence").alias("evidence"))


@query("SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE event_type = 'error' ORDER BY CAST(event_id AS VARCHAR) LIMIT 20")
def decisions_listed(spark, sf_dir):
    return injection.list_decisions(_decisions(spark, sf_dir), limit=20, status="failed", tag="error").select("id")


@query("SELECT CAST(event_id AS VARCHAR) AS id FROM events ORDER BY CAST(event_id AS VARCHAR) DESC LIMIT 500")
def decisions_kept(spark, sf_dir):
    d = _decisions(spark, sf_dir)
    return injection.append_decisions(d.limit(0), d.select("id", "goal", "constraints", "options", "chosen", "reason", "evidence", "expected", "actual", "conditions", "status", "tags"), 7).select("id")


@query("WITH q AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) SELECT event_id FROM q WHERE before IS NULL OR before <> event_type")
def repeats_dropped(spark, sf_dir):
    return store.drop_repeats(_events(spark, sf_dir).withColumn("query", F.col("event_type")), by=["user_id"], order="event_id").select("event_id")


# ---- facts and evidence ----------------------------------------------------------------


@query(f"WITH {td.ITEMS} SELECT count(*) AS records, count(*) FILTER (level <> 'project') AS todo, count(*) FILTER (level = 'project') AS unchanged, CAST(sum(CASE WHEN level <> 'project' THEN least(length(content), 3000) END) AS BIGINT) AS chars FROM items")
def facts_plan(spark, sf_dir):
    items = td.items(spark, sf_dir)
    scanned = items.where("level IN ('project', 'topic')").select("id", (F.col("updated_at") - (F.col("level") == "topic").cast("int")).alias("updated_at"))
    return facts.plan_build(items, scanned).select("records", "todo", "unchanged", F.col("chars").cast("long").alias("chars"))


@query("SELECT CAST(event_id AS VARCHAR) AS src, event_type AS subject, props AS value, '配置' AS category FROM events")
def facts_flat(spark, sf_dir):
    t = F.struct(F.col("event_type").alias("subject"), F.lit("p").alias("predicate"), F.col("props").alias("value"), F.lit(None).cast("string").alias("category"))
    records = _events(spark, sf_dir).select(F.col("event_id").alias("id"), F.lit("l").alias("level"), F.lit(None).cast("string").alias("project"), F.col("event_id").alias("updated_at"), F.array(t, t).alias("triples"))
    return facts.flatten_facts(records).select("src", "subject", "value", "category")


@query("SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN 0 ELSE 1 END AS facts, CASE WHEN event_type NOT IN ('error', 'click') THEN props END AS value FROM events")
def facts_parsed(spark, sf_dir):
    """Errors have no list, clicks a blank subject; the rest is a list or an object that holds one."""
    e = F.col("event_type")
    one = F.struct(F.when(e == "click", " ").otherwise(e).alias("subject"), F.lit("p").alias("predicate"), F.col("props").alias("value"))
    raw = F.when(e == "error", "no json").when(e == "view", F.to_json(F.struct(F.array(one).alias("triples")))).otherwise(F.to_json(F.array(one)))
    found = _events(spark, sf_dir).select("event_id", facts.parse_facts(raw).alias("f"))
    return found.select("event_id", F.when(F.col("f").isNotNull(), F.size("f")).alias("facts"), F.get("f", 0)["value"].alias("value"))


@query("SELECT event_id, CASE event_type WHEN 'error' THEN '/: not an object' WHEN 'click' THEN '/summary: blank' WHEN 'view' THEN '/outcome: unknown' WHEN 'signup' THEN '/triples/0/object: blank' ELSE '' END AS problems FROM events")
def extraction_checked(spark, sf_dir):
    e = F.col("event_type")
    t = F.struct(F.lit("s").alias("subject"), F.lit("p").alias("predicate"), F.when(e == "signup", "").otherwise("o").alias("object"))
    raw = F.to_json(F.struct(F.when(e == "click", " ").otherwise("said").alias("summary"), F.when(e == "view", "odd").otherwise("completed").alias("outcome"), F.array(t).alias("triples")))
    return _events(spark, sf_dir).select("event_id", F.array_join(facts.validate_extraction(F.when(e == "error", "[1]").otherwise(raw)), ";").alias("problems"))


@query("SELECT CAST(user_id AS VARCHAR) AS src, event_type AS subject, CASE WHEN event_type = 'view' THEN 'old' ELSE 'new' END AS value FROM (SELECT DISTINCT user_id, event_type FROM events) WHERE event_type IN ('view', 'click')")
def facts_merged(spark, sf_dir):
    """Clicks' sources were scanned with success, views' weren't."""
    e = _events(spark, sf_dir).where("event_type IN ('view', 'click')").select(F.concat_ws("/", _user(), "event_type").alias("src"), F.col("event_type").alias("subject")).distinct()
    old, new = (e.withColumn("value", F.lit(v)) for v in ("old", "new"))
    merged = facts.merge_facts(old, new, e.where("subject = 'click'").select(F.col("src").alias("id")))
    return merged.select(F.split("src", "/")[0].alias("src"), "subject", "value")


def _edits(spark, sf_dir):
    items = td.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id")).distinct()
    name = td.session_name(F.col("id").cast("string"))
    return items.select("id", F.concat(F.lit("jot-update-"), name, F.lit("-turn(1); dream-update-"), name, F.lit("-turnRange(1,3); bad")).alias("edit_history"))


def _groups(spark, sf_dir):
    events = td.log(spark, sf_dir).withColumn("session", F.concat(F.lit("session-"), td.session_name(F.col("session")))).withColumn("seq", F.col("seq").cast("double"))
    starts = events.where(sessions.real_user()).withColumns({"type": F.lit("turn/start"), "seq": F.col("seq") - 0.5})
    return sessions.groups(events.unionByName(starts))


@query(f"WITH {td.TURNS}, g AS (SELECT session, t, user_seq FROM ends JOIN log l USING (session) WHERE l.seq = user_seq AND trim(l.text) <> '' AND t <= 2), m AS (SELECT session, min(t) AS t FROM g GROUP BY 1) SELECT CAST(g.session AS BIGINT) AS id, g.user_seq, n.turn_index FROM m JOIN g USING (session, t) LEFT JOIN turns n ON n.session = g.session AND n.user_seq = g.user_seq")
def latest_evidence(spark, sf_dir):
    located = table(evidence.locate(_edits(spark, sf_dir), _groups(spark, sf_dir)), "located")
    turns = td.turns(spark, sf_dir).select(F.concat(F.lit("session-"), td.session_name(F.col("session_id"))).alias("session_id"), F.col("user_seq").cast("double").alias("user_seq"), "turn_index")
    return evidence.latest_evidence(located, turns).select("id", F.col("user_seq").cast("long").alias("user_seq"), "turn_index")


@query(f"WITH {td.TURNS}, g AS (SELECT session, t, user_seq FROM ends JOIN log l USING (session) WHERE l.seq = user_seq AND trim(l.text) <> '' AND t <= 2), m AS (SELECT session, min(t) AS t FROM g GROUP BY 1), e AS (SELECT CAST(g.session AS BIGINT) AS id, g.user_seq FROM m JOIN g USING (session, t)) SELECT d.doc_id AS id, e.user_seq FROM documents d LEFT JOIN e ON e.id = d.doc_id")
def memory_evidence(spark, sf_dir):
    """Items of the numbers of conversations come from these."""
    located = table(evidence.locate(_edits(spark, sf_dir), _groups(spark, sf_dir)), "located")
    turns = spark.createDataFrame([], "session_id string, user_seq double, turn_index int")
    found = memory.with_evidence(td.items(spark, sf_dir).select("id"), located, turns)
    return found.select("id", F.col("evidence.user_seq").cast("long").alias("user_seq"))


@query("SELECT DISTINCT 'session-' || lpad(CAST(conv_id AS VARCHAR), 4, '0') AS session FROM conversations WHERE conv_id < 40")
def wanted_sessions(spark, sf_dir):
    logs = _groups(spark, sf_dir).select("session").distinct()
    wanted = evidence.wanted_sessions(_edits(spark, sf_dir).where("id < 40"), logs)
    return wanted.select(F.concat(F.lit("session-"), F.substring("session", -4, 4)).alias("session"))


@query("SELECT DISTINCT 'session-' || lpad(CAST(conv_id AS VARCHAR), 4, '0') AS session, CASE WHEN conv_id < 10 THEN 'read' ELSE 'cached' END AS source FROM conversations")
def refreshed_alignment(spark, sf_dir):
    """The files of the first ten sessions have changed since. A name has four characters, as in the SQL, so longer numbers that begin alike are one session's file."""
    found = td.read(spark, sf_dir, "conversations").select(F.concat(F.lit("session-"), F.lpad(F.col("conv_id").cast("string"), 4, "0")).alias("session"), F.col("conv_id").alias("n")).groupBy("session").agg(F.min("n").alias("n"))
    files = found.select("session", F.concat(F.lit("/"), "session").alias("path"), F.lit(5).alias("modified"), F.lit(9).alias("size"), "n")
    groups = lambda kind: lambda f: f.select("session", F.lit(1).alias("abs"), F.lit(0).alias("user_seq"), F.lit(kind).alias("quote"))
    cached = files.withColumn("modified", F.when(F.col("n") < 10, 4).otherwise(5)).select("path", "modified", "size", "session", F.lit(1).alias("abs"), F.lit(0).alias("user_seq"), F.lit("cached").alias("quote"))
    return evidence.refreshed_alignment(files.drop("n"), cached, groups("read")).select("session", F.col("quote").alias("source"))


# ---- text functions and vectors -------------------------------------------------------


_WORD_SET = f"SELECT DISTINCT unnest(string_split(regexp_replace(text, '[{_WS}]+', ' ', 'g'), ' ')) AS w FROM conversations"


@query(f"WITH w AS ({_WORD_SET}), i AS (SELECT w, {base._informative_sql('w')} AS n FROM w) SELECT w, n >= 4 OR (n >= 2 AND ({' OR '.join(f"contains(lower(w), '{h}')" for h in tx.HISTORY_HINTS)})) AS go FROM i")
def recall_gate(spark, sf_dir):
    words = td.read(spark, sf_dir, "conversations").select(F.explode(F.split(F.regexp_replace("text", f"[{tx.SPACE}]+", " "), " ")).alias("w")).distinct()
    return words.select("w", tx.should_recall("w").alias("go"))


_MARKED = "'[表情:笑](https://a.b/c) ' || text || ' ⟨image⟩ [表情:哭]'"


@query(f"SELECT conv_id, turn, sha256(trim(regexp_replace(regexp_replace(regexp_replace({_MARKED}, '\\[表情:[^\\]]*\\](?:\\(https?://[^{_WS})]*\\))?', ' ', 'g'), '⟨[^⟩]{{0,24}}⟩', ' ', 'g'), '[{_WS}]+', ' ', 'g'))) AS said FROM conversations")
def markers_stripped(spark, sf_dir):
    text = F.concat(F.lit("[表情:笑](https://a.b/c) "), "text", F.lit(" ⟨image⟩ [表情:哭]"))
    return td.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(tx.strip_non_content(text), 256).alias("said"))


@query("SELECT event_id, '0mabcdef' || event_id || '-' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS id FROM events")
def memory_ids(spark, sf_dir):
    own = F.concat(F.lit("0mabcdef"), "event_id", F.lit("-"), F.lpad(F.col("event_id").cast("string"), 8, "0"))
    text = F.concat(F.lit("see "), own, F.lit(", "), own, F.lit(" and 0mabc"))
    return _events(spark, sf_dir).select("event_id", F.array_join(tx.memory_ids(text), ",").alias("id"))


@query(f"SELECT doc_id, sha256(substr({_TRIMMED}, 1, 500) || chr(10) || '关键词: ' || source) AS embedded FROM documents")
def embed_texts(spark, sf_dir):
    return td.read(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.embed_text(F.col("text"), F.col("source")), 256).alias("embedded"))


@query(f"SELECT conv_id, turn, sha256(lower(trim(regexp_replace(text, '[{_WS}]+', ' ', 'g')))) AS term, 'nt-' || substr(sha256(lower(trim(regexp_replace(text, '[{_WS}]+', ' ', 'g')))), 1, 32) AS id FROM conversations")
def normalized_terms(spark, sf_dir):
    term = tx.normalize_term(F.col("text"))
    return td.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(term, 256).alias("term"), store.term_id(term).alias("id"))


@query(f"SELECT doc_id, {_line_sql('text', 120)} AS text FROM documents")
def clipped(spark, sf_dir):
    return td.read(spark, sf_dir, "documents").select("doc_id", tx.clip(F.col("text"), 120).alias("text"))


@query("SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%m-%d %H:%M') AS at FROM events")
def short_times(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", tx.short_time(td.millis("ts")).alias("at"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN NULL ELSE CAST(400 + event_id % 100 AS INTEGER) END AS status FROM events")
def http_statuses(spark, sf_dir):
    code = (400 + F.col("event_id") % 100).cast("string")
    e = F.col("event_type")
    text = F.when(e == "view", F.concat(F.lit("code "), code)).when(e == "click", F.concat(F.lit("OpenAI API "), code, F.lit(" failed"))).otherwise(F.concat(F.lit('{"statusCode": '), code, F.lit("}")))
    return _events(spark, sf_dir).select("event_id", tx.http_status(text).alias("status"))


@query(f"SELECT conv_id, turn, sha256({_TRIMMED}) AS inner_sha FROM conversations")
def code_fences(spark, sf_dir):
    text = F.when(F.col("role") == "user", F.concat(F.lit("```json\n"), F.regexp_replace("text", f"^[{tx.SPACE}]+|[{tx.SPACE}]+$", ""), F.lit("\n```"))).otherwise(F.col("text"))
    return td.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(tx.strip_code_fence(text), 256).alias("inner_sha"))


@query(f"SELECT conv_id, turn, sha256({base._redact_sql('text')}) AS first, sha256({base._redact_sql("text || ' token=abcdefghijklmnop0123'")}) AS second FROM conversations")
def redacted_values(spark, sf_dir):
    c = td.read(spark, sf_dir, "conversations").withColumn("v", F.struct(F.array("text").alias("xs"), F.create_map(F.lit("k"), F.concat("text", F.lit(" token=abcdefghijklmnop0123"))).alias("m")))
    held = c.select("conv_id", "turn", tx.redact_value(F.col("v"), c.schema["v"].dataType).alias("v"))
    return held.select("conv_id", "turn", F.sha2(F.col("v.xs")[0], 256).alias("first"), F.sha2(F.col("v.m")["k"], 256).alias("second"))


@query(f"SELECT conv_id, turn, substr({base._redact_sql('text')}, 1, 200) AS query, CAST(length(text) AS INTEGER) AS query_chars, role = 'assistant' AS would_inject, FALSE AS injected FROM conversations")
def shadow_rows(spark, sf_dir):
    c = td.read(spark, sf_dir, "conversations")
    rows = c.select(F.col("conv_id").alias("session"), "turn", F.lit(0).alias("step"), F.col("text").alias("query"), F.lit(1).alias("results"), F.lit(1).alias("included"), F.lit(0).alias("skipped"), F.when(F.col("role") == "assistant", F.col("text")).alias("text"))
    return tables.shadow_rows(rows).select(F.col("session").alias("conv_id"), "turn", "query", "query_chars", "would_inject", "injected")


@query("SELECT event_type, CASE WHEN event_type = 'view' THEN '0.8' ELSE '0.9' END AS ratio, '0.16' AS retain, event_type = 'view' AS untouched FROM (SELECT DISTINCT event_type FROM events)")
def settings_with_defaults(spark, sf_dir):
    given = F.when(F.col("event_type") != "view", F.create_map(F.lit("ratio"), F.lit("0.9")))
    held = _events(spark, sf_dir).select("event_type").distinct().withColumns({"v": tables.with_defaults(given, {"ratio": "0.8", "retain": "0.16"}), "untouched": tables.untouched(given)})
    return held.select("event_type", F.col("v")["ratio"].alias("ratio"), F.col("v")["retain"].alias("retain"), "untouched")


@query(
    f"""WITH {base._PARTS}, u AS (SELECT doc_id, unnest(parts) AS unit FROM p)
SELECT p.doc_id, CAST(len(parts) AS INTEGER) AS sentences, CAST(coalesce(h.n, 0) AS INTEGER) AS hits FROM p LEFT JOIN (SELECT doc_id, count(*) AS n FROM u WHERE regexp_matches(unit, '{repetition.SECOND_THOUGHTS}') OR regexp_matches(unit, '{repetition.SECOND_THOUGHTS_EN.replace(chr(39), chr(39) * 2)}') GROUP BY 1) h USING (doc_id)"""
)
def second_thoughts(spark, sf_dir):
    found = repetition.reflection(td.read(spark, sf_dir, "documents"), "doc_id")
    return found.select(F.col("id").alias("doc_id"), "sentences", "hits")


@query(f"SELECT doc_id, coalesce(parts >= 25 AND short_share >= 0.35 AND top_share >= 0.5, FALSE) AS hit FROM ({base._SQL['rotation_detect']})")
def rotation_hits(spark, sf_dir):
    return repetition.rotation(td.read(spark, sf_dir, "documents"), "doc_id").select(F.col("id").alias("doc_id"), "hit")


@query("WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT a.id, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)) + 1e-9), 6) AS cosine FROM v a JOIN v b ON b.id = a.id + 1")
def cosine_of_neighbours(spark, sf_dir):
    v = td.vectors(spark, sf_dir)
    held = v.select("id", vec.blob_to_vector(vec.vector_to_blob("vector")).alias("x")).join(v.select((F.col("id") - 1).alias("id"), F.col("vector").alias("y")), "id")
    return held.select("id", F.round(vec.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


@query(base._rank_sql(10, "SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS t FROM v") + " ORDER BY r10.rank DESC, id LIMIT 20")
def top_ranks(spark, sf_dir):
    nodes, edges = base._graph(spark, sf_dir)
    return graph.top_ranks(graph.pagerank(nodes, edges, iterations=10)).select("id", F.round("rank", 6).alias("rank"))


@query(f"WITH {base._PAIRS}, arcs AS (SELECT a AS id FROM edges UNION SELECT b FROM edges) SELECT (SELECT count(*) FROM v) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM v WHERE id NOT IN (SELECT id FROM arcs)) AS isolated")
def built_graph(spark, sf_dir):
    vs = td.vectors(spark, sf_dir)
    return graph.build_graph(vs.select("id"), vs, shared_path(spark, "graph"), threshold=0.3, iterations=5).select("nodes", "edges", "isolated")


@query(f"WITH {td.TURNS}, {td.ITEMS} SELECT (SELECT count(*) FROM turns) AS turns, (SELECT count(DISTINCT session) FROM turns) AS sessions, (SELECT count(*) FROM items) AS items, (SELECT count(*) FROM embeddings) AS vectors, 2.5::DOUBLE AS stale_days")
def snapshot(spark, sf_dir):
    return store.snapshot({"items": td.items(spark, sf_dir), "vectors": td.vectors(spark, sf_dir)}, td.turns(spark, sf_dir), td.NOW, td.NOW - 5 * td.DAY // 2)

"""From a model's stream to stored turns: folding deltas, calling a service, capturing and recovering turns.

Services are functions that are passed in; a batch of rows is what they are called with, so no state is
kept between runs, and a batch that is run again gives the same tables.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import store

TOOL_NAME = "record_turn"


def collect_stream(chunks: DataFrame) -> DataFrame:
    """(stream, text, reasoning, tool_calls, usage, finish) of chunks (stream, pos, type, text, id, name, arguments, usage, reason).

    Deltas are joined in order of ``pos``. A block that ends with a tool call says the call whole, and what comes after is
    added to that; the last usage and reason that are there count. Calls stand in the order of their first chunk.
    """
    c, kind = F.col, F.col("type")
    joined = lambda wanted, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(wanted, F.struct("pos", tx.text(value).alias("v"))))), lambda s: s["v"]), "")
    last = lambda value, wanted: F.max_by(value, F.when(wanted & value.isNotNull(), c("pos")))
    whole = chunks.groupBy("stream").agg(
        joined(kind == "text-delta", "text").alias("text"), joined(kind == "reasoning-delta", "text").alias("reasoning"),
        last(c("usage"), kind == "usage").alias("usage"), last(c("reason"), kind == "finish").alias("finish"),
    )
    part = chunks.where(kind.isin("tool-call-delta", "tool-call-end") & c("id").isNotNull())
    ends = part.where(kind == "tool-call-end").groupBy("stream", "id").agg(F.max("pos").alias("end"))
    told = part.join(ends, ["stream", "id"], "left").withColumn("live", F.coalesce(c("pos") >= c("end"), F.lit(True)))
    # The end of a block replaces its name even by an empty one; a delta replaces it only by a real one.
    named = c("live") & ((kind == "tool-call-end") | (tx.text("name") != ""))
    calls = told.groupBy("stream", "id").agg(F.min("pos").alias("first"), F.coalesce(F.max_by(tx.text("name"), F.when(named, c("pos"))), F.lit("")).alias("name"), joined(c("live"), "arguments").alias("arguments"))
    listed = calls.groupBy("stream").agg(F.array_sort(F.collect_list(F.struct("first", "id", "name", "arguments"))).alias("cs"))
    slim = F.transform("cs", lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"), x["arguments"].alias("arguments")))
    none = F.array().cast("array<struct<id:string,name:string,arguments:string>>")
    return whole.join(listed, "stream", "left").select("stream", "text", "reasoning", F.coalesce(slim, none).alias("tool_calls"), "usage", "finish")


def extraction_text(calls: Column, text: Column, tool: str = TOOL_NAME) -> Column:
    """struct(raw, via) of what a model's answer has to be parsed from: the named tool's arguments, or the first call's, else its text; null if there is neither."""
    own = F.filter(calls, lambda c: c["name"] == tool)
    chosen = F.get(F.when(F.size(own) > 0, own).otherwise(calls), 0)["arguments"]
    said = tx.trim(tx.text(text))
    by_tool = F.struct(chosen.alias("raw"), F.lit("tool").alias("via"))
    return F.when(tx.trim(tx.text(chosen)) != "", by_tool).when(said != "", F.struct(tx.strip_code_fence(said).alias("raw"), F.lit("content").alias("via")))


def routed(sessions: DataFrame, provider: str | None = None, model: str | None = None, effort: str | None = None) -> DataFrame:
    """Sessions (session, provider, model, effort, ...) with what is configured in place of their own route; those without a provider or model go."""
    pick = lambda own, c: F.coalesce(F.nullif(F.lit(own), F.lit("")), F.nullif(F.col(c), F.lit("")))
    out = sessions.withColumns({"provider": pick(provider, "provider"), "model": pick(model, "model"), "effort": pick(effort, "effort")})
    return out.where("provider IS NOT NULL AND model IS NOT NULL")


class Rejected(Exception):
    """A service's refusal of a parameter that can be left out; ``parameter`` names it."""

    def __init__(self, parameter: str) -> None:
        super().__init__(parameter)
        self.parameter = parameter


def _attempt(service: Callable, request: str, options: dict, tries: int, pause: float) -> tuple[str | None, str | None]:
    error = None
    for k in range(tries):
        if k:
            time.sleep(pause)
        given = dict(options)
        for _ in range(len(options) + 1):
            try:
                found = service(request, **given)
            except Rejected as refusal:
                error = f"refused: {refusal.parameter}"
                if given.pop(refusal.parameter, None) is None:
                    break
                continue
            except Exception as failure:  # a service's failures are results here
                error = str(failure)[:500]
                break
            if found:
                return found, None
            error = "empty"
            break
    return None, error


def call_service(requests: DataFrame, service: Callable[..., str | None], *, options: dict | None = None, at_once: int = 4, tries: int = 2, pause: float = 0.8, column: str = "request") -> DataFrame:
    """``requests`` with ``answer`` and ``error``: each is tried ``tries`` times, without a parameter that was refused.

    ``at_once`` tasks call at a time, whatever the size of the table; they take their rows in order.
    """
    schema = requests.select("*", F.lit(None).cast("string").alias("answer"), F.lit(None).cast("string").alias("error")).schema
    own = dict(options or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [_attempt(service, r, own, tries, pause) for r in batch.column(column).to_pylist()]
            columns = [*batch.columns, pa.array([a for a, _ in told], pa.string()), pa.array([e for _, e in told], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "answer", "error"])

    return requests.repartition(max(1, at_once)).mapInArrow(run, schema)


def capture(tables: dict[str, DataFrame], results: DataFrame, now: int) -> dict[str, DataFrame]:
    """``tables`` (turns, terms, triples, queue, watermarks) after a batch of extractions, each of which counts whole or not at all.

    ``results`` is (session_id, user_seq, answer_seq, user_text, answer_text, ord, summary, outcome, triples, error), texts as they were said;
    ``triples`` is an array of (subject, predicate, object). A turn that fails, or whose parts aren't valid, only marks its queue entry.
    Secrets are redacted before anything is stored, and running a batch again changes nothing but times.
    """
    key = ["session_id", "user_seq", "answer_seq"]
    told = results.where(F.col("error").isNull())
    blank = lambda t: F.exists(F.array(t["subject"], t["predicate"], t["object"]), lambda x: tx.trim(tx.text(x)) == "")
    whole = F.coalesce(~F.exists("triples", blank), F.lit(True))
    accepted, rejected = store.checked_turns(told.where(whole).withColumn("turn_index", F.lit(None).cast("int")))
    turns = store.upsert_turns(tables["turns"], accepted.select(*key, "turn_index", "summary", "outcome", "user_text", "answer_text", "ord"), now)
    each = accepted.select(store.turn_id(F.col("session_id"), F.col("user_seq")).alias("turn_id"), "session_id", F.posexplode("triples").alias("source_order", "t")).select("turn_id", "session_id", "t.subject", "t.predicate", "t.object", "source_order")
    terms = store.upsert_terms(tables["terms"], each.select(F.explode(F.array("subject", "object")).alias("display_text")))
    triples = store.replace_triples(tables["triples"], each, now)

    failed = results.where(F.col("error").isNotNull()).select(*key, F.col("error").alias("e")).unionByName(told.where(~whole).select(*key, F.lit("blank triple").alias("e"))).unionByName(rejected.select(*key, F.col("reason").alias("e")))
    marks = accepted.select(*key, F.lit(None).cast("string").alias("e")).unionByName(failed).withColumn("marked", F.lit(True))
    queue = tables["queue"].join(marks, key, "left")
    more = F.col("attempts") + 1
    lost = F.col("marked") & F.col("e").isNotNull()
    won = F.col("marked") & F.col("e").isNull()
    queue = queue.select(
        "session_id", "turn_index", "user_seq", "answer_seq",
        F.when(won, "succeeded").when(lost & (more >= store.MAX_ATTEMPTS), "quarantined").when(lost, "pending").otherwise(F.col("state")).alias("state"),
        F.when(lost, more).otherwise(F.col("attempts")).cast("int").alias("attempts"), F.when(won, None).when(lost, F.substring("e", 1, 500)).otherwise(F.col("last_error")).alias("last_error"),
        F.when(won, None).when(lost & (more < store.MAX_ATTEMPTS), now + store.backoff(more)).when(lost, None).otherwise(F.col("next_retry_at")).alias("next_retry_at"),
        "provider", "model", F.when(F.col("marked"), F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    numbers = turns.join(accepted.select("session_id", "user_seq"), ["session_id", "user_seq"], "left_semi").groupBy("session_id").agg(F.max("turn_index").cast("long").alias("completed_turn"))
    marks = tables["watermarks"].select("session_id", F.col("completed_turn").cast("long").alias("completed_turn")).unionByName(numbers)
    return {"turns": turns, "terms": terms, "triples": triples, "queue": queue, "watermarks": store.watermarks(marks)}


def recover(queue: DataFrame, logged: DataFrame, turns: DataFrame, now: int, *, limit: int = 50) -> DataFrame:
    """Due queue entries with ``action``: drop (the log has no such turn), done (stored already), skip (no route), or extract, with the turn's texts.

    ``logged`` are completed turns of the logs (session_id, user_seq, answer_seq, user_text, answer_text); a stored turn is known by session and user_seq.
    """
    due = store.due(queue, now, limit)
    said = logged.select("session_id", "user_seq", F.col("answer_seq").alias("logged_answer"), "user_text", "answer_text")
    held = turns.select("session_id", "user_seq", F.lit(True).alias("stored")).distinct()
    found = due.join(said, ["session_id", "user_seq"], "left").join(held, ["session_id", "user_seq"], "left")
    routed_ = (tx.text("provider") != "") & (tx.text("model") != "")
    action = F.when(F.col("logged_answer").isNull(), "drop").when(F.col("stored"), "done").when(~routed_, "skip").otherwise("extract")
    return found.select("session_id", "user_seq", F.coalesce("logged_answer", "answer_seq").alias("answer_seq"), action.alias("action"), F.when(action == "extract", F.col("user_text")).alias("user_text"), F.when(action == "extract", F.col("answer_text")).alias("answer_text"), "provider", "model")


def pick_turns(turns: DataFrame, wanted: DataFrame) -> DataFrame:
    """The turns that ``wanted`` (session_id, user_seq) names."""
    return turns.join(wanted.select("session_id", "user_seq"), ["session_id", "user_seq"], "left_semi")


def backfill(completed: DataFrame, sessions: DataFrame, stored: DataFrame, now: int, *, days: float = 7.0) -> DataFrame:
    """Completed turns of sessions (session, modified) of the last days that aren't stored yet."""
    recent = sessions.where(now - F.col("modified") <= days * 86_400_000).select(F.col("session").alias("session_id"))
    return completed.join(recent, "session_id", "left_semi").join(stored.select("session_id", "user_seq"), ["session_id", "user_seq"], "left_anti")


def should_sweep(last_ms: Column, now: int, guard_until: Column, least_ms: int = 300_000) -> Column:
    """Whether a recovery is due: five minutes after the last, or when the guard's pause ends if that is later."""
    return F.coalesce(F.lit(now) >= F.greatest(last_ms + least_ms, F.coalesce(guard_until, F.lit(0))), F.lit(True))


def last_turn(events: DataFrame) -> DataFrame:
    """(session, user_seq, answer_seq): each session's last visible answer and the real user's message before it, null and null where a user's message comes after all answers."""
    from lodestone.operators import sessions as ss

    ends = events.groupBy("session").agg(F.max(F.when(ss.visible_answer(), F.col("seq"))).alias("answer_seq"), F.max(F.when(ss.real_user(), F.col("seq"))).alias("asked"))
    late = F.coalesce(F.col("asked") > F.col("answer_seq"), F.lit(False))
    before = events.where(ss.real_user()).select("session", "seq").join(ends, "session").where(F.col("seq") < F.col("answer_seq")).groupBy("session").agg(F.max("seq").alias("user_seq"))
    out = ends.join(before, "session", "left")
    return out.select("session", F.when(~late, F.col("user_seq")).alias("user_seq"), F.when(~late, F.col("answer_seq")).alias("answer_seq"))


def last_query(messages: DataFrame) -> DataFrame:
    """(session, query): the words of the last message (session, pos, kind, blocks) that a user really wrote, plugins' blocks left out."""
    from lodestone.operators import sessions as ss

    said = tx.trim(ss.text_of(ss.real_blocks(F.col("blocks"))))
    own = messages.where(F.coalesce(F.col("kind") == "user", F.lit(False))).withColumn("said", said).where("said <> ''")
    return own.groupBy("session").agg(F.max_by("said", "pos").alias("query"))


def messages_text(messages: Column) -> Column:
    """All that messages, an array of structs (text, blocks), say: their plain text, or their text blocks, by lines."""
    said = lambda m: F.when(m["text"].isNotNull(), F.array(m["text"])).otherwise(F.transform(F.filter(F.coalesce(m["blocks"], F.array().cast("array<struct<type:string,text:string,id:string,name:string,arguments:string>>")), lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]))
    return F.array_join(F.flatten(F.transform(messages, said)), "\n")


def steps(events: DataFrame) -> DataFrame:
    """(session, seq, text, calls): what an assistant's step says, and its calls, the i-th with the i-th result that follows at once: (name, args, is_error, text)."""
    from pyspark.sql import Window

    w = Window.partitionBy("session").orderBy("seq")
    result = F.col("type") == "tool/result"
    run = F.sum(F.when(result, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    body = F.array_join(F.transform(F.coalesce("blocks", F.array().cast(events.schema["blocks"].dataType)), lambda b: tx.text(b["text"])), "\n")
    spans = events.withColumn("__run", run).groupBy("session", "__run").agg(
        F.max(F.when(~result, F.struct("seq", "type", "blocks"))).alias("head"),
        F.array_sort(F.collect_list(F.when(result, F.struct("seq", F.coalesce("is_error", F.lit(False)).alias("is_error"), body.alias("text"))))).alias("results"),
    )
    blocks = F.coalesce("head.blocks", F.array().cast(events.schema["blocks"].dataType))
    calls = F.filter(blocks, lambda b: b["type"] == "tool-call")
    paired = F.transform(calls, lambda c, i: F.struct(tx.text(c["name"]).alias("name"), tx.text(c["arguments"]).alias("args"), F.get("results", i)["is_error"].alias("is_error"), F.get("results", i)["text"].alias("text")))
    said = F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]), "\n")
    return spans.where("head.type = 'assistant/message'").select("session", F.col("head.seq").alias("seq"), said.alias("text"), paired.alias("calls"))


def guard_sweep(events: DataFrame, seen: DataFrame, *, least: int = 400, fold_tool_steps: bool = True) -> DataFrame:
    """(session, seq, action, unit, count, share, span): degenerate steps that weren't looked at yet.

    ``fold`` takes a step and its results at once, ``wait`` is for one whose results aren't all there, ``skip`` for one with
    calls where these aren't to be folded. All but those that wait are seen from now on; ``seen`` is (session, seq).
    """
    from lodestone.operators import repetition
    from lodestone.operators import sessions as ss

    hits = repetition.degenerate_blocks(events, least=least, with_rotation=True)
    first = hits.groupBy("session", "seq").agg(F.min_by(F.struct("unit", "count", "share"), "block").alias("h")).join(seen, ["session", "seq"], "left_anti")
    pairs = ss.paired_spans(events).select("session", "seq", F.size("calls").alias("n"), "complete")
    held = first.join(pairs, ["session", "seq"], "left")
    has_calls = F.coalesce(F.col("n") > 0, F.lit(False))
    action = F.when(has_calls & F.lit(not fold_tool_steps), "skip").when(has_calls & ~F.coalesce("complete", F.lit(False)), "wait").otherwise("fold")
    return held.select("session", "seq", action.alias("action"), "h.unit", "h.count", "h.share", (1 + F.coalesce("n", F.lit(0))).cast("int").alias("span"))


def continue_budget(hits: DataFrame, *, most: int = 3, cooldown_ms: int = 60_000) -> DataFrame:
    """Hits (session, at) with ``continued``: up to ``most`` a session go on by themselves, each at least ``cooldown_ms`` after the last that did."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n, last = None, 0, None
        for batch in batches:
            out = []
            for session, at in zip(batch.column("session").to_pylist(), batch.column("at").to_pylist()):
                if session != own:
                    own, n, last = session, 0, None
                go = n < most and (last is None or at - last >= cooldown_ms)
                n, last = (n + 1, at) if go else (n, last)
                out.append(go)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], names=[*batch.schema.names, "continued"])

    return hits.repartition("session").sortWithinPartitions("session", "at").mapInArrow(run, hits.withColumn("continued", F.lit(True)).schema)

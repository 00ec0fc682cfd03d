"""What is put before a model: greedy packing, relays, rules that fire on tool calls, ledgers, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.durable import table
from lodestone.functions import text as tx
from lodestone.operators import lexical, store
from lodestone.operators.asof import newest_before
from lodestone.operators.ranking import small

MAX_TURNS, MAX_CHARS, USER_CHARS, ANSWER_CHARS = 4, 2400, 420, 760
ARG_CHARS, ITEM_CHARS, COOLDOWN_MS = 4000, 240, 900_000


def pack_greedy(hits: DataFrame, *, by: str, order: str, size: Column, most: int, used: int = 0, reserve: int = 0, most_items: int | None = None, stop: bool = False) -> DataFrame:
    """``hits`` with ``included`` and ``number``: taken in order while they fit ``most``.

    One that doesn't fit is passed over and later ones may still fit; with ``stop`` nothing follows it.
    A list is folded within its row, so the running state never leaves it.
    """
    rows = hits.withColumn("__size", size.cast("int"))
    lists = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, "__size"))).alias("xs"))
    start = F.struct(F.lit(used).alias("used"), F.lit(0).alias("n"), F.lit(True).alias("open"), F.array().cast("array<int>").alias("numbers"))
    limit = most_items if most_items is not None else 1 << 30

    def step(s: Column, x: Column) -> Column:
        fits = s["open"] & (s["n"] < limit) & (s["used"] + x["__size"] + reserve <= most)
        return F.struct(
            F.when(fits, s["used"] + x["__size"] + 1).otherwise(s["used"]).alias("used"),
            F.when(fits, s["n"] + 1).otherwise(s["n"]).alias("n"),
            (s["open"] & (fits | F.lit(not stop))).alias("open"),
            F.concat(s["numbers"], F.array(F.when(fits, s["n"] + 1))).alias("numbers"),
        )

    numbers = F.aggregate("xs", start, step)["numbers"]
    flat = lists.select(by, F.explode(F.arrays_zip("xs", numbers.alias("numbers"))).alias("z")).select(by, F.col(f"z.xs.{order}").alias(order), F.col("z.numbers").alias("number"))
    return rows.drop("__size").join(flat, [by, order]).withColumn("included", F.col("number").isNotNull())


def recall_block(number: Column) -> Column:
    """A recalled turn as text; ``number`` is its place."""
    # The labels, whose lengths decide what fits.
    head = F.concat(F.lit("["), number.cast("string"), F.lit("] 轮 "), F.coalesce(F.col("turn_index").cast("string"), F.lit("?")), F.lit("（相关度 "), F.coalesce(F.col("score").cast("string"), F.lit("-")), F.lit("）"))
    return F.concat_ws("\n", head, F.concat(F.lit("    问："), tx.clip(F.col("user_text"), USER_CHARS)), F.concat(F.lit("    答："), tx.clip(F.col("answer_text"), ANSWER_CHARS)))


def assemble(hits: DataFrame, *, most_chars: int = MAX_CHARS, most_turns: int = MAX_TURNS, head_chars: int = 160, tail_chars: int = 60) -> DataFrame:
    """Hits (query_id, position, turn_index, score, user_text, answer_text) with what of them is shown and its text."""
    useful = hits.where("user_text <> '' OR answer_text <> ''")
    packed = pack_greedy(useful, by="query_id", order="position", size=F.length(recall_block(F.col("position") + 1)), most=most_chars, used=head_chars, reserve=tail_chars + 1, most_items=most_turns)
    return packed.withColumn("block", F.when(F.col("included"), recall_block(F.col("number"))))


def insert_before_last_user(messages: Column, message: Column) -> Column:
    """An array of messages with one more before the last that a user wrote; as it is if there is none."""
    at = F.size(messages) - F.array_position(F.reverse(F.transform(messages, lambda m: F.coalesce(m["kind"] == "user", F.lit(False)))), F.lit(True)).cast("int") + 1
    found = F.exists(messages, lambda m: F.coalesce(m["kind"] == "user", F.lit(False)))
    return F.when(found, F.concat(F.slice(messages, 1, at - 1), F.array(message), F.slice(messages, at, F.size(messages)))).otherwise(messages)


def relay_lines(said: DataFrame, *, most_chars: int = 2000, head_chars: int = 160, tail_chars: int = 60) -> DataFrame:
    """Dialogue lines (session, seq, role, text) kept from the newest back until one no longer fits."""
    # The names of the two sides, whose lengths decide what fits.
    line = F.concat(F.lit("  "), F.when(F.col("role") == "user", "用户").otherwise("助手"), F.lit("："), tx.clip(F.col("text"), 300))
    back = Window.partitionBy("session").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    rows = said.withColumn("line", line)
    rows = rows.withColumn("__used", F.sum(F.length("line") + 1).over(back))
    return rows.where(F.col("__used") - 1 + head_chars + tail_chars + 40 <= most_chars).drop("__used")


def main_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions (session, origin, delegation_depth) of users, not of agents that another session has started."""
    return sessions.where(F.col("session").startswith("session-") & (tx.text("origin") != "subagent") & (F.coalesce("delegation_depth", F.lit(0)) == 0))


def previous_session(sessions: DataFrame, current: str, now: int, most_age_ms: int = 86_400_000) -> DataFrame:
    """The newest other main session (session, modified) that isn't too old."""
    own = sessions.where((F.col("session") != current) & F.col("session").startswith("session-") & (now - F.col("modified") <= most_age_ms))
    return own.orderBy(F.desc("modified"), "session").limit(1)


def serialize_arguments(arguments: Column) -> Column:
    """The telling arguments of a call by lines, and all of them as JSON; ``arguments`` is JSON text."""
    keys = ("command", "file_path", "path", "filePath", "pattern", "query", "name")
    picked = [F.nullif(F.get_json_object(arguments, f"$.{k}"), F.lit("")) for k in keys]
    return F.substring(F.concat(F.concat_ws("\n", *picked), F.lit("\n"), tx.text(arguments)), 1, ARG_CHARS)


def match_rules(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """The first rule (ord, rule_id, tools, pattern) that each call (call_id, name, arguments) meets."""
    held = calls.withColumn("__hay", serialize_arguments(F.col("arguments")))
    tools = (F.size(F.coalesce("tools", F.array().cast("array<string>"))) == 0) | F.array_contains("tools", F.col("name"))
    pattern = F.col("pattern").isNull() | F.expr("__hay RLIKE concat('(?i)', pattern)")
    met = held.join(small(rules), F.coalesce(tools, F.lit(False)) & pattern)
    first = F.row_number().over(Window.partitionBy("call_id").orderBy("ord"))
    return met.withColumn("__nth", first).where("__nth = 1").drop("__nth", "__hay")


def eligible_items(items: DataFrame, *, projects: list[str] | None = None, levels: list[str] | None = None) -> DataFrame:
    """Items that aren't archived, of any of the projects (a comma-separated column) and levels asked for."""
    own = items.where(F.coalesce(F.col("status") != "archived", F.lit(True)))
    if projects:
        held = F.transform(F.split(tx.text("project"), ","), tx.trim)
        own = own.where(F.arrays_overlap(held, F.array(*map(F.lit, projects))))
    return own.where(F.col("level").isin(levels)) if levels else own


def select_memories(items: DataFrame, query: str, *, projects: list[str] | None = None, levels: list[str] | None = None, k: int = 3) -> DataFrame:
    """The k best items of those a rule allows, by BM25 within them."""
    own = eligible_items(items, projects=projects, levels=levels).withColumn("__text", F.concat_ws(" ", tx.text("content"), tx.text("keywords")))
    terms = lexical.query_terms(items.sparkSession.createDataFrame([(0, query)], "query_id int, query string"))
    scored = lexical.bm25(lexical.postings(own, "id", "__text", terms=terms), lexical.corpus_stats(own, "__text"), terms)
    return lexical.top_k(scored, k).select(F.col("doc").alias("id"), "score", "rank").join(own.drop("__text"), "id")


def injected_text(hits: DataFrame, head: str, tail: str, *, most_chars: int = 1200, item_chars: int = ITEM_CHARS) -> DataFrame:
    """(call_id, ids, text) of hits (call_id, rank, id, level, project, content): numbered lines that fit, one too long passed over."""
    line = F.concat(F.lit(". ["), F.coalesce(F.nullif("level", F.lit("")), F.lit("-")), F.when(tx.text("project") != "", F.concat(F.lit("/"), "project")).otherwise(""), F.lit("] "), tx.clip(F.col("content"), item_chars))
    number = (F.col("rank") + 1).cast("string")
    rows = hits.withColumn("__line", F.concat(number, line))
    packed = pack_greedy(rows, by="call_id", order="rank", size=F.length("__line"), most=most_chars, used=len(head)).where("included")
    lines = packed.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "__line"))).alias("xs"))
    text = F.concat_ws("\n", F.lit(head), F.array_join(F.transform("xs", lambda x: x["__line"]), "\n"), F.lit(tail))
    return lines.select("call_id", F.transform("xs", lambda x: x["id"]).alias("ids"), text.alias("text"))


def fire_rules(calls: DataFrame, rules: list[dict], items: DataFrame, ledger: DataFrame, now: int, *, head: str = "Memories that bear on this action:", tail: str = "They were found by a rule; pass over what doesn't matter.") -> DataFrame:
    """(call_id, rule_id, session, ids, text): what the rules put in after tool calls (call_id, session, workspace, at, name, arguments).

    A rule is a dict of rule_id, tools, pattern, query, projects, levels, k, cooldown_ms, most_chars. A call meets the first rule that fits; of the calls of
    a rule and workspace only those fire that come a cooldown after the last; memories that the session has seen lately are left out.
    """
    spark = calls.sparkSession
    schema = "ord int, rule_id string, tools array<string>, pattern string, cooldown_ms long"
    table_ = spark.createDataFrame([(k, r["rule_id"], r.get("tools"), r.get("pattern"), int(r.get("cooldown_ms", COOLDOWN_MS))) for k, r in enumerate(rules)], schema)
    met = match_rules(calls, table_).select("call_id", "session", "workspace", "at", "rule_id")
    out = None
    for r in rules:  # rules are configuration, few whatever the data
        own = met.where(F.col("rule_id") == r["rule_id"])
        fired = store.throttle(own, int(r.get("cooldown_ms", COOLDOWN_MS)), by=["workspace"], tie="call_id")
        best = select_memories(items, r["query"], projects=r.get("projects"), levels=r.get("levels"), k=r.get("k", 3)).select("id", "rank", "level", "project", "content")
        hits = not_injected(fired.crossJoin(small(best)), ledger, now)
        text = injected_text(hits, head, tail, most_chars=r.get("most_chars", 1200))
        told = fired.join(text, "call_id").select("call_id", "rule_id", "session", "ids", "text")
        out = told if out is None else out.unionByName(told)
    return out if out is not None else met.select("call_id", "rule_id", "session", F.array().cast("array<string>").alias("ids"), F.lit("").alias("text")).limit(0)


def relayed(asked: DataFrame, sessions: DataFrame, said: DataFrame, *, trigger: str, most_turns: int = 3, most_age_ms: int = 86_400_000, done: DataFrame | None = None, **limits) -> DataFrame:
    """(session, source, text): the last dialogue of another session for each session whose user asks to go on.

    ``asked`` is (session, turn, at, text), turns from 1: the first that meets ``trigger`` within ``most_turns`` turns counts, once a session
    (``done`` names those that had theirs). ``sessions`` is (session, modified): of main sessions not modified after that, the newest that isn't too old is taken.
    """
    first = asked.where((F.col("turn") <= most_turns) & F.col("text").rlike(trigger) & F.col("session").startswith("session-")).groupBy("session").agg(F.min_by("at", "turn").alias("at"))
    first = first if done is None else first.join(done.select("session"), "session", "left_anti")
    other = sessions.where(F.col("session").startswith("session-")).select(F.col("session").alias("name"), F.col("modified").alias("at"))
    met = newest_before(first.select(F.col("session").alias("name"), "at"), other).where(F.col("at") - F.col("mark_at") <= most_age_ms)
    newest = table(met.select(F.col("name").alias("session"), F.col("mark").alias("source")), "relays")
    lines = relay_lines(said.join(newest.select(F.col("source").alias("session")).distinct(), "session", "left_semi"), **limits)
    texts = lines.groupBy(F.col("session").alias("source")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return newest.join(texts, "source").select("session", "source", "text")


def decision(decisions: DataFrame, decision_id: str) -> DataFrame:
    return decisions.where(F.col("id") == decision_id)


def append_decisions(decisions: DataFrame, rows: DataFrame, now: int, most: int = 500) -> DataFrame:
    """Decisions with new ones recorded, the newest ``most`` of them."""
    return keep_decisions(decisions.unionByName(record_decision(rows, now)), most)


def as_list(c: Column | str) -> Column:
    """A comma-separated text as a list of its parts that aren't blank."""
    return F.filter(F.transform(F.split(tx.text(c), ","), tx.trim), lambda x: x != "")


def not_injected(hits: DataFrame, ledger: DataFrame, now: int, ttl_ms: int = 1_800_000) -> DataFrame:
    """Hits (session, id) that the session hasn't seen within the time; the ledger is (session, id, at)."""
    live = ledger.where(now - F.col("at") <= ttl_ms).select("session", "id").distinct()
    return hits.join(live, ["session", "id"], "left_anti")


def live_sessions(ledger: DataFrame, most: int = 64) -> DataFrame:
    """Ledger rows of the sessions that were first seen last; older sessions are evicted."""
    first = ledger.groupBy("session").agg(F.min("at").alias("first"))
    return ledger.join(first.orderBy(F.desc("first"), "session").limit(most).select("session"), "session", "left_semi")


def record_decision(rows: DataFrame, now: int) -> DataFrame:
    """Decisions as stored: texts and lists cut to their limits, an unknown status where none is known."""
    cut = lambda c, n: F.substring(tx.text(c), 1, n)
    many = lambda c: F.transform(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x != ""), lambda x: F.substring(x, 1, 300))
    status = F.when(F.col("status").isin("succeeded", "failed", "unknown"), F.col("status")).otherwise("unknown")
    return rows.select(
        "id", F.lit("observed_after").alias("relation"), cut("goal", 500).alias("goal"), many("constraints").alias("constraints"), many("options").alias("options"), cut("chosen", 300).alias("chosen"), cut("reason", 800).alias("reason"),
        many("evidence").alias("evidence"), cut("expected", 500).alias("expected"), cut("actual", 500).alias("actual"), many("conditions").alias("conditions"), status.alias("status"), many("tags").alias("tags"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"),
    )


def keep_decisions(decisions: DataFrame, most: int = 500) -> DataFrame:
    return decisions.orderBy(F.desc("created_at"), F.desc("id")).limit(most)


def list_decisions(decisions: DataFrame, *, limit: int = 10, status: str | None = None, tag: str | None = None) -> DataFrame:
    own = decisions if status is None else decisions.where(F.col("status") == status)
    own = own if tag is None else own.where(F.array_contains("tags", tag))
    return own.orderBy(F.desc("created_at"), "id").limit(max(1, min(50, limit)))


def decision_text() -> Column:
    parts = [F.nullif(tx.text(c), F.lit("")) for c in ("goal", "chosen", "reason", "expected", "actual")]
    return F.concat_ws(" ", *parts, F.array_join(F.filter("conditions", lambda c: c != ""), " "))

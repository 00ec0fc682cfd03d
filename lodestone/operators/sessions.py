"""Session logs: turns, windows, segments, folding plans and their accounting.

Events are rows of ``schemas.EVENT``. A turn begins with a message that a user really wrote; all turn
numbers are running sums over (session, order), so no range join is needed.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx

#: Characters that a marker costs in the simple estimate, turns that stay unfolded, and characters of a quote.
MARKER_CHARS, KEEP_TURNS, QUOTE = 120, 13, 48

# How blocks begin that a plugin has put before a user's words. Plugins of other names add theirs.
INJECTION_MARKERS = ("===== 长期记忆 =====", "可能相关的记忆，仅供参考", "【记忆自动注入", "【接力上下文")


def real_user() -> Column:
    return (F.col("type") == "user/message") & F.coalesce(F.col("kind") == "user", F.lit(False))


def injected(block: Column, markers: tuple[str, ...] = INJECTION_MARKERS) -> Column:
    return F.coalesce((block["type"] == "text") & tx.contains_any(tx.text(block["text"]), markers), F.lit(False))


def real_blocks(blocks: Column, markers: tuple[str, ...] = INJECTION_MARKERS) -> Column:
    """The blocks from the first one on that no plugin has put there; ``markers`` is how plugins' blocks begin."""
    marks = F.transform(blocks, lambda b: injected(b, markers))
    first = F.array_position(marks, F.lit(False))
    return F.when(first > 0, F.slice(blocks, first.cast("int"), F.size(blocks))).otherwise(F.slice(blocks, 1, 0))


def injected_blocks(blocks: Column, markers: tuple[str, ...] = INJECTION_MARKERS) -> Column:
    return F.slice(blocks, 1, F.size(blocks) - F.size(real_blocks(blocks, markers)))


def text_of(blocks: Column, reasoning: bool = False, placeholders: bool = True) -> Column:
    """Texts of the blocks by lines; blocks of unknown kinds leave a placeholder, tool blocks nothing."""
    own = ["text", "reasoning"] if reasoning else ["text"]

    def part(b: Column) -> Column:
        out = F.when(b["type"].isin(own), F.nullif(tx.trim(tx.text(b["text"])), F.lit(""))).when(b["type"].isin("text", "reasoning", "tool-call", "tool-result"), F.lit(None))
        return out.otherwise(F.concat(F.lit("⟨"), b["type"], F.lit("⟩"))) if placeholders else out

    return tx.trim(F.array_join(F.array_compact(F.transform(F.coalesce(blocks, F.array().cast("array<struct<type:string,text:string,id:string,name:string,arguments:string>>")), part)), "\n"))


def visible_answer() -> Column:
    return (F.col("type") == "assistant/message") & (F.length(text_of(F.col("blocks"))) > 0)


def visible_text() -> Column:
    """As ``visible_answer``, but an image alone isn't text."""
    return (F.col("type") == "assistant/message") & F.coalesce(F.exists("blocks", lambda b: (b["type"] == "text") & (tx.trim(tx.text(b["text"])) != "")), F.lit(False))


def has_tool_call(blocks: Column) -> Column:
    return F.coalesce(F.exists(blocks, lambda b: b["type"] == "tool-call"), F.lit(False))


def with_turn(events: DataFrame, order: str = "seq", start: Column | None = None) -> DataFrame:
    """Events with ``turn_no``: how many turns have begun, 0 before the first."""
    own = F.sum(F.when(real_user() if start is None else start, 1).otherwise(0)).over(Window.partitionBy("session").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("turn_no", own)


def endpoints(events: DataFrame, since: int = -1) -> DataFrame:
    """(session, turn_index, user_seq, answer_seq, complete) of every turn that begins after ``since``, numbered from 0."""
    turns = with_turn(events).where("turn_no > 0")
    found = turns.groupBy("session", "turn_no").agg(F.min("seq").alias("user_seq"), F.max(F.when(visible_answer(), F.col("seq"))).alias("answer_seq")).where(F.col("user_seq") > since)
    number = F.row_number().over(Window.partitionBy("session").orderBy("turn_no")) - 1
    return found.select("session", number.alias("turn_index"), "user_seq", "answer_seq", F.col("answer_seq").isNotNull().alias("complete"))


def completed_turns(events: DataFrame, since: int = -1, markers: tuple[str, ...] = INJECTION_MARKERS) -> DataFrame:
    """The question and last visible answer of each turn that has both."""
    ends = endpoints(events, since).where("complete")
    asked = events.select("session", F.col("seq").alias("user_seq"), F.col("blocks").alias("q"))
    told = events.select("session", F.col("seq").alias("answer_seq"), F.col("blocks").alias("a"))
    found = ends.join(asked, ["session", "user_seq"]).join(told, ["session", "answer_seq"])
    before = injected_blocks(F.col("q"), markers)
    chars = F.aggregate(before, F.lit(0), lambda s, b: s + F.length(tx.text(b["text"])))
    out = found.select("session", "turn_index", "user_seq", "answer_seq", text_of(real_blocks(F.col("q"), markers)).alias("user_text"), text_of(F.col("a")).alias("answer_text"), F.size(before).alias("injected_blocks"), chars.alias("injected_chars"))
    return out.where("user_text <> '' AND answer_text <> ''")


def turn_windows(events: DataFrame) -> DataFrame:
    """(session, index, user_seq, from_seq, to_seq, events): each turn up to the next one's start."""
    found = with_turn(events).where("turn_no > 0").groupBy("session", "turn_no").agg(F.min("seq").alias("user_seq"), F.max("seq").alias("last"), F.count("*").alias("events"))
    following = F.lead("user_seq").over(Window.partitionBy("session").orderBy("turn_no"))
    return found.select("session", (F.col("turn_no") - 1).cast("int").alias("index"), "user_seq", F.col("user_seq").alias("from_seq"), F.coalesce(following - 1, "last").alias("to_seq"), "events")


def slice_events(events: DataFrame, low: int | None = None, high: int | None = None, types: list[str] | None = None) -> DataFrame:
    out = events
    if low is not None:
        out = out.where(F.col("seq") >= low)
    if high is not None:
        out = out.where(F.col("seq") <= high)
    return out.where(F.col("type").isin(types)) if types else out


def summarize(events: DataFrame, most: int = 900) -> DataFrame:
    """A short account of each event by its type; what a call or answer said is clipped."""
    blocks = F.coalesce(F.col("blocks"), F.array().cast(events.schema["blocks"].dataType))
    joined = tx.trim(F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & (tx.trim(tx.text(b["text"])) != "")), lambda b: b["text"]), "\n"))
    thought = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "reasoning"), lambda b: tx.text(b["text"])), "\n")
    calls = F.transform(F.filter(blocks, lambda b: b["type"] == "tool-call"), lambda b: F.struct(tx.text(b["name"]).alias("name"), F.substring(tx.clip_counted(b["arguments"], most), 1, min(300, most)).alias("args")))
    kind = F.col("type")
    body = F.when(kind == "tool/call", tx.text("arguments")).when(kind.isin("user/message", "assistant/message", "tool/result"), joined)
    chars = F.when(kind == "assistant/message", F.length(thought) + F.length(joined)).when(body.isNotNull(), F.length(body)).otherwise(F.length(tx.text("raw")))
    return events.select(
        "session", "seq", "type",
        F.when(kind == "user/message", tx.text("kind")).alias("kind"),
        F.when(kind != "user/message", F.col("turn")).alias("turn"),
        F.when(kind == "assistant/message", F.col("step")).alias("step"),
        F.when(kind == "tool/call", tx.text("name")).alias("name"),
        F.when(kind.isin("tool/call", "tool/result"), tx.text("call_id")).alias("call_id"),
        F.when(kind == "tool/result", F.col("is_error")).alias("is_error"),
        chars.alias("chars"),
        F.when(kind == "assistant/message", F.length(thought)).alias("reasoning_chars"),
        F.nullif(tx.clip_counted(body, most), F.lit("")).alias("text"),
        F.when((kind == "assistant/message") & (F.size(calls) > 0), calls).alias("tool_calls"),
        F.when(kind == "assistant/message", F.col("usage")).alias("usage"),
        F.when(kind == "compaction/prune", F.slice(F.col("shadowed_seqs"), 1, 40)).alias("shadowed_seqs"),
        F.when(kind == "compaction/prune", F.coalesce("shadowed_tokens", F.lit(0))).alias("shadowed_tokens"),
    )


def recall_events(events: DataFrame, session: str, *, turn_index: int | None = None, user_seq: int | None = None, low: int | None = None, high: int | None = None, types: list[str] | None = None, limit: int = 12, most: int = 900) -> DataFrame:
    """Accounts of a turn's or a range's first events. A turn that isn't there is an error, never a wider range."""
    own = events.where(F.col("session") == session)
    if low is None and (turn_index is not None or user_seq is not None):
        windows = turn_windows(own)
        hit = windows.where(F.col("user_seq") == user_seq).first() if user_seq is not None else None
        hit = hit or (windows.where(F.col("index") == turn_index).first() if turn_index is not None else None)
        if hit is None:
            raise LookupError(f"session {session} has no such turn (index {turn_index}, seq {user_seq})")
        low, high = hit["from_seq"], hit["to_seq"]
    return summarize(slice_events(own, low, high, types).orderBy("seq").limit(max(1, min(50, limit))), most)


def groups(events: DataFrame) -> DataFrame:
    """(session, abs, user_seq, quote): for each turn/start, counted from 1, the first real user message with words after it."""
    started = with_turn(events, start=F.col("type") == "turn/start").where("turn_no > 0")
    quote = tx.collapse(text_of(real_blocks(F.col("blocks"))))
    usable = F.when(real_user() & (quote != ""), F.struct(F.col("seq").alias("seq"), F.substring(quote, 1, QUOTE).alias("quote")))
    found = started.groupBy("session", "turn_no").agg(F.min(usable).alias("m"))
    return found.select("session", F.col("turn_no").cast("int").alias("abs"), F.col("m.seq").alias("user_seq"), F.coalesce("m.quote", F.lit("")).alias("quote"))


def user_turns(events: DataFrame) -> DataFrame:
    return events.groupBy("session").agg(F.count_if(real_user()).alias("user_turns"))


def dialogue(events: DataFrame) -> DataFrame:
    """(session, seq, role, text) of users' and assistants' words."""
    words = text_of(F.col("blocks"), placeholders=False)
    user = (F.col("type") == "user/message") & (F.col("kind").isNull() | (F.col("kind") == "user"))
    found = events.where(user | (F.col("type") == "assistant/message")).select("session", "seq", F.when(F.col("type") == "user/message", "user").otherwise("assistant").alias("role"), words.alias("text"))
    return found.where("text <> ''")


def tail_with_users(said: DataFrame, tail: int, users: int = 2) -> DataFrame:
    """The last ``tail`` messages of each session, and as many before them as it takes to have ``users`` of users."""
    back = Window.partitionBy("session").orderBy(F.desc("seq"))
    later = F.coalesce(F.sum((F.col("role") == "user").cast("int")).over(back.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = said.withColumns({"nth": F.row_number().over(back), "later": later})
    return found.where((F.col("nth") <= tail) | (F.col("later") < users)).drop("nth", "later")


def recent_turns(turns: DataFrame, limit: int, *, before: int | None = None) -> DataFrame:
    """The last turns of each session, those before a turn if one is named, oldest first by ``turn_index``."""
    own = turns if before is None else turns.where(F.col("turn_index") < before)
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("turn_index")))
    return own.withColumn("nth", rank).where(F.col("nth") <= max(1, limit)).drop("nth")


def islands(rows: DataFrame, flag: Column, *, by: list[str], order: str, least: int = 2) -> DataFrame:
    """(by..., start, end, n): runs of at least ``least`` neighbouring rows for which the flag holds."""
    w = Window.partitionBy(*by).orderBy(order)
    marked = rows.withColumns({"__pos": F.row_number().over(w), "__flag": F.coalesce(flag, F.lit(False))})
    run = F.col("__pos") - F.row_number().over(Window.partitionBy(*by, "__flag").orderBy(order))
    found = marked.withColumn("__run", run).where("__flag").groupBy(*by, "__run").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n"))
    return found.where(F.col("n") >= least).drop("__run")


# ---- accounting and folding ------------------------------------------------


def _sum(blocks: Column, size) -> Column:
    return F.coalesce(F.aggregate(blocks, F.lit(0), lambda s, b: s + size(b)), F.lit(0))


def event_chars() -> Column:
    """Characters of an event's blocks; a tool result without any counts its raw data."""
    own = _sum(F.col("blocks"), lambda b: F.when(b["type"].isin("text", "reasoning", "tool-result"), F.length(tx.text(b["text"]))).when(b["type"] == "tool-call", F.length(F.coalesce(b["arguments"], F.lit("{}")))).otherwise(8))
    return F.when((F.col("type") == "tool/result") & (own == 0), F.length(tx.text("raw"))).otherwise(own)


def chars_of(kind: str) -> Column:
    return _sum(F.col("blocks"), lambda b: F.when(b["type"] == kind, F.length(tx.text(b["text"]))).otherwise(0))


def foldable() -> Column:
    return F.col("type").isin("tool/result", "tool/call") | ((F.col("type") == "assistant/message") & ~visible_text())


def estimate(events: DataFrame, keep: int = KEEP_TURNS) -> DataFrame:
    """One row a session: what folding all turns but the last ``keep`` would save, at a fixed cost a turn."""
    keep = max(1, keep)
    placed = with_turn(events, "pos").where("turn_no > 0")
    by_turn = Window.partitionBy("session", "turn_no")
    placed = placed.withColumns({
        "answer": F.max(F.when(visible_text() & ~real_user(), F.struct("pos", "seq"))).over(by_turn)["seq"],
        "turns": F.max("turn_no").over(Window.partitionBy("session")),
        "chars": event_chars(), "inner": ~real_user(), "fold": foldable(), "thought": chars_of("reasoning"), "visible": chars_of("text"),
    })
    zone = F.col("turn_no") <= F.col("turns") - keep
    middle = zone & F.col("inner") & (F.col("seq") < F.col("answer"))
    answered = zone & F.col("answer").isNotNull()
    tool = F.when(F.col("type") == "tool/result", F.when(_sum(F.col("blocks"), lambda b: F.length(tx.text(b["text"]))) > 0, _sum(F.col("blocks"), lambda b: F.length(tx.text(b["text"])))).otherwise(F.length(tx.text("raw")))).otherwise(0)
    assistant = F.col("type") == "assistant/message"
    add = lambda cond, value: F.coalesce(F.sum(F.when(cond, value)), F.lit(0))
    sums = placed.groupBy("session").agg(
        F.max("turns").cast("int").alias("turns"),
        F.count_distinct(F.when(answered, F.col("turn_no"))).alias("foldable_turns"),
        F.count_if(middle & F.col("fold")).alias("foldable_nodes"),
        add(middle & F.col("fold") & assistant, F.col("thought")).alias("reasoning_chars"),
        add(middle & F.col("fold"), tool).alias("tool_chars"),
        add(middle & ~F.col("fold"), F.col("visible")).alias("visible_chars"),
        add(answered & (F.col("seq") == F.col("answer")), F.col("thought")).alias("kept_answer_reasoning_chars"),
        add(zone, F.col("chars")).alias("total_chars"),
    )
    saved = F.greatest(F.lit(0), F.col("reasoning_chars") + F.col("tool_chars") - F.col("foldable_turns") * MARKER_CHARS)
    return sums.withColumn("saved_chars", saved).withColumns({"saved_tokens": tx.rough_tokens(F.col("saved_chars")), "saved_pct": F.when(F.col("total_chars") > 0, F.round(100 * F.col("saved_chars") / F.col("total_chars"), 1)).otherwise(0.0)})


#: What stands in for a folded segment; any text with these fields will do.
MARKER = "[{product}: {count} events of turn {turn} folded, {first} to {last} of session {session}, about {tokens} tokens. Call recall_events for that range to see them.]"


def marker_text(turn, session: str, seqs: list[int], chars: int, product: str = "lodestone", tokens: int | None = None, template: str = MARKER) -> str:
    return template.format(product=product, turn=turn, session=session.removeprefix("session-")[:8], count=len(seqs), first=seqs[0], last=seqs[-1], tokens=int(chars / 2 + 0.5) if tokens is None else tokens)


_PLAN = "session string, turn_index int, user_seq long, answer_seq long, start long, end long, shadowed_seqs array<long>, shadowed_chars long, marker string, marker_chars long"


def _segments(items: list[dict]) -> list[list[int]]:
    out: list[list[int]] = []
    run: list[int] | None = None
    for it in items:
        if not it["fold"]:
            run = None
        elif run is None:
            out.append(run := [it["seq"]])
        else:
            run.append(it["seq"])
    return out


def fold_items(items: list[dict]) -> list[list[int]]:
    """Segments of a turn's middle that may go: a tool call and all its results go together, in one segment, or stay."""
    calls: dict[str, list[dict]] = {}
    for it in items:
        for c in it["calls"]:
            calls.setdefault(c, []).append(it)
    moved = True
    while moved:
        moved = False
        for own in calls.values():
            if not all(it["fold"] for it in own):
                for it in own:
                    moved |= it["fold"]
                    it["fold"] = False
    for _ in range(4):
        place = {seq: k for k, seg in enumerate(_segments(items)) for seq in seg}
        split = [own for own in calls.values() if any(it["fold"] for it in own) and len({place.get(it["seq"], -1) for it in own}) > 1]
        if not split:
            break
        for own in split:
            for it in own:
                it["fold"] = False
    return [s for s in _segments(items) if len(s) >= 2]


def plan_projection(events: DataFrame, keep: int = KEEP_TURNS, product: str = "lodestone", template: str = MARKER) -> DataFrame:
    """Segments of each session that can be replaced by markers; events need ``pos``, their place on the surface.

    A turn is one group of work, so a long session is spread over tasks. Turns of the last ``keep`` stay whole.
    """
    keep = max(1, keep)
    known = F.coalesce(F.exists("blocks", lambda b: ~b["type"].isin("text", "reasoning", "tool-call", "tool-result")), F.lit(False))
    calls = F.when(F.col("type") == "assistant/message", F.array_compact(F.transform(F.filter("blocks", lambda b: b["type"] == "tool-call"), lambda b: b["id"]))).when(F.col("type").isin("tool/call", "tool/result"), F.array_compact(F.array("call_id")))
    placed = with_turn(events, "pos").where("turn_no > 0")
    turns = placed.groupBy("session").agg(F.max("turn_no").alias("turns"))
    may = F.col("type").isin("tool/call", "tool/result") | ((F.col("type") == "assistant/message") & ~visible_text() & ~known)
    rows = placed.join(turns, "session").where(F.col("turn_no") <= F.col("turns") - keep)
    rows = rows.select("session", F.col("turn_no").cast("int").alias("turn_no"), "pos", "seq", real_user().alias("start"), visible_text().alias("visible"), may.alias("fold"), F.coalesce(calls, F.array().cast("array<string>")).alias("calls"), event_chars().alias("chars"))

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        inner = group[~group["start"]]
        shown = inner.index[inner["visible"]]
        out = []
        if len(shown):
            answer = inner.loc[shown[-1]]
            items = [{"seq": int(r.seq), "fold": bool(r.fold), "calls": list(r.calls), "chars": int(r.chars)} for r in inner[inner["pos"] < answer["pos"]].itertuples()]
            size = {it["seq"]: it["chars"] for it in items}
            session, turn = group["session"].iloc[0], int(group["turn_no"].iloc[0]) - 1
            for seg in fold_items(items):
                chars = sum(size[s] for s in seg)
                marker = marker_text(turn, session, seg, chars, product, template=template)
                out.append((session, turn, int(group[group["start"]]["seq"].iloc[0]), int(answer["seq"]), seg[0], seg[-1], seg, chars, marker, len(marker)))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _PLAN.split(", ")])

    return rows.groupBy("session", "turn_no").applyInPandas(plan, _PLAN)


def plan_totals(events: DataFrame, plan: DataFrame, keep: int = KEEP_TURNS) -> DataFrame:
    """One row a session: segments, nodes, characters that folding saves net of markers, and their share of the zone."""
    placed = with_turn(events, "pos").where("turn_no > 0").withColumn("turns", F.max("turn_no").over(Window.partitionBy("session")))
    zone = placed.groupBy("session").agg(F.max("turns").cast("int").alias("turns"), F.coalesce(F.sum(F.when(F.col("turn_no") <= F.col("turns") - max(1, keep), event_chars())), F.lit(0)).alias("zone_chars"))
    sums = plan.groupBy("session").agg(F.count_distinct("turn_index").alias("foldable_turns"), F.count("*").alias("segments"), F.sum(F.size("shadowed_seqs")).alias("nodes"), F.sum("shadowed_chars").alias("chars"), F.sum("marker_chars").alias("marker_chars"))
    out = zone.join(sums, "session", "left").fillna(0)
    net = F.col("chars") - F.col("marker_chars")
    return out.withColumns({"net_chars": net, "net_tokens": tx.rough_tokens(net), "net_pct": F.when(F.col("zone_chars") > 0, F.round(100 * net / F.col("zone_chars"), 1)).otherwise(0.0)})


def fold_events(plan: DataFrame, prices: DataFrame) -> DataFrame:
    """The two events of each segment that every price is known for: an audit, then the replacement.

    ``prices`` is (session, seq, tokens). A segment with a missing price gives no event at all.
    """
    each = plan.select("session", "turn_index", "start", "end", "shadowed_seqs", "marker", F.explode("shadowed_seqs").alias("seq"))
    priced = each.join(prices, ["session", "seq"], "left").groupBy("session", "turn_index", "start", "end", "shadowed_seqs", "marker").agg(F.sum("tokens").alias("tokens"), F.count_if(F.col("tokens").isNull()).alias("missing")).where("missing = 0")
    kinds = F.explode(F.array(F.lit("compaction/prune"), F.lit("user/message")))
    out = priced.withColumn("type", kinds)
    return out.select("session", "turn_index", "type", "start", "end", "shadowed_seqs", F.when(F.col("type") == "compaction/prune", F.col("tokens")).alias("shadowed_tokens"), F.when(F.col("type") == "user/message", F.col("marker")).alias("text"), F.when(F.col("type") == "user/message", F.lit("replace")).alias("surface_op"))


def usage_peaks(events: DataFrame) -> DataFrame:
    """(session, normal_peak, compaction_peak): the largest prompts by kind of step."""
    size = F.coalesce(F.col("usage.input"), F.lit(0)) + F.coalesce(F.col("usage.cache_read"), F.lit(0))
    compact = F.col("type").startswith("compaction/")
    return events.where("usage IS NOT NULL").groupBy("session").agg(F.coalesce(F.max(F.when(~compact, size)), F.lit(0)).alias("normal_peak"), F.coalesce(F.max(F.when(compact, size)), F.lit(0)).alias("compaction_peak"))


def largest_logs(files: DataFrame, limit: int = 5) -> DataFrame:
    """The ``limit`` largest log files (session, size)."""
    return files.orderBy(F.desc("size"), "session").limit(limit)


def projected_size(events: DataFrame, *, fresh: int = 3, archive_tokens: int = 60, trace_tokens: int = 40) -> DataFrame:
    """One row a session: rough tokens of all, after turns before the last ``fresh`` give way to one marker, and after the
    inner events of the rest's turns, between question and last answer, give way to a marker each.
    """
    size = tx.rough_tokens(event_chars())
    placed = with_turn(events, "pos").withColumn("tokens", size)
    rows = placed.join(placed.groupBy("session").agg(F.max("turn_no").alias("last_turn")), "session")
    kept_from = F.when(F.col("last_turn") > fresh, F.col("last_turn") - fresh + 1).otherwise(F.lit(0))
    lone_head = (F.col("type") == "system/message") & (F.col("turn_no") == 0)
    old = (F.col("turn_no") < kept_from) & ~lone_head
    by_turn = Window.partitionBy("session", "turn_no")
    answer = F.max(F.when(visible_text(), F.col("pos"))).over(by_turn)
    start = F.min(F.when(real_user(), F.col("pos"))).over(by_turn)
    rows = rows.withColumns({"old": old, "answer": answer, "start": start})
    inner = ~F.col("old") & (F.col("turn_no") > 0) & (F.col("pos") > F.col("start")) & (F.col("pos") < F.col("answer"))
    rows = rows.withColumn("inner", F.coalesce(inner, F.lit(False)))
    add = lambda c: F.coalesce(F.sum(F.when(c, F.col("tokens"))), F.lit(0))
    sums = rows.groupBy("session").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("original"), add(F.col("old")).alias("archived"), F.max(F.col("old").cast("int")).alias("any_old"), add(F.col("inner")).alias("traces"), F.count_distinct(F.when(F.col("inner"), F.col("turn_no"))).alias("trace_turns"))
    prefix = F.col("original") - F.col("archived") + F.col("any_old") * archive_tokens
    return sums.select("session", "original", prefix.alias("folded_prefix"), (prefix - F.col("traces") + F.col("trace_turns") * trace_tokens).alias("projected"), "trace_turns")


def paired_spans(events: DataFrame) -> DataFrame:
    """(session, seq, calls, results, complete): assistant messages with calls, and whether the results that follow at once answer all of them."""
    w = Window.partitionBy("session").orderBy("seq")
    result = F.col("type") == "tool/result"
    block = F.sum(F.when(result, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ids = F.array_compact(F.transform(F.filter("blocks", lambda b: b["type"] == "tool-call"), lambda b: b["id"]))
    found = events.withColumn("__run", block).groupBy("session", "__run").agg(F.min("seq").alias("seq"), F.max(F.when(~result & (F.col("type") == "assistant/message"), ids)).alias("calls"), F.array_sort(F.collect_list(F.when(result, F.col("call_id")))).alias("results"))
    return found.where(F.size("calls") > 0).select("session", "seq", "calls", "results", (F.array_sort("calls") == F.col("results")).alias("complete"))

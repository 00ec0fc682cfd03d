"""Session operators, by the cases that define them."""

import pytest
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.operators import evidence, sessions


def block(kind, text=None, id=None, name=None, arguments=None):
    return (kind, text, id, name, arguments)


def event(seq, type, kind=None, blocks=(), call=None, session="session-1", **more):
    row = {f.name: None for f in schemas.EVENT} | {"session": session, "seq": seq, "type": type, "kind": kind, "blocks": list(blocks), "call_id": call} | more
    return tuple(row[f.name] for f in schemas.EVENT)


def user(seq, text="q", **more):
    return event(seq, "user/message", "user", [block("text", text)], **more)


def says(seq, text=None, thought=None, calls=(), **more):
    parts = ([block("reasoning", thought)] if thought else []) + [block("tool-call", id=c, name="t", arguments="{}") for c in calls] + ([block("text", text)] if text else [])
    return event(seq, "assistant/message", blocks=parts, **more)


def result(seq, call, n=300):
    return event(seq, "tool/result", blocks=[block("text", "r" * n)], call=call)


def frame(spark, rows):
    return spark.createDataFrame(rows, schemas.EVENT).withColumn("pos", F.col("seq"))


def test_turns_and_windows(spark):
    rows = [event(1, "user/message", "plugin", [block("text", "x")]), user(2, "first"), says(3, "one"), event(4, "tool/call", call="c"), result(5, "c"), says(6, "two"), user(7, "second"), says(8, "three"), user(9, "open")]
    events = frame(spark, rows)
    windows = [tuple(r)[1:] for r in sessions.turn_windows(events).orderBy("index").collect()]
    assert windows == [(0, 2, 2, 6, 5), (1, 7, 7, 8, 2), (2, 9, 9, 9, 1)]
    turns = sessions.completed_turns(events).orderBy("turn_index").collect()
    assert [(t["turn_index"], t["user_seq"], t["answer_seq"], t["user_text"], t["answer_text"]) for t in turns] == [(0, 2, 6, "first", "two"), (1, 7, 8, "second", "three")]
    assert [r["turn_index"] for r in sessions.completed_turns(events, since=2).collect()] == [0]
    assert sessions.user_turns(events).first()["user_turns"] == 3


def test_injected_head_is_cut(spark):
    head = block("text", "【记忆自动注入 · x】 noise")
    rows = [event(0, "user/message", "user", [head, block("text", "real"), head]), says(1, "a")]
    t = sessions.completed_turns(frame(spark, rows)).first()
    assert (t["injected_blocks"], t["user_text"].split("\n")[0]) == (1, "real")


def test_recall_events_never_widens(spark):
    events = frame(spark, [user(5, "q"), says(9, "x" * 2000)])
    got = sessions.recall_events(events, "session-1", turn_index=0, most=100).collect()
    assert [r["seq"] for r in got] == [5, 9] and got[1]["text"].endswith("…[+1900字]")
    with pytest.raises(LookupError):
        sessions.recall_events(events, "session-1", turn_index=3)


def fold_case():
    return [user(1), says(2, thought="t" * 500, calls=["a"]), result(3, "a"), says(4, "answer", thought="t" * 200), user(5), says(6, "seen", thought="t" * 100, calls=["b"]), result(7, "b"), says(8, "done"), user(9), says(10, "end")]


def test_fold_plan(spark):
    events = frame(spark, fold_case())
    plan = sessions.plan_projection(events, keep=1).collect()
    assert [(p["turn_index"], p["user_seq"], p["answer_seq"], list(p["shadowed_seqs"])) for p in plan] == [(0, 1, 4, [2, 3])]
    assert "recall_events" in plan[0]["marker"] and plan[0]["marker_chars"] == len(plan[0]["marker"])
    totals = sessions.plan_totals(events, sessions.plan_projection(events, keep=1), keep=1).first()
    assert (totals["turns"], totals["segments"], totals["nodes"]) == (3, 1, 2)
    assert totals["chars"] == 500 + 2 + 300
    assert sessions.plan_projection(events, keep=5).count() == 0


def test_prices_are_all_or_nothing(spark):
    plan = sessions.plan_projection(frame(spark, fold_case()), keep=1)
    prices = spark.createDataFrame([("session-1", 2, 50), ("session-1", 3, 50)], "session string, seq long, tokens long")
    got = sessions.fold_events(plan, prices).collect()
    assert sorted(r["type"] for r in got) == ["compaction/prune", "user/message"]
    assert [r["shadowed_tokens"] for r in got if r["type"] == "compaction/prune"] == [100]
    assert sessions.fold_events(plan, prices.where("seq = 2")).count() == 0


def test_tool_groups_stay_together():
    items = [{"seq": k, "fold": f, "calls": c} for k, f, c in [(1, True, ["a"]), (2, True, []), (3, False, ["a"]), (4, True, []), (5, True, ["b"]), (6, True, ["b"])]]
    assert sessions.fold_items(items) == [[4, 5, 6]]


def test_estimate(spark):
    rows = [user(0, "u" * 10), says(1, thought="t" * 1000), result(2, "x", 2800), says(3, "v" * 20, thought="t" * 500), user(4), says(5, "end")]
    got = sessions.estimate(frame(spark, rows), keep=1).first()
    assert (got["turns"], got["foldable_turns"], got["foldable_nodes"], got["reasoning_chars"], got["tool_chars"], got["kept_answer_reasoning_chars"]) == (2, 1, 2, 1000, 2800, 500)
    assert got["saved_chars"] == 1000 + 2800 - 120


def test_groups(spark):
    injected = block("text", "【接力上下文】 x")
    rows = [event(0, "turn/start"), event(1, "user/message", "plugin", [block("text", "p")]), user(2, "hello  there"), user(3, "later"), event(4, "turn/start"), event(5, "user/message", "plugin", [block("text", "p")]), event(6, "turn/start"), event(7, "user/message", "user", [injected, block("text", "third")])]
    got = sessions.groups(frame(spark, rows)).orderBy("abs").collect()
    assert [(g["abs"], g["user_seq"], g["quote"]) for g in got] == [(1, 2, "hello there"), (2, None, ""), (3, 7, "third")]


def test_edit_history(spark):
    items = spark.createDataFrame([("m", "jot-update-28a7537f-turn(1); dream-update-28a7537f-turnRange(1,4); odd")], "id string, edit_history string")
    parsed = items.select(evidence.parse_edits("edit_history").alias("e")).first()["e"]
    assert [(e["unparsed"], e["scene"], e["turn"], e["low"], e["high"]) for e in parsed] == [(False, "jot", 1, None, None), (False, "dream", 4, 1, 4), (True, None, None, None, None)]
    groups = spark.createDataFrame([("session-28a7537f-x", k, s, "q") for k, s in [(1, 10), (2, None), (3, 30), (4, 40)]], "session string, abs int, user_seq long, quote string")
    got = evidence.locate(items, groups).orderBy("edit_no", "abs").collect()
    assert [(g["edit_no"], g["abs"], g["user_seq"]) for g in got] == [(0, 1, 10), (1, 1, 10), (1, 3, 30)]


def test_paired_spans(spark):
    rows = [says(0, calls=["a", "b"]), result(1, "a"), result(2, "b"), says(3, calls=["c"]), says(4, "x")]
    got = sessions.paired_spans(frame(spark, rows)).orderBy("seq").collect()
    assert [(g["seq"], g["complete"]) for g in got] == [(0, True), (3, False)]

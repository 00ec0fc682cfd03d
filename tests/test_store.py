"""Stores, queues, facts, injection and streams."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.operators import facts, injection, lexical, repetition, store


def turn(session, user_seq, ord, text="question", summary="s", outcome="completed", answer="answer", turn_index=None, answer_seq=None):
    return (session, turn_index, summary, outcome, user_seq, user_seq + 1 if answer_seq is None else answer_seq, text, answer, ord)


NEW = "session_id string, turn_index int, summary string, outcome string, user_seq long, answer_seq long, user_text string, answer_text string, ord int"


def test_upsert_numbers_and_keeps(spark):
    none = spark.createDataFrame([], schemas.TURN)
    first = store.upsert_turns(none, spark.createDataFrame([turn("a", 0, 0), turn("a", 5, 1), turn("b", 0, 2), turn("a", 9, 3)], NEW), 100)
    rows = {(r["session_id"], r["user_seq"]): r for r in first.collect()}
    assert {k: r["turn_index"] for k, r in rows.items()} == {("a", 0): 0, ("a", 5): 1, ("a", 9): 2, ("b", 0): 0}
    again = store.upsert_turns(first, spark.createDataFrame([turn("a", 0, 0, "changed"), turn("a", 20, 1)], NEW), 200)
    got = {(r["session_id"], r["user_seq"]): r for r in again.collect()}
    assert len(got) == 5 and got["a", 20]["turn_index"] == 3
    old, new = rows["a", 0], got["a", 0]
    assert (new["id"], new["turn_index"], new["created_at"], new["updated_at"], new["user_text"]) == (old["id"], 0, 100, 200, "changed")


def test_rejects(spark):
    rows = [turn("a", 0, 0), turn("a", 1, 1, summary=" "), turn("a", 2, 2, outcome="great"), turn("a", 3, 3, answer_seq=3), turn("a", -1, 4), turn("a", 6, 5, text="token: " + "q7" * 12)]
    good, bad = store.checked_turns(spark.createDataFrame(rows, NEW))
    assert sorted(r["user_seq"] for r in good.collect()) == [0, 6]
    assert "已脱敏" in good.where("user_seq = 6").first()["user_text"]
    assert {r["user_seq"]: r["reason"] for r in bad.collect()} == {1: "summary", 2: "outcome", 3: "same seq", -1: "user_seq"}


def test_triples_are_replaced_at_once(spark):
    spec = "turn_id string, session_id string, subject string, predicate string, object string, source_order int"
    none = spark.createDataFrame([], schemas.TRIPLE)
    one = store.replace_triples(none, spark.createDataFrame([("t", "s", " A  b", "is", "c", 0), ("t", "s", "a B", "is", "C", 1), ("t", "s", "x", "is", "y", 2)], spec), 1)
    assert one.count() == 2
    kept = store.replace_triples(one, spark.createDataFrame([("t", "s", "new", " ", "z", 0), ("t", "s", "p", "q", "r", 1), ("u", "s", "p", "q", "r", 0)], spec), 2)
    assert kept.where("turn_id = 't'").count() == 2 and kept.where("turn_id = 'u'").count() == 1
    terms = store.upsert_terms(spark.createDataFrame([], schemas.TERM), spark.createDataFrame([("A  b",), ("a B",), ("c",), ("x",), ("y",)], "display_text string"))
    assert terms.count() == 4 and store.named_triples(one, terms).count() == 2


def test_queue(spark):
    results = [("s", 0, 1, t, ok, e) for t, ok, e in [(10, False, "a"), (20, False, "b")]] + [("s", 1, 2, 10, False, "a"), ("s", 1, 2, 20, True, None)] + [("s", 2, 3, t, False, "x" * 600) for t in (1, 2, 3)]
    got = {r["user_seq"]: r for r in store.fold_queue(spark.createDataFrame(results, "session_id string, user_seq long, answer_seq long, at long, ok boolean, error string")).collect()}
    assert (got[0]["state"], got[0]["attempts"], got[0]["next_retry_at"], got[0]["last_error"]) == ("pending", 2, 20 + 120_000, "b")
    assert (got[1]["state"], got[1]["last_error"]) == ("succeeded", None)
    assert (got[2]["state"], got[2]["next_retry_at"], len(got[2]["last_error"])) == ("quarantined", None, 500)
    queue = spark.createDataFrame([("s", 0, 0, 1, "pending", 1, "e", 500, "p", None, 1), ("s", 1, 1, 2, "succeeded", 0, None, None, None, None, 1)], schemas.QUEUE)
    merged = store.enqueue(queue, spark.createDataFrame([("s", 9, 0, 1, None, "m"), ("s", 2, 4, 5, "p2", None)], "session_id string, turn_index int, user_seq long, answer_seq long, provider string, model string"), 7)
    rows = {r["user_seq"]: r for r in merged.collect()}
    assert (rows[0]["state"], rows[0]["provider"], rows[0]["model"], rows[0]["attempts"]) == ("pending", "p", "m", 1)
    assert (rows[4]["state"], rows[4]["turn_index"]) == ("pending", 2)
    assert [r["user_seq"] for r in store.due(merged, 400).collect()] == [4]
    assert store.queue_stats(merged).first().asDict() == {"pending": 2, "succeeded": 1, "quarantined": 0, "total": 3}


def test_greedy_packing(spark):
    hits = spark.createDataFrame([(0, k, n) for k, n in enumerate([50, 90, 30, 30])], "q int, k int, n int")
    take = lambda **o: [r["k"] for r in injection.pack_greedy(hits, by="q", order="k", size=F.col("n"), most=120, **o).where("included").orderBy("k").collect()]
    assert take() == [0, 2, 3]
    assert take(stop=True) == [0]
    assert take(most_items=2) == [0, 2]


def test_rules(spark):
    rules = spark.createDataFrame([(0, "publish", ["shell"], r"npm\s+publish"), (1, "any", None, None)], "ord int, rule_id string, tools array<string>, pattern string")
    calls = spark.createDataFrame([(0, "shell", json.dumps({"command": "NPM publish"})), (1, "edit", json.dumps({"path": "x"}))], "call_id int, name string, arguments string")
    assert {r["call_id"]: r["rule_id"] for r in injection.match_rules(calls, rules).collect()} == {0: "publish", 1: "any"}


def test_contract(spark):
    ok = {"summary": "s", "outcome": "completed", "triples": [{"subject": "a", "predicate": "b", "object": "c"}]}
    cases = [(ok, []), ({**ok, "more": 1}, ["/: wrong fields"]), ({**ok, "summary": " "}, ["/summary: blank"]), ({**ok, "outcome": "no"}, ["/outcome: unknown"]), ({**ok, "triples": 3}, ["/triples: not a list"]), ({**ok, "triples": [{"subject": " ", "predicate": "b", "object": "c"}]}, ["/triples/0/subject: blank"]), ({**ok, "triples": [{"subject": "a", "predicate": "b", "object": "c", "x": 1}, 4]}, ["/triples/0: wrong fields", "/triples/1: not an object"])]
    frame = spark.createDataFrame([(k, json.dumps(c)) for k, (c, _) in enumerate(cases)] + [(90, "nonsense"), (91, "[1]"), (92, None)], "k int, raw string")
    got = {r["k"]: r["e"] for r in frame.select("k", facts.validate_extraction("raw").alias("e")).collect()}
    for k, (_, want) in enumerate(cases):
        assert got[k] == want
    assert got[90] == got[91] == got[92] == ["/: not an object"]


def test_parse_facts(spark):
    raw = [json.dumps({"triples": [{"subject": " a ", "predicate": "版本", "value": "v1.2"}, {"subject": "", "predicate": "p", "value": "v"}]}), json.dumps([{"subject": "s" * 61, "predicate": "p", "value": "v"}]), "x"]
    frame = spark.createDataFrame(list(enumerate(raw)), "k int, raw string")
    got = [r[0] for r in frame.orderBy("k").select(facts.parse_facts("raw")).collect()]
    assert [tuple(t) for t in got[0]] == [("a", "版本", "v1.2", "版本")] and got[1] == [] and got[2] is None


def test_repetition(spark):
    rotating = "Check it. Fix it. Run it. " * 30
    texts = {"repeat": "I should stop now. " * 30, "rotate": rotating, "prose": " ".join(f"Sentence number {k} has its own words about topic {k * 7}." for k in range(40)), "short": "a. b."}
    frame = spark.createDataFrame(list(texts.items()), "id string, text string")
    hits = {r["id"]: r["hit"] for r in repetition.repeated_units(frame).collect()}
    assert hits == {"repeat": True, "rotate": True, "prose": False, "short": False}
    turned = {r["id"]: r["hit"] for r in repetition.rotation(frame).collect()}
    assert turned["rotate"] and not turned["prose"]


def test_substring_route_cuts_before_filters(spark):
    turns = spark.createDataFrame([(f"t{k}", "An É apple", "x", k) for k in range(5)], "id string, user_text string, answer_text string, updated_at long")
    got = lexical.substring_route(turns, "an É", limit=2).orderBy(F.desc("score")).collect()
    assert [(r["id"], r["score"]) for r in got] == [("t4", 19.0), ("t3", 18.9)]


def test_streams_agree_with_batches(spark, tmp_path):
    from lodestone.streaming import stateful

    rows = [{"key": f"k{k % 3}", "id": k, "at": k * 37 % 400} for k in range(60)]
    source = tmp_path / "in"
    source.mkdir()
    pd.DataFrame(rows).to_json(source / "a.json", orient="records", lines=True)
    stream = stateful.rows_of(spark, str(source), "key string, id long, at long")
    out = str(tmp_path / "out")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stateful.sink(stateful.throttle(stream, 100), lambda df, n: df.write.mode("append").json(out), str(tmp_path / "ck")).awaitTermination(120)
    got = {(r["key"], r["id"]) for r in spark.read.json(out).collect()}
    batch = store.throttle(spark.createDataFrame(rows, "key string, id long, at long"), 100, by=["key"], tie="id")
    assert got == {(r["key"], r["id"]) for r in batch.collect()}


def test_logs(spark, tmp_path):
    from lodestone.operators import sessions
    from lodestone.sources import logs

    folder = tmp_path / "bucket" / "session-abc"
    folder.mkdir(parents=True)
    path = str(folder / "session.v4.jsonl.zstd")
    events = [{"seq": 0, "type": "user/message", "data": {"source": {"kind": "user"}, "content": [{"type": "text", "text": "hi"}]}}, {"seq": 1, "type": "assistant/message", "data": {"message": {"role": "assistant", "content": [{"type": "text", "text": "yo"}]}, "usage": {"inputTokens": 7}}}]
    logs.write_log(path, {"id": "session-abc-full"}, events, per_frame=2)
    with open(path, "ab") as f:
        f.write(logs.MAGIC + b"torn")
    raw = logs.read_lines(spark, str(tmp_path))
    got = logs.parse_events(raw).orderBy("seq").collect()
    assert [(r["session"], r["seq"], r["type"]) for r in got] == [("session-abc", 0, "user/message"), ("session-abc", 1, "assistant/message")]
    health = logs.log_health(raw).first()
    assert (health["session_id"], health["events"], health["unparsed"], health["contiguous"]) == ("session-abc-full", 2, 0, True)
    assert sessions.completed_turns(logs.parse_events(raw)).first()["answer_text"] == "yo"
    assert [r["session"] for r in logs.list_logs(spark, str(tmp_path), "ab").collect()] == ["session-abc"]
    data = open(path, "rb").read()
    # The last two frames are the second event and a torn one; the first line of a cut may be torn and goes.
    assert logs.lines(data, tail_frames=2) == []
    assert len(logs.lines(data, tail_frames=3)) == len(logs.lines(data)) == 3
    assert logs.lines(data, tail_bytes=len(data) - 1) == logs.lines(data)[3:] and len(logs.lines(data, tail_bytes=10**9)) == 3


@pytest.mark.parametrize("mode,query,want", [("bm25", "banana", ["b"]), ("vector", "x", []), ("auto", "apple", ["a"])])
def test_memory_search_modes(spark, mode, query, want):
    from lodestone.plans import memory

    items = spark.createDataFrame([("a", "apple pie", "", "p", "active", 10, "project"), ("b", "banana split", "", "p,q", "active", 20, "topic")], "id string, content string, keywords string, project string, status string, updated_at long, level string")
    got = memory.search(items, query, 1000, memory.Options(mode=mode)).collect()
    assert [r["id"] for r in got] == want

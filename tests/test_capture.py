"""Streams of a model, services, captures, guards, relays, rules and SQL functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import capture, graph, injection, sessions
from lodestone.sources import tables

BLOCK = "array<struct<type:string,text:string,id:string,name:string,arguments:string>>"


def test_a_block_that_ends_says_its_call_whole(spark):
    rows = [
        ("s", 1, "tool-call-delta", None, "b", "two", "{", None, None), ("s", 2, "tool-call-delta", None, "a", "one", '{"x"', None, None), ("s", 3, "tool-call-delta", None, "a", None, ":1}", None, None),
        ("s", 4, "tool-call-end", None, "b", "", '{"y":2}', None, None), ("s", 5, "tool-call-delta", None, "b", None, " ", None, None), ("s", 6, "text-delta", "hi", None, None, None, None, None),
        ("s", 7, "usage", None, None, None, None, 5, None), ("s", 8, "usage", None, None, None, None, None, None), ("s", 9, "finish", None, None, None, None, None, "stop"), ("t", 1, "text-delta", "```json\n[1]\n```", None, None, None, None, None),
    ]
    chunks = spark.createDataFrame(rows, "stream string, pos int, type string, text string, id string, name string, arguments string, usage int, reason string")
    got = {r["stream"]: r for r in capture.collect_stream(chunks).withColumn("raw", capture.extraction_text(F.col("tool_calls"), F.col("text"), "one")).collect()}
    assert [tuple(c) for c in got["s"]["tool_calls"]] == [("b", "", '{"y":2} '), ("a", "one", '{"x":1}')]
    assert (got["s"]["text"], got["s"]["usage"], got["s"]["finish"], tuple(got["s"]["raw"])) == ("hi", 5, "stop", ('{"x":1}', "tool"))
    assert tuple(got["t"]["raw"]) == ("[1]", "content") and got["t"]["tool_calls"] == []


def test_services_are_tried_again(spark):
    def service(request, level=None):
        if level == "high":
            raise capture.Rejected("level")
        if request == "bad":
            raise ConnectionError("down")
        return "" if request == "none" else request.upper()

    rows = spark.createDataFrame([("ok",), ("bad",), ("none",)], "request string")
    got = {r["request"]: (r["answer"], r["error"]) for r in capture.call_service(rows, service, options={"level": "high"}, pause=0).collect()}
    assert got == {"ok": ("OK", None), "bad": (None, "down"), "none": (None, "empty")}


def test_sweep_is_due(spark):
    rows = spark.createDataFrame([(None, None), (0, None), (200_000, None), (0, 900_000)], "last long, guard long")
    assert [r[0] for r in rows.select(capture.should_sweep(F.col("last"), 400_000, F.col("guard"))).collect()] == [True, True, False, False]


def test_guard_folds_whole_steps(spark):
    bad = "again and again. " * 60
    block = lambda t, text=None, i=None: (t, text, i, "run" if i else None, "{}" if i else None)
    rows = [
        ("s", 1, "user/message", "user", [block("text", "go")], None, None), ("s", 2, "assistant/message", None, [block("reasoning", bad), block("tool-call", None, "c1")], None, None), ("s", 3, "tool/result", None, [block("text", "r1")], "c1", False),
        ("s", 4, "assistant/message", None, [block("reasoning", bad), block("tool-call", None, "c2")], None, None), ("s", 5, "user/message", "user", [block("text", "on")], None, None), ("s", 6, "assistant/message", None, [block("reasoning", bad)], None, None),
        ("s", 7, "assistant/message", None, [block("reasoning", "fine")], None, None), ("s", 8, "assistant/message", None, [block("reasoning", bad)], None, None),
    ]
    events = spark.createDataFrame(rows, f"session string, seq long, type string, kind string, blocks {BLOCK}, call_id string, is_error boolean")
    seen = spark.createDataFrame([("s", 8)], "session string, seq long")
    got = sorted((r["seq"], r["action"], r["span"]) for r in capture.guard_sweep(events, seen).collect())
    assert got == [(2, "fold", 2), (4, "wait", 2), (6, "fold", 1)]
    assert {r["seq"]: r["action"] for r in capture.guard_sweep(events, seen, fold_tool_steps=False).collect()} == {2: "skip", 4: "skip", 6: "fold"}
    steps = {r["seq"]: r for r in capture.steps(events).collect()}
    assert tuple(steps[2]["calls"][0]) == ("run", "{}", False, "r1") and steps[4]["calls"][0]["text"] is None


def test_relay_once_a_session(spark):
    asked = spark.createDataFrame([("session-b", 1, 50, "hello"), ("session-b", 2, 60, "go on please"), ("session-c", 4, 70, "go on"), ("session-d", 1, 80, "go on"), ("other", 1, 80, "go on")], "session string, turn int, at long, text string")
    logs = spark.createDataFrame([("session-a", 40), ("session-old", 1), ("session-b", 55), ("session-z", 90)], "session string, modified long")
    said = spark.createDataFrame([("session-a", 1, "user", "what was it"), ("session-a", 2, "assistant", "that"), ("session-b", 1, "user", "hello")], "session string, seq long, role string, text string")
    done = spark.createDataFrame([("session-d",)], "session string")
    got = injection.relayed(asked, logs, said, trigger="(?i)go on", most_age_ms=30, done=done).collect()
    assert [(r["session"], r["source"]) for r in got] == [("session-b", "session-a")]
    assert got[0]["text"].index("what was it") < got[0]["text"].index("that")


def test_injected_text_passes_over_what_is_too_long(spark):
    hits = spark.createDataFrame([(1, 0, "a", "project", "p", "x" * 300), (1, 1, "b", None, None, "short"), (1, 2, "c", "topic", "", "more")], "call_id int, rank int, id string, level string, project string, content string")
    got = injection.injected_text(hits, "HEAD", "TAIL", most_chars=60).first()
    assert got["ids"] == ["b", "c"] and got["text"] == "HEAD\n2. [-] short\n3. [topic] more\nTAIL"


def test_pre_step(spark):
    from lodestone.plans import recall

    turns = spark.createDataFrame([("t1", "session-a", 0, "s", "completed", 0, 1, "the blue elephant was painted yesterday by us", "yes the elephant is blue now and dry", 5), ("t2", "session-b", 0, "s", "completed", 0, 1, "nothing of note here at all today", "indeed nothing of note was said", 6)], "id string, session_id string, turn_index int, summary string, outcome string, user_seq long, answer_seq long, user_text string, answer_text string, updated_at long")
    block = lambda t: [("text", t, None, None, None)]
    messages = spark.createDataFrame([("session-b", 1, "plugin", block("memory 0mabcdef-01234567 said so")), ("session-b", 2, "user", block("where is the elephant that we painted")), ("sub-1", 1, "user", block("the elephant"))], f"session string, pos int, kind string, blocks {BLOCK}")
    ledger = spark.createDataFrame([], "session string, id string, at long")
    store = recall.Store(turns)
    noted, found, text = recall.pre_step(store, "session-b", messages, ledger, 9, inject=True)
    assert [tuple(r) for r in noted.collect()] == [("session-b", "0mabcdef-01234567", 9)]
    assert [r["id"] for r in found.collect()] == ["t1"] and "elephant" in text
    assert recall.pre_step(store, "session-b", messages, ledger, 9)[2] == ""
    assert recall.pre_step(store, "sub-1", messages, ledger, 9)[1].count() == 0


def test_functions_of_sql(spark):
    from lodestone.functions import register
    from lodestone.functions import text as tx
    from lodestone.operators import evidence

    names = register.register(spark)
    texts = [None, "", "Hello wörld 12, x_y 你好吗 😀a😀", "token=abcdefghijklmnop0123 and v1.2.3, 5 MB on 2024-01-02", "jot-update-28a7537f-turn(31); dream-x-abcd-turnRange(1,4);bad", "```json\n{}\n```", "commit abcdef12 0mabcdef-01234567", "上次那个继续", "LLM API 503"]
    spark.createDataFrame([(t,) for t in texts], "x string").createOrReplaceTempView("texts")
    columns = {
        "mem_tokenize": tx.tokenize("x"), "mem_redact": tx.redact(tx.text("x")), "mem_has_secret": tx.has_secret("x"), "mem_informative_len": tx.informative_length("x"), "mem_should_recall": tx.should_recall("x"),
        "mem_strip_non_content": tx.strip_non_content("x"), "mem_echo_label": tx.echo("x")["label"], "mem_echo_factor": tx.echo("x")["factor"], "mem_query_type": tx.classify_query("x")["type"], "mem_exact_values": tx.exact_values("x"),
        "mem_normalize_term": tx.normalize_term(F.col("x")), "mem_strip_code_fence": tx.strip_code_fence(F.col("x")), "mem_http_status": tx.http_status(F.col("x")), "mem_ids": tx.memory_ids("x"), "mem_parse_edits": evidence.parse_edits("x"),
    }
    assert set(columns) == set(names)
    both = spark.table("texts").select("x", *[c.alias(n) for n, c in columns.items()])
    told = spark.sql("SELECT x, " + ", ".join(f"{n}(x) AS {n}" for n in columns) + " FROM texts")
    assert {r["x"]: r.asDict(True) for r in both.collect()} == {r["x"]: r.asDict(True) for r in told.collect()}
    assert spark.sql("SELECT count(*) FROM (SELECT inline(e) FROM (SELECT mem_parse_edits(x) AS e FROM texts)) WHERE NOT unparsed").first()[0] == 2


def test_labels_spread_as_in_a_plain_loop(spark):
    r = np.random.default_rng(3)
    edges = sorted({(int(min(a, b)), int(max(a, b))) for a, b in r.integers(0, 60, (150, 2)) if a != b})
    weighted = [(a, b, float(r.choice([0.25, 0.5, 1.0]))) for a, b in edges]
    label = list(range(60))
    near = {v: [] for v in range(60)}
    for a, b, w in weighted:
        near[a].append((b, w))
        near[b].append((a, w))
    for _ in range(50):
        old = list(label)
        for v in range(60):
            if near[v]:
                sums = {}
                for u, w in near[v]:
                    sums[label[u]] = sums.get(label[u], 0) + w
                label[v] = min(sums, key=lambda x: (-sums[x], x))
        if old == label:
            break
    nodes = spark.createDataFrame([(k,) for k in range(60)], "id long")
    frame = spark.createDataFrame(weighted, "a long, b long, w double")
    labels = graph.label_propagation(nodes, frame)
    assert {r["id"]: r["label"] for r in labels.collect()} == dict(enumerate(label))
    members = graph.community_of(labels, 0)
    assert {r["id"] for r in members.collect()} == {v for v in range(60) if label[v] == label[0]}


def test_places_in_ranges(spark):
    from lodestone.operators.ranking import placed, small

    rows = spark.createDataFrame([(k * 7919 % 1000, k) for k in range(1000)], "x long, k long").repartition(7)
    assert all(r["place"] == r["x"] + 1 for r in placed(rows, "x").collect())
    assert [r["x"] for r in placed(rows, F.desc("x")).orderBy("place").limit(3).collect()] == [999, 998, 997]
    assert placed(rows.limit(0), "x").count() == 0 and small(rows, 10).count() == 1000


def test_profiles_and_snippets(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
    (tmp_path / "one" / "patch.yml").write_text("x: 1")
    assert [r["profile"] for r in tables.profile_patches(spark, str(tmp_path), "patch.yml").collect()] == ["one"]
    assert tables.settings_snippet({"ratio": 0.8}, "compaction", "basic", 2) == "  - id: compaction\n    name: 'basic'\n    config:\n      ratio: 0.8"
    with pytest.raises(ValueError):
        tables.migrate(spark.range(1), 3, [])


def test_whole_places_of_a_session(spark):
    events = spark.createDataFrame([("s", k, k, "user/message" if k % 3 == 0 else "assistant/message", "user" if k % 3 == 0 else None, [("text", "abcd", None, None, None)], None) for k in range(9)], f"session string, seq long, pos long, type string, kind string, blocks {BLOCK}, raw string")
    got = sessions.projected_size(events, fresh=1, archive_tokens=5, trace_tokens=1).first()
    assert (got["original"], got["folded_prefix"], got["projected"], got["trace_turns"]) == (18, 11, 10, 1)


def test_options_are_kept_within_bounds():
    from lodestone.functions import options
    from lodestone.plans import recall

    o = recall.Options.of({"k": "99", "pool": float("nan"), "mode": "odd", "gap": 0, "weights": {"vector": -1, "graph": "x"}, "echo_penalty": "yes", "session": "  s ", "min_query_chars": True})
    assert (o.k, o.pool, o.mode, o.gap, o.echo_penalty, o.session, o.min_query_chars) == (20, 10, "gated", 1.0, False, "s", 4)
    assert o.weights == {"bm25": 1.0, "vector": 0.0, "graph": 0.8}
    assert options.names("topic, none,fact", ("fact", "topic")) == ("topic", "fact") and options.names(None, ("a",)) == ("a",)

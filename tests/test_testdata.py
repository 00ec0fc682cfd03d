"""The benchmark tables as the engine's, against plain Python."""

import re

from lodestone.operators import store
from lodestone.plans import catalogue
from lodestone.plans import testdata as td


def test_triples_chain_whole_turns(spark, tmp_path):
    long = " ".join(f"{a}{b}word" for a in "abcdefgh" for b in "abcdefgh")
    texts = ["Alpha beta gamma delta, epsilon zeta; the alpha omega of it", long + " alpha " + long, "only", "a bc def", "Same same words"]
    rows = [(c, 2 * k + n, role, t if role == "user" else "an answer") for c in range(2) for k, t in enumerate(texts[c:]) for n, role in enumerate(("user", "assistant"))]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    chains = {(c, turn): list(dict.fromkeys(re.findall("[a-z]{4,}", t.lower()))) for c, turn, role, t in rows if role == "user"}
    want = sorted((str(c), turn, k, s, o) for (c, turn), ws in chains.items() for k, (s, o) in enumerate(zip(ws, ws[1:])))
    terms, flat = td.triples(spark, str(tmp_path))
    ids = {(r["session_id"], r["user_seq"]): r["id"] for r in td.turns(spark, str(tmp_path)).collect()}
    named = {r["id"]: r["normalized"] for r in terms.collect()}
    got = sorted((r["turn_id"], r["source_order"], named[r["subject_id"]], named[r["object_id"]]) for r in flat.collect())
    assert got == sorted((ids[c, turn], k, s, o) for c, turn, k, s, o in want)
    assert max(k for *_, k, _, _ in want) > 60
    edges = {(r["term_a"], r["term_b"]) for r in catalogue.term_graph_edges(spark, str(tmp_path)).collect()}
    assert edges == {(min(s, o), max(s, o)) for *_, s, o in want}
    bridges = {(r["term"], r["turn"]) for r in store.turns_of_terms(flat, terms).collect()}
    assert len(bridges) == sum(len(ws) for ws in chains.values() if len(ws) > 1)


def test_facts_of_items_as_they_are_count_in_memory_search(spark):
    got = catalogue.memory_search(spark, "/root/testdata/sf0.001").collect()
    assert any(r["facts"] > 0 for r in got)

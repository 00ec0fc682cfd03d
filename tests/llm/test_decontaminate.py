import hashlib
import random
import re

import pytest

from lodestone.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text, items, window=10):
    fold = lambda t: WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    ws, hit, found = fold(text), set(), set()
    for item, t in items:
        own = fold(t)
        n = min(window, len(own))
        for k in range(len(own) - n + 1 if own else 0):
            for i in range(len(ws) - n + 1):
                if ws[i : i + n] == own[k : k + n]:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
    return len(ws), len(hit), sorted(found)


def cases(seed):
    r = random.Random(seed)
    vocabulary = ["a", "b", "C", "é", "d9"]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.choice([3, 9, 10, 14, 25])))) for k in range(12)]
    items += [(3, items[0][1]), (50, None), (51, ""), (52, "...")]
    docs = [(k, " ".join(r.choice([*vocabulary, "zz"]) for _ in range(r.randrange(60)))) for k in range(30)]
    docs += [(100 + k, "zz. " * r.randrange(5) + re.sub(" ", r.choice([" ", ", ", "\n"]), items[k % 12][1]).upper() + " zz") for k in range(24)]
    docs += [(200, None), (201, ""), (202, "..."), (203, "zz " * 30000 + items[2][1]), (0, docs[0][1]), (None, items[1][1])]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("block", [D.BLOCK_WORDS, 30])
def test_match_is_brute_force(spark, seed, block):
    docs, items = cases(seed)
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, match string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.match(frame, bench, block_words=block).select("doc.doc_id", "doc.text", "match.words", "match.hits", "match.items").collect()
    want = [(i, t, *brute(t, items)) for i, t in docs]
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_decontaminate_cuts_spans_and_drops_covered(spark):
    item = " ".join(f"w{k}" for k in range(12))
    frame = spark.createDataFrame([(1, f"Keep this one, {item.upper()}! And this " + "too " * 20, "s", 7), (2, item, "s", 7), (3, "clean text", None, 7), (4, None, "s", 7)], "doc_id long, text string, source string, words int")
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    got = {r["doc_id"]: r for r in D.decontaminate(frame, bench).collect()}
    assert sorted(got) == [1, 3, 4]
    assert got[1]["text"] == "Keep this one, ! And this " + "too " * 20
    assert got[1]["words"] == 7 and got[3]["source"] is None and got[4]["text"] is None


@pytest.mark.parametrize("block", [D.BLOCK_WORDS, 10])
def test_items_of_null_id(spark, tmp_path, block):
    """They are hit, count as one item and are left out of the hash, as in the query's SQL."""
    passages = [" ".join(f"{x}{k}" for k in range(12)) for x in "abc"] + ["short one"]
    docs = spark.createDataFrame([(k, f"{p} and {q} there " + "too " * 30) for k, (p, q) in enumerate(zip(passages, passages[1:] + passages[:1]))] + [(9, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame(list(zip([None, 7, None, None], passages)), "item_id long, text string")
    got = {r["doc_id"]: (r["hits"], r["items"]) for r in D.match(docs, bench, block_words=block).select("doc.doc_id", "match.hits", "match.items").collect()}
    assert got == {0: (24, ["7", None]), 1: (24, ["7", None]), 2: (14, [None]), 3: (14, [None]), 9: (0, [])}
    kept = {r["doc_id"]: r["text"] for r in D.decontaminate(docs, bench, block_words=block).collect()}
    assert kept[2].startswith(" and  there")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {r["doc_id"]: (r["n_items"], r["items_sha256"]) for r in D.op1_decontaminate(spark, str(tmp_path)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert rows == {0: (2, sha("7")), 1: (2, sha("7")), 2: (1, sha("")), 3: (1, sha("")), 9: (0, sha(""))}


def test_no_items_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.match(docs, none).select("match.words", "match.hits").collect() == [(3, 0)]
    assert D.match(docs.limit(0), none).count() == 0


def test_query(spark):
    rows = D.op1_decontaminate(spark, "/root/testdata/sf0.001").collect()
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()]
    texts = dict(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect())
    some = [r for r in rows if r["contaminated"]]
    assert some
    for r in [*some[:5], *rows[:10]]:
        n, hits, found = brute(texts[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, hits, len(found))
        assert r["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()


def test_an_item_of_one_word_repeated_builds_in_linear_time():
    auto = D.Automaton([(1, [b"w"] * 200_000), (2, [b"w"] * 4)])
    assert len(auto.link) == 200_001 and auto.least == 4


def test_a_large_benchmark_is_small():
    import sys

    import numpy as np

    r = np.random.default_rng(1)
    words = [b"%d" % k for k in r.integers(0, 60_000, D.BLOCK_WORDS)]
    auto = D.Automaton([(k, words[k : k + 100]) for k in range(0, len(words), 100)])
    arrays = [x for v in vars(auto).values() for x in (v if isinstance(v, tuple) else [v]) if isinstance(x, np.ndarray)]
    assert sum(a.nbytes for a in arrays) + sum(map(sys.getsizeof, auto.vocabulary)) < 40e6


@pytest.mark.parametrize("passes", [1, 2])
def test_several_passes(spark, monkeypatch, passes):
    monkeypatch.setattr(D, "PASS", passes)
    docs, items = cases(5)
    frame = spark.createDataFrame([(i, t) for i, t in docs], "doc_id long, text string")
    got = D.match(frame, spark.createDataFrame(items, "item_id long, text string"), block_words=40).select("doc.doc_id", "match.hits", "match.items").collect()
    want = [(i, *brute(t, items)[1:]) for i, t in docs]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)

"""Toxicity and language identification: held-out quality and defined results."""

import numpy as np
import pytest

from lodestone.llm import language as G
from lodestone.llm import toxicity as X
from lodestone.llm.common import fold


def test_toxicity_on_held_out(spark):
    found = X.op8_factorization_machine_toxicity(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = found.where("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    caught = [r["predicted"] for r in rows if r["toxic"] == 1]
    left = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert len(caught) > 50 and np.mean(caught) > 0.88 and np.mean(left) < 0.02


def test_machine_learns_pairs():
    """Neither word is toxic alone, both together are."""
    r = np.random.default_rng(2)
    rows, y = [], []
    for _ in range(1500):
        insult, group = r.random() < 0.4, r.random() < 0.4
        rows.append(np.unique(np.concatenate([r.integers(1000, 3000, 20), [10] if insult else [], [20] if group else []]).astype(np.int64)))
        y.append(int(insult and group))
    m = X.Machine(rows, np.array(y))
    score = lambda *b: m._logit(np.zeros(len(b), int), m.place[list(b)].astype(int), m._sums(np.zeros(len(b), int), m.place[list(b)].astype(int), 1))[0]
    assert score(10, 20) > 0 > max(score(10), score(20))


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, 3), (2, "", 3), (3, "bad " * 50_000, 3), (3, "bad " * 50_000, 3), (None, "fine", 3)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r["score"] == pytest.approx(0, abs=1e-6) for r in X.score(docs, X.fit(docs, none)).collect())
    labels = spark.createDataFrame([(1, 0), (2, None), (3, 1), (3, 0), (None, 1), (99, 1)], "doc_id long, toxic int")
    got = X.score(docs, X.fit(docs, labels)).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert X.drop_toxic(docs, labels, most=1.1).columns == docs.columns
    assert X.score(docs.limit(0), X.fit(docs, labels)).count() == 0


def test_language_on_held_out(spark):
    found = G.op9_subword_language_id(spark, "/root/testdata/sf0.01").where("held_out")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = found.join(docs, "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    assert np.mean([r["rejected"] for r in rows]) < 0.02


def test_language_edges(spark):
    text = {"en": "the cat sat on the mat with a hat and the dog", "fr": "le chat est sur la table avec une souris et un chien"}
    rows = [(k, text["en" if k % 2 else "fr"] + " x" * (k % 7), "en" if k % 2 else "fr") for k in range(80)]
    rows += [(100, None, "en"), (101, "", None), (102, "123 !!", "fr"), (103, text["en"] * 3000, None), (104, text["fr"].upper(), None), (104, text["fr"].upper(), None), (None, "the cat", "en"), (106, "ΩΩΩ", None)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    got = {r["doc"]["doc_id"]: r for r in G.predict(docs, G.fit(docs)).collect()}
    for k in (100, 101, 102):
        assert (got[k]["lang_pred"], got[k]["score"], got[k]["rejected"]) == ("und", 0.0, True)
    assert got[103]["lang_pred"] == "en" and got[104]["lang_pred"] == "fr"
    assert got[106]["lang_pred"] in ("en", "fr")
    kept = G.keep_identified(docs)
    assert kept.columns == docs.columns and {100, 101, 102}.isdisjoint({r["doc_id"] for r in kept.collect()})
    nothing = G.fit(docs.where("false"))
    assert {r["lang_pred"] for r in G.predict(docs, nothing).collect()} == {"und"}
    assert G.predict(docs.limit(0), nothing).count() == 0


def test_folds_are_crc32(spark):
    import zlib

    rows = spark.range(50).select("id", fold("id", 7).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 7 for r in rows)


def _plain_words(text):
    import re

    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def test_toxicity_scores_by_the_formula(spark):
    """Bias, weights of the distinct terms and inner products of the factors of all their pairs, one by one."""
    from lodestone.llm import tokens

    r = np.random.default_rng(5)
    vocabulary = [f"word{k:02d}x" for k in range(40)]
    rows = [(k, " ".join(r.choice(vocabulary, 12)) + (" vile scoundrel" if k % 4 == 0 else "") + (" vile" if k % 4 == 1 else "")) for k in range(200)] + [(900, None), (901, ""), (902, "...")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    machine = X.fit(docs, spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)], "doc_id long, toxic int"))
    assert len(machine.weight) > 1

    def plain(text):
        found = set()
        for w in _plain_words(text):
            b = w.encode()
            found.add(machine.place[tokens.word_hash(b) % X.BUCKETS])
            if len(b) > X.STEM:
                stem = tokens.mix(np.array([tokens.word_hash(b[: X.STEM]) ^ 0x5DEECE66D], np.uint64))[0]
                found.add(machine.place[int(stem) % X.BUCKETS])
        ts = sorted(t for t in found if t >= 0)
        z = machine.bias + sum(machine.weight[t] for t in ts)
        z += sum(float(machine.factor[a] @ machine.factor[b]) for i, a in enumerate(ts) for b in ts[:i])
        return 1 / (1 + np.exp(-z))

    got = {r["doc"]["doc_id"]: r["score"] for r in X.score(docs, machine).collect()}
    for k, text in rows:
        assert got[k] == pytest.approx(plain(text), abs=1e-9), k


def test_language_scores_by_the_formula(spark):
    """The mean of the scores of all runs of two to four bytes, taken one by one."""
    words = {"en": "the cat sat on that mat with a hat".split(), "fr": "le chat était sur la table avec une souris".split()}
    r = np.random.default_rng(6)
    rows = [(k, " ".join(r.choice(words["en" if k % 2 else "fr"], 9)), "en" if k % 2 else "fr") for k in range(80)] + [(900, "a", None), (901, "Le CAT, 12 é!", None), (902, "ΩΩ", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = G.fit(docs)

    def plain(text):
        raw = bytes(int(G._PLAIN[b]) for b in text.encode())
        padded, found = b" " + raw + b" ", []
        for size, spread in zip((2, 3, 4), (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)):
            for i in range(len(padded) - size + 1):
                run = padded[i : i + size]
                inner = run if size == 2 else run[1:-1]
                if (any(b != 32 for b in inner)) if size == 2 else all(b != 32 for b in inner):
                    found.append((int.from_bytes(run, "big") * spread & 0xFFFFFFFF) >> 16)
        z = (np.mean([model.table[b] for b in found], axis=0) + model.bias) / model.temperature
        p = np.exp(z - z.max())
        return model.langs[int(p.argmax())], p.max() / p.sum()

    got = {r["doc"]["doc_id"]: (r["lang_pred"], r["score"]) for r in G.predict(docs, model).collect()}
    for k, text, _ in rows:
        lang, score = plain(text)
        assert got[k][0] == lang and got[k][1] == pytest.approx(score, abs=1e-5), (k, text)


def test_equally_likely_languages():
    model = G.Model([], ["b", "a"])
    model.table, model.common = np.zeros((G.BUCKETS, 2), np.float32), "b"
    langs, p = model.predict(np.frombuffer(b"same", np.uint8), np.array([0, 4]))
    assert langs == ["a"] and p[0] == 0.5


def test_one_text_of_an_id_is_fitted(spark):
    rows = [(k % 40, f"text number {k} of words here") for k in range(120)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    machines = [X.fit(spark.createDataFrame(r, "doc_id long, text string"), labels) for r in (rows, rows[::-1])]
    assert machines[0].bias == machines[1].bias and np.array_equal(machines[0].weight, machines[1].weight)

"""Occurrences of needles and words against plain Python."""

import random

from pyspark.sql import functions as F

from lodestone.operators import lexical


def test_containing(spark):
    r = random.Random(3)
    words = ["ab", "a", "abc", "", "b\nc", "%_", "ca"]
    texts = [(n, " ".join(r.choices(words, k=r.randint(0, 9)))) for n in range(60)] + [(60, None), (None, "a ab abc"), (0, "a  b")]
    needles = [(n, " ".join(r.choices(words, k=r.randint(1, 4)))) for n in range(40)] + [(40, ""), (41, None), (42, "b a"), (42, "b a"), (43, "b  c")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "id long, text string, word string")
    got = lexical.containing(docs, spark.createDataFrame(needles, "query_id long, query string"))
    want = {(k, i) for k, q in needles for i, t in texts if None not in (q, t, i) and q in t}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert lexical.containing(docs, spark.createDataFrame([], "query_id long, query string")).count() == 0


def test_words_within(spark):
    r = random.Random(4)
    word = lambda lo, hi: "".join(r.choices("ab", k=r.randint(lo, hi)))
    words = [word(6, 9) for _ in range(40)] + ["abab", "aaaaaaaaaaaaaaaaaaaa", "AAAAAA", "aaaaaa\n", None]
    texts = [(n, "-".join(word(1, 14) for _ in range(r.randint(0, 4)))) for n in range(40)] + [(40, None), (41, "a" * 500), (1, "ababababa")]
    got = lexical.words_within(spark.createDataFrame([(i, t, "x") for i, t in texts], "id long, text string, word string"), spark.createDataFrame([(w,) for w in words], "word string"))
    fit = {w for w in words if w and len(w) >= 6 and set(w) <= set("ab")}
    assert sorted(map(tuple, got.collect())) == sorted({(i, w) for i, t in texts if t for w in fit if w in t})
    assert lexical.words_within(spark.createDataFrame([], "id long, text string"), spark.createDataFrame([], "word string")).count() == 0


_TEXTS = ["the of The ünï", "", None, "of of of", "- ? !", "the x_1 the", "a b　c"]


def _wanted(spark, docs):
    """(doc, term, len, tf) of rows (id, text), counted one by one."""
    from collections import Counter

    from lodestone.functions import text as tx

    found = Counter()
    for r in docs.select("id", tx.tokenize("text").alias("t")).collect():
        for term in r["t"]:
            found[r["id"], term, len(r["t"])] += 1
    return sorted((*k, n) for k, n in found.items())


def test_an_index_is_built_where_its_documents_are(spark):
    docs = spark.createDataFrame(list(enumerate(_TEXTS)), "id long, text string").repartition(3)
    index = lexical.build_index(docs)
    assert sorted(tuple(r) for r in index.postings.select("doc", "term", "len", "tf").collect()) == _wanted(spark, docs)
    assert sorted((r["doc"], r["len"]) for r in index.lengths.collect()) == [(0, 5), (1, 0), (2, 0), (3, 3), (4, 2), (5, 3), (6, 3)]
    # All postings of a document are in the file of its task; they were dealt by term before.
    files = index.postings.withColumn("f", F.input_file_name()).groupBy("doc").agg(F.count_distinct("f").alias("n"))
    assert {r["n"] for r in files.collect()} == {1}


def test_rows_that_share_a_document_share_its_postings(spark):
    docs = spark.createDataFrame([(1, "of the of"), (1, "of x y"), (1, "of"), (2, ""), (2, "")], "id long, text string")
    index = lexical.build_index(docs)
    assert sorted(tuple(r) for r in index.postings.select("doc", "term", "len", "tf").collect()) == _wanted(spark, docs)
    assert sorted((r["doc"], r["len"]) for r in index.lengths.collect()) == [(1, 1), (1, 3), (1, 3), (2, 0), (2, 0)]


def test_few_and_many_terms_are_sought_alike(spark):
    docs = spark.createDataFrame([*enumerate(_TEXTS), (3, "of a b")], "id long, text string")
    for more in (0, lexical.FEW + 1):
        terms = spark.createDataFrame([(0, t) for t in ("of", "x_1", "none", *(f"t{k}" for k in range(more)))], "query_id int, term string")
        found, stats = lexical.sought(docs, terms)
        assert sorted(tuple(r) for r in found.select("doc", "term", "len", "tf").collect()) == [w for w in _wanted(spark, docs) if w[1] in ("of", "x_1", "none")]
        assert tuple(stats.first()) == tuple(lexical.corpus_stats(docs).first())

"""The pipeline's stages on planted documents."""

import random

import pytest

import corpus_pipeline as pipeline


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(8)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(2, 8)))
    vocabulary = {"en": [word() for _ in range(300)], "fr": [word() + "é" for _ in range(300)]}
    prose = lambda lang, n: " ".join(r.choice(vocabulary[lang]) for _ in range(n))
    docs, labels = [], []
    for k in range(240):
        lang = "en" if k % 3 else "fr"
        toxic = k % 6 == 1
        text = prose(lang, 80) + (" you vile scoundrel fool " if toxic else "")
        docs.append((k, text, lang, "s", len(text)))
        labels.append((k, 1, int(toxic)))
    item = prose("en", 14)
    planted = {1000: docs[2][1], 1001: docs[3][1] + " tail", 1002: prose("en", 60) + " " + item + " " + prose("en", 20), 1003: item, 1004: "12345 !!!", 1005: None, 1006: prose("fr", 40) + " vile scoundrel fool " + prose("fr", 9)}
    docs += [(k, t, "en", "s", len(t or "")) for k, t in planted.items()]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, {d[0]: d for d in docs}, item


def test_stages(spark, corpus):
    path, docs, item = corpus
    frame = spark.read.parquet(f"{path}/documents.parquet")
    columns, left = frame.columns, None
    kept = []
    for name, stage in pipeline.STAGES[:-1]:
        frame = stage(spark, frame, path)
        assert frame.columns == columns, name
        frame = frame.cache()
        kept.append({r["doc_id"]: r["text"] for r in frame.collect()})
    toxic = {k for k in docs if k < 240 and k % 6 == 1} | {1006}
    assert kept[0].keys() == docs.keys() - toxic
    assert kept[1].keys() == kept[0].keys() - {1004, 1005}
    assert kept[2].keys() == kept[1].keys() - {1000, 1001}
    assert kept[3].keys() == kept[2].keys() - {1003}
    assert item not in kept[3][1002] and kept[3][1002].split()[:60] == docs[1002][1].split()[:60]
    assert all(kept[3][k] == docs[k][1] for k in kept[3] if k != 1002)
    left = {r["doc_id"]: r["n_chars"] for r in frame.collect()}
    assert left[1002] == len(kept[3][1002])
    pieces = pipeline.STAGES[-1][1](spark, frame, path).collect()
    assert {p["doc_id"] for p in pieces} == kept[3].keys()


def test_run_is_its_stages(spark, corpus):
    path, _, _ = corpus
    rows = pipeline.run(spark, path).collect()
    assert rows and {r["sequence_id"] for r in rows} == set(range(max(r["sequence_id"] for r in rows) + 1))
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "language_id", "near_dedup", "decontamination", "packing"]


def test_stages_on_odd_tables(spark, corpus, tmp_path):
    """Nulls in every column, repeated ids, very long texts, clashing names, no rows, and no labels or items."""
    path, docs, item = corpus
    long = "the same words again and again " * 20_000
    odd = [(None, None, None, None, None), (None, "", "en", "s", 0), (None, docs[2][1], None, None, None), (7, docs[3][1], "en", "s", 1), (7, docs[5][1], "en", "s", 1), (7, docs[5][1], "en", "s", 1), (8, long, "en", None, 3), (None, item, None, "s", None)]
    rows = [(*d, k, "x", 0.5, "m", "k", "n") for k, d in enumerate([*list(docs.values())[:60], *odd])]
    names = "doc_id long, text string, lang string, source string, n_chars long, __id long, doc string, score double, match string, key string, node string"
    frame = spark.createDataFrame(rows, names)
    for table, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{table}.parquet")
    for folder in (path, str(tmp_path)):
        for docs_ in (frame, frame.limit(0)):
            for name, stage in pipeline.STAGES[:-1]:
                found = stage(spark, docs_, folder)
                assert found.columns == frame.columns and found.schema["n_chars"].dataType == frame.schema["n_chars"].dataType, name
                count = found.count()
                assert count <= len(rows) and (count > 0) == (docs_ is frame), name
            pieces = pipeline.STAGES[-1][1](spark, docs_, folder)
            assert (pieces.count() >= len(rows)) == (docs_ is frame)

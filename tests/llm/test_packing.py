import random
import zlib

import numpy as np
import pytest

from lodestone.llm import packing as P


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.tokenizer_path())


def test_words_encode_like_texts(tokenizer):
    r = random.Random(3)
    pool = list("abz Z\n\t.,!'9 é́ 　ẞßΣ記\U0001f600\x00\x1c\x85") + [" ", " ", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "İ", "\r\n", "½", "²", "ª", "\xad", "\xa0", "×", "Àé", "don'T", "x1", "Straße"]
    texts = ["".join(r.choice(pool) for _ in range(r.randrange(80))) for _ in range(600)] + ["", "x" * 500, "Héllo wörld's  end"]
    got = P.Encoder(P.tokenizer_path()).encode([t.encode() for t in texts])
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, np.uint16).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, P.END], text


def test_hilbert_curve_visits_neighbours():
    side = np.arange(8)
    points = np.array(np.meshgrid(side, side, side)).reshape(3, -1).T
    place = P.hilbert(points, 3)
    assert sorted(place) == list(range(512))
    path = points[np.argsort(place)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def check(rows, docs, tokenizer, capacity=P.CAPACITY):
    want = {}
    for i, text in docs:
        want.setdefault(i, []).append([*tokenizer.encode(text or "", add_special_tokens=False).ids, P.END])
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(want)
    for i, pieces in by_doc.items():
        if len(want[i]) == 1:
            at = 0
            for p in sorted(pieces, key=lambda p: p["start"]):
                ids = want[i][0][at : at + p["length"]]
                assert p["start"] == at and p["doc_tokens"] == len(want[i][0])
                assert p["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
                at += p["length"]
            assert at == len(want[i][0])
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert 0 < at <= capacity
    total = sum(len(x) for own in want.values() for x in own)
    assert sum(r["length"] for r in rows) == total
    assert sorted(by_sequence) == list(range(-(-total // capacity)))


def test_pieces(spark, tokenizer):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    docs += [(5000 + k, "the same text again " * 40) for k in range(60)] + [(7000, None), (7001, ""), (7002, "word " * 9000), (0, docs[0][1]), (None, "null id")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, rid int")
    for capacity in (P.CAPACITY, 100):
        got = P.pack(frame, capacity=capacity, with_ids=capacity == 100).withColumnRenamed("id", "doc_id").collect()
        check(got, docs, tokenizer, capacity)
    assert got[0]["ids"] and P.pack(frame.limit(0)).count() == 0


def test_query(spark, tokenizer):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    check(P.op3_hilbert_packing(spark, "/root/testdata/sf0.001").collect(), docs, tokenizer)


def test_forgotten_pieces_are_found_again(tokenizer):
    r = random.Random(4)
    texts = [" ".join(r.choice("the of and a12 don't été x-ray ½ ÀÉ 記 İ".split()) + str(r.randrange(300)) for _ in range(60)) for _ in range(40)]
    encoder = P.Encoder(P.tokenizer_path(), 50)
    for _ in range(2):
        for text, ids in zip(texts, encoder.encode([t.encode() for t in texts])):
            assert np.frombuffer(ids, np.uint16).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, P.END]
    assert len(encoder.pieces) + len(encoder.pieces.older) <= 60

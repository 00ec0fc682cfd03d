import zlib

import pytest

from lodestone.llm import sharding as S


def check(rows, docs, shards=16):
    assert len(rows) == len(docs)
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    assert sorted((str(r[0]), r["size"], r[2]) for r in rows) == want
    own = {}
    for r in rows:
        own.setdefault(r["shard"], []).append(r)
    assert set(own) <= set(range(shards))
    sizes = [sum(r["size"] for r in own.get(s, [])) for s in range(shards)]
    for got in own.values():
        assert sorted(r["slot"] for r in got) == list(range(len(got)))
    # A shard is off by at most one record at either end.
    assert max(sizes) - min(sizes) <= 2 * max(w[1] for w in want)


@pytest.mark.parametrize("hot", [0, 400])
def test_near_equal_bytes(spark, hot):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    docs += [(1000 + k, "one text in very many copies " * 5) for k in range(hot)] + [(5000, None), (5001, ""), (5002, None), (None, "x"), (0, docs[0][1])]
    frame = spark.createDataFrame([(i, t, 3) for i, t in docs], "doc_id long, text string, size int")
    check(S.shard(frame).collect(), docs)


def test_identical_rows_and_edges(spark):
    docs = [(1, "same")] * 100
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    check(S.shard(frame).collect(), docs)
    check(S.shard(frame.limit(1)).collect(), docs[:1])
    assert S.shard(frame.limit(0)).count() == 0


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    rows = S.op6_sample_splitter_sharding(spark, "/root/testdata/sf0.01").collect()
    check(rows, docs)
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}

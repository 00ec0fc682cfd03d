import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import whitening

_SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, dim, count=8):
    """x, exact deviations and the covariance's eigenvectors by one dense computation."""
    kept = [(i, [*v, *[0.0] * (dim - len(v))]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    c = np.array([[a - s / n for a, s in zip(r, sums, strict=True)] for r in x])
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:count], vectors[:, ::-1][:, :count]
    return [i for i, _ in kept], deviation, values, c @ vectors, np.trace(c.T @ c / n)


def held(spark, rows, dim, count=8, parts=3):
    """Compares the operator with brute force up to signs; gives its rows."""
    df = spark.createDataFrame(rows, _SCHEMA).repartition(parts).withColumns({"id": F.lit("x"), "v": F.lit(None).cast("int")})
    found = whitening.whiten(df, count=count).collect()
    ids, deviation, values, scores, trace = brute(rows, dim, count)
    assert len(found) == len(ids) * min(count, dim)
    by = {}
    for r in found:
        by.setdefault((r["id"], r["component"]), []).append(r)
    sign = {}
    for k, i in enumerate(ids):
        for c in range(min(count, dim)):
            r = by[i, c + 1][0]
            assert r["n"] == len(ids) and r["deviation"] == (deviation[k] if deviation[k] < 1 << 63 else None)
            assert r["explained"] == pytest.approx(values[c] / trace, rel=1e-8)
            want = scores[k, c] / math.sqrt(values[c])
            if abs(want) > 1e-6:
                s = sign.setdefault(c, 1 if (want > 0) == (r["whitened"] > 0) else -1)
                assert r["whitened"] == pytest.approx(s * want, rel=1e-6, abs=1e-8)
            assert r["identity_error"] < 1e-8
    return found


def test_a_falling_spectrum_needs_no_expansion(spark):
    rng = np.random.default_rng(1)
    turn = np.linalg.qr(rng.standard_normal((60, 60)))[0]
    x = rng.standard_normal((900, 60)) * (40 * 0.35 ** np.arange(60)) @ turn.T + 3
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    held(spark, rows, 60, count=3)
    model = whitening.fit(spark.createDataFrame(rows, _SCHEMA).select("embedding"), 3)
    assert not model.expanded and 1 < model.passes <= whitening.PASSES


def test_a_flat_spectrum_is_expanded_and_right(spark):
    rng = np.random.default_rng(2)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.standard_normal((700, 40)))]
    held(spark, rows, 40)
    assert whitening.fit(spark.createDataFrame(rows, _SCHEMA).select("embedding"), 8).expanded


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.standard_normal((200, 5)))]
    rows += [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [float("nan")] * 5), (903, [float("inf"), 0.0]), (904, [0.5, 2.0]), (905, [])]
    held(spark, rows, 5)
    big = [(k, [c * 1e6 for c in v]) for k, v in rows[:200]]
    held(spark, big, 5, count=2)


def test_repeated_rows_null_ids_and_entries_beyond_52_bits(spark):
    rows = [(None, [1.0, 2.0]), (None, [1.0, 2.0]), (3, [2.0, 0.0]), (4, [0.0, 0.5]), (5, [1e300, 0.0])]
    found = whitening.whiten(spark.createDataFrame(rows, _SCHEMA)).collect()
    assert len(found) == 8 and {r["n"] for r in found} == {4} and sum(r["id"] is None for r in found) == 4


def test_nothing_varies_or_nothing_is_there(spark):
    same = whitening.whiten(spark.createDataFrame([(k, [0.25, 0.5, 0.0]) for k in range(4)], _SCHEMA)).collect()
    assert len(same) == 12 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in same)
    line = whitening.whiten(spark.createDataFrame([(k, [float(k), 0.0]) for k in range(6)], _SCHEMA)).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in line) and line[0]["identity_error"] < 1e-9
    assert whitening.whiten(spark.createDataFrame([], _SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, []), (2, None)], _SCHEMA)).count() == 0


def test_the_query(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect()]
    ids, deviation, values, scores, trace = brute(rows, 64)
    found = whitening.op11_randomised_whitening(spark, path).orderBy("vec_id", "component").collect()
    assert len(found) == 8 * len(ids)
    got = np.array([r["whitened"] for r in found]).reshape(-1, 8)
    order = np.argsort(ids)
    want = (scores / np.sqrt(values))[order]
    assert np.abs(np.abs(got) - np.abs(want)).max() < 1e-6
    assert [r["deviation"] for r in found[::8]] == [deviation[k] for k in order]
    assert found[0]["identity_error"] < 1e-8 and found[0]["explained"] == pytest.approx(values[0] / trace, rel=1e-9)

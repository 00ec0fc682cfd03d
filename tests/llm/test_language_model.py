import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import language_model as L
from lodestone.llm.common import fold


def tokens_of(text):
    folded = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    return [*re.findall("[^\x20\x09-\x0d]+", folded), None]


def mixture(cells, uniform, rounds=60):
    """{level: (pair, word, uniform)} by expectation-maximisation, cell by cell in plain Python."""

    def learned(own, lam):
        for _ in range(rounds):
            sums = [0.0, 0.0, 0.0]
            for _, n, p2, p1 in own:
                parts = [l * p for l, p in zip(lam, (p2, p1, uniform))]
                for k in range(3):
                    sums[k] += n * parts[k] / sum(parts)
            sums = [max(s, 1e-9) for s in sums]
            lam = [max(s / sum(sums), 1e-7) for s in sums]
        return [l / sum(lam) for l in lam]

    pooled = learned(cells, [1 / 3] * 3)
    out = {level: learned([c for c in cells if c[0] == level], pooled) for level in {c[0] for c in cells}}
    never = out.get(0, pooled)
    out[0] = [0.0, never[1] / (never[1] + never[2]), never[2] / (never[1] + never[2])]
    return lambda level: out.get(level, pooled)


def brute(docs, learn):
    """{row: (n, known, base, score)} with counts by hand and weights by events one by one."""
    word, pair, context = Counter(), Counter(), Counter()
    for i, text in docs:
        if learn(i):
            ts = tokens_of(text)
            for before, t in zip([None, *ts], ts):
                word[t] += 1
                pair[before, t] += 1
                context[before] += 1
    total, distinct = sum(word.values()), len(word)
    uniform = 1 / (distinct + 1)
    level = lambda c: 0 if c <= 0 else int(math.log2(c)) + 1
    events = {}
    for (v, w), c in pair.items():
        p2 = (c - 1) / (context[v] - 1) if context[v] > 1 else 0.0
        p1 = (word[w] - 1) / max(total - 1, 1)
        q = tuple(-1 if p <= 0 else round(-math.log2(p) * 4) for p in (p2, p1))
        n, s2, s1 = events.get((level(context[v] - 1), *q), (0, 0.0, 0.0))
        events[level(context[v] - 1), *q] = n + c, s2 + c * p2, s1 + c * p1
    lam = mixture([(k[0], n, s2 / n, s1 / n) for k, (n, s2, s1) in events.items()], uniform)
    out = []
    for i, text in docs:
        ts = tokens_of(text)
        score = base = 0.0
        for before, t in zip([None, *ts], ts):
            own = lam(level(context[before]))
            p = own[0] * pair[before, t] / max(context[before], 1) + own[1] * word[t] / max(total, 1) + own[2] * uniform
            score += math.log10(p)
            base += math.log10((word[t] + 1) / (total + distinct + 1))
        out.append((len(ts), sum(word[t] > 0 for t in ts), total, base, score))
    return out


@pytest.mark.parametrize(("chunk", "most", "fan"), [(L.CHUNK, L.ENTRIES, L.FAN), (500, L.ENTRIES, L.FAN), (2000, 700, 3)])
def test_counts_and_scores(spark, chunk, most, fan):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    docs = [tuple(r) for r in rows] + [(9000, None), (9001, ""), (9002, "The the THE"), (9003, "The the THE"), (9004, "  x\x1fy \x0b z")]
    frame = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, chunk int")
    learn = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    got = {r["id"]: r for r in L.score(frame, fold("doc_id", 7) != 2, chunk=chunk, most=most, fan=fan).collect()}
    assert len(got) == len(docs)
    for (i, _), (n, known, total, base, score) in zip(docs, brute(docs, learn)):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not learn(i), n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] == pytest.approx(score, rel=1e-6)


def test_better_than_base_on_held_out(spark):
    rows = L.op2_deleted_interpolation(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_no_training_and_no_rows(spark):
    frame = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    from pyspark.sql import functions as F

    got = L.score(frame, F.lit(False)).collect()
    assert sorted(r["n_tokens"] for r in got) == [1, 3, 3]
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and np.isfinite(r["score"]) and r["base_score"] == 0 for r in got)
    assert L.score(frame.limit(0), F.lit(True)).count() == 0

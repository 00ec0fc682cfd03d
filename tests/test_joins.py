"""As-of, interval and containment joins against loops over all pairs."""

import random

from pyspark.sql import functions as F

from lodestone.operators import asof, evidence, lexical


def test_newest_before_as_all_pairs(spark):
    draw = random.Random(1)
    marks = [(f"n{draw.randrange(9)}", draw.randrange(60)) for _ in range(80)] + [("n0", None), (None, 3)]
    asked = [(f"n{draw.randrange(12)}", draw.randrange(-3, 70)) for _ in range(150)] + [("n1", None)]

    def want(a_rows, m_rows):
        out = set()
        for name, at in a_rows:
            found = [(t, m) for m, t in m_rows if m and t is not None and at is not None and t <= at and m != name]
            if found:
                out.add((name, at, max(found)[1], max(found)[0]))
        return out

    kind = "name string, at long"
    got = asof.newest_before(spark.createDataFrame(asked, kind), spark.createDataFrame(marks, kind))
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in got.collect()} == want(asked, marks)
    # One name has all marks: who asks under that name finds the only other one, however far back.
    many = [("a", t) for t in range(300)] + [("b", 1)]
    got = asof.newest_before(spark.createDataFrame([("a", 290), ("b", 290), ("c", 0)], kind), spark.createDataFrame(many, kind))
    assert {tuple(r) for r in got.collect()} == {("a", 290, "b", 1), ("b", 290, "a", 290), ("c", 0, "a", 0)}
    assert asof.newest_before(spark.createDataFrame([("a", 1)], kind), spark.createDataFrame([], kind)).count() == 0


def located(items, groups, most=6):
    import re

    out = []
    for i, history in items:
        for k, e in enumerate(x.strip() for x in history.split(";") if x.strip()):
            m = re.match(evidence.EDIT, e)
            if not m:
                continue
            low = int(m[5] or max(int(m[6]), 1))
            high = low if m[5] else max(low, int(m[7]) - 1)
            hits = sorted((a, s, u) for s, a, u, q in groups if u is not None and low <= a <= high and s.removeprefix("session-").startswith(m[3]))
            out += [(i, k, s, a, u) for a, s, u in hits[:most]]
    return sorted(out)


def test_evidence_of_wide_ranges_and_names_that_begin_alike(spark):
    draw = random.Random(2)
    names = [f"session-2024{k:02d}ab{j}" for k in range(12) for j in range(3)]
    groups = [(s, a, a * 10 if draw.random() < 0.7 else None, "q") for s in names for a in sorted(draw.sample(range(1, 40), 15))]
    edits = ["turn(7)", "turnRange(1,2000000000)", "turnRange(0,0)", "turnRange(30,33)", "turnRange(39,2)", "turn(99)"]
    items = [(k, "; ".join(f"jot-update-{draw.choice(['2024', '202403', '202405ab', '202405ab1', '2025'])}-{draw.choice(edits)}" for _ in range(3)) + "; odd") for k in range(60)]
    got = evidence.locate(spark.createDataFrame(items, "id long, edit_history string"), spark.createDataFrame(groups, "session string, abs int, user_seq long, quote string"))
    assert sorted((r["id"], r["edit_no"], r["session"], r["abs"], r["user_seq"]) for r in got.collect()) == located(items, groups)
    sessions = spark.createDataFrame([(s,) for s in [*names, "202411ab0x"]], "session string")
    one = spark.createDataFrame([(1, "jot-update-202411ab-turn(1)")], "id long, edit_history string")
    assert {r["session"] for r in evidence.wanted_sessions(one, sessions).collect()} == {"session-202411ab0", "session-202411ab1", "session-202411ab2", "202411ab0x"}


def test_containment_in_blocks_and_of_long_needles(spark, monkeypatch):
    draw = random.Random(3)
    text = lambda n: "".join(draw.choice("ab é😀") for _ in range(n))
    texts = [(k, text(draw.randrange(0, 60))) for k in range(200)] + [(900, None), (901, "")]
    needles = [(k, text(draw.randrange(0, 6))) for k in range(60)] + [(70, texts[3][1]), (71, None), (None, "a"), (72, texts[5][1] + "x")]
    want = {(k, i) for k, n in needles for i, t in texts if k is not None and n is not None and t is not None and n in t}
    docs, asked = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(needles, "query_id long, query string")
    for block, longest in ((1 << 20, 1 << 10), (40, 4)):
        monkeypatch.setattr(lexical, "_BLOCK_LETTERS", block)
        monkeypatch.setattr(lexical, "_NEEDLE_LETTERS", longest)
        got = lexical.containing(docs, asked)
        assert {tuple(r) for r in got.collect()} == want
    assert lexical.containing(docs, asked.where(F.col("query_id") < 0)).count() == 0


def test_blocks_of_vectors_do_not_depend_on_the_session(spark):
    import numpy as np

    from lodestone.operators import vectors

    rng = np.random.default_rng(1)
    rows = [(k, rng.standard_normal(4 + (k % 3 == 0)).tolist()) for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, vector array<double>").coalesce(1)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    counts = []
    settings = dict(spark.conf.getAll)
    for most in ("64", "10000"):
        spark.conf.set(key, most)
        counts.append(vectors._blocks(df).count())
    spark.conf.unset(key)
    assert counts == [3, 3]
    got = {(r["src"], r["dst"]) for r in vectors.similar_pairs(df.where("id < 300"), 0.9, 3).collect()}
    x = {k: np.array(v) / np.linalg.norm(v) for k, v in rows[:300]}
    for k in range(300):
        near = sorted((-(x[k] @ x[j]), j) for j in range(300) if j != k and len(x[j]) == len(x[k]) and x[k] @ x[j] >= 0.9)[:3]
        assert {j for _, j in near} == {j for s, j in got if s == k}
    assert dict(spark.conf.getAll) == settings


def test_many_frames_are_read_in_linear_time():
    import time

    import zstandard

    from lodestone.sources import logs

    packer = zstandard.ZstdCompressor()
    # A frame that isn't compressed holds the magic number as it is.
    one = [packer.compress(b'{"seq": %d}\n' % k) for k in range(8000)] + [packer.compress(b"\x00" + logs.MAGIC + bytes(range(200)))]
    data = b"".join(one) + logs.MAGIC + b"torn"
    began = time.time()
    found = list(logs.frames(data))
    assert time.time() - began < 2 and len(found) == 8001 and found[7] == b'{"seq": 7}\n' and logs.MAGIC in found[-1]
